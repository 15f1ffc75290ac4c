"""Structured Streaming jobs: JSONL ingest, stateful comment delta and a
first-arrival-wins dedup archive."""
