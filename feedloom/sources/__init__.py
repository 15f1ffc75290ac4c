"""Readers: feed text, JSON Lines, snapshots, and views over stored tables."""
