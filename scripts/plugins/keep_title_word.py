"""Example external-command stage: keep JSONL items whose title contains a word."""

import json
import sys

word = sys.argv[1].lower() if len(sys.argv) > 1 else ""
for line in sys.stdin:
    if not line.strip():
        continue
    item = json.loads(line)
    if word in (item.get("title") or "").lower():
        sys.stdout.write(json.dumps(item, ensure_ascii=False) + "\n")
