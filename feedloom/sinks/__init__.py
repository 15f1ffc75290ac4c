"""Writers: RSS/Atom, JSON/JSON Lines, Markdown digest, lint report,
outbox and state tables, archive, explain records."""
