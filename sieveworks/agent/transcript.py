"""The append-only log of a session: one JSON event a line, numbered on across reopening."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

# Kinds of events.
KINDS = ("session_meta", "user", "model", "gate", "exec", "card")


class Transcript:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.last = max((e["ev_id"] for e in self.events()), default=0)

    def append(self, kind: str, **payload) -> int:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event {kind!r}; there are {', '.join(KINDS)}")
        self.last += 1
        event = {"ev_id": self.last, "t": datetime.now(timezone.utc).isoformat(), "kind": kind, **payload}
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(event, default=str) + "\n")
        return self.last

    def events(self) -> list[dict]:
        return [json.loads(line) for line in self.path.read_text("utf-8").splitlines()] if self.path.exists() else []
