"""Plain functions for tool servers: results and errors are dictionaries, sessions idle out."""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from ..api import diagnose
from .session import Session, by_policy, run_clean_once

IDLE_S = 30 * 60
_OPEN: dict[str, tuple[Session, float]] = {}


def tool(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(*args, **kwargs) -> dict:
        for key, (_, used) in list(_OPEN.items()):
            if time.monotonic() - used > IDLE_S:
                del _OPEN[key]
        try:
            return f(*args, **kwargs)
        except Exception as e:  # noqa: BLE001 - a tool's error is its result
            return {"error": f"{type(e).__name__}: {e}"}

    return run


def _session(key: str) -> Session:
    if key not in _OPEN:
        raise KeyError(f"no open session {key!r}")
    session, _ = _OPEN[key]
    _OPEN[key] = (session, time.monotonic())
    return session


@tool
def diagnose_file(path: str) -> dict:
    return diagnose(path).to_dict()


@tool
def clean_file(path: str, policy: str = "auto", workspace: str = "workspace") -> dict:
    return run_clean_once(Session(workspace), path, policy=policy)


@tool
def open_data(path: str, name: str | None = None, workspace: str = "workspace", generate=None, allow_code: bool = False) -> dict:
    session = Session(workspace, generate, allow_code=allow_code)
    df = session.load(path, name)
    key = uuid.uuid4().hex[:12]
    _OPEN[key] = (session, time.monotonic())
    return {"session": key, "variable": session.datasets[-1]["variable"], "columns": df.columns}


@tool
def ask(session: str, question: str, policy: str = "all") -> dict:
    card = _session(session).ask(question, by_policy(policy))
    return {"card": card.card_id, "answer": card.answer, "checks": card.checks, "flags": card.flags}


@tool
def why(session: str, claim: str | None = None) -> dict:
    return {"provenance": _session(session).why(claim)}


@tool
def close_session(session: str) -> dict:
    closed = _session(session)
    del _OPEN[session]
    return {"closed": session, "folder": str(Path(closed.folder))}
