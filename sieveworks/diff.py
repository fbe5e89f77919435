"""Showing a change so that only what moved is marked."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher

_PIECES = re.compile(r"\s+|\w+|[^\w\s]")
# Bounds of what is shown.
SAMPLES, MARKED, CONTEXT, BOUND = 3, 60, 24, 2000


def word_segments(before: str, after: str) -> list[tuple[str, str]]:
    """Runs of ("equal" | "delete" | "insert", text); runs of one kind are joined."""
    a, b = _PIECES.findall(str(before)), _PIECES.findall(str(after))
    out: list[tuple[str, str]] = []

    def put(kind: str, text: str) -> None:
        if text and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))

    for op, i, j, x, y in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            put("equal", "".join(a[i:j]))
        else:
            put("delete", "".join(a[i:j]))
            put("insert", "".join(b[x:y]))
    return out


def marked(kind: str, text: str) -> str:
    return {"equal": "{}", "delete": "[-{}-]", "insert": "{{+{}+}}"}[kind].format(text)


def inline(before: str, after: str) -> str:
    return "".join(marked(kind, text) for kind, text in word_segments(before, after))


def _short(kind: str, text: str) -> str:
    if kind == "equal":
        return text if len(text) <= CONTEXT else f"{text[:11]}…{text[-11:]}"
    return marked(kind, text if len(text) <= MARKED else text[: MARKED - 1] + "…")


def change_line(before: object, after: object) -> str:
    """A change on one bounded line; what lies beyond the bound is said."""
    a, b = (" ".join(str(x).splitlines()) for x in (before, after))
    runs = word_segments(a[:BOUND], b[:BOUND])
    hidden = a != b and all(kind == "equal" for kind, _ in runs)
    return "".join(_short(*r) for r in runs) + " ⋯ (change beyond preview bound)" * hidden


def column_change(name: str, changed: int, total: int, samples: Iterable[tuple], untouched: Iterable[str] = (), limit: int = SAMPLES) -> str:
    lines = [f"{name}: {changed:,} of {total:,} cells change"]
    shown = 0
    for before, after in samples:
        shown += 1
        line = f"  {change_line(before, after)}"
        if line not in lines:
            lines.append(line)
        if shown >= limit:
            break
    if changed > shown:
        lines.append(f"  … {changed - shown:,} more")
    if rest := len(list(untouched)):
        lines.append(f"  {rest} columns untouched")
    return "\n".join(lines)
