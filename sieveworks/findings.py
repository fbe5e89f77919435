"""Findings and diagnoses as plain values."""

from __future__ import annotations

import math
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from .functions import vocab as V

AUTO, GATE, HUMAN = "AUTO", "GATE", "HUMAN"
_BREAKS = re.compile("[\n\r\t\v\f\x1c\x1d\x1e\x85\u2028\u2029]+")


def one_line(text: object) -> str:
    """A text without any character that ends a line; other spaces stay."""
    return _BREAKS.sub(" ", str(text)).strip()


def plain(value: Any) -> Any:
    """A value as JSON keeps it: finite floats of six places, sorted sets, strings for the rest."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [plain(v) for v in sorted(value, key=str)]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def shown(values, limit: int = 3, chars: int = 40) -> str:
    """At most three distinct values in repr form, cut to 40 characters."""
    return ", ".join(repr(str(v)[:chars]) for v in list(dict.fromkeys(str(v) for v in values))[:limit])


@dataclass
class Finding:
    disease: int
    slug: str
    columns: list[str]
    evidence: str
    stats: dict
    grade: str
    confidence: float
    indicator: bool

    def to_dict(self) -> dict:
        return asdict(self)


def finding(disease: int, columns: list[str], evidence: str, stats: dict, grade: str, confidence: float) -> Finding:
    return Finding(disease, V.SLUGS[disease], [str(c) for c in columns], one_line(evidence), plain(stats), grade, round(float(confidence), 3), disease in V.INDICATORS)


@dataclass
class Diagnosis:
    """What was found, what ran and stayed silent (clear), and what could not run (broken)."""

    findings: list[Finding] = field(default_factory=list)
    clear: list[int] = field(default_factory=list)
    broken: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"findings": [f.to_dict() for f in self.findings], "clear": self.clear, "broken": self.broken}
