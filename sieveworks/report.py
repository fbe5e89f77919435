"""Diagnoses and cleanings as text, JSON and HTML."""

from __future__ import annotations

import html
import json

from .findings import Diagnosis, Finding
from .functions import vocab as V

MEANING = {"AUTO": "can be repaired unattended", "GATE": "repair with a person's check", "HUMAN": "needs a person's judgement"}
COLOURS = {"AUTO": "#2e7d32", "GATE": "#b8860b", "HUMAN": "#b3261e"}


def ranges(ids: list[int]) -> str:
    """Numbers as compact ranges: 1-3, 5."""
    out: list[list[int]] = []
    for i in sorted(ids):
        if out and i == out[-1][1] + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return ", ".join(f"{a}-{b}" if a != b else str(a) for a, b in out) or "none"


def where(f: Finding | dict) -> str:
    return ", ".join(f["columns"] if isinstance(f, dict) else f.columns) or "whole table"


class Report:
    """A diagnosis with its table: prints for people, serialises for machines."""

    def __init__(self, frame, result: Diagnosis, name: str = "dataframe", notes: dict | None = None):
        self.frame, self.result, self.name, self.notes = frame, result, name, notes or {}
        self._rows: int | None = None

    @property
    def findings(self) -> list[dict]:
        return [f.to_dict() for f in self.result.findings]

    @property
    def clear(self) -> list[int]:
        return self.result.clear

    @property
    def broken(self) -> dict[str, str]:
        return self.result.broken

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.frame.count()
        return self._rows

    def to_dict(self) -> dict:
        return {"name": self.name, "rows": self.rows, "columns": len(self.frame.columns), **self.result.to_dict()}

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent)

    def findings_df(self, spark=None):
        """The findings as a small DataFrame; stats as JSON."""
        spark = spark or self.frame.sparkSession
        rows = [(f.disease, f.slug, f.columns, f.grade, f.confidence, f.indicator, f.evidence, json.dumps(f.stats)) for f in self.result.findings]
        return spark.createDataFrame(rows, "disease int, slug string, columns array<string>, grade string, confidence double, indicator boolean, evidence string, stats string")

    def __repr__(self) -> str:
        fixable = [f for f in self.result.findings if not f.indicator]
        flagged = [f for f in self.result.findings if f.indicator]
        lines = [f"{self.name}: {self.rows:,} rows x {len(self.frame.columns)} columns", ""]
        if self.notes.get("encoding", "utf-8") != "utf-8":
            lines += [f"  ! not UTF-8: read as {self.notes['encoding']}; check that accents survived", ""]
        lines += [f"  {len(fixable)} to repair, {len(flagged)} flagged, {len(self.clear)} checks clear" + f", {len(self.broken)} could not run" * bool(self.broken), ""]
        for f in fixable:
            lines += [f"  d{f.disease:02d}  {f.slug}  [{where(f)}]", f"        {f.evidence}", f"        {MEANING[f.grade]}, confidence {f.confidence:.2f}", ""]
        for f in flagged:
            lines += [f"  !  d{f.disease:02d}  {f.slug}  [{where(f)}]: flagged, never repaired unattended", f"        {f.evidence}", ""]
        for disease, why in sorted(self.broken.items(), key=lambda x: int(x[0])):
            lines += [f"  x  d{int(disease):02d}  did not run: {why}", ""]
        lines += ["  nothing found", ""] * (not self.result.findings)
        return "\n".join([*lines, f"  checked and clear: {ranges(self.clear)} (of {len(V.SINGLE_TABLE)} checks that every table gets)"])

    def _repr_html_(self) -> str:
        cards = "".join(card(f"d{f.disease:02d} {f.slug}", where(f), f.evidence, COLOURS[f.grade], MEANING[f.grade]) for f in self.result.findings)
        head = f"{self.name}: {self.rows:,} rows, {len(self.result.findings)} findings, {len(self.clear)} checks clear"
        return f"<div><h3>{html.escape(head)}</h3>{cards}<p>clear: {html.escape(ranges(self.clear))}</p></div>"

    def plot(self, ax=None):
        """Findings per column as bars in the colour of the gravest grade (needs matplotlib)."""
        import matplotlib.pyplot as plt

        ax = ax or plt.subplots()[1]
        places: dict[str, list[Finding]] = {}
        for f in self.result.findings:
            for c in f.columns or ["whole table"]:
                places.setdefault(c, []).append(f)
        order = sorted(places, key=lambda c: len(places[c]))
        ax.barh(order, [len(places[c]) for c in order], color=[COLOURS[max((f.grade for f in places[c]), key=list(COLOURS).index)] for c in order])
        ax.set_title(f"{self.name}: {len(self.result.findings)} findings, {len(self.clear)} checks clear")
        return ax


def card(title: str, place: str, text: str, colour: str, note: str) -> str:
    title, place, text, note = map(html.escape, (title, place, text, note))
    return f'<div style="border-left:4px solid {colour};padding:4px 10px;margin:6px 0"><b>{title}</b> <code>{place}</code><br>{text}<br><small>{note}</small></div>'


def clean_html(summary) -> str:
    parts = []
    for s in summary.samples():
        lines = [f"{x['column']}: removed" if x.get("removed") else f"{x['column']}: {x['old']!r} → {x['new']!r}" for x in s["examples"]]
        parts.append(card(f"d{s['disease']:02d} {s['slug']}", where(s), "; ".join(lines), COLOURS["AUTO"], "repaired and verified"))
    parts += [card(f"d{r['disease']:02d} {r['slug']}", where(r), r.get("reason", ""), COLOURS[r["grade"]], MEANING[r["grade"]]) for r in summary.needs_review]
    return f"<div>{''.join(parts)}</div>"
