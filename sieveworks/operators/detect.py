"""Running the checks over a table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from ..findings import Diagnosis, Finding, one_line
from ..functions import vocab as V
from ..plans.boundary import Table
from ..plans.measures import Measures
from . import number_checks, row_checks, text_checks  # noqa: F401
from .registry import BY_COLUMN, CHECKS

#: Checks that run at once, and those that start first.
AT_ONCE = 4
LONG_CHECKS = (9, 10, 12, 15, 7)


def detect_all(df: DataFrame, name: str = "dataframe") -> Diagnosis:
    """All checks of one table: findings, and which checks were silent and which could not run."""
    table = Table(df, name)
    if not table.width or not table.rows:
        return Diagnosis(clear=list(V.SINGLE_TABLE))
    out, m = Diagnosis(), Measures(table)
    everything = list(range(table.width))

    def run(disease: int) -> tuple[list[Finding], str]:
        try:
            return CHECKS[disease](m, everything), ""
        except Exception as e:  # noqa: BLE001 - a check that breaks must not stop the others, and must not look clear
            return [], one_line(f"{type(e).__name__}: {e}")[:240]

    try:
        # most checks wait on small jobs; side by side they fill the cores. Long ones start first
        with ThreadPoolExecutor(AT_ONCE) as pool:
            jobs = {d: pool.submit(run, d) for d in sorted(V.SINGLE_TABLE, key=lambda d: (d not in LONG_CHECKS, d))}
        for disease in V.SINGLE_TABLE:
            found, why = jobs[disease].result()
            out.findings += found
            if why:
                out.broken[str(disease)] = why
    finally:
        m.release()
    out.findings.sort(key=lambda f: (f.disease, f.columns))
    found = {f.disease for f in out.findings}
    out.clear = [d for d in V.SINGLE_TABLE if d not in found and str(d) not in out.broken]
    return out


def check_columns(df: DataFrame, disease: int, columns: list[str] | None) -> list[Finding]:
    """One check on some columns: all its findings. A break is raised.

    Columns that are all gone put every column in scope, so a dropped column is a cleared finding.
    """
    if disease not in CHECKS:
        raise ValueError(f"{disease} is no check of a single table; there are {sorted(CHECKS)}")
    table = Table(df)
    if not table.width or not table.rows:
        return []
    scope = table.places(columns) or list(range(table.width))
    if disease in BY_COLUMN and len(scope) < table.width:
        cut = df.toDF(*(f"c{i}" for i in range(table.width))).select(*(f"c{i}" for i in scope)).toDF(*(table.names[i] for i in scope))
        rows, table = table.rows, Table(cut)
        table.rows = rows
        scope = list(range(table.width))
    m = Measures(table)
    try:
        return CHECKS[disease](m, scope)
    finally:
        m.release()


def detect_one(df: DataFrame, disease: int, columns: list[str] | None) -> Finding | None:
    """One check again, on some columns: its first finding for exactly these columns."""
    return next((f for f in check_columns(df, disease, columns) if f.columns == [str(c) for c in columns or ()]), None)
