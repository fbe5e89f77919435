"""The library's front: read, diagnose, clean, write, and ``df.sieve`` on DataFrames."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .operators.detect import detect_all, detect_one
from .operators.repair import CleanSummary, clean
from .operators.row_checks import detect_family
from .profile import profile_df
from .report import Report
from .sources.readers import NOTES, read
from .sources.readers import read_sql as _read_sql
from .sources.writers import write

__all__ = ["CleanSummary", "Report", "clean", "detect_all", "detect_family", "detect_one", "diagnose", "profile_df", "read", "read_sql", "write"]


def diagnose(data: Any, name: str | None = None, **options) -> Report:
    """All checks over a DataFrame, or over what ``read`` makes of a path, URL or connection."""
    df = data if isinstance(data, DataFrame) else read(data, **options)
    label = name or (Path(str(data)).name if isinstance(data, (str, os.PathLike)) else "dataframe")
    return Report(df, detect_all(df, label), label, getattr(df, NOTES, None))


def read_sql(query: str, connection: Any) -> DataFrame:
    """A query's result; connection is a DBAPI connection or a database URL."""
    return _read_sql(connection, query)


class Accessor:
    def __init__(self, df: DataFrame):
        self._df = df

    def diagnose(self, name: str = "dataframe") -> Report:
        return diagnose(self._df, name)

    def clean(self, policy: str = "auto") -> tuple[DataFrame, CleanSummary]:
        return clean(self._df, policy)


def attach() -> None:
    """Puts the accessor on DataFrames, unless the name is taken."""
    for kind in {DataFrame, *DataFrame.__subclasses__()}:
        if not hasattr(kind, "sieve"):
            kind.sieve = property(Accessor)
