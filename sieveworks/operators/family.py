"""File families: one schema for all slices, then one table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .verify import family_problem, quoted


def harmonize(tables: Mapping[str, DataFrame], mapping: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, DataFrame]:
    """Every slice with the columns of all: renamed by its mapping, missing ones null, of one type, in one order.

    Types that differ become double if all are numbers, else string. Rows and values are never lost; a
    mapping that would merge two columns of a slice is an error.
    """
    renamed = {}
    for name, df in tables.items():
        own = dict((mapping or {}).get(name, {}))
        columns = [own.get(c, c) for c in df.columns]
        if len(set(columns)) < len(columns):
            raise ValueError(f"{name}: the mapping gives two columns one name")
        renamed[name] = df.toDF(*columns)
    kinds: dict[str, set[str]] = {}
    for df in renamed.values():
        for c, t in df.dtypes:
            kinds.setdefault(c, set()).add(t)
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    common = {c: next(iter(t)) if len(t) == 1 else "double" if t <= numbers else "string" for c, t in kinds.items()}
    out = {n: df.select(*((quoted(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in common.items())) for n, df in renamed.items()}
    if why := family_problem(tables, out):
        raise ValueError(f"harmonising is refused: {why}")
    return out


def stacked(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Harmonised slices as one table with the slice's name in _slice."""
    parts = [df.withColumn("_slice", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def slice_variable(name: str, key: str) -> str:
    """A variable name of its own for each slice: cleaned up, with a digest of the exact key."""
    return re.sub(r"\W+", "_", f"{name}_{key}").strip("_") + "_" + hashlib.sha256(key.encode()).hexdigest()[:6]
