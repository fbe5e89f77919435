"""Proof that a change did what it should and no more: baselines, invariants, cases, scores."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..findings import Finding

# Rows that repairs of a check may remove, exactly or at most.
ROWS_EXACT = {9: "dup_count", 21: "rollup_count"}
ROWS_AT_MOST = {10: "pair_count"}
PREVIEW_ROWS = 200
CASE_SICK, CASE_HEALTHY = 150, 50


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hashable(c: Column, t: T.DataType) -> Column:
    return F.to_json(c) if isinstance(t, (T.MapType, T.VariantType)) else c


@dataclass(frozen=True)
class Baseline:
    """The rows of a table and a hash of each column that does not depend on row order."""

    rows: int
    hashes: dict[str, int]


def baseline(df: DataFrame) -> Baseline:
    """One aggregation: sums of 64-bit hashes, in which nulls count, as decimals that cannot overflow."""
    names = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(names))))
    one = lambda i: hashable(F.col(f"c{i}"), df.schema.fields[i].dataType)
    sums = [F.sum(F.xxhash64(one(i), F.col(f"c{i}").isNull()).cast("decimal(38,0)")).alias(f"h{i}") for i in range(len(names))]
    r = flat.agg(F.count("*").alias("rows"), *sums).first()
    return Baseline(r.rows, {n: int(r[f"h{i}"] or 0) for i, n in enumerate(names)})


def rows_allowed(f: Finding, before: int, after: int) -> bool:
    """Whether a repair of a finding may lead from one row count to the other."""
    if f.disease in ROWS_EXACT:
        return after == before - int(f.stats.get(ROWS_EXACT[f.disease], 0))
    if f.disease in ROWS_AT_MOST:
        return before - int(f.stats.get(ROWS_AT_MOST[f.disease], 0)) <= after <= before
    return after == before


def verify(before: DataFrame, after: DataFrame, f: Finding) -> tuple[bool, str]:
    """Whether a repair is proven: silent check, allowed row count, untouched columns; and why not.

    A check that breaks proves nothing: the reason then starts with "uncheckable:".
    """
    from ..functions.text import tidy_spaces
    from .detect import detect_one

    try:
        left = detect_one(after, f.disease, f.columns)
    except Exception as e:  # noqa: BLE001
        return False, f"uncheckable: {type(e).__name__}: {e}"
    if left is not None:
        return False, f"the check still fires: {left.evidence}"
    old, new = baseline(before), baseline(after)
    if not rows_allowed(f, old.rows, new.rows):
        return False, f"row count changed from {old.rows} to {new.rows}"
    if old.rows == new.rows:
        moved = [c for c in old.hashes if c not in f.columns and old.hashes[c] != new.hashes.get(c)]
        if moved:
            return False, f"untouched columns changed: {', '.join(moved)}"
    if f.disease == 6:
        want = baseline(before.select(*(tidy_spaces(quoted(c)).alias(c) for c in f.columns))).hashes
        if any(new.hashes.get(c) != want[c] for c in f.columns):
            return False, "the text is not what tidying white space alone gives"
    return True, ""


# What previewed code may import and must not call.
IMPORTS = {"pandas", "numpy", "re", "math", "datetime", "json", "unicodedata", "string", "collections", "itertools", "functools", "pyspark"}
FORBIDDEN = {"open", "exec", "eval", "compile", "__import__", "input", "breakpoint"}
FORBIDDEN_ATTRIBUTES = {"write", "writeTo", "writeStream", "collect", "toPandas", "sparkContext", "_jvm", "_jsparkSession", "_jdf", "sparkSession"}


def screen(source: str) -> list[str]:
    """What speaks against running code: imports, calls and attributes that are not allowed."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax error: {e.msg}"]
    bad = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            bad += [f"import {a.name}" for a in node.names if a.name.split(".")[0] not in IMPORTS]
        elif isinstance(node, ast.ImportFrom) and (node.level or (node.module or "").split(".")[0] not in IMPORTS):
            bad.append(f"import {node.module}")
        elif isinstance(node, ast.Name) and (node.id in FORBIDDEN or node.id.startswith("__")):
            bad.append(node.id)
        elif isinstance(node, ast.Attribute) and (node.attr in FORBIDDEN_ATTRIBUTES or node.attr.startswith("__")):
            bad.append(f".{node.attr}")
    return bad


def preview(before: DataFrame, fix: Callable[[DataFrame], DataFrame], rows: int = PREVIEW_ROWS) -> str:
    """What a repair would do to the first rows: changed cells a column with samples, types, rows, dropped columns."""
    from ..diff import column_change

    head = before.limit(rows)
    old = head.toPandas()
    try:
        frame = head.sparkSession.createDataFrame(head.collect(), head.schema)
        after = fix(frame)
        new = after.toPandas()
    except Exception as e:  # noqa: BLE001
        return f"(no preview: {type(e).__name__}: {e})"
    lines = [f"preview of {len(old)} rows"]
    if len(new) != len(old):
        return "\n".join([*lines, f"rows: {len(old)} -> {len(new)}"])
    same = []
    for c in old.columns:
        if c not in new.columns:
            lines.append(f"column dropped: {c!r}")
            continue
        pairs = [(a, b) for a, b in zip(old[c], new[c]) if str(a) != str(b)]
        if pairs:
            lines.append(column_change(c, len(pairs), len(old), pairs))
        else:
            same.append(c)
        if before.schema[c].dataType != after.schema[c].dataType:
            lines.append(f"type of {c!r}: {before.schema[c].dataType.simpleString()} -> {after.schema[c].dataType.simpleString()}")
    lines += [f"column added: {c!r}" for c in new.columns if c not in old.columns]
    return "\n".join(lines + [f"{len(same)} columns untouched"])


def frozen_case(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that a repair changed and rows that it left, as they were: at most 150 and 50."""
    from .repair import aligned

    shared = [c for c in columns if c in before.columns and c in after.columns]
    if not shared:
        return before.limit(CASE_SICK + CASE_HEALTHY)
    marked = before if "__row" in before.columns else before.withColumn("__row", F.monotonically_increasing_id())
    changed = F.lit(False)
    for i in range(len(shared)):
        changed = changed | ~F.col(f"a{i}").cast("string").eqNullSafe(F.col(f"b{i}").cast("string"))
    pairs = aligned(marked, after if "__row" in after.columns else after.withColumn("__row", F.monotonically_increasing_id()), shared).select("_rid", changed.alias("sick"))
    picked = pairs.where("sick").orderBy("_rid").limit(CASE_SICK).unionByName(pairs.where("not sick").orderBy("_rid").limit(CASE_HEALTHY))
    return marked.join(F.broadcast(picked), F.col("__row") == F.col("_rid"), "left_semi").orderBy("__row").drop("__row")


def admissible(case: DataFrame, fix: Callable[[DataFrame, list[str]], DataFrame], disease: int, columns: list[str]) -> tuple[bool, str]:
    """Whether a general repair earns its place on the case it came from."""
    from .detect import detect_one

    found = detect_one(case, disease, columns)
    if found is None:
        return False, "the case does not show the finding"
    try:
        after = fix(case, columns)
        return verify(case, after, found)
    except Exception as e:  # noqa: BLE001
        return False, f"{type(e).__name__}: {e}"


def family_problem(before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> str | None:
    """Why harmonised tables cannot be trusted: other columns among them, lost rows, or lost values. None if they can."""
    if before.keys() != after.keys():
        return "tables are missing or new"
    columns = [df.columns for df in after.values()]
    if any(set(c) != set(columns[0]) for c in columns):
        return "the tables do not have the same columns"
    for name, old in before.items():
        count = lambda df: df.agg(F.count("*").alias("rows"), *(F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
        a, b = count(old), count(after[name])
        if a.rows != b.rows:
            return f"{name}: {a.rows} rows became {b.rows}"
        if sum(b[1:]) < sum(a[1:]):
            return f"{name}: {sum(a[1:]) - sum(b[1:])} values were lost"
    return None


def score(dirty: DataFrame, cleaned: DataFrame, truth: DataFrame, key: str) -> dict[str, float]:
    """Cell precision, recall and F1 of a cleaning against the truth, on shared columns, rows matched by a key.

    Cells are compared as stripped text; plain numbers by value, but leading zeros count; nulls are equal.
    """
    shared = [c for c in dirty.columns if c in cleaned.columns and c in truth.columns and c != key]

    def canonical(c: Column) -> Column:
        t = F.trim(c.cast("string"))
        number = t.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?$")
        return F.when(t == "", None).otherwise(F.when(number, t.try_cast("double").cast("string")).otherwise(t))

    sides = [df.select(quoted(key).alias("k"), *(canonical(quoted(c)).alias(f"{tag}{i}") for i, c in enumerate(shared))) for tag, df in (("d", dirty), ("c", cleaned), ("t", truth))]
    rows = sides[0].join(sides[1], "k").join(sides[2], "k")
    zero = F.lit(0)
    changed, right, wrong = zero, zero, zero
    for i in range(len(shared)):
        moved = (~F.col(f"d{i}").eqNullSafe(F.col(f"c{i}"))).cast("int")
        true = F.col(f"c{i}").eqNullSafe(F.col(f"t{i}")).cast("int")
        changed, right, wrong = changed + moved, right + moved * true, wrong + (~F.col(f"d{i}").eqNullSafe(F.col(f"t{i}"))).cast("int")
    r = rows.agg(F.sum(changed).alias("changed"), F.sum(right).alias("right"), F.sum(wrong).alias("wrong")).first()
    precision = r.right / r.changed if r.changed else 1.0
    recall = r.right / r.wrong if r.wrong else 1.0
    return {"changed": r.changed or 0, "correct": r.right or 0, "errors": r.wrong or 0, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0}
