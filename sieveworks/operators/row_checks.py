"""Checks 9 to 12, 18 and 20: rows, keys, fields against fields, headers and file families."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..findings import AUTO, GATE, HUMAN, Finding, finding
from ..functions import text as X
from ..functions import vocab as V
from ..plans.measures import Measures
from .registry import check

# The limits of the checks.
FD_PAIRS, FD_PAIRS_LARGE, FD_LARGE_ROWS = 200, 16, 20_000
FD_DETERMINANTS, FD_DEPENDENTS = 12, 20
HEADER_ROWS = 200
#: Columns, those of most values, that may already tell all rows apart.
NEAR_COLUMNS = 6


def distinct_rows(df: DataFrame, columns: list) -> int:
    """Distinct rows by two 64-bit hashes of the cells' hashes, in which a null has its place; 16 bytes a row are shuffled."""
    cells = df.select(F.array(*(F.xxhash64(c) for c in columns)).alias("cells"))
    return cells.select(F.xxhash64("cells").alias("a"), F.xxhash64(F.lit(1), "cells").alias("b")).distinct().count()


def exact_repeats(m: Measures) -> int:
    with m.lock:
        if "repeats" not in m.__dict__:
            m.repeats = m.table.rows - distinct_rows(m.table.df, [F.col(f"c{k}") for k in range(m.table.width)])
        return m.repeats


@check(9)
def duplicate_rows(m: Measures, cols: list[int]) -> list[Finding]:
    count = exact_repeats(m)
    if not count:
        return []
    return [finding(9, [], f"{count} of {m.table.rows} rows repeat an earlier row exactly", {"dup_rows": count, "dup_count": count, "rows": m.table.rows}, AUTO, 1.0)]


@check(10)
def near_duplicate_rows(m: Measures, cols: list[int]) -> list[Finding]:
    texts = m.table.of_kind("text")
    if not texts:
        return []
    foreign = any(m.text[k]["foreign"] for k in texts)
    fold = X.folded_any if foreign else X.folded
    exact = exact_repeats(m)
    folded = lambda ks: [fold(F.col(f"c{k}")) if k in texts else F.col(f"c{k}") for k in ks]
    telling = sorted(range(m.table.width), key=lambda k: -m.about(k))[:NEAR_COLUMNS]
    if len(telling) < m.table.width and distinct_rows(m.table.df, folded(telling)) == m.table.rows - exact:
        return []  # rows that differ in some folded columns differ in all
    near = m.table.rows - distinct_rows(m.table.df, folded(range(m.table.width))) - exact
    if near <= 0:
        return []
    said = f"{near} rows repeat another row once case, white space and compatibility forms are folded"
    return [finding(10, [], said, {"near_dup_rows": near, "pair_count": near, "exact_dup_rows": exact}, HUMAN, 0.8)]


@check(11)
def key_violations(m: Measures, cols: list[int]) -> list[Finding]:
    out, rows, table = [], m.table.rows, m.table
    if rows < 20 or table.width < 2:
        return out
    for k in cols:
        distinct = m.distinct(k) if 0.9 * rows <= m.about(k) <= 1.1 * rows else 0
        if distinct < 20 or not 0.995 <= distinct / rows < 1:
            continue
        key, others = F.col(f"c{k}"), [i for i in range(table.width) if i != k]
        doubled = table.df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")
        held = table.df.join(doubled, key == F.col("key"), "left_semi")  # a few thousandths of the rows
        hashed = [F.when(F.col(f"c{i}").isNotNull(), F.xxhash64(f"c{i}")).alias(f"h{i}") for i in others]
        spread = held.select(key.alias("key"), *hashed).groupBy("key").agg(*((F.min(f"h{i}") != F.max(f"h{i}")).alias(f"d{i}") for i in others))
        any_ = F.lit(False)
        for i in others:
            any_ = any_ | F.coalesce(F.col(f"d{i}"), F.lit(False))
        r = spread.agg(F.count_if(any_).alias("bad"), *(F.max(f"d{i}").alias(f"d{i}") for i in others)).first()
        if not r.bad:
            continue
        columns = [table.names[i] for i in others if r[f"d{i}"]]
        said = f"{table.names[k]} is a key in all but name ({distinct / rows:.1%} of its values differ), yet {r.bad} of them have rows that disagree in {', '.join(columns[:3])}"
        out.append(finding(11, [table.names[k], *columns], said, {"key": table.names[k], "uniqueness": distinct / rows, "contradicted_keys": r.bad, "attributes": columns[:8]}, HUMAN, 0.85))
    return out


@check(12)
def field_contradictions(m: Measures, cols: list[int]) -> list[Finding]:
    """A null or blank on either side of a pair takes no part."""
    table, rows = m.table, m.table.rows
    if rows < 40 or table.width < 2:
        return []
    limit = max(50, rows / 5)
    sizes = sorted((m.distinct(k), k) for k in cols if m.about(k) <= 1.1 * limit)
    determinants = [k for n, k in sizes if 2 <= n <= limit][:FD_DETERMINANTS]
    pairs = [(i, j) for i in determinants for j in range(min(table.width, FD_DEPENDENTS)) if i != j][: FD_PAIRS if rows <= FD_LARGE_ROWS else FD_PAIRS_LARGE]
    if not pairs:
        return []

    def side(k: int, tokens: bool):
        c = F.col(f"c{k}")
        if table.kinds[k] != "text":
            return F.when(c.isNotNull(), F.xxhash64(c))
        stripped = X.trimmed(c)
        return F.when((stripped != "") & ~X.is_token(stripped) if tokens else stripped != "", F.xxhash64(stripped))

    left = {i: side(i, True).alias(f"x{i}") for i in {i for i, _ in pairs}}
    right = {j: side(j, False).alias(f"y{j}") for j in {j for _, j in pairs}}
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("pair"), F.col(f"x{i}").alias("x"), F.col(f"y{j}").alias("y")) for n, (i, j) in enumerate(pairs))))
    met = table.df.select(*left.values(), *right.values()).select(cells.alias("c")).select("c.*").where("x is not null and y is not null")
    groups = met.groupBy("pair", "x", "y").agg(F.count("*").alias("n")).groupBy("pair", "x").agg(F.sum("n").alias("size"), F.max("n").alias("modal"))
    dissent = (F.col("size") >= 4) & (F.col("modal") >= 0.6 * F.col("size")) & (F.col("modal") < F.col("size"))
    found = groups.groupBy("pair").agg(F.sum("size").alias("live"), F.sum("modal").alias("modal"), F.count_if(dissent).alias("bad"), F.count("*").alias("groups")).orderBy("pair").collect()
    best: dict[str, tuple] = {}
    for r in found:
        conf = r.modal / r.live
        if r.live >= 40 and conf < 1 and (conf >= 0.98 and r.bad >= 1 or conf >= 0.85 and r.bad >= 5):
            name = table.names[pairs[r.pair][1]]
            if name not in best or conf > best[name][0]:
                best[name] = (conf, table.names[pairs[r.pair][0]], r.bad, r.groups)
    said = "{} decides {} in {:.1%} of the rows, but {} of its {} groups have a dissenting minority, so one side is wrong there"
    top = sorted(best.items(), key=lambda x: -x[1][0])[:5]
    return [finding(12, [a, b], said.format(a, b, conf, bad, n), {"determinant": a, "dependent": b, "confidence": conf, "violating_groups": bad, "groups": n}, HUMAN, conf) for b, (conf, a, bad, n) in top]


@check(18)
def header_damage(m: Measures, cols: list[int]) -> list[Finding]:
    names = m.table.names
    marked = [n for n in names if any(z in n for z in V.ZERO_WIDTH_IN_NAMES)]
    times = Counter(names)
    doubled = sum(n - 1 for n in times.values())
    unnamed = [n for n in names if n.startswith("Unnamed:") or not n.strip()]
    repeated = 0
    if set(m.table.kinds) == {"text"}:
        repeated = sum(list(r) == names for r in m.table.first.select(*(f"c{k}" for k in range(m.table.width))).take(HEADER_ROWS))
    if not (marked or doubled or unnamed or repeated):
        return []
    counts = ((len(marked), "column names with a zero-width mark"), (doubled, "repeated column names"), (len(unnamed), "columns without a name"), (repeated, "data rows that repeat the header"))
    affected = {*marked, *unnamed, *(n for n in names if times[n] > 1)}
    return [finding(18, sorted(affected), "; ".join(f"{n} {what}" for n, what in counts if n), {"bom_columns": len(marked), "duplicate_columns": doubled, "unnamed_columns": len(unnamed), "header_rows": repeated}, AUTO, 0.98)]


def detect_family(tables: Mapping[str, DataFrame]) -> list[Finding]:
    """Schema drift of each table of a family against its first; reads schemas only."""
    out = []
    (base, first), *rest = tables.items() if tables else ((None, None),)
    for other, df in rest:
        a, b = first.columns, df.columns
        kinds_a, kinds_b = dict(first.dtypes), dict(df.dtypes)
        only_a, only_b = [c for c in a if c not in b], [c for c in b if c not in a]
        shared = [c for c in a if c in b]
        changed = {c: [kinds_a[c], kinds_b[c]] for c in shared if kinds_a[c] != kinds_b[c]}
        moved = [c for c in shared if a.index(c) != b.index(c)]
        if not (only_a or only_b or changed):
            continue
        parts = [f"{len(only)} columns only in {name} ({', '.join(only[:3])})" for only, name in ((only_a, base), (only_b, other)) if only]
        parts += [f"{len(changed)} columns of another type"] * bool(changed)
        stats = {"files": [base, other], "only_in_a": only_a, "only_in_b": only_b, "dtype_changes": changed, "reordered": moved}
        out.append(finding(20, sorted({*only_a, *only_b, *changed}), f"{base} and {other}: " + "; ".join(parts), stats, GATE, 0.95))
    return out
