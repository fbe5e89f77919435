"""Checks 13 to 16, 19 and 22: ranges, coordinates, outliers, units, empty columns and ids."""

from __future__ import annotations

import math
import re
from statistics import median

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..findings import AUTO, GATE, HUMAN, Finding, finding, shown
from ..functions import text as X
from ..functions import vocab as V
from ..plans.measures import Measures, _each
from .registry import check

#: Positive values of a column that decide whether it has two bands.
BAND_ROWS = 20_000


def numbers(m: Measures, cols: list[int], least: int):
    for k in cols:
        if m.table.kinds[k] == "number" and m.plain[k]["values"] >= least:
            yield k, m.table.names[k], m.plain[k]


def first_values(m: Measures, k: int, cond) -> list:
    """The first distinct values of a column that meet a condition."""
    c = F.col(f"c{k}")
    return [r.v for r in m.table.df.where(cond).groupBy(c.alias("v")).agg(F.min("_rid").alias("first")).orderBy("first").limit(3).collect()]


@check(13)
def out_of_domain(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, p in numbers(m, cols, 5):
        bounds = next(((lo, hi) for pattern, lo, hi in V.DOMAINS if re.search(pattern, m.table.key(k))), None)
        if not bounds or bounds[0] <= p["min"] and p["max"] <= bounds[1]:
            continue
        low, high = bounds
        bad = (F.col(f"c{k}").cast("double") < low) | (F.col(f"c{k}").cast("double") > high)
        count = m.table.df.where(bad).count()
        said = f"{count} values are outside [{low:g}, {high:g}], the range that the column's name implies, such as {shown(first_values(m, k, bad))}"
        out.append(finding(13, [name], said, {"violations": count, "low": low, "high": None if math.isinf(high) else high, "min": p["min"], "max": p["max"]}, GATE, 0.9))
    return out


@check(14)
def coordinates(m: Measures, cols: list[int]) -> list[Finding]:
    named = lambda pattern: [k for k in cols if m.table.kinds[k] == "number" and re.search(pattern, m.table.key(k))]
    lats, lons = named(V.LAT_NAME), named(V.LON_NAME)
    if not lats or not lons:
        return []
    lat, lon = F.col(f"c{lats[0]}").cast("double"), F.col(f"c{lons[0]}").cast("double")
    within = lambda a, b, c, d: F.coalesce(lat.between(a, b) & lon.between(c, d), F.lit(False))
    r = m.table.df.agg(
        F.count_if((lat == 0) & (lon == 0)).alias("zero"),
        F.count_if(~within(-90, 90, -180, 180)).alias("out"),  # a missing coordinate counts
        F.count_if(within(*V.REGION["lat"], *V.REGION["lon"])).alias("home"),
    ).first()
    if not r.zero and not r.out:
        return []
    said = f"{r.zero} rows are at (0, 0) and {r.out} are outside the valid ranges; {r.home / m.table.rows:.0%} are in the home region"
    return [finding(14, [m.table.names[lats[0]], m.table.names[lons[0]]], said, {"zero_zero": r.zero, "out_of_range": r.out, "in_bc_frac": r.home / m.table.rows, "rows": m.table.rows}, GATE, 0.9)]


@check(15)
def outliers(m: Measures, cols: list[int]) -> list[Finding]:
    center = {k: c for k, c in m.center.items() if k in cols and c[1] > 0}
    if not center:
        return []
    score = {k: 0.6745 * F.abs(F.col(f"c{k}").cast("double") - F.lit(mid)) / F.lit(spread) for k, (mid, spread) in center.items()}
    cells = _each(m.table, sorted(center), lambda c, k: c.cast("double").alias("x"), lambda c, k: score[k].alias("score")).where("score > 3.5")
    found = {r.k: r for r in cells.groupBy("k").agg(F.count("*").alias("n"), F.max("score").alias("most")).collect()}
    if not found:
        return []
    firsts: dict[int, list] = {}
    rank = F.row_number().over(Window.partitionBy("k").orderBy("first"))
    for r in cells.groupBy("k", "x").agg(F.min("_rid").alias("first")).withColumn("rank", rank).where("rank <= 3").orderBy("k", "rank").collect():
        firsts.setdefault(r.k, []).append(r.x)
    said = "{} values have a modified z-score above 3.5 (median {:g}, MAD {:g}), such as {}; extremes can be real, so they are only shown"
    return [finding(15, [m.table.names[k]], said.format(r.n, *center[k], shown(firsts[k])), {"count": r.n, "median": center[k][0], "mad": center[k][1], "max_score": r.most}, HUMAN, 0.7) for k, r in sorted(found.items())]


def band_ratio(logs: list[float]) -> float | None:
    """The factor between two bands of sorted logarithms, if there are two."""
    gaps = [b - a for a, b in zip(logs, logs[1:])]
    if len(logs) < 20:
        return None
    widest = max(gaps)
    cut = gaps.index(widest) + 1
    others = (logs[-1] - logs[0] - widest) / max(len(gaps) - 1, 1)
    if widest <= 0 or widest < 5 * others or not 0.25 <= cut / len(logs) <= 0.75:
        return None
    return 10 ** (median(logs[cut:]) - median(logs[:cut]))


@check(16)
def units(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    named = [k for k in cols if re.search(V.UNIT_NAME, m.table.key(k))]
    parameters = [k for k in range(m.table.width) if re.search(V.PARAMETER_NAME, m.table.key(k))]
    if named and parameters:
        u, p = named[0], parameters[0]
        unit, parameter = F.col(f"c{u}"), F.col(f"c{p}")
        groups = m.table.df.where(parameter.isNotNull()).groupBy(parameter.alias("p")).agg(F.min(unit).alias("a"), F.max(unit).alias("b"), F.min("_rid").alias("first")).where("a <> b")
        if count := groups.count():
            first = [r.p for r in groups.orderBy("p").limit(3).collect()]
            seen = []
            if m.table.kinds[u] == "text":
                seen = [r.v for r in m.table.df.where(X.trimmed(unit) != "").select(unit.alias("v")).distinct().orderBy("v").limit(8).collect()]
            said = f"{count} parameters come in more than one unit, such as {shown(first)}, so their values cannot be compared"
            out.append(finding(16, sorted({m.table.names[u], m.table.names[p]}), said, {"mixed_parameters": count, "units": seen, "kind": "explicit"}, AUTO, 0.9))
    likely = [k for k, _, p in numbers(m, cols, 20) if p["max"] > 0 and (p["min"] <= 0 or p["max"] > 1.05 * p["min"])]
    if not likely:
        return out
    cells = _each(m.table, likely, lambda c, k: c.cast("double").alias("x")).where("x > 0")
    step = m.table.rows // BAND_ROWS
    if step:  # an even share of the rows, alike on every run
        cells = cells.where(F.pmod(F.xxhash64("_rid"), F.lit(step + 1)) == 0)
    for r in cells.groupBy("k").agg(F.sort_array(F.collect_list(F.log10("x"))).alias("logs")).orderBy("k").collect():  # bounded by BAND_ROWS
        ratio = band_ratio(r.logs)
        known = next(((x, name) for x, name in V.KNOWN_RATIOS if ratio and ratio >= 1.05 and abs(ratio - x) / x <= 0.03), None)
        if known:
            said = f"the values fall into two bands {ratio:.4g} times apart, the factor of {known[1]}, so the column mixes units"
            out.append(finding(16, [m.table.names[r.k]], said, {"ratio": ratio, "known_ratio": known[0], "conversion": known[1], "kind": "inferred"}, HUMAN, 0.75))
    return out


@check(19)
def empty_or_constant(m: Measures, cols: list[int]) -> list[Finding]:
    out, rows = [], m.table.rows
    if rows < 5:
        return out
    for k in cols:
        nulls = 1 - m.values(k) / rows
        distinct = m.distinct(k) if m.about(k) <= 3 else 4
        if nulls >= 0.995:
            reason, stats = "has no values", {"null_frac": nulls, "distinct": 0}
        elif distinct <= 1:
            only = m.table.df.where(F.col(f"c{k}").isNotNull()).select(f"c{k}").first()
            reason, stats = f"has one value ({shown(only or [''])}) in every row", {"null_frac": nulls, "distinct": distinct}
        else:
            continue
        out.append(finding(19, [m.table.names[k]], f"the column {reason} and says nothing", stats, AUTO, 1.0))
    return out


@check(22)
def corrupted_ids(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, p in numbers(m, cols, 10):
        if not re.search(V.ID_NAME, m.table.key(k)) or p["integral"] < 0.99 * p["values"] or p["negative"]:
            continue
        c = F.col(f"c{k}")
        whole = m.table.df.where(c.cast("double") == F.floor(c.cast("double")))
        span = whole.agg((F.max(c).cast("double") - F.min(c).cast("double") + 1).alias("span")).first().span
        about = p["about"] / (0.5 * span)
        dense = about > 1.1 or about > 0.9 and whole.select(c).distinct().count() >= 0.5 * span
        width = F.length(c.cast("decimal(38,0)").cast("string"))
        widths = {r.w: r.n for r in whole.groupBy(width.alias("w")).agg(F.count("*").alias("n")).collect()}
        modal = min(widths, key=lambda w: (-widths[w], w))
        total, shorter = sum(widths.values()), sum(n for w, n in widths.items() if w < modal)
        if modal < 4 or widths[modal] < 0.5 * total or not shorter:
            continue
        if dense:  # a counter, unless what is below the modal width is far emptier than the whole range
            low = whole.where(width < modal).agg(F.count_distinct(c).alias("n"), F.min(c).cast("double").alias("least")).first()
            expected = min(1, p["about"] / span) * (10 ** (modal - 1) - low.least)
            if expected < 30 or low.n >= 0.5 * expected:
                continue
        bad = (c.cast("double") == F.floor(c.cast("double"))) & (F.length(c.cast("decimal(38,0)").cast("string")) < modal)
        said = f"{shorter} ids are shorter than the {modal} digits of most, as if a numeric cast had cut leading zeros, such as {shown(int(v) for v in first_values(m, k, bad))}"
        out.append(finding(22, [name], said, {"modal_width": modal, "shorter": shorter, "values": total, "modal_frac": widths[modal] / total}, GATE, 0.85))
    return out
