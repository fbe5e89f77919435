"""Checks 1 to 8, 17 and 21: what text columns hold. All read the value-count dictionary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..findings import AUTO, GATE, HUMAN, Finding, finding, shown
from ..functions import text as X
from ..functions import vocab as V
from ..plans.measures import Measures
from .registry import check

# The thresholds of the checks.
SHAPED = 0.30
MIXED = 0.50
COVERED = 0.90
NAMED = 0.05
FUZZY = 0.92
FUZZY_VALUES = 150
FUZZY_PAIRS = 50
PACKED = 0.8


def texts(m: Measures, cols: list[int], least: int, count: str = "n_present"):
    """(column, its name, its measures, number of values) of the text columns with enough values."""
    for k in cols:
        if m.table.kinds[k] == "text" and (t := m.text[k])[count] >= least:
            yield k, m.table.names[k], t, t[count]


def shares(t: dict, what: str, shapes: dict[str, str]) -> dict[str, float]:
    found = {name: t[f"{what}_{i}"] / t["n_present"] for i, name in enumerate(shapes, 1)}
    return {name: s for name, s in found.items() if s > 0}


def listed(families: dict[str, float]) -> str:
    return ", ".join(f"{name} {s:.0%}" for name, s in sorted(families.items(), key=lambda x: -x[1]))


@check(1)
def numbers_as_strings(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, t, n in texts(m, cols, 8):
        found = shares(t, "number", V.NUMBER_SHAPES)
        union, parsed, led = sum(found.values()), t["plain_present"] / n, t["leading"] / n
        families = {f: s for f, s in found.items() if s >= NAMED}
        if union < SHAPED or parsed > 0.95 or not families:
            continue
        ambiguous = "decimal-comma" in families and bool({"thousands-comma", "symbol"} & families.keys())
        stats = {"values": n, "families": families, "union": round(union, 3), "parse_frac": led, "residue_frac": 1 - parsed}
        if union < COVERED and (len(families) < 2 or union < MIXED):
            out.append(finding(1, [name], f"{union:.0%} of the values have the shape of amounts ({listed(families)}), {1 - union:.0%} have no known shape", stats, HUMAN, round(union, 3)))
        elif len(families) > 1:
            said = f"{len(families)} number formats share the column: {listed(families)}"
            said += f"; {1 - union:.0%} have no known shape" * (union < 0.98)
            said += "; with decimal and thousands commas the same digits can be read two ways" * ambiguous
            out.append(finding(1, [name], said, stats, GATE if ambiguous else AUTO, union * (0.85 if ambiguous else 0.95)))
        else:
            said = f"{n - int(parsed * n)}/{n} values are numbers with currency or unit residue, such as {shown(m.text_samples.get((k, 'residue'), ()))}"
            out.append(finding(1, [name], said, stats, AUTO, min(union, led)))
    return out


def dates(m: Measures, cols: list[int]):
    for k, name, t, n in texts(m, cols, 8):
        found = shares(t, "date", V.DATE_SHAPES)
        if not any(s >= NAMED for f, s in found.items() if f != "epoch"):
            found.pop("epoch", None)  # ten digits alone are an id
        families = {f: s for f, s in found.items() if s >= NAMED}
        if (covered := sum(families.values())) >= SHAPED:
            yield k, name, t, n, families, covered


@check(2)
def dates_as_strings(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, _, n, families, covered in dates(m, cols):
        if len(families) == 1:
            (family,) = families
            stats = {"values": n, "family": family, "coverage": covered}
            if covered >= COVERED:
                out.append(finding(2, [name], f"{n} values are {family} dates kept as text, such as {shown(m.text_samples.get((k, 'present'), ()))}", stats, AUTO, covered))
            else:
                out.append(finding(2, [name], f"{covered:.0%} of the values are {family} dates, {1 - covered:.0%} have no known shape", stats, HUMAN, covered))
    return out


@check(3)
def mixed_dates(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for _, name, t, n, families, covered in dates(m, cols):
        if len(families) < 2 or covered < MIXED:
            continue
        ambiguous = 0 < t["left"] <= 12 and 0 < t["right"] <= 12
        ranked = dict(sorted(families.items(), key=lambda x: -x[1]))
        said = f"{len(families)} date formats in one column: {listed(families)}" + f"; {1 - covered:.0%} fit none" * (covered < 0.98) + "; day and month cannot be told apart" * ambiguous
        out.append(finding(3, [name], said, {"values": n, "families": ranked, "ambiguous": ambiguous, "coverage": covered}, GATE, covered * (0.8 if ambiguous else 1)))
    return out


@check(4)
def sentinels(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    hit = [k for k, _, t, n in texts(m, cols, 8, "n_text") if 2 <= t["sentinels"] < n]
    words = m.words(F.col("is_text") & (F.col("token") | F.col("sentinel_date")), "t", hit, 100)
    for k in hit:
        t, tokens = m.text[k], words[k]
        n, count = t["n_text"], t["sentinels"]
        said = f"{count}/{n} values stand for missing data: {', '.join(map(repr, tokens[:4]))}"
        out.append(finding(4, [m.table.names[k]], said, {"sentinel_count": count, "tokens": tokens[:8], "frac": count / n}, AUTO, min(0.99, 0.9 + count / n / 10)))
    for k in cols:
        if m.table.kinds[k] != "number" or m.plain[k]["values"] < 12 or (s := m.top_sentinel(k)) is None:
            continue
        count, rest, n = m.plain[k][f"is_{V.NUMERIC_SENTINELS.index(s)}"], m.exact[k]["rest"], m.plain[k]["values"]
        if rest and count > 5 * rest:
            said = f"{count} rows hold {s}, {count / rest:.0f} times the next most common value, as a stand-in for missing data would"
            out.append(finding(4, [m.table.names[k]], said, {"sentinel_value": s, "sentinel_count": count, "next_count": rest, "frac": count / n}, HUMAN, 0.75))
    return out


@check(5)
def suppression(m: Measures, cols: list[int]) -> list[Finding]:
    likely = [k for k, _, t, n in texts(m, cols, 12, "n_text") if t["plain_text"] >= 0.85 * n and 0.9 * n <= t["bare_text"] < n]
    left = F.col("is_text") & ~F.col("plain_bare") & ~F.col("token")
    tokens = m.words(left, "t", likely, 11)
    likely = [k for k in likely if 1 <= len(tokens.get(k, ())) <= 10 and all(re.search(V.SUPPRESSION, w) for w in tokens[k])]
    if not likely:
        return []
    counts = {r.k: r.n for r in m.dictionary.where(F.col("k").isin(*likely) & left).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    said = "{} cells of a numeric column are suppression marks: {}"
    return [finding(5, [m.table.names[k]], said.format(counts[k], ", ".join(map(repr, tokens[k][:4]))), {"tokens": tokens[k], "flagged": counts[k], "parse_frac": m.text[k]["bare_text"] / m.text[k]["n_text"]}, AUTO, 0.9) for k in likely]


@check(6)
def white_space(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, t, n in texts(m, cols, 5, "n_text"):
        if count := t["dirty"]:
            said = f"{count}/{n} values have stray white space" + f", {t['exotic']} of them special or zero-width spaces" * bool(t["exotic"]) + f", such as {shown(m.text_samples.get((k, 'dirty'), ()))}"
            out.append(finding(6, [name], said, {"count": count, "exotic": t["exotic"], "values": n}, AUTO, 0.99))
    return out


def differ_in_digits_only(a: str, b: str) -> bool:
    moved = "".join(a[i:j] + b[x:y] for op, i, j, x, y in SequenceMatcher(None, a, b).get_opcodes() if op != "equal")
    return moved != "" and not any(c.isalnum() and not c.isdigit() for c in moved)


def similar(values: list[str]) -> list[tuple[float, str, str]]:
    """Pairs of similar values, in the order of the values; the first 50.

    Shared letters bound a pair's ratio from above; they are counted for all pairs at once, and only
    pairs that can reach the threshold are compared.
    """
    pairs: list[tuple[float, str, str]] = []
    letters = {c: i for i, c in enumerate(sorted(set("".join(values))))}
    counts = np.zeros((len(values), len(letters)), np.int32)
    for i, v in enumerate(values):
        for c in v:
            counts[i, letters[c]] += 1
    sizes = counts.sum(axis=1)
    for i, a in enumerate(values):
        rest = slice(i + 1, None)
        shared = np.minimum(counts[i], counts[rest]).sum(axis=1)
        near = (abs(sizes[rest] - sizes[i]) <= 3) & (2 * shared >= FUZZY * (sizes[rest] + sizes[i]) - 1e-9)
        for j in np.flatnonzero(near) + i + 1:
            ratio = SequenceMatcher(None, a, values[j]).ratio()
            if ratio >= FUZZY and not differ_in_digits_only(a, values[j]):
                pairs.append((round(ratio, 3), a, values[j]))
                if len(pairs) == FUZZY_PAIRS:
                    return pairs
    return pairs


@check(7)
def spelling_variants(m: Measures, cols: list[int]) -> list[Finding]:
    likely = [k for k, _, t, _ in texts(m, cols, 10) if t["distinct_present"] >= 2]
    if not likely:
        return []
    folds = m.keep(m.folds(likely))
    distinct = {r.k: r.n for r in folds.groupBy("k").agg(F.count("*").alias("n")).collect()}
    shrunk = [k for k in likely if (m.text[k]["distinct_present"] - distinct[k]) / m.text[k]["distinct_present"] > 0.1]
    coarse = [k for k in likely if distinct[k] <= max(50, 0.2 * m.text[k]["n_present"])]
    samples: dict[int, list[str]] = {}
    if shrunk:
        rank = F.row_number().over(Window.partitionBy("k").orderBy("first"))
        firsts = folds.where(F.col("k").isin(*shrunk) & (F.col("spellings") > 1)).withColumn("rank", rank).where("rank <= 3").select("k", "first").collect()
        picked = m.dictionary.where(F.col("first").isin(*{r["first"] for r in firsts}) & F.col("k").isin(*shrunk)).select("k", "first", "v").collect()
        of = {(r.k, r["first"]): r.v for r in picked}
        for r in sorted(firsts):
            samples.setdefault(r.k, []).append(of.get((r.k, r["first"]), ""))
    ranked: dict[int, list] = {}
    if coarse:
        rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "first"))
        top = m.folds(coarse, strings=True).where(F.length("fold") >= 6).withColumn("rank", rank).where(F.col("rank") <= FUZZY_VALUES)
        for r in top.orderBy("k", "rank").collect():
            ranked.setdefault(r.k, []).append((r.fold, r.original))
    out = []
    for k in likely:
        name, raw = m.table.names[k], m.text[k]["distinct_present"]
        if k in shrunk:
            said = f"{raw} distinct values are {distinct[k]} once case and white space are folded, such as {shown(samples.get(k, ()))}"
            out.append(finding(7, [name], said, {"distinct": raw, "normalised": distinct[k], "shrink": (raw - distinct[k]) / raw}, AUTO, 0.95))
        own = dict(ranked.get(k, ()))
        if pairs := similar(list(own)):
            said = f"{len(pairs)} pairs of values are at least {FUZZY:.0%} alike and may be one category: " + "; ".join(f"{own[a]!r}~{own[b]!r}" for _, a, b in pairs[:2])
            out.append(finding(7, [name], said, {"fuzzy_pairs": len(pairs), "distinct": distinct[k], "examples": [[own[a], own[b]] for _, a, b in pairs[:5]]}, HUMAN, min(0.9, pairs[0][0])))
    return out


def mends(value: str) -> bool:
    """Whether reading a value's latin-1 bytes as UTF-8 mends it."""
    try:
        fixed = value.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return False
    return fixed != value and not any(x in fixed for x in V.MOJIBAKE)


@check(8)
def mojibake(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, t, n in texts(m, cols, 5, "n_text"):
        if not (count := t["moji"]):
            continue
        c = F.col(f"c{k}")
        first = m.table.df.where(c.rlike("|".join(V.MOJIBAKE))).orderBy("_rid").select(c.alias("v")).limit(50).collect()
        mended = sum(mends(r.v) for r in first) / len(first)
        said = f"{count} values hold mojibake; read as UTF-8, {mended:.0%} of a sample mends: {shown(m.text_samples.get((k, 'moji'), ()))}"
        out.append(finding(8, [name], said, {"count": count, "repair_frac": mended, "values": n}, GATE, 0.95 if mended >= 0.9 else 0.6))
    return out


def packing(t: dict, n: int) -> tuple[str, int, float] | None:
    """How a column packs several fields into one cell: kind, packed values, confidence."""
    if t["latlon"] >= PACKED * n:
        return "latlon_pair", t["latlon"], 0.95
    if t["json"] >= PACKED * n:
        return "json", t["json"], 0.9
    for name in ("comma", "pipe", "semicolon"):
        numbers = name == "comma" and sum(shares(t, "number", V.NUMBER_SHAPES).values()) >= PACKED
        if t[f"with_{name}"] >= PACKED * n and t[f"sum_{name}"] >= n and not numbers:
            return f"{name}_list", t[f"with_{name}"], 0.85
    return None


@check(17)
def packed_fields(m: Measures, cols: list[int]) -> list[Finding]:
    out = []
    for k, name, t, n in texts(m, cols, 10):
        if found := packing(t, n):
            kind, count, confidence = found
            said = f"{count}/{n} values pack several fields into a cell ({kind}), such as {shown(m.text_samples.get((k, 'present'), ()))}"
            out.append(finding(17, [name], said, {"kind": kind, "values": n, "packed": count}, AUTO, confidence))
    return out + split_siblings(m, cols)


def split_siblings(m: Measures, cols: list[int]) -> list[Finding]:
    """Columns name1, name2 whose texts break mid-word between them; counted over all rows, with all their words as vocabulary."""
    groups: dict[str, list[tuple[int, int]]] = {}
    for k in cols:
        if m.table.kinds[k] == "text" and (hit := re.match(V.SIBLING, m.table.key(k))):
            groups.setdefault(hit["prefix"], []).append((int(hit["num"]), k))
    pairs = {(a, b): prefix for prefix, members in groups.items() for (_, a), (_, b) in zip(sorted(members), sorted(members)[1:])}
    if not pairs:
        return []
    places = list(pairs)
    cells = m.table.df.select(*(F.col(f"c{k}") for k in sorted({k for pair in places for k in pair})))
    counts = {r.pair: r for r in cells.mapInArrow(_breaks(places), "pair int, n long, joined long, short long").groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("n", "joined", "short"))).collect()}
    likely = {i: places[i] for i, r in sorted(counts.items()) if r.n >= 5 and r.joined >= 0.8 * r.n and r.short >= 0.6 * r.n}
    if not likely:
        return []
    words = cells.mapInArrow(_glued_and_known(likely), "pair int, word string, n long, known boolean")
    words = words.groupBy("pair", "word").agg(F.sum("n").alias("n"), F.max("known").alias("known")).where("known")
    healed = {r.pair: r.n for r in words.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    out = []
    for i, (a, b) in likely.items():
        count, n = healed.get(i, 0), counts[i].n
        if count >= 0.4 * n:
            prefix = pairs[a, b]
            said = f"{count} rows break mid-word across {prefix}* columns and make words only when joined, such as {shown(first_halves(m, a, b))}"
            stats = {"kind": "split_columns", "rows": count, "healed_frac": count / n, "members": [m.table.names[k] for _, k in sorted(groups[prefix])]}
            out.append(finding(17, [m.table.names[a], m.table.names[b]], said, stats, AUTO, 0.85))
    return out


def _both(batch: pa.RecordBatch, a: int, b: int) -> list[tuple[str, str]]:
    """The rows of a batch in which both columns hold more than blanks and tokens."""
    keep = lambda v: v and (s := v.strip()) and s.lower() not in V.MISSING_TOKENS
    return [(x, y) for x, y in zip(*(batch.column(f"c{k}").to_pylist() for k in (a, b))) if keep(x) and keep(y)]


def _breaks(pairs: list[tuple[int, int]]):
    """For each pair of columns: rows that have both, those with letters or digits on both sides of the break, those with a short half."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (a, b) in enumerate(pairs):
                rows = _both(batch, a, b)
                joined = sum(x[-1].isalnum() and y[0].isalnum() for x, y in rows)
                short = sum(min(len(x.split()[-1]), len(y.split()[0])) <= 3 for x, y in rows)
                found.append((i, len(rows), joined, short))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["pair", "n", "joined", "short"])

    return scan


def _glued_and_known(pairs: dict[int, tuple[int, int]]):
    """For each pair of columns: words glued over the break, with their rows, and words that stand in either column."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, (a, b) in pairs.items():
                rows = _both(batch, a, b)
                glued = Counter((x.split()[-1] + y.split()[0]).lower() for x, y in rows)
                found += [(i, w, n, False) for w, n in glued.items()]
                found += [(i, w, 0, True) for w in {w.lower() for row in rows for half in row for w in half.split()}]
            columns = zip(*found) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.bool_()))], names=["pair", "word", "n", "known"])

    return scan


def first_halves(m: Measures, a: int, b: int) -> list[str]:
    """The first rows that hold both columns, as text|text."""
    there = [(X.trimmed(F.col(f"c{k}")) != "") & ~X.is_token(X.trimmed(F.col(f"c{k}"))) for k in (a, b)]
    rows = m.table.df.where(there[0] & there[1]).orderBy("_rid").select(f"c{a}", f"c{b}").limit(3).collect()
    return [f"{r[0]}|{r[1]}" for r in rows]


@check(21)
def rollup_rows(m: Measures, cols: list[int]) -> list[Finding]:
    rows = m.table.rows
    hit = [k for k, _, t, _ in texts(m, cols, 10, "n_text") if rows >= 10 and t["distinct_text"] <= max(50, 0.5 * rows) and 2 <= t["rollup"] <= 0.2 * rows]
    labels = m.words(F.col("rollup"), "v", hit, 8)
    said = "{} rows are totals ({}) among detail rows, so sums over the column count twice"
    return [finding(21, [m.table.names[k]], said.format(m.text[k]["rollup"], ", ".join(map(repr, labels[k][:3]))), {"rows": m.text[k]["rollup"], "rollup_count": m.text[k]["rollup"], "labels": labels[k]}, GATE, 0.9) for k in hit]
