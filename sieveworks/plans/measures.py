"""The shared passes behind the checks, each made once and only when a check asks for it.

Text columns become a value-count dictionary (column, value, count, first row) by one shuffle that
pre-aggregates; every pattern then runs on distinct values only, and one aggregation over the column
number gives all counts of all columns. Columns of long, nearly unique texts skip the shuffle and are
labelled row by row. Other columns go through one aggregation with sketches; exact distinct counts
are made only for columns where a check's outcome depends on them.
"""

from __future__ import annotations

import threading

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vocab as V
from .boundary import Table

#: Rows up to which medians come from one exact aggregation; above, brackets are narrowed first.
MEDIAN_ROWS = 2_000_000
#: Value counts of a column that the driver orders at last.
MEDIAN_VALUES = 50_000
SAMPLES = 3
SAMPLE_CHARS = 40


class shared:
    """A property made once, by one thread; checks that run side by side wait for it."""

    def __init__(self, make):
        self.make = make

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, of, owner=None):
        with of.lock:
            if self.name not in of.__dict__:
                of.__dict__[self.name] = self.make(of)
            return of.__dict__[self.name]


def _each(table: Table, columns: list[int], *fields) -> DataFrame:
    """A row per cell of some columns: k, and fields made from the cell by functions of (column, place)."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), *(f(F.col(f"c{i}"), i) for f in fields)) for i in columns)))
    return table.df.select("_rid", cells.alias("cell")).select("_rid", "cell.*")


class Measures:
    def __init__(self, table: Table):
        self.table = table
        self.lock = threading.RLock()
        self._kept: list[DataFrame] = []
        if table.dealt:  # small, and read by many passes
            self.keep(table.df)

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.append(df)
        return df

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    # --- text -------------------------------------------------------------------------------

    @shared
    def dictionary(self) -> DataFrame | None:
        """k, v, n, first (row), and the labels of v; for long texts a row each, with v cut after the labels are made."""
        texts, long_ = self.table.of_kind("text"), self.table.long_texts
        short = [i for i in texts if i not in long_]
        value = lambda c, i: c.alias("v")
        parts = []
        if short:
            parts.append(_each(self.table, short, value).where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"), F.min("_rid").alias("first")))
        if long_:
            parts.append(_each(self.table, sorted(long_), value).where("v is not null").select("k", "v", F.lit(1).cast("long").alias("n"), F.col("_rid").alias("first")))
        if not parts:
            return None
        df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        v = F.col("v")
        df = df.withColumn("t", X.trimmed(v))
        df = df.withColumns({"is_text": F.col("t") != "", "token": X.is_token(F.col("t"))})
        df = df.withColumns({"present": F.col("is_text") & ~F.col("token"), "digit": v.rlike("[0-9]")})
        digits = F.col("present") & F.col("digit")
        df = df.withColumns(
            {
                "number": F.when(digits, X.first_match(v, V.NUMBER_SHAPES)).otherwise(0),
                "date": F.when(digits & (F.length(v) <= 64), X.first_match(v, V.DATE_SHAPES)).otherwise(0),
                "plain": F.when(F.col("digit") | F.lower("t").startswith("inf"), v.rlike(V.PLAIN_NUMBER)).otherwise(False),
                "leading": F.when(digits, v.rlike(V.LEADING_NUMBER)).otherwise(False),
                "plain_bare": F.when(F.col("digit"), F.replace(v, F.lit(","), F.lit("")).rlike(V.PLAIN_NUMBER)).otherwise(False),
                "sentinel_date": F.col("t").isin(*V.SENTINEL_DATES),
                "dirty": F.col("is_text") & X.damaged(v),
                "moji": F.col("is_text") & ~X.is_ascii(v) & v.rlike("|".join(V.MOJIBAKE)),
                "rollup": F.col("is_text") & F.lower(v).rlike(V.ROLLUP),
                "latlon": digits & v.rlike(V.LATLON),
                "json": F.col("present") & (F.length("t") >= 2) & F.substring("t", 1, 1).isin("[", "{") & F.substring("t", -1, 1).isin("]", "}"),
                **{f"n_{name}": F.when(F.col("present"), X.occurrences(v, letter)).otherwise(0) for name, letter in (("comma", ","), ("pipe", "|"), ("semicolon", ";"))},
                "ascii": X.is_ascii(v),
            }
        )
        df = df.withColumn("exotic", F.when(F.col("dirty"), X.has_exotic_space(v)).otherwise(False)).withColumn("h", F.xxhash64("v"))
        cut = F.col("k").isin(*sorted(long_)) if long_ else F.lit(False)
        return self.keep(df.withColumns({"v": F.when(cut, F.left(v, F.lit(256))).otherwise(v), "t": F.left("t", F.lit(256))}))

    @shared
    def text(self) -> dict[int, dict]:
        """All counts of every text column."""
        if self.dictionary is None:
            return {}
        n = F.col("n")
        of = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
        present = F.col("present")
        flags = ("token", "sentinel_date", "dirty", "exotic", "moji", "rollup", "latlon", "json")
        slot = lambda g: F.max(F.when(present & F.col("date").isin(3, 4, 5), F.regexp_extract("v", V.SLOTTED_DATE, g).cast("int")))
        measures = {
            "values": F.sum("n"),
            "n_text": of(F.col("is_text")),
            "n_present": of(present),
            "sentinels": of(F.col("is_text") & (F.col("token") | F.col("sentinel_date"))),
            **{f: of(F.col("is_text") & F.col(f)) for f in flags},
            "plain_present": of(present & F.col("plain")),
            "plain_text": of(F.col("is_text") & F.col("plain")),
            "bare_text": of(F.col("is_text") & F.col("plain_bare")),
            "leading": of(F.col("leading")),
            "left": F.coalesce(slot(1), F.lit(0)),
            "right": F.coalesce(slot(2), F.lit(0)),
            "foreign": of(~F.col("ascii")),
            **{f"with_{c}": of(F.col(f"n_{c}") >= 1) for c in ("comma", "pipe", "semicolon")},
            **{f"sum_{c}": F.coalesce(F.sum(F.col(f"n_{c}") * n), F.lit(0)) for c in ("comma", "pipe", "semicolon")},
            **{f"number_{i}": of(F.col("number") == i) for i in range(1, len(V.NUMBER_SHAPES) + 1)},
            **{f"date_{i}": of(F.col("date") == i) for i in range(1, len(V.DATE_SHAPES) + 1)},
        }
        rows = self.dictionary.groupBy("k").agg(*(m.alias(name) for name, m in measures.items())).collect()
        out = {r.k: r.asDict() for r in rows}
        for k, d in self._text_distinct.items():
            out[k] |= d
        none = {name: 0 for name in measures} | {"distinct": 0, "distinct_text": 0, "distinct_present": 0}
        return {k: out.get(k, {"k": k} | none) for k in self.table.of_kind("text")}

    @shared
    def _text_distinct(self) -> dict[int, dict]:
        """Distinct values, distinct non-blank values and distinct present values of every text column."""
        long_ = self.table.long_texts
        counts = lambda c: (F.count("*").alias("distinct"), F.count_if("is_text").alias("distinct_text"), F.count_if("present").alias("distinct_present"))
        df = self.dictionary.select("k", "h", "is_text", "present")
        if long_:
            df = df.where(~F.col("k").isin(*long_)).unionByName(df.where(F.col("k").isin(*long_)).distinct())
        return {r.k: r.asDict() for r in df.groupBy("k").agg(*counts(None)).collect()}

    @shared
    def text_samples(self) -> dict[tuple[int, str], list[str]]:
        """The first distinct values of every column that carry a label, in order of their first row."""
        if self.dictionary is None:
            return {}
        marks = {"present": "present", "dirty": "dirty", "moji": "moji", "residue": "present and not plain"}
        tags = F.array_compact(F.array(*(F.when(F.expr(cond), F.lit(name)) for name, cond in marks.items())))
        rank = F.row_number().over(Window.partitionBy("k", "mark").orderBy("first", "v"))
        rows = self.dictionary.select("k", "v", "first", F.explode(tags).alias("mark")).withColumn("rank", rank).where(F.col("rank") <= SAMPLES).collect()
        out: dict[tuple[int, str], list[str]] = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            out.setdefault((r.k, r.mark), []).append(r.v)
        return out

    def words(self, mark: Column, column: str, columns: list[int], limit: int) -> dict[int, list[str]]:
        """Distinct short strings of some columns, in order, at most limit each."""
        if not columns:
            return {}
        df = self.dictionary.where(F.col("k").isin(*columns) & mark).select("k", F.col(column).alias("w")).distinct()
        rows = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("w"))).where(F.col("rank") <= limit).collect()
        out: dict[int, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r.k, r["rank"])):
            out.setdefault(r.k, []).append(r.w)
        return out

    def folds(self, columns: list[int], strings: bool = False) -> DataFrame:
        """k, fold_hash, n, first, spellings of the present values of some columns; with strings also fold and original, the first spelling.

        Without strings every aggregate is numeric, so the group-by hashes and never sorts text.
        """
        foreign = any(self.text[k]["foreign"] for k in columns)
        fold = X.folded_any if foreign else X.folded
        short = [k for k in columns if k not in self.table.long_texts]
        long_ = [k for k in columns if k in self.table.long_texts]
        df = self.dictionary.where("present").select("k", "v", "n", "first", "dirty") if short else None
        df = df.where(F.col("k").isin(*short)) if short else None
        if long_:
            own = _each(self.table, long_, lambda c, i: c.alias("v")).select("k", "v", F.lit(1).cast("long").alias("n"), F.col("_rid").alias("first"), F.lit(True).alias("dirty"))
            stripped = X.trimmed(F.col("v"))
            own = own.where(F.col("v").isNotNull() & (stripped != "") & ~X.is_token(stripped))
            df = own if df is None else df.unionByName(own)
        v = F.col("v")
        tidy = fold(v) if foreign else F.lower(F.when(F.col("dirty"), X.collapsed(v)).otherwise(v))
        df = df.withColumn("fold", tidy)
        group = df.groupBy("k", F.xxhash64("fold").alias("fold_hash"))
        counts = [F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("spellings")]
        return group.agg(*counts, F.min("fold").alias("fold"), F.min_by(F.left("v", F.lit(256)), "first").alias("original")) if strings else group.agg(*counts)

    # --- other columns ----------------------------------------------------------------------

    @shared
    def plain(self) -> dict[int, dict]:
        """Counts, range, sentinels and an approximate distinct count of every column that is not text."""
        columns = self.table.of_kind("number", "bool", "time")
        if not columns:
            return {}
        number = set(self.table.of_kind("number"))
        x = lambda c, i: (c.cast("double") if i in number else F.lit(None).cast("double")).alias("x")
        cells = _each(self.table, columns, x, lambda c, i: F.when(c.isNotNull(), F.xxhash64(c)).alias("h")).where("h is not null")
        measures = {
            "values": F.count("*"),
            "about": F.approx_count_distinct("h", 0.02),
            "min": F.min("x"),
            "max": F.max("x"),
            "same": F.min("h") == F.max("h"),
            "integral": F.count_if(F.col("x") == F.floor("x")),
            "negative": F.count_if(F.col("x") < 0),
            **{f"is_{i}": F.count_if(F.col("x") == float(s)) for i, s in enumerate(V.NUMERIC_SENTINELS)},
        }
        rows = {r.k: r.asDict() for r in cells.groupBy("k").agg(*(m.alias(name) for name, m in measures.items())).collect()}
        none = {name: 0 for name in measures} | {"min": None, "max": None, "same": True}
        return {k: rows.get(k, {"k": k} | none) for k in columns}

    def values(self, k: int) -> int:
        """Non-null cells of a column."""
        return (self.text if self.table.kinds[k] == "text" else self.plain)[k]["values"]

    def about(self, k: int) -> int:
        """Distinct values of a column, exact for text, else by a sketch."""
        return self.text[k]["distinct"] if self.table.kinds[k] == "text" else self.plain[k]["about"]

    @shared
    def exact(self) -> dict[int, dict]:
        """Exact distinct counts, and the count of the most common value but the top sentinel, where an outcome may hang on them."""
        rows = self.table.rows
        columns = set()
        coarse = sorted((self.about(k), k) for k in range(self.table.width))[:16]
        for k, p in self.plain.items():
            about, named = p["about"], self.table.kinds[k] == "number"
            if named and self.top_sentinel(k) is not None:
                columns.add(k)
            if about < 50 or 0.9 <= about / max(rows, 1) <= 1.1 or any(k == c for _, c in coarse):
                columns.add(k)
        if not columns:
            return {}
        tops = [(k, self.top_sentinel(k)) for k in sorted(columns) if self.table.kinds[k] == "number"]
        top = F.lit(None).cast("double")
        for k, s in tops:
            if s is not None:
                top = F.when(F.col("k") == k, F.lit(float(s))).otherwise(top)
        number = set(self.table.of_kind("number"))
        x = lambda c, i: (c.cast("double") if i in number else F.lit(None).cast("double")).alias("x")
        cells = _each(self.table, sorted(columns), x, lambda c, i: F.when(c.isNotNull(), F.xxhash64(c)).alias("h")).where("h is not null")
        counted = cells.groupBy("k", "h").agg(F.count("*").alias("n"), F.min("x").alias("x"))
        rest = F.max(F.when(~F.col("x").eqNullSafe(top), F.col("n")))
        return {r.k: r.asDict() for r in counted.groupBy("k").agg(F.count("*").alias("distinct"), rest.alias("rest")).collect()}

    def distinct(self, k: int) -> int:
        """Distinct non-null values: exact wherever the sketch leaves a check open."""
        if self.table.kinds[k] == "text":
            return self.text[k]["distinct"]
        return self.exact[k]["distinct"] if k in self.exact else self.plain[k]["about"]

    def top_sentinel(self, k: int) -> int | None:
        """The most frequent numeric sentinel of a column if it is frequent enough to matter."""
        p = self.plain[k]
        n, i = max((p[f"is_{i}"], -i) for i in range(len(V.NUMERIC_SENTINELS)))
        return V.NUMERIC_SENTINELS[-i] if n > 5 else None

    def medians(self, shifted: dict[int, float]) -> dict[int, float]:
        """Exact medians of |x - shift| of number columns (of x itself where the shift is NaN)."""
        if not shifted:
            return {}
        value = lambda c, i: (c.cast("double") if shifted[i] != shifted[i] else F.abs(c.cast("double") - F.lit(float(shifted[i])))).alias("x")
        cells = _each(self.table, sorted(shifted), value).where("x is not null").select("k", "x")
        if self.table.rows <= MEDIAN_ROWS:
            return {r.k: r.m for r in cells.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
        return exact_medians(cells, MEDIAN_VALUES)

    @shared
    def center(self) -> dict[int, tuple[float, float]]:
        """Median and median absolute deviation of the number columns that can have outliers."""
        columns = [k for k in self.table.of_kind("number") if self.plain[k]["values"] >= 20 and self.distinct(k) >= 5]
        middle = self.medians({k: float("nan") for k in columns})
        spread = self.medians(middle)
        return {k: (middle[k], spread[k]) for k in columns}


def exact_medians(cells: DataFrame, most: int) -> dict[int, float]:
    """Exact medians of (k, x) by narrowing: sketches bracket the middle ranks, and only a bracket's value counts are ordered.

    A round reads the data twice and keeps about a hundredth, for all columns at once; the driver gets
    at most ``most`` value counts a column, and no task ever holds a column.
    """
    n = {r.k: r.n for r in cells.groupBy("k").agg(F.count("*").alias("n")).collect()}
    low, high, below = dict.fromkeys(n, float("-inf")), dict.fromkeys(n, float("inf")), dict.fromkeys(n, 0)
    size, done = dict(n), {}
    while open_ := [k for k in n if k not in done]:
        pick = lambda of: F.create_map(*(y for k in open_ for y in (F.lit(k), F.lit(of[k]))))[F.col("k")]  # noqa: E731,B023
        inside = cells.where(F.col("k").isin(*open_) & (F.col("x") >= pick(low)) & (F.col("x") <= pick(high)))
        small = [k for k in open_ if size[k] <= most or low[k] == high[k]]
        if small:
            counts: dict[int, list] = {k: [] for k in small}
            for r in inside.where(F.col("k").isin(*small)).groupBy("k", "x").agg(F.count("*").alias("n")).collect():
                counts[r.k].append((r.x, r.n))
            for k in small:
                rank, got = below[k], []
                for x, times in sorted(counts[k]):
                    got += [x] * sum(rank <= w < rank + times for w in ((n[k] - 1) // 2, n[k] // 2))
                    rank += times
                done[k] = sum(got) / 2
        wide = [k for k in open_ if k not in done]
        if not wide:
            break
        middle = {k: (n[k] / 2 - below[k]) / size[k] for k in wide}
        # sketches take constant shares only: one grid for the middles of all columns
        grid = sorted({min(1.0, max(0.0, middle[k] + s)) for k in wide for s in (-0.005, 0.005)})
        marks = {r.k: r.q for r in inside.where(F.col("k").isin(*wide)).groupBy("k").agg(F.percentile_approx("x", grid, 2000).alias("q")).collect()}
        a = {k: marks[k][grid.index(min(1.0, max(0.0, middle[k] - 0.005)))] for k in wide}
        b = {k: marks[k][grid.index(min(1.0, max(0.0, middle[k] + 0.005)))] for k in wide}
        at = lambda of: F.create_map(*(y for k in wide for y in (F.lit(k), F.lit(of[k]))))[F.col("k")]  # noqa: E731,B023
        parts = inside.where(F.col("k").isin(*wide)).groupBy("k").agg(F.count_if(F.col("x") < at(a)).alias("less"), F.count_if(F.col("x") == at(a)).alias("first"), F.count_if(F.col("x") == at(b)).alias("last"), F.count_if(F.col("x") > at(b)).alias("more")).collect()
        for r in parts:
            k, lo, hi = r.k, (n[r.k] - 1) // 2, n[r.k] // 2
            start, end = below[k] + r.less, below[k] + size[k] - r.more
            if start <= lo and hi < end:  # the middle is in [a, b]
                if start <= lo and hi < start + r.first:
                    low[k] = high[k] = a[k]
                    below[k], size[k] = start, r.first
                elif end - r.last <= lo and hi < end:
                    low[k] = high[k] = b[k]
                    below[k], size[k] = end - r.last, r.last
                elif end - start < size[k]:
                    low[k], high[k], below[k], size[k] = a[k], b[k], start, end - start
                else:  # nothing gained: order what there is
                    most = max(most, size[k])
            elif hi < start:
                high[k], size[k] = a[k], r.less + r.first
            elif lo >= end:
                low[k], below[k], size[k] = b[k], end - r.last, r.last + r.more
            else:  # the middle straddles an edge
                most = max(most, size[k])
    return done
