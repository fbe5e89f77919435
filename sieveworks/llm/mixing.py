"""Mixing sources to target weights along a curriculum.

Sources, ordered by code point with null last, get weights in turn. They share ``share`` times all
words; a target stops at ``most`` times its source's words, and the excess is shared again by weight
until no target is above its stop. Within a source documents stand in a fixed shuffled order (by
hash of id and text). A source is gone through as often as fits its target whole, then once more up
to the document whose middle passes the target; so a source's words miss its target by half a
document at most, and no document is taken more than ``most`` times (rounded up).

The weight of a source may change over training: its density at schedule time s in [0, 1] is
``1 + slope * (2 s - 1)``. The integral of that density times the target is the demand for its words
up to s; inverting it at a copy's first word gives the copy's schedule time. A position is the share
of all demand up to that time, so at any position the sources have the shares of words that their
targets times densities have of the sum over all sources, and positions are even in words.

Running totals are distributed: an order is cut into at most 65,536 ranges of its hash per source,
totals of the ranges are summed up before, and each range is summed in a task of its own, so a
source with any part of the rows is spread over tasks. Sources may be any number: their ranks, targets
and the sum of densities are computed by jobs over a table with a row for each.

Null texts have size 0, as empty ones; documents without words are not taken, or once with
``keep_wordless``; null sources are a source of their own; rows that repeat are mixed as rows of their
own; a null id is an id like others; copies at one position stand in the order of a hash of their
columns; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, sums_before, table

WEIGHTS = (3, 1, 2)
#: Slopes of the densities, in turn as the weights: the first come early, the second late.
SLOPES = (-0.5, 0.5, 0.0)
SHARE = Fraction(3, 2)
MOST = 2
#: Sources that one task ranks, about.
RANKED = 100_000


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """key, words and rank (from 0, by code point, the null source last) of a row for each source."""
    order = [F.col("key") == "", F.col("key")]
    parts = sources.count() // RANKED + 1
    dealt = scratch.keep(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources")
    ahead, offsets = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row for RANKED sources
        offsets.append((r["part"], ahead))
        ahead += r["count"]
    offset = dealt.sparkSession.createDataFrame(offsets, "part int, ahead long")
    within = Window.partitionBy("part").orderBy(*order)
    return dealt.join(offset, "part").select("key", "words", (F.col("ahead") + F.row_number().over(within) - 1).alias("rank"))


def targets(sources: DataFrame, scratch: Scratch, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """key, source_size, target, whole and rest (target = whole * source_size + rest), and slope, from (key, words).

    Each round shares what is left by weight among the sources below their stop, until no more reach it.
    """
    in_turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("rank") % len(values) + 1).cast("int"))
    weighed = scratch.keep(ranked(sources, scratch).select("key", "words", in_turn(weights).alias("weight"), in_turn([float(x) for x in slopes]).alias("slope")), "weighed")
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    sums = lambda df: tuple(x or 0 for x in df.agg(F.sum("words"), F.sum("weight"), F.count("*")).first())
    words, weight, _ = sums(weighed)
    stopped = (0, 0, 0)
    while True:
        open_weight = weight - stopped[1]
        unit = (share * words - most * stopped[0]) / open_weight if open_weight else Fraction(0)
        due = whole(unit.numerator) * F.col("weight")  # in parts of the denominator
        held = whole(unit.denominator) * F.col("words")
        above = (due > most * held) if open_weight else F.lit(True)
        found = sums(weighed.where(above))
        if found == stopped:
            break
        stopped = found
    below = unit.denominator
    times = F.when(above, F.lit(most)).otherwise(F.when(F.col("words") > 0, F.call_function("div", due, held)).otherwise(F.lit(0))).cast("long")
    rest = F.when(above, F.lit(0.0)).otherwise((due - times * held).cast("double") / below)
    target = F.when(above, (most * F.col("words")).cast("double")).otherwise(due.cast("double") / below)
    return scratch.keep(weighed.select("key", F.col("words").alias("source_size"), target.alias("target"), times.alias("whole"), rest.alias("rest"), "slope"), "targets")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: Fraction = SHARE, most: int = MOST, carry: Sequence[str] = (), keep_wordless: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, copies, positions (one for each copy), and row: the carried columns, of every row."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    place = F.xxhash64(F.col(id_col), F.col(text_col))
    row = [F.struct(*carry).alias("row")] if carry else []
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), size.alias("size"), place.alias("place"), *row).withColumn("range", F.shiftrightunsigned("place", 48).cast("int"))
    scratch = Scratch(df.sparkSession, "mixing")
    rows = rows if carry else scratch.keep(rows, "rows")  # words are counted once
    cells = scratch.keep(rows.groupBy("key", "range").agg(F.sum("size").alias("words")), "cells")
    goals = targets(cells.groupBy("key").agg(F.sum("words").alias("words")), scratch, weights, share, most, slopes)
    bent, all_words = goals.agg(F.sum(F.col("target") * F.col("slope")), F.sum("target")).first()
    tilt = bent / all_words if all_words else 0.0
    offsets = sums_before(cells, ["key"], "range", "words", 256).withColumnRenamed("before", "offset").join(goals, "key")
    within = Window.partitionBy("key", "range").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["key", "range"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("start") + F.col("size") / 2 <= F.col("rest")).cast("long")).otherwise(F.lit(int(keep_wordless))).cast("int")

    def position(copy: Column) -> Column:
        done = F.least(F.lit(1.0), F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("start")) / F.col("target")).otherwise(F.lit(0.0)))
        bend = 1 - F.col("slope")
        at = 2 * done / (bend + F.sqrt(bend * bend + 4 * F.col("slope") * done))
        return at + tilt * (at * at - at)

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("copies", copies).withColumn("positions", positions).select("doc_id", "size", "source_size", "target", "copies", "positions", *(["row"] if carry else []))


def training_order(df: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of df, each as often as it is taken, sorted over all partitions by position. Documents without words stand once."""
    copies = mixed(df, carry=df.columns, keep_wordless=True, **options).select("row", F.explode("positions").alias("at"))
    plain = [f.name for f in df.schema if not {"map<", "variant"} & {x for x in ("map<", "variant") if x in f.dataType.simpleString()}]
    ties = copies.withColumn("tie", F.xxhash64(*(F.col("row")[c] for c in plain)))
    return ties.repartitionByRange("at", "tie").sortWithinPartitions("at", "tie").select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and where."""
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.get("positions", F.lit(0)).alias("first_position"))
