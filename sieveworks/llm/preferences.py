"""Preference formatting in native columns: one prompt and two masked completions a pair.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and
equal text, place by place) is the prompt and is rendered once; the turns after it are the two
completions. Of a completion the assistant's turns are learned: their texts and end marks, not their
headers, and not other turns. The learned parts are spans (start:end in code points).

A pair is one row as long as no part of it has more than ``CHUNK`` turns. Longer ones go on in further
rows (piece 1 and so on) whose texts follow one another, so a conversation with any number of turns
is spread over tasks. Places are distributed: turns are counted per cell of turn number and hash
before, cells are summed up in blocks, and each cell is numbered by itself.

Equality is that of two independent 64-bit hashes of role and text, not of the rendered string. A
text cannot pose as a mark: ``<|`` in it is rendered as ``<||``, and ``<``, ``|`` and ``>`` in a role as ``_``.

A turn without a pair id belongs to no conversation and is left out; null roles and texts are empty;
a null turn number comes first; equal turn numbers stand in the order of a hash of role and text.
Where a side is missing, its completion is empty, and so is the prompt; equal conversations are all
prompt. Rows that repeat are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

CHUNK = 256
#: Turn numbers of a block of cells.
BLOCK = 256
#: Ids among which a conversation's next one is found by itself.
SPAN = 1024
#: The template of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.translate(role, "<|>", "___"), F.lit(MIDDLE))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(header(role), F.replace(text, F.lit(OPEN), F.lit(OPEN + "|")), F.lit(CLOSE))


def placed(turns: DataFrame) -> DataFrame:
    """pair_id, side, role, text, their two hashes h1 and h2, and place (from 0) in the conversation of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("pair_id").isNotNull()).select("pair_id", F.col("side").cast("int").alias("side"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # the seed of a chain of hashes is the hash of what stands first
    rows = rows.select("*", *(F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("range", F.shiftright("h1", 56).cast("int"))
    conversation = ["pair_id", "side"]
    cell = [*conversation, "block", "turn", "range"]
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    over = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = cells.groupBy(*conversation, "block").agg(F.sum("n").alias("n")).select(*conversation, "block", over(Window.partitionBy(*conversation).orderBy("block")).alias("whole"))
    inside = cells.select(*cell, over(Window.partitionBy(*conversation, "block").orderBy("turn", "range")).alias("part"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) if c in ("block", "turn") else a[c] == b[c] for c in names]
    ahead = inside.join(blocks, same(inside, blocks, [*conversation, "block"])).select(*(inside[c] for c in cell), (F.col("whole") + F.col("part")).alias("ahead"))
    within = Window.partitionBy(*cell).orderBy("h1", "h2")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1)
    return ranked.join(ahead, same(ranked, ahead, cell)).select(*(ranked[c] for c in conversation), "role", "text", "h1", "h2", (F.col("ahead") + F.col("rank")).alias("place"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """From (pair_id, side: 0 chosen or 1 rejected, turn, role, text): the formatted pairs.

    pair_id, piece, n_prompt (turns of the prompt in this piece), prompt, chosen, rejected, and
    chosen_learn and rejected_learn: the learned spans of the two, comma-joined.
    """
    found = placed(turns)
    ends = [f(h).alias(f"{name}_{h}") for h in ("h1", "h2") for name, f in (("low", F.min), ("high", F.max))]
    both = found.groupBy("pair_id", "place").agg(F.count("*").alias("n"), *ends)
    apart = (F.col("n") < 2) | (F.col("low_h1") != F.col("high_h1")) | (F.col("low_h2") != F.col("high_h2"))
    forks = both.where(apart).groupBy("pair_id").agg(F.min("place").alias("fork"))
    joined = found.join(forks, "pair_id", "left")
    shared = F.col("fork").isNull() | (F.col("place") < F.col("fork"))
    place = F.col("place") - F.when(shared, F.lit(0)).otherwise(F.col("fork"))
    part = F.when(shared, F.lit(-1)).otherwise(F.col("side"))
    turn = F.struct(place.alias("place"), rendered(F.col("role"), F.col("text")).alias("segment"), F.length(header(F.col("role"))).alias("head"), (F.col("role") == LEARNED).alias("learn"))
    rows = joined.where((F.col("side") == 0) | ~shared).select("pair_id", F.floor(place / CHUNK).cast("int").alias("piece"), part.alias("part"), turn.alias("turn"))
    # at most CHUNK turns of each part
    own = lambda k: F.sort_array(F.collect_list(F.when(F.col("part") == k, F.col("turn"))))
    rows = rows.groupBy("pair_id", "piece").agg(own(-1).alias("prompt"), own(0).alias("chosen"), own(1).alias("rejected"))
    text = lambda c: F.array_join(F.col(c)["segment"], "")

    def learned(c: str) -> Column:
        def step(state: Column, t: Column) -> Column:
            end = state["at"] + F.length(t["segment"])
            span = F.array(F.concat_ws(":", state["at"] + t["head"], end - 1))
            return F.struct(end.alias("at"), F.when(t["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
        return F.aggregate(c, first, step, lambda s: F.array_join(s["spans"], ","))

    return rows.select("pair_id", "piece", F.size("prompt").alias("n_prompt"), *(text(c).alias(c) for c in ("prompt", "chosen", "rejected")), *(learned(c).alias(f"{c}_learn") for c in ("chosen", "rejected")))


def rejected_by_shift(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) from single conversations: a conversation is chosen, and rejected with a wrong end.

    Its turns up to its last assistant's are both sides; in place of that one stands, as rejected, the last
    assistant's turn of the conversation with the next id (the first one's for the last). A
    conversation without an assistant's turn has no pair. Equal last turn numbers count as one: the
    smallest text of them stands.
    """
    own = turns.where(F.col("conv_id").isNotNull()).select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = own.where(F.col("role") == LEARNED).groupBy("conv_id").agg(F.min(F.struct((-F.col("turn").cast("decimal(20,0)")).alias("last"), "turn", F.coalesce("text", F.lit("")).alias("text"))).alias("end"))
    last = last.select("conv_id", F.col("end.turn").alias("end"), F.col("end.text").alias("text"))
    # the next id, in ranges of ids: the first row of a range comes from the range after it
    span = F.floor(F.col("conv_id") / SPAN)
    firsts = last.groupBy(span.alias("span")).agg(F.min(F.struct("conv_id", "text")).alias("first"))
    order = Window.orderBy("span")  # a row for SPAN ids
    after = firsts.select("span", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    rejected = last.withColumn("span", span).join(after, "span")
    following = F.lead("text").over(Window.partitionBy("span").orderBy("conv_id"))
    rejected = rejected.select("conv_id", "end", F.coalesce(following, F.col("after.text")).alias("other"))
    sides = own.join(rejected, "conv_id").where(F.col("turn") <= F.col("end")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    wrong = (F.col("side") == 1) & (F.col("turn") == F.col("end")) & (F.col("role") == LEARNED)
    return sides.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", F.when(wrong, F.col("other")).otherwise(F.col("text")).alias("text"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen, and with the end of the next one as rejected."""
    return format_preferences(rejected_by_shift(table(spark, sf_dir, "conversations")))


OP9_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, turn AS stop, min(coalesce(text, '')) AS text FROM own a WHERE role = 'assistant' AND turn = (SELECT max(turn) FROM own b WHERE b.conv_id = a.conv_id AND b.role = 'assistant') GROUP BY ALL
), others AS (
  SELECT conv_id, stop, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS other FROM ends
), t AS (
  SELECT conv_id AS pair_id, side, turn, coalesce(role, '') AS role, CASE WHEN side = 1 AND turn = stop AND role = 'assistant' THEN other ELSE coalesce(text, '') END AS text
  FROM own JOIN others USING (conv_id) CROSS JOIN (VALUES (0), (1)) s(side) WHERE turn <= stop
), p AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS place, '<|' || translate(role, '<|>', '___') || '|>' || chr(10) AS head FROM t
), s AS (
  SELECT *, head || replace(text, '<|', '<||') || '<|end|>' || chr(10) AS segment FROM p
), f AS (
  SELECT pair_id, min(place) AS fork FROM (SELECT pair_id, place FROM s GROUP BY pair_id, place HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)) GROUP BY pair_id
), d AS (
  SELECT s.pair_id, fork IS NULL OR place < fork AS shared, side, place - CASE WHEN fork IS NULL OR place < fork THEN 0 ELSE fork END AS place, role, head, segment FROM s LEFT JOIN f USING (pair_id)
), w AS (
  SELECT *, place // 256 AS piece, coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, shared, side, place // 256 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beginning FROM d WHERE side = 0 OR NOT shared
)
SELECT pair_id, CAST(piece AS INTEGER) AS piece, CAST(count(*) FILTER (shared) AS INTEGER) AS n_prompt,
       coalesce(string_agg(segment, '' ORDER BY place) FILTER (shared), '') AS prompt,
       coalesce(string_agg(segment, '' ORDER BY place) FILTER (NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg(segment, '' ORDER BY place) FILTER (NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg((beginning + length(head)) || ':' || (beginning + length(segment) - 1), ',' ORDER BY place) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_learn,
       coalesce(string_agg((beginning + length(head)) || ':' || (beginning + length(segment) - 1), ',' ORDER BY place) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_learn
FROM w GROUP BY pair_id, piece
"""
