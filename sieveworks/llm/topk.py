"""Exact top-k inner products by norm-sorted scans with SVD-rotated partial sums.

Components become floor(256 x). Candidates are sorted by descending length over all partitions (ties
by id, so equal vectors spread). Queries come in blocks of ``QUERY_BLOCK``, a bounded broadcast; each
block is held against all candidates, no row is copied or shuffled for it:

1. The longest candidates give each query a first k-th score, a lower bound of its final one.
2. A task walks its candidates from long to short. A query whose length times the next candidate's
   is below its k-th score is done with the task.
3. For the others the first rotated components (principal directions of all candidates) are
   multiplied; the rest is at most the product of the residual lengths (Cauchy-Schwarz). Only where
   partial sum and bound reach the k-th score is the integer product computed.
4. Each task returns at most k rows a query, and these are ranked at last.

Vectors that are null or hold a null or non-finite component take no part, nor do rows with a null
id; shorter vectors count as filled with zeros. Rows of the query's own id are no candidates; a
query row that repeats is a query of its own. An empty table, or one without queries, gives no rows.
Scores are exact while they fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, partitions, table

QUERY_BLOCK = 8192
HEAD = 2048
PARTS = 16
STEP = 1024
SLACK = 1e-6


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: the integer components of every vector that takes part."""
    fits = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fits).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of the rows; by floating point where that is exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Principal directions, strongest first, from the second moments of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = rows.select("v").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    flat = np.zeros(width * width)
    for r in sums:  # width squared rows
        flat[r.i] = r.x
    return np.linalg.svd(flat.reshape(width, width))[0]


class Scan:
    """A block of queries, walked over candidates in order of descending length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.turn, self.k = ids, q, turn[:, :PARTS], k
        f = q.astype(np.float64)
        self.norm = np.sqrt((f * f).sum(axis=1))
        self.part = f @ self.turn
        self.rest = np.sqrt(np.maximum(0, self.norm**2 - (self.part**2).sum(axis=1)))
        self.kth = np.full(len(ids), -np.inf)

    def best(self, which: np.ndarray, vec: np.ndarray, score: np.ndarray, raise_bar: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of some (query, candidate, score), ties to smaller ids; raises the bar of queries that have k."""
        order = np.lexsort((vec, -score, which))
        which, vec, score = which[order], vec[order], score[order]
        start = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        rank = np.arange(len(which)) - np.repeat(start, np.diff(np.append(start, len(which))))
        if raise_bar:
            last = rank == self.k - 1
            self.kth[which[last]] = np.maximum(self.kth[which[last]], score[last])
        keep = rank < self.k
        return which[keep], vec[keep], score[keep]

    def meet(self, vec: np.ndarray, c: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs of the queries with some candidates that can still count."""
        slack = SLACK * (1 + self.norm * norm.max(initial=0))
        open_ = np.flatnonzero(self.norm * norm.max(initial=0) + slack >= self.kth)
        part = c.astype(np.float64) @ self.turn
        rest = np.sqrt(np.maximum(0, norm**2 - (part**2).sum(axis=1)))
        bound = self.part[open_] @ part.T + self.rest[open_, None] * rest[None, :] + slack[open_, None]
        a, b = np.nonzero(bound >= self.kth[open_, None])
        if len(a) * 4 > bound.size:
            score = _product(self.q[open_], c)[a, b]
        else:
            score = np.einsum("ij,ij->i", self.q[open_[a]], c[b])
        a = open_[a]
        fits = (score >= self.kth[a]) & (self.ids[a] != vec[b])
        return a[fits], vec[b[fits]], score[fits]


def top_k(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of df for each row of queries."""
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    rows, asked = whole_vectors(df, id_col, vector_col), whole_vectors(queries, id_col, vector_col)
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    filled = F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("long"), width)), 1, width).alias("v")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("norm")
    rows = rows.select("vec_id", filled).select("vec_id", "v", length)
    rows = scratch.keep(rows.repartitionByRange(partitions(spark), F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"), "candidates")
    turn = rotation(rows, width)
    asked = asked.select("vec_id", filled)
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))  # hashed blocks stay below QUERY_BLOCK
    asked = scratch.keep(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), "queries")
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()
    head = tuple(np.array([r[i] for r in longest]) for i in range(3))
    found = []
    for block in range(blocks):
        own = asked.where(F.col("block") == block).orderBy("vec_id", "v").collect()  # a bounded block
        if not own:
            continue
        first = Scan(np.array([r.vec_id for r in own]), np.array([r.v for r in own], np.int64).reshape(-1, width), turn, k)
        if len(longest):
            first.best(*first.meet(head[0], head[1].astype(np.int64), head[2]))
        shared = spark.sparkContext.broadcast(first)

        def walk(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            scan = shared.value
            have = tuple(np.zeros(0, np.int64) for _ in range(3))
            for batch in batches:
                vec, norm = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("vec_id", "norm"))
                c = _matrix(batch.column("v"), width)
                for at in range(0, len(vec), STEP):
                    met = scan.meet(vec[at : at + STEP], c[at : at + STEP], norm[at : at + STEP])
                    have = scan.best(*(np.concatenate(x) for x in zip(have, met)))
            ids = [pa.array(scan.ids[have[0]]), pa.array(have[0]), pa.array(have[1]), pa.array(have[2])]
            yield pa.RecordBatch.from_arrays(ids, names=["query_id", "q", "vec_id", "score"])

        best = rows.mapInArrow(walk, "query_id long, q long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.append(scratch.keep(best, f"found{block}") if blocks > 1 else best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
