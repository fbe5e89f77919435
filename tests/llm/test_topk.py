from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from sieveworks.llm import topk


def brute(rows: list[tuple], queries: set[int], k: int) -> list[tuple]:
    fits = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in fits:
        if i in queries:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in fits if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def make(n: int, seed: int) -> list[tuple]:
    rng = np.random.RandomState(seed)
    scale = rng.lognormal(0, 1, n)
    base = rng.normal(size=(n, 5)) @ rng.normal(size=(5, 20)) * scale[:, None] + rng.normal(size=(n, 20)) * 0.1
    base[n // 2 : n // 2 + n // 3] = base[0]
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(base)]


def check(spark, rows, queries, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    found = topk.top_k(df, df.where(F.col("vec_id").isin(sorted(queries))), k)
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute(rows, queries, k)


def test_equal_to_brute_force_with_ties_and_odd_vectors(spark):
    rows = make(900, 1) + [(2000, None), (2001, [None, 1.0]), (2002, [float("nan")]), (2003, [float("inf")]), (2004, []), (2005, [1.0, 2.0]), (None, [1.0]), (2006, [3e4] * 20)]
    check(spark, rows, {0, 7, 450, 2000, 2002, 2004, 2005, 2006}, 5)


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "HEAD", 20)
    monkeypatch.setattr(topk, "STEP", 16)
    check(spark, make(300, 2), set(range(0, 300, 11)), 3)


def test_fewer_than_k_and_none(spark):
    check(spark, [(0, [1.0]), (50, [2.0]), (51, [-1.0])], {0, 50}, 5)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, empty, 5).count() == 0
    odd = spark.createDataFrame([(0, [1.0], 1, 2), (0, [1.0], 1, 2), (1, [2.0], 1, 2)], "vec_id long, embedding array<float>, v int, norm int")
    assert sorted(map(tuple, topk.top_k(odd, odd.where("vec_id = 0"), 5).collect())) == [(0, 1, 1, 131072)] * 2
