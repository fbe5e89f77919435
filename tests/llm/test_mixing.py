from __future__ import annotations

import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from sieveworks.llm import mixing
from sieveworks.llm.common import Scratch


def plain_targets(sizes: list[int], weights: list[int]) -> list[Fraction]:
    """Shares by weight, one stop after the other."""
    out: list = [None] * len(sizes)
    left = Fraction(3, 2) * sum(sizes)
    while open_ := [i for i, x in enumerate(out) if x is None]:
        unit = left / sum(weights[i] for i in open_)
        first = min(open_, key=lambda i: Fraction(2 * sizes[i], weights[i]))
        if unit * weights[first] <= 2 * sizes[first]:
            for i in open_:
                out[i] = unit * weights[i]
            break
        out[first] = Fraction(2 * sizes[first])
        left -= out[first]
    return out


def check_targets(spark, sizes: dict, **options) -> None:
    frame = spark.createDataFrame([("" if k is None else "=" + k, n) for k, n in sizes.items()], "key string, words long")
    rows = {r.key: r for r in mixing.targets(frame, Scratch(spark, "test"), **options).collect()}
    order = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    goals = plain_targets([sizes[k] for k in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    assert len(rows) == len(sizes)
    for i, (k, goal) in enumerate(zip(order, goals)):
        r = rows["" if k is None else "=" + k]
        assert (r.source_size, r.slope) == (sizes[k], mixing.SLOPES[i % 3]) and abs(r.target - goal) <= 1e-12 * goal
        assert abs(r.whole * sizes[k] + r.rest - goal) <= 1e-9 * goal


def test_targets_equal_plain_ones(spark):
    rng = random.Random(4)
    for sizes in ({"a": 10, "b": 1000, "c": 300, "d": 0, None: 77}, {"a": 0, None: 0}, {None: 5}, {"z": 10**14, "é": 3, "😀": 10**13 + 1, "": 8}):
        check_targets(spark, sizes)
    check_targets(spark, {f"s{i}": int(rng.paretovariate(0.6)) for i in range(3000)} | {None: 4})


def test_ranks_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 50)
    check_targets(spark, {f"s{i * 7919 % 1009}": i % 17 for i in range(700)} | {None: 4})


def docs(spark, n=3000):
    rows = [(i, " ".join(["w"] * (i * 37 % 41)), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words_meet_targets_and_reruns_agree(spark):
    df = docs(spark)
    rows = mixing.mixed(df).collect()
    text = {r.doc_id: r for r in df.collect()}
    assert len(rows) == 3000
    by: dict = {}
    for r in rows:
        assert r.size == len(re.findall(mixing.WORD, text[r.doc_id].text)) and r.copies * r.size <= 2 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
        by.setdefault(text[r.doc_id].source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 41
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies, r.positions) for r in rows) == sorted((r.doc_id, r.copies, r.positions) for r in again)


def test_positions_invert_the_schedule(spark):
    df = docs(spark)
    rows = [r for r in mixing.mixed(df).collect() if r.size]
    order = sorted({r.source_size: None for r in rows})
    assert len(order) == 7
    slopes = {}
    names = sorted({r.source for r in df.collect()} - {None}) + [None]
    sizes = {r.doc_id: r.source for r in df.collect()}
    for i, name in enumerate(names):
        slopes[name] = mixing.SLOPES[i % 3]
    of = {sizes[r.doc_id]: r.target for r in rows}
    tilt = sum(slopes[k] * t for k, t in of.items()) / sum(of.values())

    def time(p):  # of a position: the inverse of the share of all demand
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if mid + tilt * (mid * mid - mid) < p else (low, mid)
        return low

    for name in names:
        own = sorted((p, r.size, r.target) for r in rows if sizes[r.doc_id] == name for p in r.positions)
        done = 0
        for p, size, target in own:  # demand up to a copy's position is the words before it
            s = time(p)
            assert abs((s + slopes[name] * (s * s - s)) * target - done) < 1e-6 * target + 41
            done += size
    # positions are even in words, and the words of any stretch have the scheduled shares
    copies = sorted((p, r.size, sizes[r.doc_id]) for r in rows for p in r.positions)
    total, done = sum(of.values()), 0
    for p, size, _ in copies:
        assert abs(p * total - done) < 41 * 7 * 2
        done += size
    for k in range(5):
        part = [(n, name) for p, n, name in copies if k / 5 <= p < (k + 1) / 5]
        a, b = time(k / 5), time((k + 1) / 5)
        for name in names:
            want = of[name] * ((b - a) + slopes[name] * (b * b - b - a * a + a))
            assert abs(sum(n for n, x in part if x == name) - want) < 41 * 3


def test_training_order(spark, odd_documents, no_documents):
    df = docs(spark)
    mix = mixing.training_order(df)
    assert mix.columns == ["doc_id", "text", "source"]
    at: dict = {}
    for r in mixing.mixed(df, keep_wordless=True).collect():
        at[r.doc_id] = sorted(r.positions)
    said = [r.doc_id for r in mix.collect()]
    found = [at[k].pop(0) for k in said]
    assert found == sorted(found) and not any(at.values())
    assert said == [r.doc_id for r in mixing.training_order(df.repartition(5)).collect()]
    odd = mixing.training_order(odd_documents)
    assert odd.columns == odd_documents.columns and odd.count() >= 3
    mapped = odd_documents.select("*", F.create_map(F.lit("a"), F.lit(1)).alias("row"), F.lit(0).alias("at"), F.lit(0).alias("tie"))
    assert mixing.training_order(mapped).columns == mapped.columns
    assert len(mixing.mixed(odd_documents).collect()) == 8
    assert mixing.training_order(no_documents).count() == 0


def test_query(spark):
    rows = mixing.op7_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.taken <= 2 * r.size for r in rows)
    assert all((r.first_position is None) == (r.taken == 0) for r in rows)
