from __future__ import annotations

import random

import corpus_pipeline as pipeline
from sieveworks.llm import simhash


def kept_tables(monkeypatch, rows):
    """Counts the rows of all tables that an operator keeps."""
    keep = simhash.Scratch.keep

    def counted(self, df, name):
        found = keep(self, df, name)
        rows[name] = found.count()
        return found

    monkeypatch.setattr(simhash.Scratch, "keep", counted)


def test_the_stage_links_by_simhash_and_compares_only_what_is_left(spark, monkeypatch):
    rng = random.Random(21)
    docs = []
    for i in range(20):
        base = [f"t{i}w{j}" for j in range(2000)]
        other = list(base)
        other[rng.randrange(2000)] = "changed"  # few bits
        docs += [" ".join(base), " ".join(other), " ".join(base + [f"n{i}x{j}" for j in range(400)])]  # the last one's bits are many
    rows: dict = {}
    kept_tables(monkeypatch, rows)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.dedup_stage(spark, df, "").collect()) == list(range(0, 60, 3))
    assert 15 <= rows["compared-simhash"] <= 40 and rows["edges-near"] == 60
    assert rows["edges-new"] == rows["compared"] <= 60 - rows["compared-simhash"]


def test_passages_of_few_texts_make_no_crowds_and_few_pairs(spark, monkeypatch):
    """Passages held by as few texts as a sample of fixed size does not show."""
    rng = random.Random(22)
    passages = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(4)]
    docs = [" ".join([*(f"u{k}x{j}" for j in range(100)), passages[k % 4], *(f"v{k}x{j}" for j in range(40))]) for k in range(800)]
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 20)
    rng.shuffle(docs)
    rows: dict = {}
    kept_tables(monkeypatch, rows)
    found = simhash.near_copies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), hot=50).collect()
    assert all(r.component_id == r.doc_id for r in found) and len(found) == 800
    assert rows["stars"] == 0 and rows["pairs"] == 0 and "prefixes" not in rows
