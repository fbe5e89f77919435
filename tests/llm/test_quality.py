from __future__ import annotations

import zlib

import numpy as np

from sieveworks.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.op8_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [(rows[k].predicted, q) for k, q in labels.items() if k in rows and rows[k].held_out]
    assert len(held) > 80 and np.mean([p == q for p, q in held]) >= 0.95


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    assert np.array_equal(quality.train(docs, labels)["w"], quality.train(docs, flipped)["w"])


def test_pairs_rank_by_what_is_preferred():
    rng = np.random.RandomState(1)
    good, bad = rng.normal(size=(300, 3)) + [2, 0, -1], rng.normal(size=(200, 3))
    w = quality.fit_pairs(good, bad, 5000)
    assert w[0] > 1 and w[2] < -0.5 and abs(w[1]) < 0.3


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    model = quality.train(odd_documents, labels)
    rows = quality.scored(odd_documents, model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert quality.good_only(odd_documents, labels).columns == odd_documents.columns
    assert quality.scored(no_documents, quality.train(no_documents, labels)).count() == 0
    assert {r.score for r in quality.scored(odd_documents, quality.train(no_documents, labels)).collect()} == {0.5}


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 40)
    monkeypatch.setattr(quality, "BLOCK_RARE", 10)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    blocks, keep = {}, quality.Scratch.keep

    def kept(self, df, name):
        found = keep(self, df, name)
        blocks[name] = found.collect()
        return found

    monkeypatch.setattr(quality.Scratch, "keep", kept)
    model = quality.train(docs, labels)
    marks = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: quality.features((r.text or "").encode()) for r in docs.collect()}
    want = {k: sorted(texts[i].tobytes() for i, q in marks.items() if q == k and i in texts) for k in (0, 1)}
    width = 8 * quality.FEATURES
    held = {k: [x[i : i + width] for r in blocks["blocks"] for x in [bytes(r[c])] for i in range(0, len(x), width)] for k, c in ((0, "bad"), (1, "good"))}
    assert len(blocks["blocks"]) > 3 and all(len(r.good) and len(r.bad) for r in blocks["blocks"])
    assert sorted(held[1]) == want[1] and sorted(set(held[0])) == sorted(set(want[0]))

    x = np.array([texts[i] for i in marks if i in texts])
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], x.std(axis=0) + 1e-6, atol=1e-6)
    raw = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"]
    bad = sum(q == 0 for i, q in marks.items() if i in texts)
    assert (raw < model["cut"]).sum() == bad


def test_pairs_hold_every_document():
    good, bad = np.arange(1000.0)[:, None], 10_000.0 * np.arange(1, 8)[:, None]
    found = quality.paired(good, bad, 50, 0)[:, 0]
    assert len(found) == 1000 and sorted(set((found + 70_000) % 10_000)) == sorted(good[:, 0])
