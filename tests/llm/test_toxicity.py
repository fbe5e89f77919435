from __future__ import annotations

import math
import re
import zlib

import numpy as np

from sieveworks.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.op5_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [(rows[k].predicted, t) for k, t in labels.items() if k in rows and rows[k].held_out]
    caught = [p for p, t in held if t]
    clean = [p for p, t in held if not t]
    assert len(caught) > 50 and np.mean(caught) >= 0.9 and np.mean(clean) <= 0.02


def test_label_model_finds_accuracies_and_discounts_repeats():
    rng = np.random.RandomState(0)
    y = rng.rand(4000) < 0.3
    right = [0.95, 0.9, 0.85, 0.6]
    v = np.stack([np.where(rng.rand(4000) < a, y, ~y) * 2 - 1 for a in right], axis=1)
    v = np.concatenate((v, v[:, 3:], v[:, 3:]), axis=1).astype(np.int8)  # the worst voter three times
    p, shares, related = toxicity.label_model(v, 0.3)
    assert ((p > 0.5) == y).mean() > 0.95
    assert abs(shares[1][0][2] - 0.95) < 0.05 and abs(shares[1][3][2] - 0.6) < 0.1
    assert related[3, 4] > 0.9 and abs(related[0, 1]) < 0.3
    alone, _, _ = toxicity.label_model(v[:, :4], 0.3)
    assert ((p > 0.5) == (alone > 0.5)).mean() > 0.97  # repeats count once


def test_discoveries_equal_the_sorted_rule(spark):
    rng = np.random.RandomState(1)
    logs = np.log(np.concatenate((rng.rand(500), rng.rand(60) * 1e-3)))
    order = np.sort(logs)
    passing = [i + 1 for i, x in enumerate(order) if x <= math.log(0.05 * (i + 1) / len(order))]
    frame = spark.createDataFrame([(float(x),) for x in logs], "log_p double")
    assert toxicity.discoveries(frame, 0.05).count() == (max(passing) if passing else 0) > 20
    assert toxicity.discoveries(frame.where("log_p > -0.1")).count() == 0 == toxicity.discoveries(frame.limit(0)).count()


def test_tails_equal_plain_sums():
    cases = [(5, 5), (6, 20), (0, 7), (30, 40), (900, 3000), (1, 3000)]
    plain = [math.log(min(1, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.15) + (n - k) * math.log(0.85)) for k in range(a, n + 1)))) for a, n in cases]
    found = toxicity.log_tails(np.array([a for a, _ in cases]), np.array([n for _, n in cases]), 0.15)
    assert np.allclose(found, plain, rtol=1e-6, atol=1e-9)


def test_scores_equal_a_plain_computation(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    names = sorted(model["lexicon"], key=model["lexicon"].get)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        words = re.findall(r"\w+", texts[r.doc_id].lower())
        raw = model["bias"] + float(np.dot(model["shape"], toxicity._shape(texts[r.doc_id])))
        for i, e in enumerate(names):
            k, part = int(e[0]), e[1:]
            n = sum(w == part if k == 0 else len(w) > len(part) and (w.startswith(part) if k < 4 else w.endswith(part)) for w in words)
            raw += (n > 0) * model["present"][i] + model["dense"][i] * min(1.0, n / max(1, len(words)) / (2 * toxicity.DENSE))
        assert abs(r.score - 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))) < 1e-9


def test_held_out_labels_are_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a["lexicon"] == b["lexicon"] and np.array_equal(a["present"], b["present"])


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (5, 1)], "doc_id long, toxic int")
    rows = toxicity.scored(odd_documents, toxicity.train(odd_documents, labels)).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.scored(no_documents, toxicity.train(no_documents, labels)).count() == 0
    assert toxicity.train(odd_documents, labels.where("doc_id < 0"))["lexicon"] == {}
