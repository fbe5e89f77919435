from __future__ import annotations

import hashlib
import random
import re

from sieveworks.llm import spotsigs


def brute_signatures(text: str) -> set[str]:
    common = set(spotsigs.COMMON) - set(spotsigs.ANCHORS)
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in common]
    found = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if chain:
                found.add(" ".join((w, *chain)))
    return found or {"\0" + text}


def brute_likeness(a: str, b: str) -> float:
    x, y = brute_signatures(a), brute_signatures(b)
    return len(x & y) / len(x | y)


def brute_rows(docs: list[tuple]) -> dict:
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), brute_likeness(text, edited), brute_likeness(text, after))
    return out


def run(spark, docs, tmp_path):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return spotsigs.op1_spotsigs(spark, str(tmp_path)).collect()


def test_rows_equal_brute_force(spark, tmp_path):
    rng = random.Random(7)
    words = ["the", "of", "and", "der", "über", "que", "about", *(f"w{i}" for i in range(30)), "\U0001f600", "Été"]
    docs = [(i * i * (1 if i % 2 else 50), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs[5], docs[6], docs[9] = (docs[5][0], None), (docs[6][0], ""), (docs[9][0], docs[8][1])
    rows, want = run(spark, docs, tmp_path), brute_rows(docs)
    assert len(rows) == 400
    for r in rows:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and abs(r.near_edited - edited) < 1e-12 and abs(r.near_next - after) < 1e-12
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)


def test_lone_and_no_documents(spark, tmp_path):
    (row,) = run(spark, [(3, "the cat sat on the mat")], tmp_path / "one")
    assert row.near_next == 1 and row.n_chars == 22
    assert run(spark, [], tmp_path / "none") == []


def test_odd_rows(spark, tmp_path, odd_documents):
    odd_documents.write.parquet(f"{tmp_path}/documents.parquet")
    rows = spotsigs.op1_spotsigs(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and len({r.fingerprint for r in rows if r.doc_id == 1}) == 1 and sum(r.doc_id is None for r in rows) == 1


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for i in range(30):
        base = [f"the x{i}y{k} z{k}" for k in range(rng.randint(3, 40))]
        for j in range(rng.randint(1, 4)):
            docs.append((len(docs), " ".join(p if rng.random() > 0.04 * j else f"the q{rng.random()}" for p in base)))
    docs += [(1000, docs[0][1]), (1001, docs[0][1])]
    members, pairs = spotsigs.near_pairs(spotsigs.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")))
    cls = {r.doc_id: r.class_id for r in members.collect()}
    assert len(cls) == len(docs) and cls[1000] == cls[1001] == 0
    got = {(r.a, r.b) for r in pairs.collect()}
    text = dict(docs)
    heads = sorted(set(cls.values()))
    assert got == {(a, b) for a in heads for b in heads if a < b and brute_likeness(text[a], text[b]) >= 0.8}
