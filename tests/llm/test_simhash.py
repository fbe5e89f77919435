from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sieveworks.llm import simhash
from sieveworks.llm.common import Scratch


def brute_fingerprint(text: str, size: int = 4) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    n = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    root = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_stated_vote(spark):
    for text in ("", "one", "One two", "a b c d e f g a b c d", "Été A b c\x1cd e", "x " * 20_000):
        assert simhash.fingerprint(text.encode()) == signed(brute_fingerprint(text))


def test_spark_hash_agrees(spark):
    one = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one == signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    fps = {}
    for _ in range(40):  # scattered
        fps[len(fps)] = rng.getrandbits(64)
    for _ in range(6):  # chains of steps up to four bits, and balls with more members than DENSE
        x = rng.getrandbits(64)
        for _ in range(8):
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps[len(fps)] = x
    centre = rng.getrandbits(64)
    for _ in range(60):
        fps[len(fps)] = centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
    want = brute_components(fps)
    for dense in (2, simhash.DENSE):
        rows = spark.createDataFrame([(signed(v),) for v in set(fps.values())], "fp long")
        scratch = Scratch(spark, "test")
        root = {r.node: r.root for r in simhash.components(simhash.links(rows, scratch, dense), scratch).collect()}
        groups: dict[int, set] = {}
        for k, v in fps.items():
            groups.setdefault(root.get(signed(v), signed(v)), set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in fps if want[k] == r) for r in set(want.values()))


def test_components_with_many_forests(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FOREST_ROWS", 10)
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(-5, k) for k in range(400, 450)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = simhash.components(spark.createDataFrame(edges, "a long, b long").where("a <> b"), Scratch(spark, "test")).collect()
    assert {r.node: r.root for r in found} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == by[3].component_id == by[6].component_id == 2
    assert by[1].component_id == 1 and by[None].component_id is None
    assert simhash.near_duplicates(no_documents).count() == 0


def edited(rng, words, changes):
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"e{rng.random()}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    docs = []
    for i in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 300))]
        docs += [(len(docs) + j, " ".join(base) if j < 2 else edited(rng, base, rng.choice((1, 1, 2, 40)))) for j in range(rng.randint(1, 5))]
    docs += [(len(docs) + j, f"short {j} text") for j in range(20)]
    likeness = {(a, b): simhash.shingle_likeness(x.encode(), y.encode()) if x.split() or y.split() else 1 for a, x in docs for b, y in docs if a < b}
    root = {a: a for a, _ in docs}
    for _ in range(20):
        for (a, b), n in likeness.items():
            if n >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    for how in ({"dense": 2}, {"hot": 2, "dense": 100}):
        found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()}
        assert found == root


def test_near_copies_of_one_text_stay_one(spark):
    rng = random.Random(13)
    base = [f"w{i}" for i in range(300)]
    docs = [(i, edited(rng, base, 1)) for i in range(200)] + [(1000 + i, " ".join(base)) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.component_id for r in simhash.near_copies(df).collect()} == {0}
    assert [r.doc_id for r in simhash.without_near_copies(df).collect()] == [0]


def test_texts_that_share_one_hash_stay_apart(spark, monkeypatch):
    docs = [(i, f"text number {i // 2} of its own") for i in range(12)]
    monkeypatch.setattr(simhash, "_hashes", lambda text: (F.xxhash64(F.substring(text, 1, 4)), F.xxhash64(text)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()} == {i: i // 2 * 2 for i in range(12)}
    assert sorted(r.doc_id for r in simhash.without_near_copies(df).collect()) == [0, 2, 4, 6, 8, 10]


def test_clashing_names(spark):
    names = ("_id", "_key", "_times", "_row_key", "row", "id", "key", "other", "check", "times")
    df = spark.createDataFrame([(1, "a b c", *range(10)), (2, "a b c", *range(10)), (None, None, *range(10))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    kept = simhash.without_near_copies(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c", *range(10)), (None, None, *range(10))]


def test_query_equals_a_plain_computation(spark):
    sf = "/root/testdata/sf0.01"
    fps = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    root = {k: k for k in fps}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(fps)
    for i, b in enumerate(ids):
        for a in ids[:i]:
            if ((fps[a] ^ fps[b]) & 2**64 - 1).bit_count() <= 4 and (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
    rows = simhash.op4_simhash(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(k, f"{v & 2**64 - 1:016x}", top(k)) for k, v in fps.items()}


def test_near_copies_of_odd_rows(spark, odd_documents, no_documents):
    rows = simhash.near_copies(odd_documents).collect()
    assert len(rows) == 8 and {r.component_id for r in rows if r.doc_id in (2, 3, 6)} == {2}
    assert simhash.near_copies(no_documents).count() == 0 and simhash.without_near_copies(odd_documents).columns == odd_documents.columns


def likeness_groups(texts):
    """The least number reachable over all pairs of a likeness of 0.8, by number of text."""
    sets = []
    for text in texts:
        words = text.split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            shared = len(sets[a] & sets[b])
            if shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8 and (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in range(len(texts))}


def copy_groups(spark, texts, **how):
    rows = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **how).collect()
    return {r.doc_id: r.component_id for r in rows}


def test_near_copies_with_added_and_missing_passages(spark):
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(60, 300))]
        k, at = int(len(base) * rng.uniform(0.05, 0.22)), rng.randrange(len(base) // 2)
        new = [word() for _ in range(k)]
        kinds = [base + new, base[:-k], base[:at] + new + base[at:], base[:at] + new[: k // 2] + base[at + k // 2 :]]
        texts += [" ".join(base), " ".join(rng.choice(kinds))]
    want = likeness_groups(texts)
    assert 60 < len(set(want.values())) < 110
    for how in ({}, {"dense": 1}):
        assert copy_groups(spark, texts, **how) == want


def test_near_copies_among_texts_of_the_same_words(spark):
    rng = random.Random(15)
    blocks = [[f"b{i}w{j}" for j in range(15)] for i in range(20)]
    texts = []
    for _ in range(40):
        order = rng.sample(range(20), 20)
        swapped = list(order)
        swapped[3], swapped[4] = swapped[4], swapped[3]
        texts += [" ".join(w for i in x for w in blocks[i]) for x in (order, swapped)]
    want = likeness_groups(texts)
    assert len(set(want.values())) == 40
    assert copy_groups(spark, texts) == want


def test_near_copies_within_crowds(spark, monkeypatch):
    rng = random.Random(16)
    base = [f"w{i}" for i in range(300)]

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = rng.choice(base)
        return words

    texts = []
    for _ in range(250):
        one = changed(base, 12)
        texts += [" ".join(one), " ".join(changed(one, 2))]
    want = likeness_groups(texts)
    assert 100 < len(set(want.values())) < 300
    assert copy_groups(spark, texts) == want
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 20_000)
    assert copy_groups(spark, texts, hot=20, dense=1000) == want


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(17)
    for size in (1, 5, 300, 3000):
        base = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        for changed in (0, 1, size // 10, size):
            other = np.unique(np.concatenate((base[changed:], rng.integers(-(2**63), 2**63 - 1, changed))))
            a, b = (np.frombuffer(simhash.sketch(x), np.uint64) for x in (base, other))
            bits = np.bitwise_count(a ^ b).sum()
            assert bits <= len(np.setxor1d(base, other))
            assert changed or not bits


def test_pairs_that_share_many_shingles_are_made_about_once(spark):
    rng = random.Random(18)
    texts = []
    for i in range(40):
        base = [f"t{i}w{j}" for j in range(200)]
        texts += [edited(rng, base, 2) for _ in range(4)]
    want = likeness_groups(texts)
    made = []
    keep = simhash.Scratch.keep

    def counted(self, df, name):
        found = keep(self, df, name)
        if name == "pairs":
            made.append((found.count(), found.distinct().count()))
        return found

    simhash.Scratch.keep = counted
    try:
        assert copy_groups(spark, texts) == want
    finally:
        simhash.Scratch.keep = keep
    rows, pairs = made[0]
    assert 240 == pairs <= rows <= 8 * pairs
