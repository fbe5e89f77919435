from __future__ import annotations

import corpus_pipeline as pipeline
from sieveworks.llm import mixing, packing, quality, simhash

SF = "/root/testdata/sf0.01"


def staged(spark, tmp_path, docs, stage):
    stage(spark, docs, SF).write.parquet(f"{tmp_path}/{stage.__name__}")
    return spark.read.parquet(f"{tmp_path}/{stage.__name__}")


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    raw = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    good = staged(spark, tmp_path, docs, pipeline.quality_stage)
    model = quality.train(docs, labels)
    want = {k for k, r in raw.items() if quality.score(model, quality.features((r.text or "").encode())[None])[0] >= 0.5}
    assert good.columns == docs.columns and {r.doc_id for r in good.select("doc_id").collect()} == want
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(k in want for k, q in marks.items() if q == 1) >= 0.97 * sum(marks.values())

    one = staged(spark, tmp_path, good, pipeline.dedup_stage)
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(good).collect()}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(set(groups.values()))

    clean = staged(spark, tmp_path, one, pipeline.secrets_stage)
    before = {r.doc_id: r for r in one.collect()}
    after = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == docs.columns and before.keys() == after.keys()
    for k, r in after.items():
        assert r.n_chars == (len(r.text) if r.text != before[k].text else before[k].n_chars)

    mix = staged(spark, tmp_path, clean, pipeline.mixing_stage)
    copies = {r.doc_id: r.copies for r in mixing.mixed(clean, keep_wordless=True).collect()}
    times: dict = {}
    for r in mix.select("doc_id").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mix.columns == docs.columns and times == {k: n for k, n in copies.items() if n}

    rows = staged(spark, tmp_path, mix, pipeline.packing_stage).collect()
    used: dict = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in used.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and p[-1][0] + p[-1][1] <= packing.CAPACITY
    assert sum(r.piece == 0 for r in rows) == sum(times.values())


def test_odd_rows_go_through_every_stage(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        frame = docs
        for _, stage in pipeline.STAGES:
            frame = stage(spark, frame, SF)
        frame.collect()
    once = pipeline.dedup_stage(spark, odd_documents, SF).collect()
    assert sorted(r.doc_id for r in once if r.doc_id) == [1, 2, 4, 5] and sum(r.doc_id is None for r in once) == 1


def test_dedup_stage_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    long = sorted((r for r in rows if r.text and len(r.text.split()) >= 100), key=lambda r: r.doc_id)[:60]
    top = max(r.doc_id for r in rows if r.doc_id is not None) + 1
    words = [r.text.split() for r in long]
    made = [w + [f"n{i}" for i in range(len(w) // 8)] for w in words[:15]] + [w[: -(len(w) // 8)] for w in words[15:30]] + [w[len(w) // 3 :] + w[: len(w) // 3] for w in words[30:45]]
    made += [[*words[45][:i], f"x{i}", *words[45][i + 1 :]] for i in range(0, 80, 2)]
    docs = [(r.doc_id, r.text or "") for r in rows] + [(top + i, " ".join(w)) for i, w in enumerate(made)]

    sets = {}
    for k, text in docs:
        w = text.encode().lower().split()
        n = min(pipeline.SHINGLE, len(w))
        sets[k] = {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    root = {k: k for k in sets}

    def head(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, b in enumerate(ids):
        for a in ids[:i]:
            if not sets[a].isdisjoint(sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= pipeline.LIKENESS and (x := head(a)) != (y := head(b)):
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in pipeline.dedup_stage(spark, frame, SF).select("doc_id").collect())
    assert kept == sorted({head(k) for k in ids})
