from __future__ import annotations

import random
import zlib
from array import array

import public_tokenizers
from tokenizers import Tokenizer

from sieveworks.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
SLOW = Tokenizer.from_file(PATH)


def slow_ids(text: str) -> list[int]:
    return SLOW.encode(text, add_special_tokens=False).ids


def test_encoder_gives_the_ids_of_the_tokenizer_file(spark):
    rng = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "don't WE'LL 12 345 x_y", "été   \x1c   \U0001f600‍", "<|endoftext|> a <|endoftext|>", "z" * 3000]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0x80, 0x3000), 32, 10))) for _ in range(200)) for _ in range(100)]
    assert packing.encoder(PATH)(texts) == [slow_ids(t) for t in texts]


def test_long_runs_of_white_space(spark):
    texts = [f"{a}{space * n}{b}" for space in " \t\n" for n, a, b in ((9_999, "word", "word"), (10_000, "", ""), (1_000_000, "word", "word"))] + [" " * 5_000_000]
    want = {i: zlib.crc32(array("I", (SLOW.encode(t, add_special_tokens=False).ids + [2])[-1024:]).tobytes()) for i, t in enumerate(texts)}
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    last = {r.doc_id: r for r in sorted(rows, key=lambda r: r.piece)}
    assert {k: r.ids_crc32 for k, r in last.items() if r.length == 1024} == {k: want[k] for k, r in last.items() if r.length == 1024}
    ids = packing.encoder(PATH)(texts)
    assert all(crc == zlib.crc32(array("I", (own + [2])[-1024:]).tobytes()) for own, crc in zip(ids, want.values()))


def test_query_is_best_fit_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = packing.op2_packing(spark, sf).collect()
    lengths = []
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for text in docs.values():
        n = len(SLOW.encode(text or "", add_special_tokens=False).ids) + 1
        lengths += [1024] * (n // 1024) + [n % 1024] * (n % 1024 > 0)
    assert sorted(lengths) == sorted(r.length for r in rows)
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= length), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((1024 if best is None else best) - length)
    assert len({r.sequence_id for r in rows}) == len(rooms)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and p[-1][0] + p[-1][1] <= 1024


def test_plan_fills_each_slot_once_and_packs_well():
    rng = random.Random(2)
    for _ in range(50):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 65), rng.randint(1, 40))}
        runs, sequences = packing.plan(counts, 64)
        used: dict[int, list[tuple[int, int]]] = {}
        for length, n in counts.items():
            ranks = sorted(r for r in runs if r[0] == length)
            assert [r[1] for r in ranks] == [0, *(r[2] for r in ranks[:-1])] and ranks[-1][2] == n
        for length, a, b, first, offset in runs:
            for i in range(b - a):
                used.setdefault(first + i, []).append((offset, length))
        assert sorted(used) == list(range(sequences))
        for slots in used.values():
            slots.sort()
            assert [o for o, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
            assert sum(n for _, n in slots) <= 64
        # best fit from long to short, one document at a time
        rooms: list[int] = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            best = min((r for r in rooms if r >= length), default=None)
            if best is not None:
                rooms.remove(best)
            rooms.append((64 if best is None else best) - length)
        assert sequences == len(rooms)


def test_pieces_rebuild_documents(spark, odd_documents, no_documents):
    rows = packing.packed(odd_documents, PATH, with_ids=True).collect()
    docs: dict = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.row_key), []).append(r)
        assert r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes()) and len(r.ids) == r.length <= 1024
    for r in odd_documents.collect():
        want = slow_ids(r.text or "") + [2]
        own = [x for k, v in docs.items() if k[0] == r.doc_id for x in v]
        own = sorted({(x.piece, x.start, tuple(x.ids)) for x in own})
        assert [i for p in own for i in p[2]] == want and [p[1] for p in own] == [sum(len(p[2]) for p in own[:k]) for k in range(len(own))]
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))]
    assert packing.packed(no_documents, PATH).count() == 0
