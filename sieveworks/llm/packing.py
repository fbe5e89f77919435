"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Documents become token ids followed by an end id; only longer ones than a sequence are cut, into
full pieces with the shorter piece first. The histogram of piece lengths (as many rows as a
sequence has tokens, at most) goes to the driver, which packs counts instead of documents: lengths
from long to short, each into the open sequences with the least room that fits, and new ones when
none is left. Sequences with equal room are one group, so the plan's size and time depend on the
sequence length and not on the corpus. The plan is runs of slots (length, first rank, last rank,
first sequence, offset); a piece takes the slot of its rank among the pieces of its length. Ranks are
distributed: hash ranges of each length are counted before and each is numbered in a task of its
own, so one length may hold any part of the pieces.

Null texts are empty: a document of the end id alone. Rows that repeat, and rows with a null id, are
packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches, bucket_of, id_and_text, sums_before, table

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
RANGES = 4096
#: tiktoken's pattern goes back over white space step by step and runs out of stack on longer runs than some 400,000.
_LONG_SPACE = re.compile(r"(?<!\s)\s{10000}")
_ENCODERS: dict[str, Callable[[list[str]], list[list[int]]]] = {}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Token ids of texts by the tokenizer file, without special tokens of its own.

    A byte-level vocabulary whose ids follow its merges is run by tiktoken, which gives the same ids
    several times faster; texts that hold a special token's string or 10,000 white spaces in a row, and
    other files, go to tokenizers.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    import tiktoken

    whole: list = []  # the tokenizer itself, loaded only when a text needs it

    def plain(texts: list[str]) -> list[list[int]]:
        from tokenizers import Tokenizer

        if not whole:
            whole.append(Tokenizer.from_file(path))
        return [e.ids for e in whole[0].encode_batch(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, letters = spec["model"], spec.get("pre_tokenizer") or {}, _byte_letters()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", ())]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    special = [x["content"] for x in spec.get("added_tokens", ())]
    fits = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and made == sorted(set(made)) and not model.get("ignore_merges")
    if not fits:
        _ENCODERS[path] = plain
        return plain
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain([t])[0] if any(s in t for s in special) or _LONG_SPACE.search(t) else fast.encode_ordinary(t) for t in texts]

    _ENCODERS[path] = encode
    return encode


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 (and ids) of every piece of (doc_id, text)."""
    bounded_batches(df.sparkSession)
    ids_type = pa.list_(pa.int32())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(encode([text])[0] + [end_id], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > first else [0, len(ids)]
                out += [(doc, key, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b] if with_ids else None) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            if with_ids:
                columns, names = [*columns, pa.array([x[6] for x in out], ids_type)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    return rows.mapInArrow(scan, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of slots (length, first rank, rank after the last, first sequence, offset), and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # in order, of the open groups
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and number of sequences
    sequences = 0

    def open_group(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = next((r for r in rooms if r >= length), 0)
            if not room:
                n = -(-left // (capacity // length))
                open_group(capacity, sequences, n)
                sequences += n
                continue
            first, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.remove(room)
            each = room // length
            full, odd = divmod(min(left, each * n), each)
            for first, n, each in ((first, full, each), (first + full, bool(odd) * 1, odd), (first + full + bool(odd), n - full - bool(odd), 0)):
                if n:
                    for j in range(each):
                        runs.append((length, rank, rank + n, first, capacity - room + j * length))
                        rank, left = rank + n, left - n
                    open_group(room - each * length, first, n)
    return runs, sequences


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(id_and_text(df, id_col, text_col), tokenizer, capacity, end_id, with_ids).withColumn("range", bucket_of(F.concat_ws("/", "doc_id", "piece", "row_key"), RANGES))
    cut = scratch.keep(cut, "pieces")
    cells = scratch.keep(cut.groupBy("length", "range").agg(F.count("*").alias("n")), "cells")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(counts, capacity)
    slots: dict[int, tuple[np.ndarray, ...]] = {}
    for length in counts:
        own = sorted(r[1:] for r in runs if r[0] == length)
        slots[length] = tuple(np.array(x, np.int64) for x in zip(*own))
    offsets = sums_before(cells, ["length"], "range", "n", 64).withColumnRenamed("before", "ahead")
    within = Window.partitionBy("length", "range").orderBy("doc_id", "row_key", "piece")
    ranked = cut.join(offsets, ["length", "range"]).withColumn("rank", F.col("ahead") + F.row_number().over(within) - 1)

    kept = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                of = lengths == length
                first, _, start, at = slots[int(length)]
                run = np.searchsorted(first, ranks[of], "right") - 1
                sequence[of], offset[of] = start[run] + ranks[of] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    shape = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*kept, "rank").mapInArrow(place, shape)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document is packed."""
    found = packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
