"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text is lower-cased (A-Z), cut into words and shingles; each shingle's XXH64 votes on the 64 bits
of the fingerprint. Two fingerprints link if they differ in at most ``RADIUS`` bits.

Finding links, exactly and without all pairs:

1. Documents with one fingerprint are one class; from here on only distinct fingerprints move.
2. The 64 bits are three blocks. If two fingerprints differ in at most four bits, then in some two
   of the blocks they differ in at most two bits together. So over each two blocks every fingerprint
   emits its ball of half that radius (all variants with at most one flipped bit: 132 rows in all),
   the variants are shuffled, and two fingerprints that meet in a variant are compared in full.
3. Where more than ``DENSE`` fingerprints meet in one variant, pairs would grow with the square.
   Those fingerprints emit the whole ball instead: all variants of the 64 bits with at most two
   flipped bits (2,081). Two that share one of these differ in at most four bits by the triangle
   inequality, and any two that differ in at most four share one. So all of a variant's fingerprints
   link to one of them, and no pair needs to be made: a star per variant, linear in rows. Its centre
   is the one that met most others before (a hub, as the original among its copies), so that a
   fingerprint's stars have few centres between them.
4. Edges are dealt into tasks of ``FOREST_ROWS``, each of which keeps a star per component of what it
   holds: at most as many edges as it has fingerprints. What is left goes through min-label
   propagation with pointer jumping over tables in the shared folder.

Rows with a null id take part but never name a component; a component of such rows alone has a
null id. A null text is empty; a text without words has fingerprint zero and links like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bounded_batches, bucket_of, clear_scratch, id_and_text, partitions, release, table

#: Differing bits at which two fingerprints still link. The blocks and balls below are made for four.
RADIUS = 4
SHINGLE = 4
SEED = 42
#: More fingerprints than this in one variant take the whole ball's way.
DENSE = 24
#: Rows that one task holds of shuffled variants, at most on average.
TASK_ROWS = 1_500_000
#: Edges that one task reduces to stars.
FOREST_ROWS = 500_000
_BLOCKS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)
_CHUNK = 8192


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer."""
    words = text.lower().split()  # of bytes: A-Z only, and at the six white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (hash of the text, to tell repeated ids apart) and fp of every row of (doc_id, text)."""
    bounded_batches(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column("bytes")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), fps], names=["doc_id", "row_key", "fp"])

    rows = df.select("doc_id", F.xxhash64("text").alias("row_key"), F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(scan, "doc_id long, row_key long, fp long")


def _flips(mask: int) -> np.ndarray:
    """The masks of a ball of radius one over the bits of mask: none and each single bit."""
    return np.array([0, *(1 << b for b in range(64) if mask >> b & 1)], np.uint64)


def _block_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = [(np.uint64(0xFFFFFFFFFFFFFFFF ^ left_out), np.uint64(left_out & -left_out) * np.uint64(k + 1), _flips(0xFFFFFFFFFFFFFFFF ^ left_out)) for k, left_out in enumerate(_BLOCKS)]
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for mask, tag, flips in keys:
            variants = ((fps & mask) | tag)[:, None] ^ flips[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(variants.ravel().view(np.int64)), pa.array(np.repeat(fps, len(flips)).view(np.int64))], names=["variant", "fp"])


def _ball_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    single = np.array([1 << b for b in range(64)], np.uint64)
    double = np.array([1 << a | 1 << b for a in range(64) for b in range(a)], np.uint64)
    flips = np.concatenate((np.zeros(1, np.uint64), single, double))
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        nodes, mets = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("node", "met"))
        for at in range(0, len(fps), 256):
            part = fps[at : at + 256]
            variants = part[:, None] ^ flips[None, :]
            columns = [variants.ravel().view(np.int64), np.repeat(nodes[at : at + 256], len(flips)), np.repeat(mets[at : at + 256], len(flips))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["variant", "node", "met"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """A task's variants in order, hubs first: fingerprints, number of the run of each, start and length of the runs."""
    parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)] for b in batches if b.num_rows]
    if not parts:
        return None
    variants, fps, *mets = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((fps, -mets[0], variants)) if mets else np.argsort(variants, kind="stable")
    variants, fps = variants[order], fps[order]
    starts = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
    lengths = np.diff(np.append(starts, len(variants)))
    many = np.repeat(lengths > 1, lengths)
    fps, lengths = fps[many], lengths[lengths > 1]
    starts = np.cumsum(lengths) - lengths
    return fps, np.repeat(np.arange(len(lengths)), lengths), starts, lengths


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack((low, high), axis=1), axis=0) if len(low) else np.empty((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _block_edges(dense: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _grouped(batches)
        if found is None:
            return
        fps, run, _, lengths = found
        large = (lengths > dense)[run]
        members, places = np.unique(fps[large], return_inverse=True)
        mets = np.bincount(places, lengths[run][large], len(members)).astype(np.int64)
        # an edge to oneself marks a fingerprint for the whole ball, with how many it met
        yield pa.RecordBatch.from_arrays([pa.array(members), pa.array(members), pa.array(mets)], names=["a", "b", "met"])
        fps, run = fps[~large], run[~large]
        for step in range(1, min(dense, len(fps))):
            same = run[step:] == run[:-step]
            if not same.any():
                break
            a, b = fps[step:][same], fps[:-step][same]
            near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
            edges = _edges(a[near], b[near])
            yield pa.RecordBatch.from_arrays([*edges.columns, pa.array(np.zeros(edges.num_rows, np.int64))], names=["a", "b", "met"])

    return scan


def _star_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _grouped(batches)
    if found is None or not len(found[0]):
        return
    fps, run, starts, _ = found
    centre = fps[starts][run]
    yield _edges(fps[fps != centre], centre[fps != centre])


def met(distinct: DataFrame, scratch: Scratch, dense: int = DENSE, tag: str = "") -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) among distinct fingerprints (fp, node): compared pairs of fp, and stars of nodes in crowded variants.

    Together they join exactly the components of the link relation; every edge links two fingerprints.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    tasks = max(partitions(spark), -(-n * 132 // TASK_ROWS))
    blocks = distinct.select("fp").mapInArrow(_block_variants, "variant long, fp long").repartition(tasks, "variant").mapInArrow(_block_edges(dense), "a long, b long, met long")
    blocks = scratch.keep(blocks, f"met{tag}")
    crowded = blocks.where("a = b").groupBy(F.col("a").alias("fp")).agg(F.sum("met").alias("met"))
    crowded = scratch.keep(crowded.join(distinct, "fp").select("fp", "node", "met"), f"crowded{tag}")
    m = crowded.count()
    tasks = max(partitions(spark), -(-m * 2081 // TASK_ROWS))
    spread = crowded.repartition(max(partitions(spark), m // 512))
    stars = spread.mapInArrow(_ball_variants, "variant long, node long, met long").repartition(tasks, "variant").mapInArrow(_star_edges, "a long, b long")
    return blocks.where("a <> b").select("a", "b").distinct(), stars.distinct() if m else blocks.where("a <> a").select("a", "b")


def links(distinct: DataFrame, scratch: Scratch, dense: int = DENSE) -> DataFrame:
    near, stars = met(distinct.select("fp", F.col("fp").alias("node")), scratch, dense)
    return near.unionByName(stars)


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node of each one's component."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        if not (apart := low != high).any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if parts:
        nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*parts)))
        yield _edges(nodes[nodes != roots], roots[nodes != roots])


def components(edges: DataFrame, scratch: Scratch, tag: str = "") -> DataFrame:
    """node, root (the smallest node of its component) of every node of the edges (a, b).

    Each round takes the least label among the neighbours, then the label of that label; rounds grow
    with the logarithm of a component's width. Joins can split a node with many edges, the least
    label is summed up before it is shuffled.
    """
    edges = scratch.keep(edges.select("a", "b"), f"links{tag}")
    edges = edges.repartition(max(1, edges.count() // FOREST_ROWS)).mapInArrow(_forest, "a long, b long")
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"edges{tag}")
    scratch.drop(f"links{tag}")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"), F.lit(True).alias("moved")), f"labels{tag}-0")
    step = 0
    while labels.where("moved").limit(1).count():
        now = labels.select("node", "root")
        seen = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        best = now.join(seen, "node", "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("least", "root")).alias("best"))
        over = now.select(F.col("node").alias("best"), F.col("root").alias("next"))
        jumped = best.join(over, "best", "left").select("node", F.least("best", F.coalesce("next", "best")).alias("root"), (F.least("best", F.coalesce("next", "best")) < F.col("was")).alias("moved"))
        labels = scratch.keep(jumped, f"labels{tag}-{step + 1}")
        scratch.drop(f"labels{tag}-{step}")
        step += 1
    return labels.select("node", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, dense: int = DENSE) -> DataFrame:
    """doc_id, row_key, fp, component_id (smallest id reachable), leader (this row stays if one of each group does).

    The leader of a group is the row with the smallest id, ties to the smallest text hash; rows that
    repeat both id and text are all leaders, and a caller keeps one. An empty table gives no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.keep(fingerprints(id_and_text(df, id_col, text_col), shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    classes = scratch.keep(rows.groupBy("fp").agg(first), "classes")
    roots = components(links(classes.select("fp"), scratch, dense), scratch)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = scratch.keep(named, "named")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    heads = named.join(heads, "root").select("fp", "head")
    return rows.join(heads, "fp").select("doc_id", "row_key", "fp", F.col("head.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row_key") == F.col("head.row_key"))).alias("leader"))


# --- near copies by shared shingles ------------------------------------------------------------
#
# Near copies are texts whose shingle sets have a Jaccard likeness of COPY_LIKENESS or more.
#
# 1. SimHash comes first: fingerprints of all texts are linked by balls as above, and the links are
#    checked by the shingle sets of their texts. Fingerprints of copies with added or cut text mostly
#    differ in more bits, so what follows finds, exactly, the pairs that are left: by prefixes, under
#    one order of all shingles. Two sets of likeness t share at least the part t of either, so the
#    first shingle they share stands among the first (1 - t) n + 1 of each.
# 2. Shingles held by more than COPY_DENSE texts of a sample come last in the order, the most frequent
#    at the end. Which ones the sample shows has no bearing on what is found: prefixes are exact under
#    any order. The sample grows with the texts, so that few shingles of many texts are in prefixes.
# 3. Texts that meet in a shingle of their prefixes, and can still be alike by their sizes and
#    places there, are pairs. Shingles of one text are dropped first; then each knows the one before it
#    in its text, and texts that have that in common too met there already. So a pair is made about
#    once, not once for each shingle. Pairs that SimHash has not grouped are compared: first by sketches, the parity of the shingles that fall on each of
#    SKETCH bits. Two sketches differ in no more bits than their sets differ in shingles, so a pair
#    whose sketches are too far apart for the likeness is not alike. Texts move for the other pairs only.
# 4. More than COPY_HOT texts that meet are a crowd. A text is compared with the least text of each task's
#    crowds, and texts that are linked through such hubs are one family. Then all texts of
#    a family that are outside its largest group are compared with all of the family, in blocks.
#    A pair that meets in crowds only is of one family, so none is left out.
#
# Prefixes are shuffled as they are made, and each step's tables and shuffle files go before the next.

COPY_SHINGLE = 5
COPY_LIKENESS = 0.8
#: A shingle of more texts of the sample is common.
COPY_DENSE = 6
#: Texts that meet in one shingle are compared pair by pair up to so many; more are a crowd.
COPY_HOT = 256
#: Texts that are looked at for common shingles: one in SAMPLE_SHARE, but as many as SAMPLE_TEXTS if there are; and common shingles that are kept, at most.
SAMPLE_TEXTS, SAMPLE_SHARE = 20_000, 8
COMMON = 100_000
#: Bits of a sketch. Sets of more than twice as many shingles are hardly told apart and go on to their texts.
SKETCH = 1024
#: Shingles on either side of a block of a family, on average.
BLOCK_SHINGLES = 1_000_000
_LOW = 1e-9  # products with a likeness may be above a whole number by rounding


def shingle_likeness(a: bytes, b: bytes, shingle: int = COPY_SHINGLE) -> float:
    """Jaccard likeness of the shingle sets of two texts; a text of fewer words is one shingle."""
    sets = []
    for text in (a, b):
        words = text.lower().split()
        n = min(shingle, len(words))
        sets.append({b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})
    union = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / union if union else 1.0


def shingle_hashes(text: bytes, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """The hashes of a text's shingle set in order; a text without words has the empty shingle."""
    words = text.lower().split()
    n = min(shingle, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)], np.uint64).view(np.int64))


def _all_shingles(shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(x.as_py(), shingle) for x in batch.column("bytes")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["token"])

    return scan


def sketch(hashes: np.ndarray) -> bytes:
    """For each of SKETCH bits, whether an odd number of the hashes falls on it."""
    return np.packbits((np.bincount(hashes & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.bool_)).tobytes()


def _prefixes(shingle: int, likeness: float, common: np.ndarray):
    """The tokens of the prefixes, and for each text a row of place -1 with its size and sketch, its node as token. common: from the rarest to the most frequent."""
    ranks = np.argsort(common, kind="stable")
    known = common[ranks]
    names = ["token", "node", "size", "place", "sketch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[np.empty(0, x) for x in (np.int64, np.int64, np.int32, np.int32)]]
            heads = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("bytes")):
                hashes = shingle_hashes(text.as_py(), shingle)
                n = len(hashes)
                at = np.searchsorted(known, hashes)
                often = known[np.minimum(at, len(known) - 1)] == hashes if len(known) else np.zeros(n, np.bool_)
                last = hashes[often][np.argsort(ranks[at[often]])]
                tokens = np.concatenate((hashes[~often], last))[: n - math.ceil(likeness * n - _LOW) + 1]
                parts.append([tokens, np.full(len(tokens), node), np.full(len(tokens), n, np.int32), np.arange(len(tokens), dtype=np.int32)])
                heads.append((node, node, n, -1, sketch(hashes)))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.binary())], names=names)
            if heads:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*heads), kinds)], names=names)

    return scan


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray] | None:
    """A task's columns in order of the first one, with start and length of each run of it."""
    parts = [[b.column(x).to_numpy(zero_copy_only=False) for x in names] for b in batches if b.num_rows]
    if not parts:
        return None
    columns = [np.concatenate(x) for x in zip(*parts)]
    del parts
    order = np.argsort(columns[0], kind="stable")
    for i, column in enumerate(columns):
        columns[i] = column[order]
    starts = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
    return columns, starts, np.diff(np.append(starts, len(order)))


def _shared(hot: int):
    """Rows of texts, and rows whose token is in two to hot texts; of tokens in more the edges (hub, node) to the least text, once a task."""
    names = ["token", "node", "size", "place", "hub", "sketch"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = []
        for batch in batches:
            head = pc.equal(batch.column("place"), -1)
            texts = batch.filter(head)
            yield pa.RecordBatch.from_arrays([*texts.columns[:4], pa.nulls(texts.num_rows, pa.int64()), texts.column("sketch")], names=names)
            tokens.append(batch.select(names[:4]).filter(pc.invert(head)))
        found = _runs(tokens, ("token", "node", "size", "place"))
        if found is None:
            return
        columns, _, lengths = found
        each = np.repeat(lengths, lengths)
        few = (each > 1) & (each <= hot)
        columns, members = [x[few] for x in columns], columns[1][each > hot]
        none = [pa.nulls(len(columns[0]), x) for x in (pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *none], names=names)
        if len(members):  # copies have the least text in common, however often they meet
            large = lengths[lengths > hot]
            hub = np.repeat(np.minimum.reduceat(members, np.cumsum(large) - large), large)
            edges = _edges(members[members != hub], hub[members != hub])
            none = [pa.nulls(edges.num_rows, x) for x in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([none[0], edges.column("b"), none[1], none[2], edges.column("a"), none[3]], names=names)

    return scan


def _prefix_pairs(likeness: float):
    """Pairs of texts by the tokens they share, but for tokens right before which both have one more in common."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _runs(batches, ("token", "node", "size", "place", "earlier", "first"))
        if found is None:
            return
        (_, nodes, sizes, places, earlier, first), starts, lengths = found
        ends = np.repeat(starts + lengths, lengths)
        at, step = np.arange(len(nodes)), 1
        while len(at := at[at + step < ends[at]]):
            for part in np.array_split(at, -(-len(at) // 1_000_000)):
                to = part + step
                shared = np.minimum(sizes[part] - places[part], sizes[to] - places[to])
                near = (shared >= likeness / (1 + likeness) * (sizes[part] + sizes[to]) - _LOW) & (nodes[part] != nodes[to])
                near &= first[part] | first[to] | (earlier[part] != earlier[to])
                yield _edges(nodes[part][near], nodes[to][near])
            step += 1

    return scan


def _may_be_alike(likeness: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            both = batch.column("m").to_numpy().astype(np.int64) + batch.column("n").to_numpy()
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (1 - likeness) / (1 + likeness) * both + _LOW
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return scan


def _alike(shingle: int, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [shingle_likeness(x, y, shingle) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(fits, pa.bool_())], names=["a", "b", "fits"])

    return scan


def _links_across(apart: list[tuple], members: list[tuple], likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what all alike pairs of apart and members join; both are (node, root, hashes)."""
    nodes, roots = (np.array([x[i] for x in apart], np.int64) for i in (0, 1))
    sizes = np.array([len(x[2]) for x in apart])
    tokens, owners = np.concatenate([x[2] for x in apart]), np.repeat(np.arange(len(apart)), sizes)
    order = np.argsort(tokens, kind="stable")
    owners = owners[order]
    known, starts, counts = np.unique(tokens[order], return_index=True, return_counts=True)
    # a bit for each frequent shingle, lists of texts for the others
    often = counts > max(32, len(apart) // 64)
    columns = np.cumsum(often) - 1
    width = -(-int(often.sum()) // 64) * 64
    bits = np.zeros((len(apart), width), np.bool_)
    flat = np.repeat(np.arange(len(known)), counts)
    bits[owners[often[flat]], columns[flat[often[flat]]]] = True
    bits = np.packbits(bits, axis=1).view(np.uint64)
    low, high, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for node, root, hashes in members:
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        at = at[known[at] == hashes]
        own = np.zeros(width, np.bool_)
        own[columns[at[often[at]]]] = True
        rare = at[~often[at]]
        lists = np.repeat(starts[rare] - np.cumsum(counts[rare]) + counts[rare], counts[rare]) + np.arange(counts[rare].sum())
        shared = np.bincount(owners[lists], minlength=len(apart)) + np.bitwise_count(bits & np.packbits(own).view(np.uint64)).sum(axis=1, dtype=np.int64)
        near = nodes[(shared / (sizes + len(hashes) - shared) >= likeness) & (roots != root)]
        low.append(near)
        high.append(np.full(len(near), node))
        held += len(near)
        if held > FOREST_ROWS:
            ends, tops = roots_of(np.concatenate(low), np.concatenate(high))
            low, high, held = [ends[ends != tops]], [tops[ends != tops]], 0
    return np.concatenate(low), np.concatenate(high)


def _across(shingle: int, likeness: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple, tuple[list, list]] = {}
        for batch in batches:
            keys = zip(*(batch.column(x).to_pylist() for x in ("family", "left", "right")))
            for key, whole, node, root, text in zip(keys, *(batch.column(x).to_pylist() for x in ("whole", "node", "root", "bytes"))):
                blocks.setdefault(key, ([], []))[whole].append((node, root, shingle_hashes(text, shingle)))
        for apart, members in blocks.values():
            if apart and members:
                nodes, roots = roots_of(*_links_across(apart, members, likeness))
                yield _edges(nodes[nodes != roots], roots[nodes != roots])

    return scan


def _common_shingles(texts: DataFrame, classes: int, shingle: int, dense: int) -> np.ndarray:
    share = min(-(-classes // SAMPLE_TEXTS), SAMPLE_SHARE)
    sample = texts.where(bucket_of("node", share) == 0) if share > 1 else texts
    counts = sample.select("bytes").mapInArrow(_all_shingles(shingle), "token long").groupBy("token").count().where(F.col("count") > dense)
    found = counts.orderBy(F.desc("count"), "token").limit(COMMON).collect()
    return np.array([r.token for r in reversed(found)], np.int64)


def _simhash_links(texts: DataFrame, scratch: Scratch, shingle: int) -> DataFrame:
    """Edges (a, b) between texts (node, bytes) that SimHash links: to the least text of one fingerprint, and between such texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py(), shingle) for x in batch.column("bytes")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), fps], names=["node", "fp"])

    fps = scratch.keep(texts.mapInArrow(scan, "node long, fp long"), "fingerprints")
    heads = scratch.keep(fps.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    found = scratch.keep(links(heads.select("fp"), scratch), "fingerprint-links")
    across = found.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    within = fps.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    edges = scratch.keep(across.unionByName(within).distinct(), "simhash-links")
    for name in ("fingerprints", "heads", "fingerprint-links", "met", "crowded"):
        scratch.drop(name)
    release(texts.sparkSession)
    return edges


def _compared(edges: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, likeness: float, tag: str) -> DataFrame:
    """The edges (a, b) whose texts have that likeness."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    paired = scratch.keep(texts.join(nodes, "node", "left_semi"), f"paired{tag}")
    release(texts.sparkSession)
    both = edges.join(paired.toDF("a", "x"), "a").join(paired.toDF("b", "y"), "b")
    alike = scratch.keep(both.mapInArrow(_alike(shingle, likeness), "a long, b long, fits boolean"), f"compared{tag}").where("fits").select("a", "b")
    scratch.drop(f"paired{tag}")
    release(texts.sparkSession)
    return alike


def _crowd_links(spark: SparkSession, stars: DataFrame, alike: DataFrame, sizes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, likeness: float) -> DataFrame | None:
    """Edges between groups of one family that comparing with hubs left apart; None if there are no such groups."""
    families = components(stars, scratch, "-families").withColumnRenamed("root", "family")
    roots = components(alike, scratch, "-groups")
    members = families.join(sizes, "node").join(roots, "node", "left").select("node", "family", "size", F.coalesce("root", "node").alias("root"))
    members = scratch.keep(members, "members")
    groups = members.groupBy("family", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = groups.groupBy("family").agg(F.max(F.struct("n", "root", "size")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("groups")).where("groups > 1")
    blocks = lambda size: F.ceil(size / BLOCK_SHINGLES).cast("int")
    largest = scratch.keep(largest.select("family", F.col("top.root").alias("top"), blocks(F.col("all") - F.col("top.size")).alias("lefts"), blocks(F.col("all")).alias("rights")), "largest")
    if not largest.limit(1).count():
        return None
    part = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = scratch.keep(members.join(largest, "family"), "placed")
    whole = placed.select("node", "family", "root", every("lefts").alias("left"), part("rights").alias("right"), F.lit(True).alias("whole"))
    apart = placed.where("root <> top").select("node", "family", "root", part("lefts").alias("left"), every("rights").alias("right"), F.lit(False).alias("whole"))
    rows = scratch.keep(whole.unionByName(apart), "blocks").join(texts, "node")
    tasks = max(partitions(spark), largest.agg(F.sum(F.col("lefts") * F.col("rights"))).first()[0] // 4)
    return rows.repartition(tasks, "family", "left", "right").mapInArrow(_across(shingle, likeness), "a long, b long")


def _hashes(text: Column | str) -> tuple[Column, Column]:
    """Two independent hashes of a text: texts are equal if both are."""
    return F.xxhash64(text), F.xxhash64(F.lit("check"), text)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, likeness: float = COPY_LIKENESS, dense: int = COPY_DENSE, hot: int = COPY_HOT) -> DataFrame:
    """doc_id, row_key, check, component_id and leader of every row, as near_duplicates gives them, for near copies by shingle likeness.

    Equal texts, by two hashes of 64 bits, are one class. The groups are those that all pairs of classes of that likeness make.
    Nulls, empties, ties and repeats are treated as in near_duplicates; texts without words are one group.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "copies")
    bounded_batches(spark)
    docs = id_and_text(df, id_col, text_col).select("doc_id", *(h.alias(c) for c, h in zip(("row_key", "check"), _hashes("text"))), F.col("text").cast("binary").alias("bytes"))
    rows = scratch.keep(docs.select("doc_id", "row_key", "check"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    classes = scratch.keep(rows.groupBy("row_key", "check").agg(first), "all-classes")
    # texts that share the first hash only, a few in 10^10: all but one get another node, made of both hashes
    shared = classes.groupBy("row_key").agg(F.min("check").alias("least"), F.count("*").alias("n")).where("n > 1").select("row_key", "least")
    node = F.when(F.col("check") != F.col("least"), F.xxhash64("check", "row_key")).otherwise(F.col("row_key"))
    classes = scratch.keep(classes.join(shared, "row_key", "left").select("row_key", "check", node.alias("node"), "first"), "classes")
    scratch.drop("all-classes")
    n = classes.count()
    wanted = classes.select(F.col("row_key").alias("key"), F.col("check").alias("other"), "node", F.col("first.doc_id").alias("first_id"))
    same_row = (F.col("row_key") == F.col("key")) & (F.col("check") == F.col("other")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = scratch.keep(docs.join(wanted, same_row).select("node", "bytes"), "texts")
    if texts.count() > n:  # rows that repeat id and text
        texts = scratch.keep(texts.groupBy("node").agg(F.min("bytes").alias("bytes")), "texts-once")
    release(spark)

    linked = _compared(_simhash_links(texts, scratch, shingle), texts, scratch, shingle, likeness, "-simhash")
    groups = components(linked, scratch, "-simhash")

    common = _common_shingles(texts, n, shingle, dense)
    prefixes = texts.mapInArrow(_prefixes(shingle, likeness, common), "token long, node long, size int, place int, sketch binary")
    words = (texts.agg(F.sum(F.length("bytes"))).first()[0] or 0) / 5
    tasks = max(partitions(spark), math.ceil((1 - likeness) * words / TASK_ROWS))
    met = prefixes.repartition(tasks, "token").mapInArrow(_shared(hot), "token long, node long, size int, place int, hub long, sketch binary")
    met = scratch.keep(met, "shared")
    release(spark)
    stars = scratch.keep(met.where("hub is not null").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    crowds = stars.limit(1).count() > 0
    sizes = scratch.keep(met.where("place = -1").select("node", "size", "sketch"), "sizes")  # a row for each text
    before = F.lag("token").over(Window.partitionBy("node").orderBy("place"))
    chained = met.where("place >= 0").select("token", "node", "size", "place", F.coalesce(before, F.lit(0)).alias("earlier"), before.isNull().alias("first"))
    chained = scratch.keep(chained, "chained")
    scratch.drop("shared")
    release(spark)
    tasks = max(partitions(spark), -(-chained.count() // TASK_ROWS))
    pairs = scratch.keep(chained.repartition(tasks, "token").mapInArrow(_prefix_pairs(likeness), "a long, b long"), "pairs")
    scratch.drop("chained")
    release(spark)
    edges = scratch.keep(pairs.unionByName(stars).distinct(), "edges-met")
    scratch.drop("pairs")
    release(spark)
    both = edges.join(sizes.toDF("a", "m", "x"), "a").join(sizes.toDF("b", "n", "y"), "b")
    edges = scratch.keep(both.mapInArrow(_may_be_alike(likeness), "a long, b long"), "edges-near")
    scratch.drop("edges-met")
    sizes = sizes.select("node", "size")
    release(spark)
    known = edges.join(groups.toDF("a", "p"), "a", "left").join(groups.toDF("b", "q"), "b", "left")
    edges = scratch.keep(known.where("p is null or q is null or p <> q").select("a", "b"), "edges-new")
    alike = linked.unionByName(_compared(edges, texts, scratch, shingle, likeness, ""))
    if crowds:
        more = _crowd_links(spark, stars, alike, sizes, texts, scratch, shingle, likeness)
        alike = alike if more is None else alike.unionByName(scratch.keep(more, "across"))
        scratch.drop("blocks")
        release(spark)

    scratch.drop("texts")
    scratch.drop("texts-once")
    roots = components(alike, scratch)
    named = classes.join(roots, "node", "left").select("row_key", "check", F.coalesce("root", "node").alias("root"), F.struct("first.*", "row_key", "check").alias("first"))
    named = scratch.keep(named, "named")
    heads = named.join(named.groupBy("root").agg(F.min("first").alias("head")), "root").select("row_key", "check", "head")
    lead = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("row_key") == F.col("head.row_key")) & (F.col("check") == F.col("head.check"))
    return rows.join(heads, ["row_key", "check"]).select("doc_id", "row_key", "check", F.col("head.doc_id").alias("component_id"), lead.alias("leader"))


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, likeness: float = COPY_LIKENESS) -> DataFrame:
    """The leaders of all groups of near copies, with the columns of df; of rows that repeat id and text one stays."""
    spark = df.sparkSession
    scratch = Scratch(spark, "dedup")
    before = len(Scratch.made)
    found = near_copies(df, id_col, text_col, shingle, likeness).where("leader")
    leaders = scratch.keep(found.groupBy("doc_id", "row_key", "check").agg(F.count("*").alias("times")), "leaders")
    clear_scratch(before)
    release(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("long").alias("id"), *(h.alias(c) for c, h in zip(("key", "other"), _hashes(text))))
    kept = keyed.join(leaders, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")) & (F.col("other") == F.col("check")))
    if leaders.where("times > 1").limit(1).count():
        kept = kept.where("times = 1").unionByName(kept.where("times > 1").dropDuplicates(["id", "key", "other"]))
    return kept.select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
