"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a row of shape features (character classes, repeats, word and line statistics).
From labelled documents preference pairs are drawn: one of label 1 is preferred to one of label 0.
The ranking model learns a linear score by logistic loss on feature differences. The threshold is
the quantile of scores that leaves as large a share below as label 0 has among the labels, and a
logistic curve through it gives a score from 0 to 1.

Learning uses every labelled document outside the held-out fold. Their features are dealt by hash into
blocks of ``BLOCK`` documents of the larger class; one of the smaller class goes to as many blocks as
gives each some ``BLOCK_RARE``. Within a block every document of either class is in pairs. Newton's steps add
up gradients of all blocks, and the threshold is an exact order statistic of all scores, so the driver
gets sums only.
Labels come only from ids whose crc32, as text, has a remainder other than ``HELD`` by ``FOLDS``.

A null or empty text has features of zero and the score that follows. Rows that repeat are scored as
rows of their own, rows with a null id too (held out: false). Null labels teach nothing; where a
class has no labels every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, clear_scratch, partitions, table

FOLDS, HELD = 3, 1
BLOCK, BLOCK_RARE = 4096, 512
#: Pairs of a block, at least; each of its documents is in some.
PAIRS = 60_000
RIDGE = 1e-3

_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:'\"?()-", b"!", b"#$%&*@^~+=_", b"|/\\<>{}[]`", b" \t", b"\n\r", bytes(range(128, 256)), bytes([*range(9), 11, 12, *range(14, 32), 127])]
_TABLE = np.zeros((256, len(_KINDS)))
for _k, _chars in enumerate(_KINDS):
    _TABLE[list(_chars), _k] = 1
FEATURES = len(_KINDS) + 11


def features(text: bytes) -> np.ndarray:
    out = np.zeros(FEATURES)
    words = text.split()
    if not words:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts @ _TABLE / len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    often = Counter(words)
    p = counts[counts > 0] / len(text)
    out[: len(_KINDS)] = np.log1p(100 * share)
    out[len(_KINDS) :] = (
        np.log1p(n),
        sizes.mean(),
        np.log1p(sizes.std()),
        len(often) / n,
        np.log(len(often)) / np.log(n) if n > 1 else 1,
        np.log1p(100 * sum(map(eq, words, words[1:])) / n),
        np.log1p(100 * max(often.values()) / n),
        sum(map(bytes.isupper, words)) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
        -(p * np.log2(p)).sum(),
    )
    return out


def pair_sums(diff: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the log-likelihood of feature differences at w, summed over the pairs."""
    p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
    return diff.T @ (1 - p), (diff * (p * (1 - p))[:, None]).T @ diff


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], pairs: int, size: int) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(25):
        gradient, curvature = sums(w)
        step = np.linalg.solve(curvature / pairs + RIDGE * np.eye(size), gradient / pairs - RIDGE * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def paired(good: np.ndarray, bad: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Differences of drawn pairs: the documents of either class in rounds, each round in a new order, so all take part."""
    rng = np.random.RandomState(seed)
    pairs = max(pairs, len(good), len(bad))
    turns = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-pairs // n))])[:pairs]
    return good[turns(len(good))] - bad[turns(len(bad))]


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, seed: int = 0) -> np.ndarray:
    """Weights of the Bradley-Terry model: P(a preferred to b) = logistic(w . (a - b))."""
    diff = paired(good, bad, pairs, seed)
    return newton(lambda w: pair_sums(diff, w), len(diff), diff.shape[1])


def score(model: dict, x: np.ndarray) -> np.ndarray:
    raw = np.clip((x - model["mean"]) / model["scale"], -6, 6) @ model["w"] - model["cut"]
    return 1 / (1 + np.exp(-np.clip(model["slope"] * raw, -30, 30)))


def remainder(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds, F.lit(-1))


def training_ids(labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """doc_id and label of at most per_class rows of each label: those with the smallest hashes outside the held-out fold."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    parts = [own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def training_labels(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """doc_id and label of all rows that may be learned from; the smaller label of an id with both."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held))
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))


def label_share(labels: DataFrame, label: str, folds: int, held: int) -> float:
    """The share of label 0 among all labels that may be learned from."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", folds) != held))
    return own.agg(F.avg((F.col(label) == 0).cast("double"))).first()[0] or 0.0


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(-1, FEATURES)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t).tobytes() for t in batch.column("bytes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its number, and the features of each class in one order on every run."""
    found: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for block, label, doc_id, x in zip(*(batch.column(c).to_pylist() for c in ("block", "label", "doc_id", "x"))):
            found.setdefault(block, ([], []))[label].append((doc_id, x))
    for block, rows in sorted(found.items()):
        bad, good = (b"".join(x for _, x in sorted(r)) for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([good], pa.binary()), pa.array([bad], pa.binary())], names=["block", "good", "bad"])


def _pair_sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, pairs: int):
    """A row for each block: number of pairs, gradient and curvature."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, good, bad in zip(*(batch.column(c).to_pylist() for c in ("block", "good", "bad"))):
                good, bad = (np.clip((_matrix([x]) - mean) / scale, -6, 6) for x in (good, bad))
                diff = paired(good, bad, pairs, block) if len(good) and len(bad) else np.zeros((0, FEATURES))
                gradient, curvature = pair_sums(diff, w)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(diff)]), pa.array([np.concatenate((gradient, curvature.ravel())).tobytes()], pa.binary())], names=["block", "n", "sums"])

    return scan


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, *cells in zip(*(batch.column(c).to_pylist() for c in ("block", "good", "bad"))):
            sums = [np.concatenate((x.sum(axis=0), (x * x).sum(axis=0))) for x in map(_matrix, zip(cells))]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.concatenate(sums).tobytes()], pa.binary())], names=["block", "sums"])


def weighted_cut(rows: DataFrame, raw: Callable[[list[bytes]], np.ndarray], weights: dict[int, float], share: float) -> float:
    """Midway between the score (of rows label, x) up to which the weights come to share, and the next; exact: 16 bits of the ordered scores are found in each pass."""

    def keys(scores: np.ndarray) -> np.ndarray:
        bits = (scores + 0.0).view(np.int64)
        return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)

    def counted(shift: int, prefix: int):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, label = keys(raw(batch.column("x").to_pylist())), batch.column("label").to_numpy()
                if shift < 48:
                    here = own >> np.uint64(shift + 16) == np.uint64(prefix)
                    own, label = own[here], label[here]
                cells, counts = np.unique((own >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int32) * 2 + label, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["cell", "n"])

        return scan

    def above(least: float):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = raw(batch.column("x").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(scores[scores > least])], names=["score"])

        return scan

    prefix, below = 0, 0.0
    for shift in (48, 32, 16, 0):
        found = rows.mapInArrow(counted(shift, prefix), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        weight: dict[int, float] = {}
        for r in sorted(found, key=lambda r: r.cell):
            weight[r.cell >> 1] = weight.get(r.cell >> 1, 0.0) + r.n * weights[r.cell & 1]
        for cell, own in weight.items():
            if below + own >= share - 1e-9:
                break
            below += own
        else:
            below -= own  # by rounding: the last cell
        prefix = prefix << 16 | cell
    bits = prefix ^ 1 << 63 if prefix >> 63 else ~prefix & 2**64 - 1
    at = float(np.array([bits], np.uint64).view(np.float64)[0])
    after = rows.mapInArrow(above(at), "score double").agg(F.min("score")).first()[0]
    return at if after is None else (at + after) / 2


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """A model: scaling, weights, threshold and slope."""
    spark = df.sparkSession
    none = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros(FEATURES), "cut": 0.0, "slope": 1.0}
    bounded_batches(spark)
    before = len(Scratch.made)
    scratch = Scratch(spark, "quality")
    try:
        marked = training_labels(labels, "quality", FOLDS, HELD)
        texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
        # features move to the labels, not texts
        found = texts.where(remainder("doc_id", FOLDS) != HELD).mapInArrow(_features, "doc_id long, x binary").join(marked, "doc_id")
        rows = scratch.keep(found.select("doc_id", "label", "x"), "rows")
        count = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(count) < 2:
            return none
        rare = min(count, key=lambda k: (count[k], k))
        blocks = -(-max(count.values()) // BLOCK)
        times = min(blocks, max(1, -(-BLOCK_RARE * blocks // count[rare])))
        own = F.pmod(F.xxhash64("doc_id", F.xxhash64("x"), F.lit("block")), F.lit(blocks))
        more = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, times - 1).otherwise(0)))
        dealt = rows.select("*", more.alias("more")).select(((own + F.col("more")) % blocks).cast("int").alias("block"), "label", "doc_id", "x")
        kept = scratch.keep(dealt.repartition(max(partitions(spark), blocks), "block").mapInArrow(_blocks, "block int, good binary, bad binary"), "blocks")

        # a document of the larger class stands in one block, one of the smaller in so many
        repeats = [times if k == rare else 1 for k in (1, 0)]
        sums = [np.frombuffer(r.sums).reshape(2, 2, FEATURES) for r in sorted(kept.mapInArrow(_moments, "block int, sums binary").collect())]
        total, squares = (sum(x[k] / n for k, n in enumerate(repeats)) for x in np.sum(sums, axis=0).swapaxes(0, 1))
        n = sum(count.values())
        mean = total / n
        scale = np.sqrt(np.maximum(squares / n - mean**2, 0)) + 1e-6

        def sums_at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = sorted(kept.mapInArrow(_pair_sums(mean, scale, w, PAIRS), "block int, n long, sums binary").collect())
            every = np.sum([np.frombuffer(r.sums) for r in found], axis=0) / sum(r.n for r in found)
            return every[:FEATURES], every[FEATURES:].reshape(FEATURES, FEATURES)

        w = newton(sums_at, 1, FEATURES)
        raw = lambda cells: np.clip((_matrix(cells) - mean) / scale, -6, 6) @ w
        share = label_share(labels, "quality", FOLDS, HELD)
        cut = weighted_cut(rows.select("label", "x"), raw, {0: share / count[0], 1: (1 - share) / count[1]}, share)
        return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": 1.0}
    finally:
        clear_scratch(before)


def scored(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and score of every row; with carry all of its columns, as row."""
    bounded_batches(df.sparkSession)
    names = ["doc_id", *["row"] * carry, "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column("bytes").to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names[:-1]), pa.array(score(model, x))], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), *([F.struct(*df.columns).alias("row")] if carry else []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    shape = "doc_id long, " + (f"row {rows.schema['row'].dataType.simpleString()}, " if carry else "") + "score double"
    return rows.mapInArrow(scan, shape)


def good_only(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of df that the classifier accepts, with the columns of df."""
    return scored(df, train(df, labels), carry=True).where("score >= 0.5").select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
