"""Toxicity scores by weak supervision.

1. Candidate lexicon entries are whole words, word beginnings and word ends (4 to 6 letters). An entry
   is taken if it stands in more toxic than other training documents than chance explains, at all or
   densely (``DENSE`` of the words). Both are tested (binomial tails) for every candidate that ``LEAST``
   or more training documents have so, and all that a false discovery rate of ``RATE`` over all tests
   allows are taken; the classifier weighs what chance brought in. A syllable that clean texts have now and then can still be dense in toxic ones.
2. Voters read a document and vote toxic, clean or nothing: one per entry kind for presence and for
   density, some that ask for several hits, a general word list, and patterns (shouting, exclamations, address).
3. A generative label model is fitted to the votes alone, by EM: how toxic and clean documents are
   voted on by each voter, and the correlations between voters given the label, so that a voter that
   repeats others adds only what they leave open.
4. A linear classifier (presence and density of entries, and patterns) is trained on the posterior labels; its scores
   cover every row and whole text.

Learning uses at most ``PER_CLASS`` labelled documents of each class, those whose ids have the
smallest hashes; labels come only from ids whose crc32, as text, has a remainder other than
``HELD`` by ``FOLDS``. The driver sees the entries that were taken and where these documents have them.

A null or empty text has no hits and the score that follows. Rows that repeat are scored as rows of
their own, rows with a null id too (held out: false). Null labels teach nothing; without labels of
both classes every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, table
from .quality import label_share, remainder, training_ids

FOLDS, HELD = 5, 0
PER_CLASS = 3000
RATE = 0.1
LEAST = 5
#: Log odds from which entries vote.
STRONG = 2.5
#: Share of a text's words from which an entry is dense there.
DENSE = 0.005

# A general list of insults.
INSULTS = frozenset("idiot moron loser pathetic worthless disgusting scum trash stupid clown dumb jerk freak garbage".split())
_WORD = re.compile(r"\w+")
_ADDRESS = re.compile(r"\b(?:you|your|du|ihr|tu|toi|vous|tú|usted)\b")
_CAPITALS = bytes(range(65, 91))
KINDS = ("word", "begin4", "begin5", "begin6", "end4", "end5", "end6")
PATTERNS = 4
COUNTS = ("toxic", "clean", "toxic_dense", "clean_dense")


def entries(word: str) -> Iterable[str]:
    """The lexicon candidates of a word, each marked by its kind's number."""
    yield "0" + word
    for k, n in ((1, 4), (2, 5), (3, 6)):
        if len(word) > n:
            yield f"{k}{word[:n]}"
            yield f"{k + 3}{word[-n:]}"


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def patterns(text: str) -> list[float]:
    """Shares of capitals and exclamation marks, hits of the general list, address."""
    raw = text.encode("utf-8", "replace")
    n = len(raw) or 1
    return [(len(raw) - len(raw.translate(None, _CAPITALS))) / n, min(1.0, 50 * text.count("!") / n), 0.0, float(bool(_ADDRESS.search(text.lower())))]


def hits(text: str, lexicon: dict[str, int]) -> tuple[list[int], list[float]]:
    """The numbers of the lexicon's entries in a text, and for each its share of the words in units of twice DENSE, 1 at most."""
    found: defaultdict[int, int] = defaultdict(int)
    get, own, total = lexicon.get, words(text), 0
    for w, times in own.items():
        total += times
        if (i := get("0" + w)) is not None:
            found[i] += times
        n = len(w)
        if n > 4:
            if (i := get("1" + w[:4])) is not None:
                found[i] += times
            if (i := get("4" + w[-4:])) is not None:
                found[i] += times
            if n > 5:
                if (i := get("2" + w[:5])) is not None:
                    found[i] += times
                if (i := get("5" + w[-5:])) is not None:
                    found[i] += times
                if n > 6:
                    if (i := get("3" + w[:6])) is not None:
                        found[i] += times
                    if (i := get("6" + w[-6:])) is not None:
                        found[i] += times
    places = sorted(found)
    return places, [min(1.0, found[i] / total / (2 * DENSE)) for i in places]


def seen(text: str) -> tuple[set[str], set[str]]:
    """The candidates that stand in a text, and those that are dense there."""
    own = words(text)
    counts: defaultdict[str, int] = defaultdict(int)
    for w, times in own.items():
        for e in entries(w):
            counts[e] += times
    least = DENSE * own.total()
    return set(counts), {e for e, n in counts.items() if n >= least}


def log_tails(toxic: np.ndarray, seen: np.ndarray, share: float) -> np.ndarray:
    """Logs of the chances that at least so many of the documents seen are toxic: binomial tails, summed up."""
    most = int(seen.max(initial=0))
    factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))
    first = factorial[seen] - factorial[toxic] - factorial[seen - toxic] + toxic * math.log(share) + (seen - toxic) * math.log1p(-share)
    odds, total, term, k = share / (1 - share), np.ones(len(seen)), np.ones(len(seen)), toxic.astype(float)
    while len(term) and (term > 1e-12 * total).any():
        term = term * np.maximum(0, seen - k) / (k + 1) * odds
        total, k = total + term, k + 1
    return np.minimum(0.0, first + np.log(total))


def tested(totals: DataFrame, share: float, least: int = LEAST) -> DataFrame:
    """entry and log_p of every test: an entry's presence and its density, where at least so many documents have it.

    How many have it says nothing of their labels, so tests that are left out do not bend the others.
    """

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("toxic", "clean"))
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(log_tails(toxic, toxic + clean, share))], names=["entry", "log_p"])

    both = totals.select("entry", F.explode(F.array(*(F.struct(F.col(a).alias("toxic"), F.col(b).alias("clean")) for a, b in (COUNTS[:2], COUNTS[2:])))).alias("n")).select("entry", "n.*")
    return both.where(F.col("toxic") + F.col("clean") >= least).mapInArrow(tails, "entry string, log_p double")


def discoveries(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of tested (with log_p) that a false discovery rate over all of them allows (Benjamini-Hochberg).

    The largest k with k rows at or below rate * k / n: counted anew for the k found before until it stays.
    """
    n = kept = tested.count()
    while kept:
        found = tested.where(F.col("log_p") <= math.log(rate * kept / n)).count()
        if found == kept:
            break
        kept = found
    return tested.where(F.col("log_p") <= math.log(rate * kept / n)) if kept else tested.limit(0)


def choose(totals: DataFrame, tests: DataFrame, toxic: int, clean: int, rate: float = RATE) -> list[tuple[str, float, float]]:
    """The lexicon in order: entries with a discovery among their tests, with their log odds, present and dense."""
    odds = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    found = totals.join(discoveries(tests, rate).select("entry").distinct(), "entry").select("entry", *COUNTS)
    return sorted((e, odds(a, b), odds(c, d) if c >= LEAST else 0.0) for e, a, b, c, d in found.collect())


class Hits:
    """A sparse matrix: row, column and value of what is not zero."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * e[self.rows], self.shape[1])

    def count(self, which: np.ndarray, least: float) -> np.ndarray:
        """How many of some columns reach a value, for each row."""
        return np.bincount(self.rows[which[self.columns] & (self.values >= least)], minlength=self.shape[0])


def votes(present: Hits, dense: Hits, shape: np.ndarray, lexicon: list[tuple[str, float, float]]) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) of all voters, from the entries present and dense, and the patterns."""
    kind = np.array([int(e[0]) for e, _, _ in lexicon], int)
    columns = []
    for hits_, least, odds in ((present, 1.0, [x[1] for x in lexicon]), (dense, 0.5, [x[2] for x in lexicon])):
        strong = np.array(odds) > STRONG
        columns += [np.where(hits_.count(own, least) > 0, 1, -1) for k in range(len(KINDS)) if (own := strong & (kind == k)).any()]
        if strong.any():
            total = hits_.count(strong, least)
            columns += [np.where(total >= n, 1, np.where(total == 0, -1, 0)) for n in (2, 4)]
    insults = shape[:, 2] > 0
    columns += [np.where(insults, 1, 0), np.where(shape[:, 0] > 0.5, 1, 0), np.where(shape[:, 1] > 0.5, 1, 0), np.where(insults & (shape[:, 3] > 0), 1, 0)]
    return np.stack(columns, axis=1).astype(np.int8)


def label_model(v: np.ndarray, prior: float, rounds: int = 40, shrink: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes, the voters' vote shares given the label, and their correlations.

    The model: a label with the prior, and votes that are normal around the label's means with one
    covariance; what voters share beyond the label counts once. It starts from the votes' sum, a vote
    counting the less the more others go along with it. shrink mixes some even variance in.
    """
    n, m = v.shape
    x = v.astype(float)
    apart = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    start = x @ (1 / np.maximum(1, np.abs(apart.T @ apart / n).sum(axis=1)))
    p = np.where(start >= np.quantile(start, max(0.0, 1 - prior)), 0.9, 0.1)
    related = np.eye(m)
    for _ in range(rounds):
        means = [(q @ x) / q.sum() for q in (1 - p, p)]
        left = x - (1 - p)[:, None] * means[0] - p[:, None] * means[1]
        covariance = left.T @ left / n
        spread = np.sqrt(np.diag(covariance)) + 1e-9
        related = covariance / np.outer(spread, spread)
        covariance = (1 - shrink) * covariance + (shrink * np.trace(covariance) / m + 1e-9) * np.eye(m)
        w = np.linalg.solve(covariance, means[1] - means[0])
        odds = (x - (means[0] + means[1]) / 2) @ w + math.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if abs(new - p).max(initial=0) < 1e-6:
            break
        p = new
    shares = np.array([[(q @ (v == k)) / max(q.sum(), 1e-9) for k in (-1, 0, 1)] for q in (1 - p, p)]).transpose(0, 2, 1)
    return p, shares, related


def fit_linear(x: Hits, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    weight = weight / weight.sum()
    rate = min(1.0, 4 / (1 + float(np.dot(weight[x.rows], x.values**2)) / 4))
    for i in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(x.times(vw) + vb, -30, 30))) - y) * weight
        nw, nb = vw - rate * (x.transposed_times(e) + ridge * vw), vb - rate * e.sum()
        vw, vb = nw + i / (i + 3) * (nw - w), nb + i / (i + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> dict:
    """The model: lexicon (entry to number), weights of entries, weights of patterns, bias."""
    scratch = Scratch(df.sparkSession, "toxicity")
    share = 1 - label_share(labels, "toxic", FOLDS, HELD) if labels.limit(1).count() else 0.0
    ids = training_ids(labels, "toxic", FOLDS, HELD, per_class)
    # a broadcast with a proven bound: two times per_class rows
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = scratch.keep(rows.dropDuplicates(["doc_id"]), "training")
    of = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    empty = {"lexicon": {}, "present": np.zeros(0), "dense": np.zeros(0), "shape": np.zeros(PATTERNS), "bias": math.log(share / (1 - share)) if 0 < share < 1 else -30.0}
    if len(of) < 2:
        return empty

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [Counter() for _ in range(4)]  # present and dense, for each label
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                for k, found in enumerate(seen(text)):
                    got[2 * k + 1 - label].update(found)
        names = sorted(got[0].keys() | got[1].keys())
        for at in range(0, len(names), 10_000):
            part = names[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([x[e] for e in part], pa.int64()) for x in got)], names=["entry", *COUNTS])

    totals = rows.select("label", "text").mapInArrow(count, "entry string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("entry").agg(*(F.sum(c).alias(c) for c in COUNTS))
    rate = of[1] / (of[0] + of[1])
    totals = scratch.keep(totals, "totals")
    lexicon = choose(totals, scratch.keep(tested(totals, rate), "tested"), of[1], of[0])
    number = {e: i for i, (e, _, _) in enumerate(lexicon)}
    found = sorted(rows.select("label", "text").mapInArrow(_reader(number), "label int, hits array<int>, shares array<double>, shape array<double>").collect())
    n, m = len(found), len(lexicon)
    of_row = np.repeat(np.arange(n), [len(r.hits) for r in found])
    places, shares = (np.array([x for r in found for x in r[k]], t) for k, t in ((1, np.int64), (2, np.float64)))
    present, dense = Hits(of_row, places, np.ones(len(places)), (n, m)), Hits(of_row, places, shares, (n, m))
    shape = np.array([r["shape"] for r in found]).reshape(n, PATTERNS)
    own, kinds = np.nonzero(shape)
    x = Hits(np.concatenate((of_row, of_row, own)), np.concatenate((places, places + m, kinds + 2 * m)), np.concatenate((present.values, shares, shape[own, kinds])), (n, 2 * m + PATTERNS))
    v = votes(present, dense, shape, lexicon)
    posterior, _, _ = label_model(v, rate)
    label = np.array([r.label for r in found])
    natural = np.where(label == 1, share / rate, (1 - share) / (1 - rate))
    w, b = fit_linear(x, posterior, natural)
    present, dense, shape = w[:m], w[m : 2 * m], w[2 * m :]
    return {"lexicon": number, "present": present, "dense": dense, "shape": shape, "bias": b}


def _shape(text: str) -> list[float]:
    out = patterns(text)
    out[2] = float(not INSULTS.isdisjoint(_WORD.findall(text.lower())))
    return out


def _reader(number: dict[str, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [hits(t, number) for t in texts]
            columns = [batch.column("label"), pa.array([h for h, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.list_(pa.float64())), pa.array([_shape(t) for t in texts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "hits", "shares", "shape"])

    return read


def score(model: dict, text: str) -> float:
    found, shares = hits(text, model["lexicon"])
    raw = model["bias"] + float(np.dot(model["shape"], _shape(text)))
    if found:
        raw += float(model["present"][found].sum()) + float(np.dot(model["dense"][found], shares))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))


def scored(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    bounded_batches(df.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(model, t) for t in batch.column("text").to_pylist()], pa.float64())], names=["doc_id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
