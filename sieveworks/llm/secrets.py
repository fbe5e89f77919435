"""Secret scans: fixed patterns plus sliding-window Shannon entropy, in native columns only.

Base kinds, each leftmost and non-overlapping: ``assign`` (a credential's name, a sign and a value of
12 or more characters), ``access`` (an access key id of 18 or more) and ``hex`` (a lower-case
hexadecimal run of 16 or more). Matches that are too short are passed over, as a scan would.

Entropy spans: candidate runs of 20 or more characters of the base-64 alphabets with a digit and a
letter. A window of 20 characters slides over the candidate; counts per character are kept
incrementally (five bits each, packed into six longs), and with them the sum of ``n log2 n``, so a
step costs one character in and one out. The highest window entropy is held against the threshold of
the candidate's character class (hexadecimal, or letters and digits); the walk ends at the first
window that reaches it. An allow list passes over UUIDs, alphabets in order and hyphenated slugs. A
span that equals a base span is not added again; one that only overlaps it is.

Positions are code points, ends exclusive. Everything is per row: no shuffle, whole texts, time in
proportion to the text. A null or empty text has no spans; rows that repeat are scanned as rows of
their own; a null id stays null. Other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The base patterns and least lengths.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
#: Least highest window entropy in bits, for hexadecimal candidates and for others.
HEX_BITS, OTHER_BITS = 3.0, 3.7
#: Whole candidates that are passed over.
ALLOW = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i).*(?:abcdefghij|0123456789).*",
    r"(?:[A-Za-z]++|[0-9]{1,4}+)(?:[-_/](?:[A-Za-z]++|[0-9]{1,4}+))++",
)
REDACTED = "<secret>"
_SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Spans that are put together at once, and characters that are redacted at once.
_FEW, _CHARS = 256, 4096


def _none() -> Column:
    return F.array().cast(_SPAN)


def _in_parts(items: Column, first: Column, step, done) -> Column:
    """A fold over an array that collects spans in state["spans"], without copying all of them at each step.

    Parts of the array are folded by themselves, and their spans appended at once.
    """

    def part(state: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(items, k * _FEW + 1, _FEW), state["now"], step)
        return F.aggregate(F.array(own), state, lambda s, x: F.struct(F.concat(s["all"], x["spans"]).alias("all"), x.withField("spans", _none()).alias("now")))

    start = F.struct(_none().alias("all"), first.alias("now"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _FEW).cast("int"))
    return F.when(F.size(items) > 0, F.aggregate(parts, start, part, done)).otherwise(_none())


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Where a pattern matches: matches are put between two marks, and lengths between marks add up to positions."""

    def of(parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            match = F.substring_index(part, "\x02", 1)
            start, end = state["at"], state["at"] + F.length(match)
            span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct((start + F.length(part) - 1).alias("at"), F.when(keep(match), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        first = F.struct(F.length(F.element_at(parts, 1)).alias("at"), _none().alias("spans"))
        return _in_parts(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), first, step, lambda s: s["all"])

    return _bound(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), of)


def _bound(value: Column, of) -> Column:
    """of(value), where value is computed once however often of reads it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def window_entropy(word: Column, enough: Column | None = None) -> Column:
    """The highest Shannon entropy, in bits, of the windows of a candidate; of those up to the first that has enough."""
    per = 12  # counts of five bits in a long
    weight = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)))
    of = lambda n: F.element_at(weight, n + 1)
    letters = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    place, shift = (lambda c: F.floor(c / per).cast("int")), (lambda c: c % per * 5)
    held = lambda counts, c: F.call_function("shiftright", F.get(counts, place(c)), shift(c)).bitwiseAND(F.lit(31)).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    more = lambda counts, c, by: F.transform(counts, lambda x, k: F.when(k == place(c), x + by * one(c)).otherwise(x))

    def walk(letters: Column) -> Column:
        def take(state: Column, i: Column) -> Column:
            out, into = F.get(letters, i - WINDOW), F.get(letters, i)
            left = F.when(i < WINDOW, state).otherwise(_bound(held(state["counts"], out), lambda n: F.struct(more(state["counts"], out, -1).alias("counts"), (state["total"] + of(n - 1) - of(n)).alias("total"), state["best"].alias("best"))))

            def enter(s: Column) -> Column:
                total = _bound(held(s["counts"], into), lambda n: s["total"] + of(n + 1) - of(n))
                bits = lambda t: F.when(i >= WINDOW - 1, F.lit(math.log2(WINDOW)) - t / WINDOW).otherwise(F.lit(0.0))
                return _bound(total, lambda t: F.struct(more(s["counts"], into, 1).alias("counts"), t.alias("total"), F.greatest(s["best"], bits(t)).alias("best")))

            return _bound(left, enter)

        step = take if enough is None else (lambda s, i: F.when(s["best"] >= enough, s).otherwise(take(s, i)))
        counts = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // per))
        first = F.struct(counts.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), first, step, lambda s: s["best"])

    return _bound(letters, walk)


def _random_looking(word: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | word.rlike(f"^(?:{pattern})$")
    least = F.when(word.rlike("^[0-9A-Fa-f]+$"), F.lit(HEX_BITS)).otherwise(F.lit(OTHER_BITS))
    return F.when(allowed, F.lit(False)).otherwise(_bound(least, lambda bits: window_entropy(word, bits) >= bits))


def _found(text: Column, base: bool) -> Column:
    """The base spans of a text without marks, or its entropy spans."""
    if not base:
        return F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3, _random_looking)).otherwise(_none())
    named = F.lower(text).rlike("passw|secret|token|api")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_LEAST
    found = F.concat(
        F.when(named, F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, value)).otherwise(_none())).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, lambda m: F.lit(True))).otherwise(_none()),
        F.when(text.rlike(HEX), _spans(text, HEX, 2, lambda m: F.lit(True))).otherwise(_none()),
    )
    return F.sort_array(found)


def _both(text: Column) -> Column:
    """A struct of base and spans: arrays of (start, kind, end) in order, the base ones and all."""
    # the marks are control characters that no pattern can match; a text's own are blanked
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x01\x02", "\x03\x03")
    keys = lambda spans: F.transform(spans, lambda s: s["start"].cast("long") * 2**31 + s["end"])

    def joined(x: Column) -> Column:
        new = F.transform(F.array_except(keys(x["more"]), keys(x["base"])), lambda k: F.struct(F.call_function("shiftright", k, F.lit(31)).cast("int").alias("start"), F.lit(3).alias("kind"), k.bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("end")))
        return F.struct(x["base"].alias("base"), F.when(F.size(x["more"]) > 0, F.sort_array(F.concat(x["base"], new))).otherwise(x["base"]).alias("spans"))

    return _bound(plain, lambda t: _bound(F.struct(_found(t, True).alias("base"), _found(t, False).alias("more")), joined))


def _said(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of start, kind as its place in KINDS, end) of every row."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), _both(F.col(text_col)).alias("found")).select("doc_id", "found.base", "found.spans")


def _unions(spans: Column) -> Column:
    """Spans in order, overlapping ones as one."""

    def step(state: Column, s: Column) -> Column:
        apart, span = s["start"] >= state["end"], F.array(F.struct(state["start"].alias("start"), F.lit(0).alias("kind"), state["end"].alias("end")))
        return F.struct(
            F.when(apart, s["start"]).otherwise(state["start"]).alias("start"),
            F.when(apart, s["end"]).otherwise(F.greatest(state["end"], s["end"])).alias("end"),
            F.when(apart & (state["end"] > 0), F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), _none().alias("spans"))
    last = lambda s: F.concat(s["all"], F.array(F.struct(s["now"]["start"].alias("start"), F.lit(0).alias("kind"), s["now"]["end"].alias("end"))))
    return _in_parts(spans, first, step, last)


def redacted(text: Column, mark: str = REDACTED) -> Column:
    """The text with each of its spans, overlapping ones as one, replaced by a mark, piece by piece of the text."""

    def without(unions: Column) -> Column:
        def piece(part: Column, k: Column) -> Column:
            at, size = k * _CHARS, F.length(part)
            own = F.filter(unions, lambda s: (s["start"] < at + size) & (s["end"] > at))
            first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

            def step(state: Column, s: Column) -> Column:
                gap = F.substr(part, state["at"] + 1, F.greatest(s["start"] - at - state["at"], F.lit(0)))
                said = F.concat(state["out"], gap, F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit("")))
                return F.struct(F.least(s["end"] - at, size).alias("at"), said.alias("out"))

            return F.aggregate(own, first, step, lambda s: F.concat(s["out"], F.substr(part, s["at"] + 1, size - s["at"])))

        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0))
        return F.array_join(F.transform(parts, piece), "")

    return _bound(_both(text)["spans"], lambda spans: F.when(F.size(spans) > 0, _bound(_unions(spans), without)).otherwise(text))


def redact(df: DataFrame, text_col: str = "text", mark: str = REDACTED) -> DataFrame:
    """df with redacted texts. Null texts stay null."""
    return df.withColumn(text_col, redacted(F.col(text_col).cast("string"), mark))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_said("base"), 256).alias("base_sha256"), _said("spans").alias("spans"))
