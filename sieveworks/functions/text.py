"""Column expressions over text: what a cell holds, and its tidied and folded forms. All native but one.

Spark has no Unicode normalisation and no full case folding; ``folded_any`` sends non-ASCII values
through an Arrow UDF and keeps all others in native expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab as V

_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in V.SPACES) + "]"
_EXOTIC = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in V.EXOTIC_SPACES + V.ZERO_WIDTH) + "]"
_ODD = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in V.SPACES + V.ZERO_WIDTH if c != " ") + "]"
_ODD_ASCII = r"[\t-\r\x1c-\x1f]"


def odd_space(c: Column) -> Column:
    """Any space other than the plain one, or zero-width noise."""
    return F.when(is_ascii(c), c.rlike(_ODD_ASCII)).otherwise(c.rlike(_ODD))


def damaged(c: Column) -> Column:
    """Spaces at an edge, in runs, of another kind, or zero-width noise."""
    return F.contains(c, F.lit("  ")) | F.startswith(c, F.lit(" ")) | F.endswith(c, F.lit(" ")) | odd_space(c)


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(V.SPACES))


def is_token(stripped: Column) -> Column:
    return F.lower(stripped).isin(*V.MISSING_TOKENS)


def first_match(c: Column, shapes: dict[str, str]) -> Column:
    """The number, from 1, of the first pattern that fits; else 0."""
    out = F.lit(0)
    for i, pattern in reversed(list(enumerate(shapes.values(), 1))):
        out = F.when(c.rlike(pattern), i).otherwise(out)
    return out


def tidy_spaces(c: Column) -> Column:
    """Every Unicode space a plain one, zero-width noise gone, runs collapsed, ends trimmed."""
    mapped = F.translate(c, V.EXOTIC_SPACES + V.ZERO_WIDTH, " " * len(V.EXOTIC_SPACES))
    return F.when(damaged(c), trimmed(F.regexp_replace(mapped, f"{_CLASS}+", " "))).otherwise(c)


def has_exotic_space(c: Column) -> Column:
    return c.rlike(_EXOTIC)


def collapsed(c: Column) -> Column:
    """Runs of spaces of any kind as one plain space, ends trimmed; the pattern runs only where there is one."""
    inner = F.trim(c)
    return F.when(F.contains(inner, F.lit("  ")) | odd_space(c), trimmed(F.regexp_replace(c, f"{_CLASS}+", " "))).otherwise(inner)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def folded(c: Column) -> Column:
    """Case and white space folded; exact for ASCII text."""
    return F.lower(collapsed(c))


@F.pandas_udf(T.StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).split()).casefold())


def folded_any(c: Column) -> Column:
    """Case, white space and compatibility forms folded, for any text."""
    return F.coalesce(_fold(F.when(~is_ascii(c), c)), folded(c))


def occurrences(c: Column, letter: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(letter), F.lit("")))
