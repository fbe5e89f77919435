"""Words, patterns and bounds that decide what the checks find."""

from __future__ import annotations

# The checks.
SLUGS = {
    1: "numbers-as-strings",
    2: "dates-as-strings",
    3: "mixed-date-formats",
    4: "sentinel-missing",
    5: "suppression-codes",
    6: "whitespace-damage",
    7: "case-spelling-variants",
    8: "encoding-mojibake",
    9: "duplicate-rows",
    10: "near-duplicate-rows",
    11: "key-violations",
    12: "field-contradictions",
    13: "out-of-domain-values",
    14: "broken-coordinates",
    15: "statistical-outliers",
    16: "unit-heterogeneity",
    17: "packed-fields",
    18: "header-damage",
    19: "empty-constant-columns",
    20: "schema-drift",
    21: "aggregate-rows",
    22: "id-numeric-corruption",
}
INDICATORS = (12, 15)
FAMILY_ONLY = (20,)
SINGLE_TABLE = tuple(d for d in SLUGS if d not in FAMILY_ONLY)

# Spellings of missing data.
MISSING_TOKENS = (
    "n/a",
    "na",
    "n.a.",
    "n/a.",
    "#n/a",
    "none",
    "null",
    "nil",
    "nan",
    "unknown",
    "unk",
    "not available",
    "not applicable",
    "not specified",
    "missing",
    "empty",
    "blank",
    "-",
    "--",
    "?",
    "tbd",
    "no data",
)
NUMERIC_SENTINELS = (-9999, -999, -99, -9, -1, 0, 9999, 99999, 999999)
SENTINEL_DATES = ("1900-01-01", "1899-12-30", "0001-01-01", "1970-01-01")

# Number shapes, first match counts.
NUMBER_SHAPES = {
    "symbol": r"^\s*[-+]?\s*[$€£¥]\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*$",
    "thousands-comma": r"^\s*[-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*$",
    "decimal-comma": r"^\s*[-+]?\d+,\d{1,2}\s*$",
    "code-prefixed": r"^\s*[A-Z]{3}\s?[-+]?\d+(?:[.,]\d+)?\s*$",
    "accounting": r"^\s*\((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\)\s*$",
    "bare": r"^\s*[-+]?\d+(?:\.\d+)?\s*$",
    "unit-suffix": r"^\s*[-+]?\s*[$€£¥]?\s*(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*[%a-zA-Z°µ²³/.\- ]{0,20}\s*$",
}
LEADING_NUMBER = r"^\s*([-+]?)\s*[$€£¥]?\s*((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"

# Date shapes; no value fits two of them.
DATE_SHAPES = {
    "iso": r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$",
    "iso-zoned": r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s?([Zz]|[+-]\d{2}:?\d{2})$",
    "slash": r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    "dash": r"^\d{1,2}-\d{1,2}-\d{2,4}$",
    "dot": r"^\d{1,2}\.\d{1,2}\.\d{2,4}$",
    "day-month-name": r"^\d{1,2}\s+[A-Za-z]{3,9}\.?,?\s+\d{4}$",
    "month-name-day": r"^[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}$",
    "compact": r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$",
    "time": r"^\d{1,2}:\d{2}(:\d{2})?\s*([aApP]\.?\s?[mM]\.?)?$",
    "epoch": r"^(?:1\d{9}|20\d{8})$",
}
SLOTTED_DATE = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-]\d{2,4}$"

# Other shapes of text.
SUPPRESSION = r"^[<>]=?\s?\d+$|^[a-zA-Z*.]{1,3}$"
MOJIBAKE = ("Ã", "Â", "â€", "Ð", "Ñ", "\ufffd")
ROLLUP = r"^\s*(all\b|total\s*$|grand\s+total|sub\s*-?\s*total|overall\b|all\s+others?|combined\s*$|aggregate\b)"
LATLON = r"^\s*-?\d{1,3}\.\d+\s*[,;]\s*-?\d{1,3}\.\d+\s*$"
SIBLING = r"^(?P<prefix>.+?)[ _-]?(?P<num>\d)$"
ZERO_WIDTH_IN_NAMES = ("\u200b", "\u200c", "\u200d", "\ufeff")

# Names of columns.
DOMAINS = (
    (r"(^|_)age(_|$)", 0.0, 120.0),
    (r"(^|_)(pct|percent|percentage|rate|share)(_|$)", 0.0, 100.0),
    (r"(^|_)(year|yr)(_|$)", 1800.0, 2100.0),
    (r"(^|_)month(_|$)", 1.0, 12.0),
    (r"(^|_)hour(_|$)", 0.0, 23.0),
    (r"(^|_)(count|qty|quantity|num|number|population)(_|$)", 0.0, float("inf")),
)
ID_NAME = r"(^|_)(zip|postal|code|folio|id|number|no|acct|account)(_|$)"
LAT_NAME = r"(^|_)(lat|latitude)(_|$)"
LON_NAME = r"(^|_)(lon|lng|long|longitude)(_|$)"
UNIT_NAME = r"(^|_)(unit|units|uom|measure_unit)(_|$)"
PARAMETER_NAME = r"(^|_)(param|parameter|measure|metric|variable|analyte|pollutant)(_|$)"

# Unit conversions.
KNOWN_RATIOS = (
    (3.28084, "metres -> feet"),
    (2.54, "inches -> centimetres"),
    (1.60934, "miles -> kilometres"),
    (2.20462, "kilograms -> pounds"),
    (3.78541, "gallons -> litres"),
    (1.09361, "metres -> yards"),
    (6.89476, "psi -> kPa"),
    (100.0, "hundreds"),
    (1000.0, "thousands"),
)

# The home region of coordinates, a reported share only.
REGION = {"lat": (48.0, 60.0), "lon": (-139.0, -114.0)}

# White space as str.strip and the regex class \s see it in Unicode.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Of these, the separators (category Zs) other than the plain space, and zero-width noise; joiners carry meaning and stay.
EXOTIC_SPACES = "\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
ZERO_WIDTH = "\u200b\ufeff"
#: What a number in text must look like to be read as it is.
PLAIN_NUMBER = r"^\s*[-+]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"
