"""Queries over the supplied tables: each check and repair as a DataFrame of counts, with SQL of the same meaning.

Checks that are silent on the supplied tables run on dirtied views: whole tables with deterministic
damage, by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import verify
from .operators.detect import detect_all
from .operators.family import harmonize, stacked
from .operators.registry import CHECKS
from .operators.repair import FIXES, date_of, number_of, quoted
from .operators.row_checks import detect_family
from .plans.boundary import Table
from .plans.measures import Measures
from .profile import statistics

Query = Callable[[SparkSession, str], DataFrame]

# Damage by key, the same text for Spark and DuckDB.
MONEY = "CASE WHEN o_orderkey % 5 = 0 THEN '$' || CAST(o_custkey AS STRING) || '.00' WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS STRING) || ' kg' WHEN o_orderkey % 5 = 2 THEN 'USD ' || CAST(o_custkey AS STRING) WHEN o_orderkey % 5 = 3 THEN '(' || CAST(o_custkey AS STRING) || '.50)' ELSE CAST(o_custkey AS STRING) END"
DAY = "CAST(2000 + o_orderkey % 20 AS STRING) || '-0' || CAST(1 + o_orderkey % 9 AS STRING) || '-1' || CAST(o_orderkey % 9 AS STRING)"
MIXED_DAY = f"CASE WHEN o_orderkey % 3 = 0 THEN '0' || CAST(1 + o_orderkey % 9 AS STRING) || '/1' || CAST(o_orderkey % 9 AS STRING) || '/2001' ELSE {DAY} END"
STATUS = "CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' WHEN o_orderkey % 10 = 1 THEN 'unknown' ELSE o_orderpriority END"
CODES = "CASE WHEN o_orderkey % 50 = 0 THEN '<5' WHEN o_orderkey % 50 = 1 THEN '..' ELSE CAST(o_custkey AS STRING) END"
SPACED = "CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' ' ELSE c_mktsegment END"
CASED = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"
LABEL = "CASE WHEN c_custkey % 50 = 0 THEN 'Total' WHEN c_custkey % 50 = 1 THEN 'All segments' ELSE c_mktsegment END"
PAIR = "CAST(10 + c_custkey % 80 AS STRING) || '.5, -' || CAST(100 + c_custkey % 60 AS STRING) || '.25'"

MISSPELT = "CASE WHEN c_custkey % 11 = 0 THEN substr(c_mktsegment, 1, length(c_mktsegment) - 1) ELSE c_mktsegment END"
DEED_LEFT = "CASE WHEN c_custkey % 4 <> 0 THEN 'plot ' || CAST(c_custkey AS STRING) || ' northumberla' ELSE 'northumberland ledger' END"
DEED_RIGHT = "CASE WHEN c_custkey % 4 <> 0 THEN 'nd parish' ELSE 'parish ' || CAST(c_custkey AS STRING) END"


def orders(spark: SparkSession, d: str, expr: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(expr).alias(name))


def customers(spark: SparkSession, d: str, expr: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(expr).alias(name))


def found(spark: SparkSession, df: DataFrame, disease: int, stats: list[tuple[str, str]], columns: list[str] | None = None) -> DataFrame:
    """The findings of one check as rows: columns, grade, and some statistics (floats to six places)."""
    table = Table(df)
    m = Measures(table)
    try:
        rows = CHECKS[disease](m, table.places(columns) if columns else list(range(table.width)))
    finally:
        m.release()
    values = [("|".join(f.columns), f.grade, *(f.stats[k] for k, _ in stats)) for f in rows]
    return spark.createDataFrame(values, "columns string, grade string" + "".join(f", {k} {t}" for k, t in stats))


def check(disease: int, make: Callable[[SparkSession, str], DataFrame], stats: list[tuple[str, str]], columns: list[str] | None = None) -> Query:
    return lambda spark, d: found(spark, make(spark, d), disease, stats, columns)


def table(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, d: str) -> DataFrame:
        df = spark.read.parquet(f"{d}/{name}.parquet")
        return df.select(*columns) if columns else df

    return make


def doubled(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.unionByName(t.where("c_custkey % 97 = 0"))


def recased(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/customer.parquet")
    return t.unionByName(t.where("c_custkey % 97 = 0").withColumn("c_mktsegment", F.lower("c_mktsegment")))


def dissent(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_nationkey AS nation", "CASE WHEN c_custkey % 101 = 0 THEN 'other' ELSE 'n' || CAST(c_nationkey AS STRING) END AS label")


def places(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr("CASE WHEN c_custkey % 40 = 0 THEN 0.0D WHEN c_custkey % 40 = 1 THEN 95.5D ELSE 49.0D END AS lat", "CASE WHEN c_custkey % 40 = 0 THEN 0.0D ELSE -123.0D END AS lon")


def ages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey", "CASE WHEN c_custkey % 30 = 0 THEN 150 WHEN c_custkey % 30 = 1 THEN -3 ELSE 20 + CAST(c_custkey % 60 AS INT) END AS age")


def measured(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_linenumber AS parameter", "CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 5 = 0 THEN 'feet' ELSE 'metres' END AS unit", "l_quantity AS value")


def zips(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr("CASE WHEN c_custkey % 9 = 0 THEN 1000 + c_custkey % 1000 ELSE 10000 + (c_custkey * 7001) % 90000 END AS zip_code")


def constants(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey", "'x' AS constant", "CAST(NULL AS STRING) AS nothing", "s_name")


def in_feet(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 2 = 0 THEN (100 + c_custkey % 30) * 3.28084D ELSE 100.0D + c_custkey % 30 END AS depth")


def halved_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr(f"{DEED_LEFT} AS deed_text1", f"{DEED_RIGHT} AS deed_text2")


def headed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").selectExpr("CASE WHEN n_nationkey % 10 = 0 THEN 'n_name' ELSE n_name END AS n_name", "CASE WHEN n_nationkey % 10 = 0 THEN 'Unnamed: 1' ELSE 'r' || CAST(n_regionkey AS STRING) END AS `Unnamed: 1`")


def halves(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = spark.read.parquet(f"{d}/customer.parquet")
    return {"a": t.where("c_custkey % 2 = 0"), "b": t.where("c_custkey % 2 = 1").selectExpr("c_custkey AS customer_id", "c_name", "CAST(c_nationkey AS BIGINT) AS c_nationkey", "c_acctbal", "1.5D AS rate")}


def drift(spark: SparkSession, d: str) -> DataFrame:
    rows = [("|".join(f.columns), f.grade, len(f.stats["only_in_a"]), len(f.stats["only_in_b"]), len(f.stats["dtype_changes"])) for f in detect_family(halves(spark, d))]
    return spark.createDataFrame(rows, "columns string, grade string, only_in_a int, only_in_b int, type_changes int")


def one_schema(spark: SparkSession, d: str) -> DataFrame:
    return stacked(harmonize(halves(spark, d), {"b": {"customer_id": "c_custkey"}})).select("_slice", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "rate")


def repaired(disease: int, make, name: str, **more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return FIXES[disease](make(spark, d), [name], **more)

    return run


def dates_repaired(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, DAY, "day").select("o_orderkey", date_of(quoted("day"), "iso").cast("date").alias("day"))


def numbers_repaired(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d, MONEY, "amount").select("o_orderkey", number_of(quoted("amount")).alias("amount"))


def baseline_rows(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    b, moved = verify.baseline(t), verify.baseline(t.withColumn("l_tax", F.expr("CASE WHEN l_orderkey % 7 = 0 THEN l_tax + 1 ELSE l_tax END")).repartition(5))
    return spark.createDataFrame([(c, b.rows, h == moved.hashes[c]) for c, h in b.hashes.items()], "column string, rows long, same boolean")


def scored(spark: SparkSession, d: str) -> DataFrame:
    truth = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    dirty = customers(spark, d, SPACED, "segment").withColumn("segment", F.expr("CASE WHEN c_custkey % 7 = 0 THEN 'lost' ELSE segment END"))
    r = verify.score(dirty.withColumn("segment", F.concat("segment", F.lit("."))), FIXES[6](dirty, ["segment"]), truth, "c_custkey")
    return spark.createDataFrame([(r["changed"], r["correct"], r["errors"], round(r["precision"], 6), round(r["recall"], 6), round(r["f1"], 6))], "changed long, correct long, errors long, precision double, recall double, f1 double")


def profiled(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = statistics(spark.read.parquet(f"{d}/{name}.parquet"))
        return s.select("column", "non_null", "distinct", F.round("min", 6).alias("min"), F.round("median", 6).alias("median"), F.round("max", 6).alias("max"))

    return run


def diagnosed(name: str) -> Query:
    """A table's whole diagnosis; SQL has no evidence text and no similarity ratio."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        result = detect_all(spark.read.parquet(f"{d}/{name}.parquet"), name)
        rows = [(f.disease, f.slug, "|".join(f.columns), f.grade, f.confidence, f.indicator, f.evidence) for f in result.findings]
        return spark.createDataFrame(rows, "disease int, slug string, columns string, grade string, confidence double, indicator boolean, evidence string")

    return run


def queries() -> dict[str, Query]:
    n, x = "long", "double"
    o = lambda expr, name: lambda s, d: orders(s, d, expr, name)
    c = lambda expr, name: lambda s, d: customers(s, d, expr, name)
    out: dict[str, Query] = {
        "d01_numbers_as_strings": check(1, o(MONEY, "amount"), [("values", n), ("union", x), ("parse_frac", x)]),
        "d02_dates_as_strings": check(2, o(DAY, "day"), [("values", n), ("coverage", x)]),
        "d03_mixed_dates": check(3, o(MIXED_DAY, "day"), [("values", n), ("coverage", x)]),
        "d04_text_sentinels": check(4, o(STATUS, "status"), [("sentinel_count", n), ("frac", x)], ["status"]),
        "d04_numeric_sentinels_labels": check(4, table("labels"), [("sentinel_value", n), ("sentinel_count", n), ("next_count", n)]),
        "d05_suppression_codes": check(5, o(CODES, "measured"), [("flagged", n), ("parse_frac", x)]),
        "d06_whitespace_documents": check(6, table("documents"), [("count", n), ("exotic", n), ("values", n)]),
        "d06_whitespace_customer": check(6, c(SPACED, "segment"), [("count", n), ("exotic", n), ("values", n)]),
        "d07_case_variants": check(7, c(CASED, "segment"), [("distinct", n), ("normalised", n), ("shrink", x)]),
        "d07_fuzzy_spellings": check(7, c(MISSPELT, "segment"), [("fuzzy_pairs", n)], ["segment"]),
        "d08_mojibake_documents": check(8, table("documents"), [("count", n), ("values", n)]),
        "d09_duplicate_rows": check(9, doubled, [("dup_rows", n), ("rows", n)]),
        "d10_near_duplicate_rows": check(10, recased, [("near_dup_rows", n), ("exact_dup_rows", n)]),
        "d11_key_violations_lineitem": check(11, table("lineitem"), [("contradicted_keys", n), ("uniqueness", x)]),
        "d11_key_violations_orders": check(11, table("orders"), [("contradicted_keys", n), ("uniqueness", x)]),
        "d12_contradictions": check(12, dissent, [("confidence", x), ("violating_groups", n), ("groups", n)], ["nation"]),
        "d13_out_of_domain": check(13, ages, [("violations", n), ("min", x), ("max", x)]),
        "d14_coordinates": check(14, places, [("zero_zero", n), ("out_of_range", n), ("in_bc_frac", x), ("rows", n)]),
        "d15_outliers_events": check(15, table("events", "value"), [("count", n), ("median", x), ("mad", x), ("max_score", x)]),
        "d15_outliers_documents": check(15, table("documents", "n_chars"), [("count", n), ("median", x), ("mad", x), ("max_score", x)]),
        "d16_units": check(16, measured, [("mixed_parameters", n)]),
        "d16_inferred_units": check(16, in_feet, [("ratio", x)], ["depth"]),
        "d17_split_words": check(17, halved_words, [("rows", n), ("healed_frac", x)]),
        "d17_packed_events": check(17, table("events"), [("values", n), ("packed", n)]),
        "d17_packed_coordinates": check(17, c(PAIR, "geom"), [("values", n), ("packed", n)]),
        "d17_packed_texts": check(17, table("documents", "text"), [("values", n), ("packed", n)]),
        "d18_header_damage": check(18, headed, [("bom_columns", n), ("duplicate_columns", n), ("unnamed_columns", n), ("header_rows", n)]),
        "d19_constant_columns": check(19, constants, [("null_frac", x), ("distinct", n)]),
        "d20_schema_drift": drift,
        "d21_rollups": check(21, c(LABEL, "segment"), [("rows", n)]),
        "d22_corrupted_ids": check(22, zips, [("modal_width", n), ("shorter", n), ("values", n), ("modal_frac", x)]),
        "fix01_numbers": numbers_repaired,
        "fix02_dates": dates_repaired,
        "fix04_tokens": repaired(4, o(STATUS, "status"), "status"),
        "fix06_spaces": repaired(6, c(SPACED, "segment"), "segment"),
        "fix07_spellings": repaired(7, c(CASED, "segment"), "segment"),
        "fix19_columns": repaired(19, constants, "constant"),
        "verify_baseline": baseline_rows,
        "verify_score": scored,
        "family_harmonize": one_schema,
        "profile_lineitem": profiled("lineitem"),
        "profile_events": profiled("events"),
    }
    return out | {f"diagnose_{t}": diagnosed(t) for t in ("events", "orders", "lineitem", "documents", "pages", "conversations")}


def _duck(expr: str) -> str:
    return expr.replace("AS STRING)", "AS VARCHAR)")


SPACE = r"^ | $|  |[\t\n\r\f\v\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}]"
EXOTIC = r"[\xA0\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{200B}\x{FEFF}]"


def _outliers(source: str, column: str) -> str:
    return f"""
    WITH v AS (SELECT CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL), m AS (SELECT median(x) AS med FROM v),
    d AS (SELECT median(abs(x - med)) AS mad FROM v, m), s AS (SELECT 0.6745 * abs(x - med) / mad AS score FROM v, m, d)
    SELECT '{column}' AS columns, 'HUMAN' AS grade, count(*) FILTER (score > 3.5) AS count, round((SELECT med FROM m), 6) AS median, round((SELECT mad FROM d), 6) AS mad, round(max(score), 6) AS max_score FROM s HAVING count(*) FILTER (score > 3.5) > 0"""


def _keys(source: str, key: str, others: list[str]) -> str:
    spread = " OR ".join(f"count(DISTINCT {c}) > 1" for c in others)
    named = ", ".join(f"CASE WHEN max(CASE WHEN d_{c} THEN 1 ELSE 0 END) = 1 THEN '{c}' END" for c in others)
    return f"""
    WITH g AS (SELECT {key}, {spread} AS bad, {', '.join(f'count(DISTINCT {c}) > 1 AS d_{c}' for c in others)} FROM {source} GROUP BY {key})
    SELECT concat_ws('|', '{key}', {named}) AS columns, 'HUMAN' AS grade, count(*) FILTER (bad) AS contradicted_keys, round(count(*)::DOUBLE / (SELECT count(*) FROM {source}), 6) AS uniqueness
    FROM g HAVING count(*) FILTER (bad) > 0 AND count(*) < (SELECT count(*) FROM {source}) AND count(*) >= 0.995 * (SELECT count(*) FROM {source}) AND count(*) >= 20"""


def _profile(source: str, numbers: list[str], others: list[str]) -> str:
    one = lambda c, x: f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", round(min({x}), 6) AS min, round(median({x}), 6) AS median, round(max({x}), 6) AS max FROM {source}"
    return " UNION ALL ".join([one(c, f"CAST({c} AS DOUBLE)") for c in numbers] + [one(c, "CAST(NULL AS DOUBLE)") for c in others])


def oracle_sql() -> dict[str, str]:
    money, day, mixed, status, codes = map(_duck, (MONEY, DAY, MIXED_DAY, STATUS, CODES))
    spaced, cased, label, pair = map(_duck, (SPACED, CASED, LABEL, PAIR))
    tokens = "('n/a', 'na', 'n.a.', 'n/a.', '#n/a', 'none', 'null', 'nil', 'nan', 'unknown', 'unk', 'not available', 'not applicable', 'not specified', 'missing', 'empty', 'blank', '-', '--', '?', 'tbd', 'no data')"
    texts = lambda column: f"SELECT '{column}' AS c, {column} AS v FROM documents WHERE trim({column}) <> ''"
    all_texts = " UNION ALL ".join(texts(c) for c in ("text", "lang", "source"))
    pages = "SELECT CAST(l_linenumber AS VARCHAR) AS p, CASE WHEN l_linenumber % 2 = 0 AND l_orderkey % 5 = 0 THEN 'feet' ELSE 'metres' END AS u FROM lineitem"
    line_numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    line_others = ["l_returnflag", "l_linestatus", "l_shipdate"]
    return {
        "d01_numbers_as_strings": f"SELECT 'amount' AS columns, 'AUTO' AS grade, count(*) AS values, CAST(1 AS DOUBLE) AS \"union\", round(avg(CASE WHEN regexp_matches(v, '^\\s*[-+]?\\s*[$€£¥]?\\s*[0-9]') THEN 1.0 ELSE 0.0 END), 6) AS parse_frac FROM (SELECT {money} AS v FROM orders)",
        "d02_dates_as_strings": f"SELECT 'day' AS columns, 'AUTO' AS grade, count(*) AS values, avg(CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN 1.0 ELSE 0.0 END) AS coverage FROM (SELECT {day} AS v FROM orders)",
        "d03_mixed_dates": f"SELECT 'day' AS columns, 'GATE' AS grade, count(*) AS values, avg(CASE WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}') THEN 1.0 ELSE 0.0 END) AS coverage FROM (SELECT {mixed} AS v FROM orders)",
        "d04_text_sentinels": f"SELECT 'status' AS columns, 'AUTO' AS grade, count(*) FILTER (lower(trim(v)) IN {tokens}) AS sentinel_count, round(count(*) FILTER (lower(trim(v)) IN {tokens})::DOUBLE / count(*), 6) AS frac FROM (SELECT {status} AS v FROM orders)",
        "d04_numeric_sentinels_labels": "WITH u AS (SELECT 'doc_id' AS c, CAST(doc_id AS BIGINT) AS v FROM labels UNION ALL SELECT 'quality', quality FROM labels UNION ALL SELECT 'toxic', toxic FROM labels), g AS (SELECT c, v, count(*) AS n, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) AS r FROM u GROUP BY c, v), t AS (SELECT a.c, a.v, a.n, b.n AS m FROM g a JOIN g b ON a.c = b.c AND a.r = 1 AND b.r = 2) SELECT c AS columns, 'HUMAN' AS grade, v AS sentinel_value, n AS sentinel_count, m AS next_count FROM t WHERE v IN (-9999, -999, -99, -9, -1, 0, 9999, 99999, 999999) AND n > 5 * m",
        "d05_suppression_codes": f"SELECT 'measured' AS columns, 'AUTO' AS grade, count(*) FILTER (NOT regexp_full_match(v, '[0-9]+')) AS flagged, round(count(*) FILTER (regexp_full_match(v, '[0-9]+'))::DOUBLE / count(*), 6) AS parse_frac FROM (SELECT {codes} AS v FROM orders)",
        "d06_whitespace_documents": f"SELECT c AS columns, 'AUTO' AS grade, count(*) FILTER (regexp_matches(v, '{SPACE}')) AS count, count(*) FILTER (regexp_matches(v, '{EXOTIC}')) AS exotic, count(*) AS values FROM ({all_texts}) GROUP BY c HAVING count(*) FILTER (regexp_matches(v, '{SPACE}')) > 0",
        "d06_whitespace_customer": f"SELECT 'segment' AS columns, 'AUTO' AS grade, count(*) FILTER (regexp_matches(v, '{SPACE}')) AS count, CAST(0 AS BIGINT) AS exotic, count(*) AS values FROM (SELECT {spaced} AS v FROM customer)",
        "d07_case_variants": f"SELECT 'segment' AS columns, 'AUTO' AS grade, count(DISTINCT v) AS \"distinct\", count(DISTINCT lower(v)) AS normalised, round((count(DISTINCT v) - count(DISTINCT lower(v)))::DOUBLE / count(DISTINCT v), 6) AS shrink FROM (SELECT {cased} AS v FROM customer)",
        "d07_fuzzy_spellings": f"WITH v AS (SELECT DISTINCT {_duck(MISSPELT)} AS v FROM customer) SELECT 'segment' AS columns, 'HUMAN' AS grade, count(*) AS fuzzy_pairs FROM v a JOIN v b ON length(a.v) > length(b.v) WHERE levenshtein(lower(a.v), lower(b.v)) = 1 AND 2.0 * length(b.v) / (length(a.v) + length(b.v)) >= 0.92 AND length(b.v) >= 6",
        "d08_mojibake_documents": f"SELECT c AS columns, 'GATE' AS grade, count(*) FILTER (regexp_matches(v, 'Ã|Â|â€|Ð|Ñ|' || chr(65533))) AS count, count(*) AS values FROM ({all_texts}) GROUP BY c HAVING count(*) FILTER (regexp_matches(v, 'Ã|Â|â€|Ð|Ñ|' || chr(65533))) > 0",
        "d09_duplicate_rows": "WITH t AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 97 = 0) SELECT '' AS columns, 'AUTO' AS grade, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS dup_rows, count(*) AS rows FROM t",
        "d10_near_duplicate_rows": "WITH t AS (SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, lower(c_mktsegment) FROM customer WHERE c_custkey % 97 = 0), f AS (SELECT DISTINCT c_custkey, lower(c_name), c_nationkey, c_acctbal, lower(c_mktsegment) FROM t) SELECT '' AS columns, 'HUMAN' AS grade, count(*) - (SELECT count(*) FROM f) AS near_dup_rows, CAST(0 AS BIGINT) AS exact_dup_rows FROM t",
        "d11_key_violations_lineitem": _keys("lineitem", "l_extendedprice", [c for c in (*line_numbers, *line_others) if c != "l_extendedprice"]),
        "d11_key_violations_orders": _keys("orders", "o_totalprice", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]),
        "d12_contradictions": "WITH t AS (SELECT c_nationkey AS x, CASE WHEN c_custkey % 101 = 0 THEN 'other' ELSE 'n' || CAST(c_nationkey AS VARCHAR) END AS y FROM customer), p AS (SELECT x, y, count(*) AS n FROM t GROUP BY x, y), g AS (SELECT x, sum(n) AS size, max(n) AS modal FROM p GROUP BY x) SELECT 'nation|label' AS columns, 'HUMAN' AS grade, round(sum(modal)::DOUBLE / sum(size), 6) AS confidence, count(*) FILTER (size >= 4 AND modal >= 0.6 * size AND modal < size) AS violating_groups, count(*) AS groups FROM g",
        "d13_out_of_domain": "SELECT 'age' AS columns, 'GATE' AS grade, count(*) FILTER (age < 0 OR age > 120) AS violations, CAST(min(age) AS DOUBLE) AS min, CAST(max(age) AS DOUBLE) AS max FROM (SELECT CASE WHEN c_custkey % 30 = 0 THEN 150 WHEN c_custkey % 30 = 1 THEN -3 ELSE 20 + c_custkey % 60 END AS age FROM customer)",
        "d14_coordinates": "SELECT 'lat|lon' AS columns, 'GATE' AS grade, count(*) FILTER (k = 0) AS zero_zero, count(*) FILTER (k = 1) AS out_of_range, round(count(*) FILTER (k > 1)::DOUBLE / count(*), 6) AS in_bc_frac, count(*) AS rows FROM (SELECT c_custkey % 40 AS k FROM customer)",
        "d15_outliers_events": _outliers("events", "value"),
        "d15_outliers_documents": _outliers("documents", "n_chars"),
        "d16_units": f"SELECT 'parameter|unit' AS columns, 'AUTO' AS grade, count(*) AS mixed_parameters FROM (SELECT p FROM ({pages}) GROUP BY p HAVING count(DISTINCT u) > 1)",
        "d16_inferred_units": "WITH t AS (SELECT log10(CASE WHEN c_custkey % 2 = 0 THEN (100 + c_custkey % 30) * 3.28084 ELSE 100.0 + c_custkey % 30 END) AS x FROM customer) SELECT 'depth' AS columns, 'HUMAN' AS grade, round(10 ** ((SELECT median(x) FROM t WHERE x > log10(200)) - (SELECT median(x) FROM t WHERE x < log10(200))), 6) AS ratio",
        "d17_split_words": f"WITH t AS (SELECT {_duck(DEED_LEFT)} AS l, {_duck(DEED_RIGHT)} AS r FROM customer), w AS (SELECT DISTINCT lower(unnest(string_split(l || ' ' || r, ' '))) AS w FROM t), h AS (SELECT lower(string_split(l, ' ')[-1] || string_split(r, ' ')[1]) IN (SELECT w FROM w) AS healed FROM t) SELECT 'deed_text1|deed_text2' AS columns, 'AUTO' AS grade, count(*) FILTER (healed) AS rows, round(count(*) FILTER (healed)::DOUBLE / count(*), 6) AS healed_frac FROM h",
        "d17_packed_events": "SELECT 'props' AS columns, 'AUTO' AS grade, count(*) AS values, count(*) FILTER (regexp_matches(props, '^\\s*[\\[{]') AND regexp_matches(props, '[\\]}]\\s*$')) AS packed FROM events",
        "d17_packed_coordinates": f"SELECT 'geom' AS columns, 'AUTO' AS grade, count(*) AS values, count(*) FILTER (regexp_full_match(v, '\\s*-?[0-9]{{1,3}}\\.[0-9]+\\s*[,;]\\s*-?[0-9]{{1,3}}\\.[0-9]+\\s*')) AS packed FROM (SELECT {pair} AS v FROM customer)",
        "d17_packed_texts": "SELECT 'text' AS columns, 'AUTO' AS grade, count(*) AS values, count(*) FILTER (contains(text, ',')) AS packed FROM documents WHERE trim(text) <> ''",
        "d18_header_damage": "SELECT 'Unnamed: 1' AS columns, 'AUTO' AS grade, CAST(0 AS BIGINT) AS bom_columns, CAST(0 AS BIGINT) AS duplicate_columns, CAST(1 AS BIGINT) AS unnamed_columns, count(*) FILTER (n_nationkey % 10 = 0) AS header_rows FROM nation",
        "d19_constant_columns": "WITH t AS (SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, 'x' AS constant, CAST(NULL AS VARCHAR) AS nothing, s_name FROM supplier), u AS (SELECT c, count(*) AS n, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS d FROM (SELECT 's_suppkey' AS c, s_suppkey AS v FROM t UNION ALL SELECT 'constant', constant FROM t UNION ALL SELECT 'nothing', nothing FROM t UNION ALL SELECT 's_name', s_name FROM t) GROUP BY c) SELECT c AS columns, 'AUTO' AS grade, round(nulls::DOUBLE / n, 6) AS null_frac, d AS \"distinct\" FROM u WHERE n >= 5 AND (nulls >= 0.995 * n OR d <= 1)",
        "d20_schema_drift": "WITH c AS (SELECT column_name AS c, data_type AS t FROM information_schema.columns WHERE table_name = 'customer'), a AS (SELECT c, t FROM c), b AS (SELECT CASE c WHEN 'c_custkey' THEN 'customer_id' ELSE c END AS c, CASE c WHEN 'c_nationkey' THEN 'BIGINT' ELSE t END AS t FROM c WHERE c <> 'c_mktsegment' UNION ALL SELECT 'rate', 'DOUBLE'), f AS (SELECT coalesce(a.c, b.c) AS c, a.t AS x, b.t AS y FROM a FULL JOIN b ON a.c = b.c) SELECT string_agg(c, '|' ORDER BY c) AS columns, 'GATE' AS grade, CAST(count(*) FILTER (y IS NULL) AS INTEGER) AS only_in_a, CAST(count(*) FILTER (x IS NULL) AS INTEGER) AS only_in_b, CAST(count(*) FILTER (x <> y) AS INTEGER) AS type_changes FROM f WHERE x IS NULL OR y IS NULL OR x <> y",
        "d21_rollups": f"SELECT 'segment' AS columns, 'GATE' AS grade, count(*) FILTER (v IN ('Total', 'All segments')) AS rows FROM (SELECT {label} AS v FROM customer)",
        "d22_corrupted_ids": "WITH w AS (SELECT length(CAST(CASE WHEN c_custkey % 9 = 0 THEN 1000 + c_custkey % 1000 ELSE 10000 + (c_custkey * 7001) % 90000 END AS VARCHAR)) AS w FROM customer), m AS (SELECT mode(w) AS m FROM w) SELECT 'zip_code' AS columns, 'GATE' AS grade, (SELECT m FROM m) AS modal_width, count(*) FILTER (w < (SELECT m FROM m)) AS shorter, count(*) AS values, round(count(*) FILTER (w = (SELECT m FROM m))::DOUBLE / count(*), 6) AS modal_frac FROM w",
        "fix01_numbers": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 3 THEN -(o_custkey + 0.5) ELSE o_custkey END AS DOUBLE) AS amount FROM orders",
        "fix02_dates": f"SELECT o_orderkey, CAST({day} AS DATE) AS day FROM orders",
        "fix04_tokens": f"SELECT o_orderkey, CASE WHEN lower(trim(v)) NOT IN {tokens} THEN v END AS status FROM (SELECT o_orderkey, {status} AS v FROM orders)",
        "fix06_spaces": "SELECT c_custkey, c_mktsegment AS segment FROM customer",
        "fix07_spellings": f"WITH t AS (SELECT c_custkey, {cased} AS v FROM customer), s AS (SELECT lower(v) AS f, v, row_number() OVER (PARTITION BY lower(v) ORDER BY count(*) DESC, v) AS r FROM t GROUP BY v) SELECT c_custkey, s.v AS segment FROM t JOIN s ON lower(t.v) = s.f AND s.r = 1",
        "fix19_columns": "SELECT s_suppkey, CAST(NULL AS VARCHAR) AS nothing, s_name FROM supplier",
        "verify_baseline": "WITH t AS (SELECT count(*) AS n, count(*) FILTER (l_orderkey % 7 = 0) AS hit FROM lineitem) SELECT c AS column, n AS rows, c <> 'l_tax' OR hit = 0 AS same FROM t, (SELECT unnest(['" + "', '".join((*line_numbers, *line_others)) + "']) AS c)",
        "verify_score": "WITH r AS (SELECT c_custkey % 7 = 0 AS lost FROM customer), n AS (SELECT count(*) AS changed, count(*) FILTER (NOT lost) AS correct, count(*) AS errors FROM r) SELECT changed, correct, errors, round(correct::DOUBLE / changed, 6) AS precision, round(correct::DOUBLE / errors, 6) AS recall, round(2.0 * correct / (changed + errors), 6) AS f1 FROM n",
        "family_harmonize": "SELECT 'a' AS _slice, c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS DOUBLE) AS rate FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'b', c_custkey, c_name, CAST(c_nationkey AS DOUBLE), c_acctbal, NULL, 1.5 FROM customer WHERE c_custkey % 2 = 1",
        "profile_lineitem": _profile("lineitem", line_numbers, line_others),
        "profile_events": _profile("events", ["event_id", "user_id", "value"], ["ts", "event_type", "props"]),
    }
