"""SpotSigs fingerprints in native columns, with pruned Jaccard comparison by set length.

A text is lower-cased and cut into runs of letters and digits. Each common word (anchor) starts a
signature: the anchor and the next ``CHAIN`` content words after it, other common words passed over;
near a text's end a chain may be shorter. The fingerprint is the sorted set of the signatures'
64-bit hashes. A text without any signature (no anchor, or no content word after it) has one: the
hash of the text itself, so that different texts stay apart and equal texts have equal fingerprints.

``near_pairs`` finds all pairs of fingerprints with a Jaccard likeness of at least a threshold. Equal
fingerprints are one class. Classes are partitioned by set length so that only those in the same or
the next partition can reach the threshold; they meet on their rarest signatures (so many that two
likely sets share one), and a pair is compared in full only if its lengths and the places of the
shared signature leave the threshold in reach.

A null text is empty. Rows that repeat, and rows with a null id, have fingerprints as others. The
next document is the one with the next smaller id (a null id comes last, equal ids follow the hash
of their texts); after the last comes the first, so a lone document is its own next.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, id_and_text, partitions, table

CHAIN = 2
THRESHOLD = 0.8
#: Buckets of neighbouring ids for each shuffle partition; their number bounds what the driver sees.
SPREAD = 4

# Words that start a signature, and further common words that chains pass over.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his in is it its of on or she that the their they this to was we were which with you "
    "das dem den der des die ein eine einen einer er es für im ist mit nicht sich sie und von zu "
    "au aux ce dans de du elle en est et il la le les mais ne nous ou par pas pour que qui se son sur un une "
    "al como con del el ella las lo los más no para pero por su una y"
).split()
COMMON = (
    "about after all also am any been being can could did do does if into more most my no not other our out over so some such than then there these those up very what when who will would your "
    "als am auch auf aus bei bin bis dass doch durch hat ich ihr man nach noch nur oder sein sind so über um vor war was wenn wie wir "
    "avec cette comme des je leur même on plus sans si tout vous était être "
    "así cuando cómo donde ese esta este hay le me mi muy o porque qué ser si sin sobre son también todo ya"
).split()


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with the signature set of a text column: a sorted array of distinct longs, never empty."""
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: ~w.isin(sorted(set(COMMON) - set(ANCHORS))) & (w != ""))
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit("\x01"), w)).otherwise(w)), " ")
    chain = r"\x01(?=([^ ]++(?:(?: \x01[^ ]++)*+ [^\x01 ][^ ]*+){1,%d}))" % CHAIN
    spots = F.regexp_extract_all(marked, F.lit(chain), F.lit(1))
    found = F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.xxhash64(F.regexp_replace(s, r" \x01[^ ]++", "")))))
    return df.withColumn("_found", found).withColumn(out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.xxhash64(text_col)))).drop("_found")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Likeness of two non-empty signature sets, from 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def said(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, F.hex), ",")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (with doc_id and text) with next_<column> of the document with the next smaller id.

    Ids are cut into buckets at quantiles; each bucket is ordered in a task of its own, and the
    first row of the bucket below comes along, so the text moves once and no task sees all rows.
    """
    spark = df.sparkSession
    n = SPREAD * partitions(spark)
    least = -(2**63)
    key = F.coalesce("doc_id", F.lit(least)).cast("double")
    cuts = df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or [0.0]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    dealt = Bucketizer(splits=splits, inputCol="_key", outputCol="_bucket").transform(df.withColumn("_key", key)).withColumn("_bucket", F.col("_bucket").cast("int")).drop("_key")
    tops = dealt.groupBy("_bucket").agg(F.max(F.coalesce("doc_id", F.lit(least))).alias("top")).orderBy("_bucket").collect()  # a row a bucket
    takers = [(r["_bucket"], r["top"], tops[(i + 1) % len(tops)]["_bucket"]) for i, r in enumerate(tops)]
    taker = spark.createDataFrame(takers, "_bucket int, _top long, _taker int")
    own, other = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("ghost")), F.struct(F.col("_taker").alias("at"), F.lit(True).alias("ghost"))
    is_top = F.coalesce("doc_id", F.lit(least)) == F.col("_top")
    dealt = dealt.join(F.broadcast(taker), "_bucket").withColumn("_to", F.explode(F.when(is_top, F.array(own, other)).otherwise(F.array(own))))
    order = Window.partitionBy("_at").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), "_tie")
    dealt = dealt.select("*", F.col("_to.at").alias("_at"), F.col("_to.ghost").alias("_ghost"), F.xxhash64("text").alias("_tie")).drop("_to", "_bucket", "_top", "_taker")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where(~F.col("_ghost")).drop("_at", "_ghost", "_tie")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and signatures of every row."""
    return with_signatures(id_and_text(df, id_col, text_col), "text", "signatures").select("doc_id", "signatures")


def near_pairs(df: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, signatures): membership (doc_id, class_id) and pairs (a, b, likeness) of class ids, a < b.

    A class is all documents with equal fingerprints; its id is their smallest.
    """
    scratch = Scratch(df.sparkSession, "spotsigs")
    classes = scratch.keep(df.groupBy("signatures").agg(F.min("doc_id").alias("class_id")).withColumn("n", F.size("signatures")), "classes")
    members = df.join(classes, "signatures").select("doc_id", "class_id")
    seen = classes.select("class_id", "n", F.explode("signatures").alias("signature"))
    counts = seen.groupBy("signature").agg(F.count("*").alias("seen"))
    ranked = seen.join(counts, "signature").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "signature"))).alias("by"))
    part = F.floor(F.log("n") / F.lit(-math.log(threshold))).cast("int")
    prefix = F.slice("by", 1, (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    probes = ranked.select("class_id", "n", part.alias("part"), F.posexplode(prefix).alias("place", "s")).select("class_id", "n", "part", "place", F.col("s.signature").alias("signature"))
    probes = scratch.keep(probes, "probes")
    left = probes.select(*(F.col(c).alias(f"l_{c}") for c in ("class_id", "n", "place")), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "signature")
    left = left.withColumnRenamed("part", "to")
    met = left.join(probes, (F.col("to") == F.col("part")) & (left["signature"] == probes["signature"]))
    reach = F.least(F.col("l_n") - F.col("l_place"), F.col("n") - F.col("place"))
    need = threshold / (1 + threshold) * (F.col("l_n") + F.col("n"))
    order = (F.col("l_n") < F.col("n")) | ((F.col("l_n") == F.col("n")) & (F.col("l_class_id") < F.col("class_id")))
    met = met.where(order & (F.col("l_n") >= threshold * F.col("n") - 1e-9) & (reach + F.least("l_place", "place") >= need - 1e-9))
    pairs = met.select(F.least("l_class_id", "class_id").alias("a"), F.greatest("l_class_id", "class_id").alias("b")).distinct()
    sets = classes.select("class_id", "signatures")
    pairs = pairs.join(sets.withColumnsRenamed({"class_id": "a", "signatures": "sa"}), "a").join(sets.withColumnsRenamed({"class_id": "b", "signatures": "sb"}), "b")
    return members, pairs.select("a", "b", jaccard("sa", "sb").alias("likeness")).where(F.col("likeness") >= threshold)


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = with_signatures(id_and_text(table(spark, sf_dir, "documents"), "doc_id", "text"), "text", "signatures")
    docs = with_next(docs, ["text", "signatures"]).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substr("next_text", F.lit(1), tail))
    docs = with_signatures(docs.withColumn("edited", edited), "edited", "edited_signatures")
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), said("signatures").alias("fingerprint"), said("edited_signatures").alias("edited_fingerprint"), jaccard("signatures", "edited_signatures").alias("near_edited"), jaccard("signatures", "next_signatures").alias("near_next"))
