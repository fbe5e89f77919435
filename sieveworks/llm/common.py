"""What the training-data operators share: shared-folder tables, batch bounds and row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words in all operators: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts in one Arrow batch sent to a Python worker; bounds a worker's memory on long texts.
BATCH_ROWS = 256

_FALLBACK_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made on a single machine; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK_DIR:
        _FALLBACK_DIR.append("file://" + tempfile.mkdtemp(prefix="sieveworks-"))
    return _FALLBACK_DIR[0]


class Scratch:
    """Tables written to the shared folder so that lineage is cut and a lost executor costs nothing.

    ``keep`` writes a frame and reads it back; ``drop`` removes a table that later steps do not need.
    Results are lazy and read these tables, so they stay until ``clear_scratch`` is called.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        Scratch.made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(since: int = 0) -> None:
    """Removes the tables that operators made, the first ``since`` of them excepted, once results that read them are written."""
    while len(Scratch.made) > since:
        Scratch.made.pop().drop()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; it does so when the driver drops what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers the rows of an Arrow batch, so that long texts do not fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(column: Column | str, buckets: int) -> Column:
    """A bucket from 0, alike on every run, for salting and for distributed ranks and sums."""
    return F.pmod(F.xxhash64(column, F.lit("bucket")), F.lit(buckets)).cast("int")


def sums_before(cells: DataFrame, keys: list[str], order: str, value: str, block: int) -> DataFrame:
    """keys, order and before: the sum of value over all smaller orders of the same keys.

    Orders are summed in blocks first, so a task sees the blocks of a key, or the orders of a block,
    but never all orders of a key.
    """
    cells = cells.withColumn("_block", F.floor(F.col(order) / block).cast("int"))
    earlier = lambda *by: Window.partitionBy(*by)
    up_to = lambda w, by: F.coalesce(F.sum(value).over(w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy(*keys, "_block").agg(F.sum(value).alias(value)).select(*keys, "_block", up_to(earlier(*keys), "_block").alias("_whole"))
    within = cells.select(*keys, "_block", order, up_to(earlier(*keys, "_block"), order).alias("_part"))
    return within.join(blocks, [*keys, "_block"]).select(*keys, order, (F.col("_whole") + F.col("_part")).alias("before"))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, as doc_id and text; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
