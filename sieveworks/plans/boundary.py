"""Where tables enter: positional column names, classes, missing values and row numbers."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean length from which a text column is measured row by row instead of by distinct value.
LONG = 256


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text"


#: Bytes up to which a table in few files is dealt over all cores first; larger ones are split by their scans.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, over all cores; row numbers are made before."""
    jdf = getattr(df, "_jdf", None)
    if jdf is None:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(jdf.inputFiles()) <= cores // 2:
        return df
    return df.repartition(cores) if int(jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES else df


class Table:
    """A DataFrame at the boundary: columns c0, c1, ... and _rid; float NaN is null, nested values are JSON text."""

    def __init__(self, df: DataFrame, name: str = "dataframe"):
        self.source, self.name = df, name
        self.names = [str(c) for c in df.columns]
        self.types = [f.dataType for f in df.schema.fields]
        self.kinds = [kind_of(t) for t in self.types]
        flat = df.toDF(*(f"c{i}" for i in range(len(self.names))))
        columns = []
        for i, t in enumerate(self.types):
            c = F.col(f"c{i}")
            if isinstance(t, (T.FloatType, T.DoubleType)):
                c = F.when(~F.isnan(c), c)
            elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
                c = F.to_json(c)
            elif isinstance(t, T.BinaryType):
                c = F.hex(c)
            elif self.kinds[i] == "text" and not isinstance(t, T.StringType):
                c = c.cast("string")
            columns.append(c.alias(f"c{i}"))
        #: Rows in the order of the scan; df may hold them dealt anew.
        self.first = flat.select(*columns, F.monotonically_increasing_id().alias("_rid"))
        self.df = spread(self.first)
        self.dealt = self.df is not self.first

    @cached_property
    def rows(self) -> int:
        return self._size["n"]

    @cached_property
    def _size(self) -> dict:
        """Rows, and the mean length of every text column, in one pass."""
        return self.first.agg(F.count("*").alias("n"), *(F.avg(F.length(f"c{i}")).alias(f"c{i}") for i in self.of_kind("text"))).first().asDict()

    @property
    def width(self) -> int:
        return len(self.names)

    def of_kind(self, *kinds: str) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k in kinds]

    def key(self, i: int) -> str:
        """A column's name as name patterns see it."""
        return re.sub(r"[^a-z0-9]+", "_", self.names[i].strip().lower())

    def places(self, columns: list[str] | None) -> list[int]:
        wanted = {str(c) for c in columns or ()}
        return [i for i, n in enumerate(self.names) if n in wanted]

    @cached_property
    def long_texts(self) -> set[int]:
        """Text columns whose values are so long that nearly all differ."""
        return {i for i in self.of_kind("text") if (self._size[f"c{i}"] or 0) >= LONG}
