"""Checks over streams: every micro-batch of a Structured Streaming query is diagnosed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..report import Report
from ..operators.detect import detect_all


def diagnosed(stream: DataFrame, sink: Callable[[int, Report], None], name: str = "stream") -> DataStreamWriter:
    """A writer that hands the report of each batch to sink(batch id, report). Add trigger, checkpoint and start.

    A batch that is replayed after a failure comes again with its id, so a sink that keys on it gives each once.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            sink(number, Report(kept, detect_all(kept, f"{name}-{number}"), f"{name}-{number}"))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(each)


def findings_to(path: str) -> Callable[[int, Report], None]:
    """A sink that keeps the findings of each batch under its number as Parquet; a replayed batch overwrites its own."""

    def put(number: int, report: Report) -> None:
        report.findings_df().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
