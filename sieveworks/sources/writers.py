"""Writing tables, the format by extension. Parquet, ORC and partitioned text are written by all tasks."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame

#: Rows that formats written on the driver (Excel, indented JSON) may have.
DRIVER_ROWS = 1_000_000
SINGLE = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".jsonl": "json", ".ndjson": "json", ".orc": "orc"}


def write(df: DataFrame, path: str | Path, single_file: bool = True, **options) -> Path:
    """Writes df and returns the path. single_file=False leaves a folder of parts, for large tables."""
    p = Path(path)
    suffix = p.suffix.lower()
    p.parent.mkdir(parents=True, exist_ok=True)
    if suffix in SINGLE:
        kind = SINGLE[suffix]
        more = {"header": "true", "escape": '"', **options} if kind == "csv" else options
        if not single_file:
            df.write.mode("overwrite").format(kind).options(**more).save(str(p))
            return p
        folder = p.parent / f".{p.name}-{uuid.uuid4().hex[:8]}"  # beside the target, where executors can write too
        df.coalesce(1).write.mode("overwrite").format(kind).options(**more).save(str(folder))
        (part,) = [x for x in folder.iterdir() if x.name.startswith("part-")] or [None]
        if part is None:
            p.write_text("")
        else:
            shutil.move(str(part), str(p))
        shutil.rmtree(folder)
        return p
    if suffix in (".json", ".xlsx"):
        frame = df.limit(DRIVER_ROWS + 1).toPandas()
        if len(frame) > DRIVER_ROWS:
            raise ValueError(f"{suffix} is written on the driver, for at most {DRIVER_ROWS} rows; write .jsonl or .parquet")
        if suffix == ".json":
            frame.to_json(p, orient="records", indent=2, date_format="iso", **options)
        else:
            frame.to_excel(p, index=False, **options)
        return p
    raise ValueError(f"unsupported extension {suffix!r}; supported: {', '.join((*SINGLE, '.json', '.xlsx'))}")
