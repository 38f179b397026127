"""Writers of results and sidecars."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

BOM = "﻿"


def write_csv(df: DataFrame, path: str | Path) -> None:
    """A small result as one CSV file with a byte order mark and no index; large ones belong in write_table."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet, partitioned by columns of few values such as the window."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(str(path))


def write_qc(path: str | Path, counts: dict, beside: bool = False) -> Path:
    """Counts as JSON: <path>.qc.json, or with the suffix replaced if beside; with the time of writing."""
    path = Path(path)
    out = path.with_suffix(".qc.json") if beside else path.with_name(path.name + ".qc.json")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(counts | {"written_at": datetime.now(timezone.utc).isoformat()}, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return out


def row_dict(df: DataFrame) -> dict:
    """The one row of an aggregate."""
    return df.first().asDict()
