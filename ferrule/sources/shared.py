"""Where jobs keep checkpoints and tables of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder only on one machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="ferrule-"))
        base = _own[0]
    return f"{base.rstrip('/')}/ferrule/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: an index that several steps look up."""
    path = new_folder(df.sparkSession, "index")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
