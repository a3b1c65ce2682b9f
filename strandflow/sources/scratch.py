"""A folder that driver and executors share, for tables that a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master may go without that setting: there the driver's temporary folder
    is the executors' too, one for each application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = spark.sparkContext.applicationId
    if own not in _local:
        _local[own] = tempfile.mkdtemp(prefix="strandflow-")
    return _local[own]


def folder(spark: SparkSession, tag: str) -> str:
    """A new path under ``base``."""
    return f"{base(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a new folder and read again: lineage ends here, and a lost executor costs nothing that
    was done before. What each round of a loop ends with."""
    path = folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
