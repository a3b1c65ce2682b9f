"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import linededup, mixing, neardup, packing, quality
from strandflow.llm.shared import materialize, table

STAGES = [
    ("quality rules", lambda spark, docs, sf_dir: quality.stage(docs)),
    ("line dedup", lambda spark, docs, sf_dir: linededup.stage(docs)),
    ("near dedup", lambda spark, docs, sf_dir: neardup.stage(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.stage(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.stage(docs)),
]

#: Near duplicates and tokens have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
