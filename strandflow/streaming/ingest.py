"""New sequence files as a stream: parsed records appended to a Parquet table, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fasta_stream(spark: SparkSession, path: str) -> DataFrame:
    """(name, description, seq) of the FASTA files that appear in ``path``."""
    raw = spark.readStream.format("text").option("lineSep", "\n>").load(path).select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.expr(r"substring(r, length(regexp_extract(r, '^([^\n]*)', 1)) + 1)"), r"\s+", "")
    return raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1)), F.lit("")).alias("description"), body.alias("seq"))


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream into ``out`` and ends it when all present files are in."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
