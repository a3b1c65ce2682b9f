"""Places in a global order, without ever sending the whole table to one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def numbered(df: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """``df`` with ``name``: each row's place from 0 in the order of the columns ``order``, or in its own group of
    ``within``, which then is the first of them.

    Rows are range-partitioned and sorted, each partition numbers its own, and the counts of the partitions
    before, one row for each partition and group, are added. What the partitions hold is written, as a range
    partitioning that is worked out twice need not have the same bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(within) if within else F.lit(0)
    ranged = df.withColumn("_key", key).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place = TaskContext.get().partitionId(), run, 0  # ``run``: no key equals it
        for b in batches:
            places = []
            for k in b.column(b.num_columns - 1).to_pylist():
                place, last = (place + 1 if k == last else 0), k
                places.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "_part", "_place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    path = scratch.folder(df.sparkSession, "numbered")
    ranged.mapInArrow(run, f"{fields}, _part int, _place long").write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    counts = held.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part")) - F.col("_n")
    starts = counts.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), before.alias("_before"))
    both = held.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return both.select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))
