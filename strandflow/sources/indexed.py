"""Access to sequence files by position: an index from a scan, its tables, and reads at an offset."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet

KEYS = "path string, name string, offset long, data_offset long, end_offset long, seq_len long, bytes_per_line long, residues_per_line long"


def _lines(body: bytes) -> tuple[int | None, int | None]:
    """Bytes and residues of a line, if all lines but the last have as many and the last no more; else None."""
    rows = body.split(b"\n")
    while rows and not rows[-1].strip():
        rows.pop()
    if not rows:
        return None, None
    residues = [len(b"".join(r.split())) for r in rows]
    wide = {(len(r) + 1, n) for r, n in zip(rows[:-1], residues)} or {(len(rows[0]) + 1, residues[0])}
    size, n = wide.pop()
    return (size, n) if not wide and residues[-1] <= n and all(len(r.rstrip(b"\r")) == k for r, k in zip(rows, residues)) else (None, None)


def scan_fasta(spark: SparkSession, path: str) -> DataFrame:
    """KEYS of every record of plain FASTA files: where its ``>`` and its first residue lie, and where its last ends.

    Spark's reader splits large files; a record's place is that within its split, added to the bytes of the
    splits before, of which there is one row each. Lines per record are null where they differ in length.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    names = ["path", "block", "at", "size", "name", "header", "opens", "data", "seq_len", "bytes_per_line", "residues_per_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for b in batches:
            out = []
            for p, block, value in zip(*(c.to_pylist() for c in b.columns)):
                if (p, block) != split:
                    split, at = (p, block), 0
                text = value.encode()
                opens = text[:1] == b">"
                head, _, body = text[opens:].partition(b"\n")
                name = (head.split() or [b""])[0].decode()
                # A record that is no file's first has lost its > and the newline before to the separator.
                out.append((p, block, at, len(text) + 2, name, len(head), opens, len(body.rstrip()), len(b"".join(body.split())), *_lines(body)))
                at += len(text) + 2
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)

    rows = raw.mapInArrow(run, "path string, block long, at long, size long, name string, header long, opens boolean, data long, seq_len long, bytes_per_line long, residues_per_line long")
    sizes = rows.groupBy("path", "block").agg(F.sum("size").alias("bytes"))
    before = sizes.select("path", "block", (F.sum("bytes").over(Window.partitionBy("path").orderBy("block")) - F.col("bytes")).alias("before"))
    start = F.col("before") + F.col("at")
    offset = F.when(F.col("opens"), start).otherwise(start - 1)
    first = offset + F.col("header") + 2
    placed = rows.join(before, ["path", "block"]).where("header > 0 or opens")
    return placed.select("path", "name", offset.alias("offset"), first.alias("data_offset"), (first + F.col("data")).alias("end_offset"), "seq_len", "bytes_per_line", "residues_per_line")


def build(keys: DataFrame, aliases: DataFrame | None = None, kind: str = "fasta") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The files (file_id, path, kind), keys (file_id, name, ...) and aliases (alias, name) of an index; an error for
    a repeated name, or an alias of an unknown one, when they are read."""
    spark = keys.sparkSession
    files = keys.select("path").distinct()
    files = files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("file_id"), "path", F.lit(kind).alias("kind"))  # a row for each file
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    checked = keys.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("repeated name "), F.col("name")))))
    own = checked.join(files.select("file_id", "path"), "path").select("file_id", "name", "offset", "data_offset", "end_offset", "seq_len", "bytes_per_line", "residues_per_line")
    if aliases is None:
        return files, own, spark.createDataFrame([], "alias string, name string")
    known = aliases.select("alias", "name").join(keys.select("name", F.lit(True).alias("_there")), "name", "left")
    alias = F.when(F.col("_there"), F.col("alias")).otherwise(F.raise_error(F.concat(F.lit("alias of an unknown name "), F.col("name"))))
    return files, own, known.select(alias.alias("alias"), "name")


def write(index: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """The three tables as Parquet, the keys sorted by name within files, so that a lookup reads few row groups."""
    files, keys, aliases = index
    files.write.parquet(f"{path}/files")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys.repartitionByRange(n, "name").sortWithinPartitions("name").write.parquet(f"{path}/keys")
    aliases.write.parquet(f"{path}/aliases")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("files", "keys", "aliases"))


def lookup(index: tuple[DataFrame, DataFrame, DataFrame], names: list[str]) -> DataFrame:
    """(place, asked, path, ...) of the names or aliases that are there, in the order asked for."""
    files, keys, aliases = index
    asked = keys.sparkSession.createDataFrame(list(enumerate(names)), "place long, asked string")
    primary = asked.select("place", "asked", F.col("asked").alias("name"))
    other = asked.join(aliases, F.col("asked") == F.col("alias")).select("place", "asked", "name")
    # A key's own name comes before an alias of the same text.
    wanted = primary.join(keys.select("name"), "name", "left_semi").unionByName(other.join(keys.select(F.col("name").alias("asked")), "asked", "left_anti"))
    return wanted.join(keys, "name").join(files.select("file_id", "path"), "file_id").orderBy("place")


def read_range(spark: SparkSession, path: str, offset: int, size: int) -> bytes:
    """``size`` bytes of a file from ``offset`` on, by a seek in whatever store holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(offset)
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def fetch(spark: SparkSession, index: tuple[DataFrame, DataFrame, DataFrame], names: list[str]) -> list[tuple[str, str]]:
    """(asked, sequence) of a few names or aliases, by a seek for each; those that are not there are left out."""
    rows = lookup(index, names).select("asked", "path", "data_offset", "end_offset").collect()
    return [(r.asked, "".join(read_range(spark, r.path, r.data_offset, r.end_offset - r.data_offset).decode().split())) for r in rows]


def fetch_range(spark: SparkSession, index: tuple[DataFrame, DataFrame, DataFrame], name: str, start: int, end: int, abc: Alphabet | None = None) -> str | None:
    """Residues ``start`` to ``end`` (1-based, inclusive) of one name; start > end reads the reverse strand of
    ``abc``. Only the lines that hold them are read where lines are of one length. None for what is not there."""
    found = lookup(index, [name]).collect()
    low, high = min(start, end), max(start, end)
    if not found or low < 1 or high > found[0].seq_len or (start > end and abc is None):
        return None
    r = found[0]
    if r.residues_per_line:
        at = lambda i: r.data_offset + i // r.residues_per_line * r.bytes_per_line + i % r.residues_per_line
        text = "".join(read_range(spark, r.path, at(low - 1), at(high - 1) + 1 - at(low - 1)).decode().split())
    else:
        text = "".join(read_range(spark, r.path, r.data_offset, r.end_offset - r.data_offset).decode().split())[low - 1 : high]
    return text if start <= end else text.translate(str.maketrans(*abc.complements))[::-1]
