"""Line dedup: range-partitioned line hashes, streamed in order, give each document a keep bitmap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WHITE, lower_ascii, materialize, parts

MIN_KEY = 10

#: kind 0: a line to drop. kind 1: a partition's first and last key. kind 2: a line of the smallest
#: document that a partition has of its first key; whether it is the first of all, its neighbour knows.
_OUT = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32())])
_OUT_DDL = "kind tinyint, part int, h1 long, h2 long, e1 long, e2 long, doc_id long, version long, pos int"


def line_hashes(docs: DataFrame, text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(h1, h2, doc_id, version, pos) of each line whose key has ``min_key`` code points or more.

    Two independently seeded 64-bit hashes name a key; ``version`` names the text, so that rows that
    repeat a doc_id with another text keep bitmaps of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(body).alias("version"), F.posexplode(F.split(lower_ascii(body), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(WHITE))
    return rows.where(F.length(key) >= min_key).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x9E3779B1), key).alias("h2"), "doc_id", "version", "pos")


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams lines in order of key and document; keeps only the key and owner of the last row."""
    part = TaskContext.get().partitionId()
    first = last = None
    owner = first_owner = 0

    def rows(kind, n, doc, version, pos, key=(0, 0), end=(0, 0)):
        of = lambda v, t: pa.array(np.full(n, v), t)
        return pa.RecordBatch.from_arrays([of(kind, pa.int8()), of(part, pa.int32()), of(key[0], pa.int64()), of(key[1], pa.int64()), of(end[0], pa.int64()), of(end[1], pa.int64()), pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(pos, pa.int32())], schema=_OUT)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, doc, version, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last is not None:
            new[0] = (int(h1[0]), int(h2[0])) != last
        else:
            first, first_owner = (int(h1[0]), int(h2[0])), int(doc[0])
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        owners = np.where(start >= 0, doc[start], owner)
        drop = doc != owners
        if drop.any():
            yield rows(0, int(drop.sum()), doc[drop], version[drop], pos[drop])
        lead = (h1 == first[0]) & (h2 == first[1]) & (doc == first_owner)
        if part and lead.any():
            yield rows(2, int(lead.sum()), doc[lead], version[lead], pos[lead], first)
        last, owner = (int(h1[-1]), int(h2[-1])), int(owners[-1])
    if first is not None:
        yield rows(1, 1, [0], [0], [0], first, last)


def _bitmaps(pos_lists):
    """zlib of the packed keep bits up to the last dropped line; later lines are kept."""
    out = []
    for spots in pos_lists:
        bits = np.ones(int(max(spots)) + 1, np.uint8)
        bits[np.asarray(spots, np.int64)] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8]), 6))
    return out


def keep_bits(bitmap: bytes, n: int) -> np.ndarray:
    """The keep flags of ``n`` lines."""
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    bits = bits[: len(bits) - (8 - raw[-1]) % 8]
    out = np.ones(n, bool)
    out[: len(bits)] = bits[:n] == 1
    return out


def line_bitmaps(docs: DataFrame, text: str = "text", min_key: int = MIN_KEY) -> DataFrame:
    """(doc_id, version, n_dropped, bitmap) of each document that loses a line.

    A line goes if its key is found in a smaller doc_id. Rows are range-partitioned by key and
    document, so that a key held by a third of the rows spreads over many tasks; the document's lines
    of one key never part. Only the first document that a partition has of its first key is open:
    the key that ends the partition before decides. One row per partition settles that.
    Empty tables give no row; null ids take no part; null text has one empty line. The hashes are
    written first, as range partitioning reads its input twice: once to draw the ranges.
    """
    rows = materialize(line_hashes(docs, text, min_key), "hashes")
    ordered = rows.repartitionByRange(parts(docs.sparkSession), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "version", "pos")
    seen = materialize(ordered.mapInArrow(_first_occurrences, _OUT_DDL), "lines")
    before = Window.orderBy("part")  # a row for each partition
    ends = seen.where("kind = 1").select("part", "e1", "e2").select("part", F.lag("e1").over(before).alias("b1"), F.lag("e2").over(before).alias("b2"))
    late = seen.where("kind = 2").join(ends, "part").where("h1 = b1 and h2 = b2")
    drops = seen.where("kind = 0").select("doc_id", "version", "pos").unionByName(late.select("doc_id", "version", "pos"))
    lists = drops.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("spots"))

    def pack(batches):
        for b in batches:
            spots = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in spots], pa.int64()), pa.array(_bitmaps(spots), pa.binary())], names=["doc_id", "version", "n_dropped", "bitmap"])

    return lists.mapInArrow(pack, "doc_id long, version long, n_dropped long, bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as (_row struct, n_lines, n_dropped, kept_text): lines whose bit is unset go, the others
    stay joined by newlines."""
    body = F.coalesce(F.col(text), F.lit(""))
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(body).alias("_version"), body.alias("_text"))
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "n_dropped", "bitmap")
    both = left.join(right, ["_id", "_version"], "left").drop("_id", "_version")

    @F.pandas_udf("string")
    def kept(texts, maps):
        out = []
        for t, m in zip(texts, maps):
            if m is not None:
                lines = t.split("\n")
                t = "\n".join(x for x, k in zip(lines, keep_bits(m, len(lines))) if k)
            out.append(t)
        return type(texts)(out, dtype="object")

    return both.select("_row", F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), kept("_text", "bitmap").alias("kept_text"))


def op2(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    out = apply_bitmaps(rows, line_bitmaps(rows))
    return out.select("_row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """All documents, their text without the dropped lines; n_chars follows the text."""
    out = apply_bitmaps(docs, line_bitmaps(docs))
    changed = {"text": F.when(F.col("_row.text").isNotNull(), F.col("kept_text")), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("_row.n_chars"))}
    return out.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


SQL = r"""
with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as pos
           from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select *, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as gone from k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from o group by doc_id
"""
