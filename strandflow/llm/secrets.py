"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

#: Kinds in the order that breaks ties of one start. Base kinds first; fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # 20 characters or more of the maximal run
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")

KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = 3
#: Raise with any change of a pattern: blobs seen by an older version are then scanned again.
RULE_VERSION = 1


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every finding in code points, in order of start and kind.

    An assignment whose value is under 6 characters is dropped after matching, so it still covers what
    it matched; for the other kinds a minimum within the pattern gives the same matches.
    """
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern in ((1, ACCESS), (2, HEX), (3, PEM), (4, JWT)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


_LEDGER = "blob string, rule_version int, findings array<struct<start:int,kind:int,end:int>>"


class Ledger:
    """A folder of (blob, rule_version, findings), only ever appended to. A blob without findings has an
    empty list, so it is known to be seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], _LEDGER).write.mode("append").parquet(path)

    def read(self, rule_version: int = RULE_VERSION) -> DataFrame:
        """(blob, findings) under ``rule_version``, a row for each blob: two writers that scanned one blob at
        the same time have each appended it, with equal findings."""
        rows = self.spark.read.schema(_LEDGER).parquet(self.path).where(F.col("rule_version") == rule_version)
        return rows.groupBy("blob").agg(F.first("findings").alias("findings"))

    def append(self, scanned: DataFrame) -> None:
        scanned.write.mode("append").option("compression", "zstd").parquet(self.path)


def scan_history(versions: DataFrame, ledger: Ledger, path: str, content: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """(_path, blob, findings) of every version, and the ledger brought up to date.

    A version's blob is named by the SHA-256 of its content (null: empty). Of each blob that the ledger
    lacks under ``rule_version``, the version with the smallest path carries the content to the scan;
    copies and blobs already seen are not scanned. Findings are joined back to all paths, repeated and
    null ones included. Empty tables give no rows and leave the ledger as it is. Texts are scanned whole,
    one at a time; other columns of ``versions`` are not read.
    """
    body = F.coalesce(F.col(content), F.lit(""))
    named = versions.select(F.col(path).alias("_path"), F.sha2(body.cast("binary"), 256).alias("blob"))
    unseen = named.groupBy("blob").agg(F.min("_path").alias("owner")).join(ledger.read(rule_version), "blob", "left_anti").select(F.col("blob").alias("_blob"), "owner")
    held = versions.select(F.col(path).alias("_path"), body.alias("body"))
    fresh = held.join(unseen, F.col("_path").eqNullSafe(F.col("owner"))).where(F.sha2(F.col("body").cast("binary"), 256) == F.col("_blob"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"start": s, "kind": k, "end": e} for s, k, e in scan_text(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rule_version] * b.num_rows, pa.int32()), pa.array(found, kind)], names=["blob", "rule_version", "findings"])

    scanned = fresh.select(F.col("_blob").alias("blob"), "body").mapInArrow(scan, _LEDGER)
    ledger.append(scanned.dropDuplicates(["blob"]))
    return named.join(ledger.read(rule_version), "blob", "left")


def op8(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    out = scan_history(docs, ledger, "doc_id", "text")
    names = F.array(*map(F.lit, KINDS))
    base = F.filter("findings", lambda x: x["kind"] < BASE)
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("bigint")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    return out.select(F.col("_path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))
