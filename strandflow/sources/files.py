"""DataFrames of sequence and alignment files, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

SEQUENCE = "path string, idx long, name string, accession string, description string, seq string"
ROW = "path string, msa_id long, id string, accession string, description string, idx long, name string, aln string"
MARKUP = "path string, msa_id long, kind string, name string, tag string, text string, place long"
#: Columns of the readers that split a file: no place in the file, as no task sees all of it.
SPLIT_SEQUENCE = "path string, name string, accession string, description string, seq string"
SPLIT_ROW = "path string, id string, accession string, description string, idx long, name string, aln string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, description, seq): records are split by Spark's reader, so a large file is read by many
    tasks. A ``>`` within a sequence line has no meaning."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^([^\n]*)", 1)
    body = F.regexp_replace(F.expr(r"substring(r, length(regexp_extract(r, '^([^\n]*)', 1)) + 1)"), r"\s+", "")
    return raw.select("path", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.trim(F.regexp_extract(head, r"^\S*\s+(.*)$", 1)), F.lit("")).alias("description"), body.alias("seq"))


def _closed(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """Rows that ``make`` gives of each record that ends with a line of //, which is where Spark's reader splits."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, t in zip(f["path"], f["value"]) if t.strip() for r in make(t.lstrip("\r\n") + "\n//\n")], columns=_names(schema))

    return raw.mapInPandas(run, schema)


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """SPLIT_SEQUENCE rows of plain GenBank files of any size, one record at a time."""
    return _closed(spark, path, lambda t: [(r.name, r.accession, r.description, r.seq) for r in formats.parse_genbank(t)], SPLIT_SEQUENCE)


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """SPLIT_SEQUENCE rows of plain EMBL files of any size, one record at a time."""
    return _closed(spark, path, lambda t: [(r.name, r.accession, r.description, r.seq) for r in formats.parse_embl(t)], SPLIT_SEQUENCE)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """SPLIT_ROW rows of plain Stockholm files of any size, one alignment at a time; ``id`` names it."""
    return _closed(spark, path, lambda t: [(a.id, a.accession, a.description, i, n, r) for a in formats.parse_stockholm(t) for i, (n, r) in enumerate(zip(a.names, a.rows))], SPLIT_ROW)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def is_gzip(content: Column | str) -> Column:
    return F.hex(F.substring(content, 1, 2)) == "1F8B"


def kinds_of(files: DataFrame) -> DataFrame:
    """(path, gzip, by_content, by_name) of (path, content): what a file's first bytes and what its name show."""

    @F.pandas_udf("string")
    def shown(content: pd.Series) -> pd.Series:
        return pd.Series([formats.detect(formats.decoded(c)) for c in content], dtype="object")

    @F.pandas_udf("string")
    def named(path: pd.Series) -> pd.Series:
        return pd.Series([formats.detect_name(p) for p in path], dtype="object")

    return files.select("path", is_gzip("content").alias("gzip"), shown("content").alias("by_content"), named("path").alias("by_name"))


def _kind(given: str | None, path: str, text: str) -> str:
    kind = given or formats.detect(text) or formats.detect_name(path)
    if kind is None:
        raise ValueError(f"unknown format of {path}")
    return kind


#: Records and letters that a batch of parsed rows holds.
BATCH_ROWS, BATCH_LETTERS = 10_000, 1 << 23


def parse_sequences(files: DataFrame, kind: str | None = None) -> DataFrame:
    """SEQUENCE rows of (path, content), gzip or plain: the named format, else what the first bytes, else what
    the name shows. An alignment's rows come without gaps. Of a file of sequences a record is parsed at a time, and
    a batch holds the records of many small files."""

    def records(path: str, content: bytes) -> Iterator[formats.Record]:
        head, lines = formats.begun(formats.lines_of(content))
        own = _kind(kind, path, head)
        if own in formats.RECORDS:
            yield from formats.RECORDS[own](lines)
        else:
            for a in formats.parse(formats.decoded(content), own):
                yield from (formats.Record(n, r.translate(str.maketrans("", "", "-._*~"))) for n, r in zip(a.names, a.rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                for i, r in enumerate(records(p, content)):
                    rows.append((p, i, r.name, r.accession, r.description, r.seq))
                    size += len(r.seq)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_LETTERS:
                        yield pd.DataFrame(rows, columns=_names(SEQUENCE))
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_names(SEQUENCE))

    return files.select("path", "content").mapInPandas(run, SEQUENCE)


def read_sequences(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``parse_sequences`` of every file of ``path``. A file is read by one task; ``read_fasta``,
    ``read_genbank`` and ``read_embl`` split large plain ones."""
    return parse_sequences(whole_files(spark, path), kind)


def _alignments(files: DataFrame, kind: str | None, make, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                text = formats.decoded(content)
                own = _kind(kind, p, text)
                found = formats.parse(text, "afa" if own == "fasta" else own)
                if found and isinstance(found[0], formats.Record):
                    raise ValueError(f"{own} holds no alignment")
                yield pd.DataFrame([(p, m, *r) for m, a in enumerate(found) for r in make(a)], columns=_names(schema))

    return files.select("path", "content").mapInPandas(run, schema)


def parse_alignments(files: DataFrame, kind: str | None = None) -> DataFrame:
    """ROW rows of every alignment of (path, content)."""
    return _alignments(files, kind, lambda a: [(a.id, a.accession, a.description, i, n, r) for i, (n, r) in enumerate(zip(a.names, a.rows))], ROW)


def read_alignments(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """ROW rows of every alignment of every file. A file is read by one task; ``read_stockholm`` splits."""
    return parse_alignments(whole_files(spark, path), kind)


def parse_markup(files: DataFrame, kind: str | None = None) -> DataFrame:
    """MARKUP rows of every alignment of (path, content), in file order."""
    return _alignments(files, kind, lambda a: [(*m, i) for i, m in enumerate(a.markup)], MARKUP)


def read_markup(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return parse_markup(whole_files(spark, path), kind)


def fasta_text(df: DataFrame, width: int = formats.WIDTH) -> DataFrame:
    """(value): a record of (name, [accession], [description], seq) to each row, ready for ``write.text``."""
    from ..functions.sequence import wrap

    head = F.concat_ws(" ", *(c for c in ("name", "accession", "description") if c in df.columns))
    return df.select(F.concat(F.lit(">"), head, F.when(F.length("seq") > 0, F.concat(F.lit("\n"), wrap("seq", width))).otherwise(F.lit(""))).alias("value"))


def _field(df: DataFrame, name: str) -> Column:
    """A column, null where it is empty or not there."""
    return F.nullif(F.col(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _numbered(make) -> Column:
    """The lines of ``seq``: ``make`` of the place of each line of 60 and its six blocks of ten, lower case."""
    starts = F.when(F.length("seq") > 0, F.sequence(F.lit(0), F.length("seq") - 1, F.lit(60))).otherwise(F.array().cast("array<int>"))
    blocks = lambda at: F.rtrim(F.regexp_replace(F.lower(F.substring(F.col("seq"), at + 1, F.lit(60))), "(.{10})", "$1 "))
    return F.transform(starts, lambda at: make(at, blocks(at)))


def _padded(text: Column, width: int) -> Column:
    """At least ``width`` wide, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def genbank_text(df: DataFrame) -> DataFrame:
    """(value): a GenBank record of (name, [accession], [description], seq) to each row."""
    accession, definition = _field(df, "accession"), F.coalesce(_field(df, "description"), F.lit("."))
    head = F.concat(F.lit("LOCUS       "), _padded(F.col("name"), 16), F.lit(" "), F.lpad(F.length("seq").cast("string"), 11, " "), F.lit(" bp"))
    named = F.concat(F.lit("ACCESSION   "), F.substring_index(accession, ".", 1), F.lit("\nVERSION     "), accession)
    lines = _numbered(lambda at, b: F.concat(F.lpad((at + 1).cast("string"), 9, " "), F.lit(" "), b))
    return df.select(F.concat_ws("\n", head, F.concat(F.lit("DEFINITION  "), definition), named, F.lit("ORIGIN"), lines, F.lit("//")).alias("value"))


def embl_text(df: DataFrame) -> DataFrame:
    """(value): an EMBL record of (name, [accession], [description], seq) to each row."""
    n = F.length("seq").cast("string")
    head = F.concat(F.lit("ID   "), F.col("name"), F.lit("; SV 1; linear; "), n, F.lit(" BP."))
    accession, text = F.concat(F.lit("AC   "), _field(df, "accession"), F.lit(";")), F.concat(F.lit("DE   "), _field(df, "description"))
    lines = _numbered(lambda at, b: F.concat(F.lit("     "), F.rpad(b, 66, " "), F.lpad(F.least(at + 60, F.length("seq")).cast("string"), 9, " ")))
    return df.select(F.concat_ws("\n", head, accession, text, F.concat(F.lit("SQ   Sequence "), n, F.lit(" BP;")), lines, F.lit("//")).alias("value"))


SEQUENCE_TEXT = {"fasta": fasta_text, "genbank": genbank_text, "embl": embl_text}


#: Records of a file that ``write_sequences`` makes.
FILE_RECORDS = 100_000


def write_sequences(df: DataFrame, path: str, kind: str = "fasta", compression: str = "none", records: int = FILE_RECORDS) -> None:
    """Text files, one or more for each partition of (name, [accession], [description], seq), ``gzip`` or plain, each of
    at most ``records`` records."""
    SEQUENCE_TEXT[kind](df).write.option("compression", compression).option("maxRecordsPerFile", records).text(path)


def write_fasta(df: DataFrame, path: str, width: int = formats.WIDTH) -> None:
    fasta_text(df, width).write.text(path)


def alignment_text(rows: DataFrame, kind: str, markup: DataFrame | None = None) -> DataFrame:
    """(msa_id, value): the text of each alignment of (msa_id, idx, name, aln) with its ``markup`` (msa_id, kind,
    name, tag, text, place), of which each format writes what it has. Formats of single sequences are refused."""
    if kind not in formats.ALIGNMENTS and kind != "pfam":
        raise ValueError(f"{kind} holds no alignment")

    def text(key, f: pd.DataFrame, marks: list) -> pd.DataFrame:
        f = f.sort_values("idx")
        return pd.DataFrame([(key[0], formats.WRITERS[kind](formats.Alignment(f["name"].tolist(), f["aln"].tolist(), markup=marks)))], columns=["msa_id", "value"])

    grouped = rows.select("msa_id", "idx", "name", "aln").groupBy("msa_id")
    if markup is None:
        return grouped.applyInPandas(lambda key, f: text(key, f, []), "msa_id long, value string")

    def run(key, f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        marks = [(k, None if n is None or n != n else n, t, v) for k, n, t, v in m.sort_values("place")[["kind", "name", "tag", "text"]].itertuples(index=False)]
        return text(key, f, marks) if len(f) else pd.DataFrame([], columns=["msa_id", "value"])

    return grouped.cogroup(markup.select("msa_id", "kind", "name", "tag", "text", "place").groupBy("msa_id")).applyInPandas(run, "msa_id long, value string")


def write_alignments(rows: DataFrame, path: str, kind: str, markup: DataFrame | None = None) -> None:
    """A folder ``msa_id=...`` with one file for each alignment."""
    alignment_text(rows, kind, markup).repartition("msa_id").write.partitionBy("msa_id").text(path)


def reformat(spark: SparkSession, source: str, target: str, to: str, kind: str | None = None) -> None:
    """The files of ``source`` written to ``target`` in another format: sequences, for which an alignment gives
    its rows without gaps, or alignments, each under a number hashed from its file and place."""
    if to in SEQUENCE_TEXT:
        return write_sequences(read_sequences(spark, source, kind), target, to)
    number = F.xxhash64("path", "msa_id").alias("msa_id")
    rows, marks = read_alignments(spark, source, kind), read_markup(spark, source, kind)
    return write_alignments(rows.select(number, "idx", "name", "aln"), target, to, marks.select(number, "kind", "name", "tag", "text", "place"))


def statistics(seqs: DataFrame) -> DataFrame:
    """(n, total, shortest, longest, mean) of sequence lengths; the mean to one place."""
    n = F.length("seq")
    return seqs.agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 1).alias("mean"))


def fetch(seqs: DataFrame, names: list[str]) -> DataFrame:
    """The named sequences in the order asked for; the first of each name by idx."""
    asked = seqs.sparkSession.createDataFrame(list(enumerate(names)), "place long, name string")
    first = seqs.join(asked.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min_by("seq", "idx").alias("seq"))
    return asked.join(first, "name").orderBy("place")
