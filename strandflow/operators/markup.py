"""Annotation of alignments as rows (msa_id, kind, name, tag, text, place).

Kinds are gf (of the alignment), gs (of a row), gc (of the columns) and gr (of a row's columns); ``name`` is the
row's, null for gf and gc, and ``place`` orders the lines of an alignment. Edits give new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "msa_id long, kind string, name string, tag string, text string, place long"
_COLUMNS = ["msa_id", "kind", "name", "tag", "text", "place"]
#: The tags of what an alignment or a row has once.
AUTHOR, ACCESSION, DESCRIPTION, IDENTIFIER = "AU", "AC", "DE", "ID"
STRUCTURE, SURFACE, CONFIDENCE = "SS", "SA", "PP"


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("string")


def _added(markup: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines (msa_id, kind, name, tag, text) after the last of their alignment, in order of name."""
    both = markup.select(_COLUMNS).unionByName(lines.withColumn("place", F.lit(None).cast("long")).select(_COLUMNS))
    own, new = Window.partitionBy("msa_id"), F.col("place").isNull()
    rank = F.row_number().over(Window.partitionBy("msa_id", new).orderBy("name", "tag", "text"))
    return both.withColumn("place", F.coalesce("place", F.coalesce(F.max("place").over(own), F.lit(-1)) + rank).cast("bigint"))


def add_to_alignments(markup: DataFrame, alignments: DataFrame, tag: str, text) -> DataFrame:
    """With one more gf line for each msa_id of ``alignments``; ``text`` is a value or a Column over them."""
    return _added(markup, alignments.select("msa_id", _column(text).alias("text")).distinct().select("msa_id", F.lit("gf").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(tag).alias("tag"), "text"))


def add_to_rows(markup: DataFrame, rows: DataFrame, tag: str, text) -> DataFrame:
    """With one more gs line for each (msa_id, name) of ``rows``."""
    return _added(markup, rows.select("msa_id", F.lit("gs").alias("kind"), "name", F.lit(tag).alias("tag"), _column(text).alias("text")))


def add_to_columns(markup: DataFrame, alignments: DataFrame, tag: str, text) -> DataFrame:
    """With one more gc line for each msa_id of ``alignments``, a symbol for each column."""
    return _added(markup, alignments.select("msa_id", _column(text).alias("text")).distinct().select("msa_id", F.lit("gc").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(tag).alias("tag"), "text"))


def add_to_residues(markup: DataFrame, rows: DataFrame, tag: str, text) -> DataFrame:
    """With one more gr line for each (msa_id, name) of ``rows``, a symbol for each column."""
    return _added(markup, rows.select("msa_id", F.lit("gr").alias("kind"), "name", F.lit(tag).alias("tag"), _column(text).alias("text")))


def _without(markup: DataFrame, targets: DataFrame, keys: list[str], kind: str, tag: str) -> DataFrame:
    meant = targets.select(keys).distinct().withColumn("_meant", F.lit(True))
    own = (F.col("kind") == kind) & (F.col("tag") == tag) & F.col("_meant").isNotNull()
    return markup.join(meant, keys, "left").where(~own).select(_COLUMNS)


def set_of_alignments(markup: DataFrame, alignments: DataFrame, tag: str, text) -> DataFrame:
    """``add_to_alignments`` in place of the lines of that tag: identifier, accession, description, author."""
    return add_to_alignments(_without(markup, alignments, ["msa_id"], "gf", tag), alignments, tag, text)


def set_of_rows(markup: DataFrame, rows: DataFrame, tag: str, text) -> DataFrame:
    """``add_to_rows`` in place of the lines of that tag: a row's accession or description."""
    return add_to_rows(_without(markup, rows, ["msa_id", "name"], "gs", tag), rows, tag, text)


def set_of_residues(markup: DataFrame, rows: DataFrame, tag: str, text) -> DataFrame:
    """``add_to_residues`` in place of the lines of that tag: a row's structure, surface or confidence."""
    return add_to_residues(_without(markup, rows, ["msa_id", "name"], "gr", tag), rows, tag, text)
