"""Functions of whole sequences: checksum, subsequences, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alphabet import Alphabet, col

_MASK = 0xFFFFFFFF


def checksum(codes: Column | str) -> Column:
    """The one-at-a-time hash of a code array as an unsigned 32-bit number in a bigint."""
    mask = F.lit(_MASK).cast("bigint")

    def step(h: Column, c: Column) -> Column:
        h = (h + c).bitwiseAND(mask)
        h = (h + F.shiftleft(h, 10)).bitwiseAND(mask)
        return h.bitwiseXOR(F.shiftright(h, 6))

    def finish(h: Column) -> Column:
        h = (h + F.shiftleft(h, 3)).bitwiseAND(mask)
        h = h.bitwiseXOR(F.shiftright(h, 11))
        return (h + F.shiftleft(h, 15)).bitwiseAND(mask)

    return F.aggregate(col(codes), F.lit(0).cast("bigint"), step, finish)


def subsequence(seq: Column | str, start: int | Column, end: int | Column) -> Column:
    """0-based, half-open."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.substring(col(seq), start + 1, end - start)


def fetch_range(abc: Alphabet, seq: Column | str, start: Column, end: Column) -> Column:
    """1-based, inclusive; start > end is the reverse strand. Null for a place outside the sequence."""
    low, high, n = F.least(start, end), F.greatest(start, end), F.length(col(seq))
    piece = F.substring(col(seq), low, high - low + 1)
    turned = abc.reverse_complement(piece) if abc.complements else F.lit(None).cast("string")
    return F.when((low < 1) | (high > n), None).when(start <= end, piece).otherwise(turned)


def windows(df: DataFrame, seq: str, width: int, context: int) -> DataFrame:
    """Forward windows of ``width`` new residues with ``context`` more: 1-based window_start and
    window_end, and whether the window completes its sequence. The first window has its context after
    it, later ones before."""
    n = F.length(seq)
    count = F.greatest(F.lit(1), F.ceil((n - context) / width)).cast("int")
    rows = df.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("_k") * width + 1
    end = F.least(F.col("_k") * width + width + context, n)
    return rows.withColumns({"window_start": start.cast("bigint"), "window_end": end.cast("bigint"), "window": F.substring(seq, start, end - start + 1), "complete": end == n}).drop("_k")


def reverse_windows(df: DataFrame, seq: str, abc: Alphabet, width: int, context: int) -> DataFrame:
    """Windows of the reverse complement; coordinates are the forward strand's, start > end. The first
    one has no context."""
    n = F.length(seq)
    rows = df.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.ceil(n / width) - 1).cast("int"))))
    before = F.least(F.col("_k") * width, F.lit(context))
    first, last = F.col("_k") * width - before + 1, F.least((F.col("_k") + 1) * width, n)
    piece = F.substring(abc.reverse_complement(seq), first, last - first + 1)
    return rows.withColumns({"window_start": (n - first + 1).cast("bigint"), "window_end": (n - last + 1).cast("bigint"), "window": piece, "complete": last == n}).drop("_k")


def wrap(seq: Column | str, width: int) -> Column:
    """Lines of ``width`` characters; 0 keeps one line."""
    return col(seq) if width == 0 else F.regexp_replace(col(seq), f"(.{{{width}}})(?=.)", "$1\n")


def appended(abc: Alphabet, codes: Column | str, text: Column | str) -> Column:
    """A code array with the codes of more text at its end."""
    return F.concat(col(codes), abc.digitize(text))


def record(name: Column | str, seq: Column | str, **more) -> Column:
    """A sequence as a struct of name, seq, accession, description and source; what is not given is null."""
    other = [F.coalesce(col(more[k]) if isinstance(more.get(k), (str, Column)) else F.lit(None).cast("string")).alias(k) for k in ("accession", "description", "source")]
    return F.struct(col(name).alias("name"), col(seq).alias("seq"), *other)


def same(a: Column | str, b: Column | str) -> Column:
    """Whether two records have one name and one sequence, whatever else they hold."""
    a, b = col(a), col(b)
    return (a["name"] == b["name"]) & (a["seq"] == b["seq"])


def line_count(text: Column | str) -> Column:
    """Lines of a text; an end of line at its end begins no other."""
    t = F.regexp_replace(col(text), r"\n\z", "")
    return F.when(F.length(col(text)) > 0, F.size(F.split(t, "\n", -1))).otherwise(0)


def line_at(text: Column | str, i: int | Column) -> Column:
    """The 0-based ``i``-th line, null where there is none."""
    return F.get(F.split(F.regexp_replace(col(text), r"\n\z", ""), "\n", -1), i if isinstance(i, Column) else F.lit(i))
