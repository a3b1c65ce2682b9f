"""Alignments as rows (msa_id, idx, name, aln): column and row selection, markup and resampling.

Column statistics never gather an alignment: rows are exploded to (msa_id, col, symbol), summed with
map-side combine, and only the per-column result, whose size is the alignment's length, is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wuss
from ..functions.alphabet import Alphabet, guess_type


def from_text(rows: DataFrame, abc: Alphabet) -> DataFrame:
    """``rows`` with ``aln`` in the alphabet's own symbols; an error for any other symbol, or for rows of unequal
    or no length."""
    return checked(rows.withColumn("aln", abc.require("aln")))


def checked(rows: DataFrame) -> DataFrame:
    """The rows; an error where an alignment's rows differ in length or are empty."""
    n = F.length("aln")
    w = Window.partitionBy("msa_id")
    return rows.withColumn("aln", F.when((F.min(n).over(w) == F.max(n).over(w)) & (n > 0), F.col("aln")).otherwise(F.raise_error(F.lit("rows of unequal or no length"))))


def cells(rows: DataFrame) -> DataFrame:
    """(msa_id, idx, col, symbol) with 1-based columns."""
    return rows.select("msa_id", "idx", F.posexplode(F.filter(F.split("aln", ""), lambda c: c != "")).alias("_p", "symbol")).select("msa_id", "idx", (F.col("_p") + 1).alias("col"), "symbol")


def column_counts(rows: DataFrame, abc: Alphabet, weight: str | None = None) -> DataFrame:
    """(msa_id, col, n_residue, n_gap, n_missing), weighted if a weight column is named."""
    w = F.col(weight) if weight else F.lit(1)
    own = rows.select("msa_id", "idx", "aln", w.alias("_w"))
    long = own.select("msa_id", "_w", F.posexplode(F.filter(F.split("aln", ""), lambda c: c != "")).alias("_p", "symbol"))
    among = lambda s: F.sum(F.when(F.instr(F.lit(s), F.col("symbol")) > 0, F.col("_w")).otherwise(0))
    return long.groupBy("msa_id", (F.col("_p") + 1).alias("col")).agg(among(abc.residues).alias("n_residue"), among(abc.gap).alias("n_gap"), among("~").alias("n_missing"))


def select_columns(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows cut to the columns of ``keep`` (msa_id, col); an alignment without any has empty rows."""
    lists = keep.groupBy("msa_id").agg(F.sort_array(F.collect_set("col")).alias("_cols"))
    return rows.join(lists, "msa_id", "left").withColumn("aln", pick("aln", "_cols")).drop("_cols")


def pick(text: str, columns: str) -> Column:
    """The characters of ``text`` at the 1-based places of an array column, in its order."""
    return F.coalesce(F.array_join(F.transform(F.col(columns), lambda i: F.substring(F.col(text), i, F.lit(1))), ""), F.lit(""))


def minimal_gaps(rows: DataFrame, abc: Alphabet, protect: DataFrame | None = None) -> DataFrame:
    """Columns with a symbol other than gap and missing; those of ``protect`` (msa_id, col) stay too."""
    keep = cells(rows).where(~F.col("symbol").isin(abc.gap, "~")).select("msa_id", "col").distinct()
    return select_columns(rows, keep if protect is None else keep.unionByName(protect.select("msa_id", "col")))


def without_gaps(rows: DataFrame, abc: Alphabet) -> DataFrame:
    """Columns in which no row has a gap or missing symbol."""
    return select_columns(rows, column_counts(rows, abc).where("n_gap + n_missing = 0").select("msa_id", "col"))


def without_gappy_columns(rows: DataFrame, abc: Alphabet, most: float) -> DataFrame:
    """Columns whose share of gaps is at most ``most``; missing symbols are no gaps."""
    n = rows.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"))
    return select_columns(rows, column_counts(rows, abc).join(n, "msa_id").where(F.col("n_gap") / F.col("n") <= most).select("msa_id", "col"))


def reference_line(rows: DataFrame, abc: Alphabet, least: float, weight: str | None = None) -> DataFrame:
    """(msa_id, rf): 'x' for columns whose residues make up ``least`` of residues and gaps, '.' else."""
    share = F.try_divide(F.col("n_residue"), F.col("n_residue") + F.col("n_gap"))
    marks = column_counts(rows, abc, weight).select("msa_id", "col", F.when(share >= least, "x").otherwise(".").alias("m"))
    return marks.groupBy("msa_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "m"))), lambda x: x["m"]), "").alias("rf"))


def composition(rows: DataFrame) -> DataFrame:
    """(msa_id, symbol, n) of every symbol, gaps included."""
    return cells(rows).groupBy("msa_id", "symbol").agg(F.count(F.lit(1)).alias("n"))


def fragments(rows: DataFrame, abc: Alphabet, threshold: float) -> DataFrame:
    """Adds ``is_fragment``: the span from first to last residue is under ``threshold`` of the alignment's
    length, or there is no residue."""
    empty = f"[{abc.gap}*~]"
    span = F.length(F.regexp_replace("aln", f"^{empty}+|{empty}+$", ""))
    return rows.withColumn("is_fragment", (span == 0) | (span < threshold * F.length("aln")))


def subset(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose (msa_id, idx) are in ``chosen``."""
    return rows.join(chosen.select("msa_id", "idx").distinct(), ["msa_id", "idx"], "left_semi")


def extract(rows: DataFrame, abc: Alphabet, idx: int) -> DataFrame:
    """One row of each alignment as a sequence without gaps."""
    return rows.where(F.col("idx") == idx).withColumn("seq", abc.dealign("aln")).drop("aln")


def reverse_complement(rows: DataFrame, abc: Alphabet) -> DataFrame:
    return rows.withColumn("aln", abc.reverse_complement("aln"))


def reverse_markup(ss: Column | str) -> Column:
    return wuss.reverse(ss)


def names_unique(rows: DataFrame) -> DataFrame:
    """(msa_id, is_unique): whether an alignment's names differ."""
    per_name = rows.groupBy("msa_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return per_name.groupBy("msa_id").agg((F.max("n") == 1).alias("is_unique"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one of two alignments, compared by msa_id, idx, name and aln."""
    key = ["msa_id", "idx", "name", "aln"]
    return a.select(key).exceptAll(b.select(key)).withColumn("side", F.lit("left")).unionByName(b.select(key).exceptAll(a.select(key)).withColumn("side", F.lit("right")))


def guess(rows: DataFrame) -> DataFrame:
    """(msa_id, kind): amino if any row's guess is, else the first row's."""
    g = rows.select("msa_id", "idx", guess_type("aln").alias("g"))
    return g.groupBy("msa_id").agg(F.max(F.coalesce(F.col("g") == "amino", F.lit(False))).alias("a"), F.min_by("g", "idx").alias("first")).select("msa_id", F.when(F.col("a"), "amino").otherwise(F.col("first")).alias("kind"))


def resample_columns(rows: DataFrame, seed: int, replace: bool) -> DataFrame:
    """A column permutation (or, with ``replace``, a bootstrap), the same for all rows of an alignment and
    in every run: columns are drawn by a hash of seed, alignment and place."""
    n = rows.groupBy("msa_id").agg(F.max(F.length("aln")).alias("n"))
    drawn = n.select("msa_id", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    key = F.xxhash64(F.lit(seed), "msa_id", "i")
    drawn = drawn.select("msa_id", "i", key.alias("k"), (F.pmod(key, F.col("n")) + 1).cast("int").alias("c"))
    item = F.struct("i", F.col("c").alias("v")) if replace else F.struct("k", F.col("i").alias("v"))
    cols = drawn.groupBy("msa_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias("_cols"))
    return rows.join(cols, "msa_id").withColumn("aln", pick("aln", "_cols")).drop("_cols")


def shuffle_within_columns(rows: DataFrame, seed: int) -> DataFrame:
    """Each column's symbols dealt anew to the rows, independently of the other columns."""
    long = cells(rows)
    w = Window.partitionBy("msa_id", "col")
    ranked = long.select("msa_id", "col", "symbol", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "msa_id", "idx", "col"), "idx")).alias("r"))
    places = long.select("msa_id", "col", "idx", F.row_number().over(w.orderBy("idx")).alias("r"))
    # By their file's size these look small enough to broadcast, but they hold a row for each cell.
    dealt = places.hint("merge").join(ranked, ["msa_id", "col", "r"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "")
    return rows.drop("aln").hint("merge").join(dealt.groupBy("msa_id", "idx").agg(text.alias("aln")), ["msa_id", "idx"])


def flush_left(aln: Column | str, rf: str) -> Column:
    """``aln`` with residues before gaps inside each run of insert columns ('.' or '~') of one ``rf`` line."""
    text = F.col(aln) if isinstance(aln, str) else aln
    out, at = [], 0
    while at < len(rf):
        end = at
        while end < len(rf) and (rf[end] in ".~") == (rf[at] in ".~"):
            end += 1
        piece = F.substring(text, at + 1, end - at)
        if rf[at] in ".~":
            piece = F.concat(F.regexp_replace(piece, "[-~.]", ""), F.regexp_replace(piece, "[^-~.]", ""))
        out.append(piece)
        at = end
    return F.concat(*out) if out else text


def checksum(rows: DataFrame, abc: Alphabet) -> DataFrame:
    """(msa_id, checksum) of the codes of all rows in order of idx."""
    from ..functions.sequence import checksum as of

    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "aln"))), lambda x: x["aln"]), "")
    return rows.groupBy("msa_id").agg(text.alias("t")).select("msa_id", of(abc.digitize("t")).alias("checksum"))


def valid(rows: DataFrame, abc: Alphabet, markup: DataFrame | None = None) -> DataFrame:
    """(msa_id, is_valid): rows of one length and of the alphabet's symbols, named apart, and column markup
    (msa_id, kind, text) of kind gc of that length."""
    n = F.length("aln")
    own = rows.groupBy("msa_id").agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.min(abc.valid("aln")).alias("ok"), (F.count("name") == F.count_distinct("name")).alias("names"))
    own = own.select("msa_id", "hi", (F.col("ok") & F.col("names") & (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)).alias("v"))
    if markup is None:
        return own.select("msa_id", F.col("v").alias("is_valid"))
    marks = markup.where("kind = 'gc'").groupBy("msa_id").agg(F.min(F.length("text")).alias("a"), F.max(F.length("text")).alias("b"))
    fits = F.coalesce((F.col("a") == F.col("hi")) & (F.col("b") == F.col("hi")), F.lit(True))
    return own.join(marks, "msa_id", "left").select("msa_id", (F.col("v") & fits).alias("is_valid"))


def by_name(rows: DataFrame) -> DataFrame:
    """(msa_id, rows): a map of each alignment's names to its idx; a repeated name has the last."""
    last = rows.groupBy("msa_id", "name").agg(F.max("idx").alias("idx"))
    return last.groupBy("msa_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "idx")))).alias("rows"))


def row_count(rows: DataFrame) -> DataFrame:
    """(msa_id, n)."""
    return rows.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"))


def without_broken_pairs(ss: Column | str, keep: Column | str) -> Column:
    """A structure line with dots for both partners of a pair of which ``keep`` (array<boolean>, a flag for each
    column) drops one."""
    k = F.col(keep) if isinstance(keep, str) else keep
    text = F.col(ss) if isinstance(ss, str) else ss
    partner = wuss.partners(text)
    kept = F.transform(partner, lambda p, i: (p < 0) | (F.get(k, i) & F.get(k, p)))
    return F.array_join(F.transform(kept, lambda ok, i: F.when(ok, F.substring(text, i + 1, F.lit(1))).otherwise(F.lit("."))), "")


def default_weights(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", F.lit(1.0))
