"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, WHITE_CLASS, lower_ascii

#: Common function words of the four corpus languages; fixed values.
STOP_WORDS = (
    "the of and to a in is that it for on was with be as by this are at from "
    "der die und den von zu das mit sich des für auf dem ist nicht eine ein als "
    "de la le et les en un du que une est pour qui dans au par sur pas "
    "el y los se del las por con una no para su es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``name`` must lie in ``[low, high]``; ``ratio`` is an expression over the measured columns."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None

    def column(self) -> Column:
        value = F.expr(self.ratio)
        tests = [value >= F.lit(self.low)] if self.low is not None else []
        tests += [value <= F.lit(self.high)] if self.high is not None else []
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


#: The method's verdict. A row with no word meets no ratio and is rejected.
RULES = (
    Rule("word length", "try_divide(word_chars, n_words)", 1.5, 15.0),
    Rule("symbols per word", "try_divide(n_symbols, n_words)", None, 0.3),
    Rule("stop words", "try_divide(n_stop, n_words)", 0.01, None),
    Rule("repeated lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)


def _repeat_cover(windows: Column) -> Column:
    """Words covered by the 3-word windows that occur twice or more, from the windows' hashes in order.

    The hashes are sorted with their places; equal neighbours mark places, and the marked places in
    order give the size of the union of their spans. Lambdas see array elements only, never another
    column: an expression captured by a lambda would be evaluated once per element.
    """
    n = F.size(windows)
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice(placed, F.lit(1), n - 1))
    after = F.concat(F.slice(placed, F.lit(2), n - 1), none)
    left = F.zip_with(placed, before, lambda x, y: F.struct(x.h.alias("h"), x.i.alias("i"), F.coalesce(x.h == y.h, F.lit(False)).alias("d")))
    marked = F.zip_with(left, after, lambda x, y: F.when(x.d | F.coalesce(x.h == y.h, F.lit(False)), x.i))
    spots = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(spots, start, lambda s, i: F.struct((s.n + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s.n)


def measure(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """Adds the measured columns to ``docs``: n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words, n_stop. Null text counts as empty; every count is then 0.

    One narrow projection: no shuffle, and rows stay in the JVM. Windows are compared by a 64-bit
    hash of their words within one text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(WHITE))
    out = docs.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+")))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "word_chars": F.length(F.regexp_replace(body, WHITE_CLASS + "+", "")).cast("bigint"),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_stop": F.size(F.filter("_words", lambda w: lower_ascii(w).isin(list(stop_words)))).cast("bigint"),
    })
    span = F.greatest(F.size("_hash") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("_hash", F.lit(1), span), F.slice("_hash", F.lit(2), span), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_windows", F.zip_with(pairs, F.slice("_hash", F.lit(3), span), lambda a, c: F.xxhash64(a, c)))
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_cover(F.col("_windows"))).otherwise(F.lit(0).cast("bigint"))
    return out.withColumn("n_repeat_words", repeats).drop("_words", "_lines", "_hash", "_windows")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``docs`` with the measured columns, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: base
    passed and every rule of the table holds. Repeated rows get equal verdicts; an input column with
    the name of a measured one is replaced. Empty tables give no rows; a text of any length is measured
    whole. The stop words are of four languages: a text in another one meets their rule by chance only,
    so a corpus of other languages needs ``stop_words`` of its own.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop", "base_failed", "kept")
    out = measure(docs.drop(*(c for c in own if c != text)), text, stop_words)
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    verdict = reduce(lambda a, b: a & b, (r.column() for r in rules), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & verdict)


def op7(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns whatever their names.

    A filter on ``kept`` would be pushed below the projections, which copies every measure into it as often
    as a rule names it. An array of one element or none per row drops the same rows and stays above them.
    """
    judged = judge(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    return judged.select("_row", F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("_kept")).select("_row.*")


_IN = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = f"""
with b as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from b),
g as (select doc_id, t, w, l, list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from w),
p as (select doc_id, unnest(g) as x, generate_subscripts(g, 1) as i from g),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as n from p) where n > 1),
r as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from d) group by doc_id),
m as (select g.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
             len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') in ({_IN})))::bigint as n_stop
      from g left join r on g.doc_id = r.doc_id),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars / n_words between 1.5 and 15 and n_symbols / n_words <= 0.3
       and n_stop / n_words >= 0.01 and n_dup_lines / greatest(n_lines, 1) <= 0.5 as kept
from f
"""
