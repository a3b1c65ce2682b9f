"""Huffman codes of symbols counted in Spark, packed residues, and ordered and indexed lookups."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import col
from . import ordering


@dataclass(frozen=True)
class Huffman:
    """Canonical code words, as strings of bits, by symbol: shorter first, then in order of symbol."""

    words: dict[str, str]

    @staticmethod
    def build(counts: dict[str, float]) -> Huffman:
        """Symbols counted 0 have no word; a single symbol has one of length 1."""
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items())) if n > 0]
        length = {s: 1 if len(heap) == 1 else 0 for _, _, (s,) in heap}
        heapq.heapify(heap)
        tick = len(counts)
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            for s in x + y:
                length[s] += 1
            heapq.heappush(heap, (a + b, tick, x + y))
            tick += 1
        words, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in length.items()):
            code <<= n - last
            words[s] = format(code, f"0{n}b")
            code, last = code + 1, n
        return Huffman(words)

    def encode(self, text: Column | str) -> Column:
        """Bits of the text's symbols; an error for one without a word."""
        keys = "".join(self.words)
        table = F.array(*map(F.lit, self.words.values()))
        chars = F.filter(F.split(col(text), ""), lambda c: c != "")
        return F.array_join(F.transform(chars, lambda c: F.when(F.instr(F.lit(keys), c) > 0, F.element_at(table, F.greatest(F.instr(F.lit(keys), c), F.lit(1)))).otherwise(F.raise_error(F.lit("no code word")))), "")

    def decode(self, bits: Column | str) -> Column:
        """Null for a stream that ends within a word."""
        back = {w: s for s, w in self.words.items()}

        @F.pandas_udf("string")
        def run(v: pd.Series) -> pd.Series:
            out = []
            for b in v:
                got, at = [], ""
                for c in b or "":
                    at += c
                    if at in back:
                        got.append(back[at])
                        at = ""
                out.append(None if b is None or at else "".join(got))
            return pd.Series(out)

        return run(col(bits))

    def mean_length(self, counts: dict[str, float]) -> float:
        total = sum(counts.values())
        return sum(n * len(self.words.get(s, "")) for s, n in counts.items()) / total if total else 0.0


def symbol_counts(df: DataFrame, text: str, limit: int = 256) -> dict[str, float]:
    """Counts of the symbols of a column; an error for more than ``limit`` kinds."""
    c = F.explode(F.filter(F.split(text, ""), lambda x: x != "")).alias("c")
    rows = df.select(c).groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} kinds of symbol")
    return {r.c: float(r.n) for r in rows}


# Packed residues: 32-bit words, low bits first free, high bit marks the last word, the next one 5-bit packing.

LAST, FIVE, PAD = 1 << 31, 1 << 30, 31


def _six(codes: list[int]) -> int:
    """A word of up to six codes of 5 bits, the first in the highest bits, padded at the end."""
    return FIVE | sum(c << (25 - 5 * k) for k, c in enumerate(codes + [PAD] * (6 - len(codes))))


def pack5(codes: list[int]) -> list[int]:
    out = [_six(codes[at : at + 6]) for at in range(0, max(len(codes), 1), 6)]
    out[-1] |= LAST
    return out


def unpack(words: list[int]) -> list[int]:
    """Of 5-bit words up to the padding, and of 2-bit words of fifteen codes."""
    out: list[int] = []
    for w in words:
        out += [c for k in range(6) if (c := w >> (25 - 5 * k) & 31) != PAD] if w & FIVE else [w >> (28 - 2 * k) & 3 for k in range(15)]
    return out


def pack2(codes: list[int]) -> list[int]:
    """Fifteen canonical codes of 2 bits to a word; where fewer follow each other, six codes of 5 bits."""
    out, at = [], 0
    while at < len(codes):
        run = codes[at : at + 15]
        if len(run) == 15 and max(run) < 4:
            out.append(sum(c << (28 - 2 * k) for k, c in enumerate(run)))
            at += 15
            continue
        out.append(_six(codes[at : at + 6]))
        at += 6
    if not out:
        return pack5([])
    out[-1] |= LAST
    return out


def packed(codes: Column | str, two_bits: bool = False) -> Column:
    """array<bigint> of the packed words. Words of six codes of 5 bits, the first in the highest bits and the end
    padded, are built in generated code; what 2-bit words hold depends on all before, so they are not."""
    if two_bits:

        @F.pandas_udf("array<bigint>")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else pack2([int(x) for x in c]) for c in v])

        return run(col(codes))
    c = col(codes)
    last = F.greatest(F.ceil(F.size(c) / 6).cast("int") - 1, F.lit(0))

    def word(w: Column) -> Column:
        own = [F.shiftleft(F.coalesce(F.get(c, w * 6 + k).cast("bigint"), F.lit(PAD).cast("bigint")), 25 - 5 * k) for k in range(6)]
        return sum(own, F.when(w == last, F.lit(LAST | FIVE)).otherwise(F.lit(FIVE)).cast("bigint"))

    return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(0), last), word))


def unpacked(words: Column | str) -> Column:
    """array<int> of the codes of 5-bit words up to the padding, and of 2-bit words of fifteen."""
    bits = lambda w, down, mask: F.shiftright(w, down).bitwiseAND(F.lit(mask).cast("bigint")).cast("int")

    def codes_of(w: Column) -> Column:
        six = F.filter(F.array(*(bits(w, 25 - 5 * k, 31) for k in range(6))), lambda c: c != PAD)
        return F.when(w.bitwiseAND(F.lit(FIVE).cast("bigint")) != 0, six).otherwise(F.array(*(bits(w, 28 - 2 * k, 3) for k in range(15))))

    return F.flatten(F.transform(col(words), codes_of))


# Ordered map and index


def ordered_map(entries: DataFrame) -> DataFrame:
    """(key, value) of (key, value, seq): the last value put under each key."""
    return entries.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def name_index(seqs: DataFrame, order: str) -> DataFrame:
    """(name, seq_len, ordinal, sorted_ordinal) of (name, seq): place in input order and by name; an error for a
    name that repeats. Both places come from range exchanges of names and lengths."""
    n = F.count(F.lit(1)).over(Window.partitionBy("name"))
    unique = seqs.withColumn("name", F.when(n == 1, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("repeated name "), F.col("name")))))
    slim = unique.select("name", F.length("seq").cast("bigint").alias("seq_len"), order)
    by_order = ordering.numbered(slim, [order], "ordinal")
    return ordering.numbered(by_order, ["name"], "sorted_ordinal").select("name", "seq_len", "ordinal", "sorted_ordinal")


def with_aliases(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """Index rows under their own names and under (alias, name); an error for an alias of an unknown name."""
    there = F.col("_there").isNotNull()
    key = F.when(there, F.col("alias")).otherwise(F.raise_error(F.concat(F.lit("alias of an unknown name "), F.col("name"))))
    extra = aliases.select("alias", "name").join(index.withColumn("_there", F.lit(True)), "name", "left").select(key.alias("key"), *index.columns)
    return index.select(F.col("name").alias("key"), *index.columns).unionByName(extra)


def found(entries: DataFrame, key) -> DataFrame:
    """(value) under one key of an ordered map: no row or one."""
    return entries.where(F.col("key") == key).select("value")


def ends(entries: DataFrame) -> DataFrame:
    """(least_key, least_value, greatest_key, greatest_value) of an ordered map."""
    both = entries.agg(F.min(F.struct("key", "value")).alias("a"), F.max(F.struct("key", "value")).alias("b"))
    return both.select(F.col("a.key").alias("least_key"), F.col("a.value").alias("least_value"), F.col("b.key").alias("greatest_key"), F.col("b.value").alias("greatest_value"))


def in_order(entries: DataFrame) -> DataFrame:
    """(place, key, value) of an ordered map."""
    return ordering.numbered(entries.select("key", "value"), ["key"], "place").select("place", "key", "value")


def byte_offset(data_offset: Column | str, position: Column | str, residues_per_line: int, bytes_per_line: int) -> Column:
    """Offset of a 1-based residue in a file of lines of equal length."""
    p = col(position) - 1
    return (col(data_offset) + F.floor(p / residues_per_line) * bytes_per_line + p % residues_per_line).cast("bigint")


def blocks(lines: DataFrame, order: str, is_mark: Column) -> DataFrame:
    """Adds ``block``: how many marked lines there are up to each line of its (grp)."""
    w = Window.partitionBy("grp").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(is_mark.cast("int")).over(w).cast("bigint"))
