"""Integer codes as Column functions of a non-negative bigint; code words are strings of bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import col


def _big(v) -> Column:
    return col(v).cast("bigint")


def varint_size(v) -> Column:
    """Bytes of the base-128 form."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(_big(v))) / 7)).cast("int")


def varint_encode(v) -> Column:
    """Hex of the base-128 bytes, low groups first, the top bit set on all but the last."""
    n = varint_size(v)
    byte = lambda i: F.lpad(F.hex(_group(v, i, n)), 2, "0")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), byte), "")


def _group(v, i: Column, n: Column) -> Column:
    """The i-th group of 7 bits, as a byte."""
    bits = F.substring(F.reverse(F.bin(_big(v))), i * 7 + 1, F.lit(7))
    value = F.conv(F.reverse(bits), 2, 10).cast("bigint")
    return value + F.when(i < n - 1, 128).otherwise(0)


def varint_decode(hexed) -> Column:
    """Value of the first code in a hex string; null if it does not end."""
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(col(hexed)) / 2 - 1).cast("int")), lambda i: F.conv(F.substring(col(hexed), i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(1).cast("bigint").alias("m"), F.lit(False).alias("done"))
    step = lambda s, b: F.when(s["done"], s).otherwise(F.struct((s["v"] + (b % 128) * s["m"]).alias("v"), F.when(b < 128, s["m"]).otherwise(s["m"] * 128).alias("m"), (b < 128).alias("done")))
    return F.aggregate(bytes_, start, step, lambda s: F.when(s["done"], s["v"]))


def _low_bits(v: Column, k: int) -> Column:
    return F.lit("") if k == 0 else F.lpad(F.bin(v % (1 << k)), k, "0")


def exp_golomb(v, k: int = 0) -> Column:
    """Zeros, then v / 2**k + 1 in binary as many bits longer, then the low k bits."""
    high = F.bin(F.shiftright(_big(v), k) + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(high) - 1), high, _low_bits(_big(v), k))


def exp_golomb_decode(bits, k: int = 0) -> Column:
    zeros = F.instr(col(bits), "1") - 1
    high = F.conv(F.substring(col(bits), zeros + 1, zeros + 1), 2, 10).cast("bigint") - 1
    low = F.conv(F.substring(col(bits), zeros * 2 + 2, F.lit(k)), 2, 10).cast("bigint") if k else F.lit(0)
    return high * (1 << k) + low


def rice(v, k: int) -> Column:
    """v / 2**k ones, a zero, the low k bits."""
    return F.concat(F.repeat(F.lit("1"), F.shiftright(_big(v), k).cast("int")), F.lit("0"), _low_bits(_big(v), k))


def rice_decode(bits, k: int) -> Column:
    ones = F.instr(col(bits), "0") - 1
    low = F.conv(F.substring(col(bits), ones + 2, F.lit(k)), 2, 10).cast("bigint") if k else F.lit(0)
    return ones.cast("bigint") * (1 << k) + low


def elias_delta(v) -> Column:
    """For v >= 1: the bit length of v in gamma code, then v without its leading bit."""
    bits = F.bin(_big(v))
    n = F.bin(F.length(bits).cast("bigint"))
    return F.when(_big(v) >= 1, F.concat(F.repeat(F.lit("0"), F.length(n) - 1), n, F.substring(bits, 2, 64)))


def elias_delta_decode(bits) -> Column:
    zeros = F.instr(col(bits), "1") - 1
    n = F.conv(F.substring(col(bits), zeros + 1, zeros + 1), 2, 10).cast("int")
    return F.conv(F.concat(F.lit("1"), F.substring(col(bits), zeros * 2 + 2, n - 1)), 2, 10).cast("bigint")
