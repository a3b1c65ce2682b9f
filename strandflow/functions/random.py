"""Random numbers as Columns of a seed and a key: the same in every run, whatever the partitions.

A number is the first 52 bits of an MD5 of seed, key and the number's place, so any engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import col


def uniform(seed: int, key: Column | str, place: int | Column = 0) -> Column:
    """In [0, 1); ``place`` numbers the draws of one key."""
    at = place if isinstance(place, Column) else F.lit(place)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string"), at.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def uniform_positive(seed: int, key: Column | str, place: int | Column = 0) -> Column:
    """In (0, 1): half a step from either end."""
    return uniform(seed, key, place) + 2.0**-53


def integer(seed: int, key: Column | str, n: int | Column, place: int | Column = 0) -> Column:
    """In 0 to n - 1."""
    return F.floor(uniform(seed, key, place) * n).cast("bigint")


def gaussian(seed: int, key: Column | str, place: int = 0) -> Column:
    """Of mean 0 and deviation 1, by the Box-Muller transform of the draws 2 * place and 2 * place + 1."""
    a, b = uniform_positive(seed, key, 2 * place), uniform(seed, key, 2 * place + 1)
    return F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)


def gamma(seed: int, key: Column | str, shape: float, place: int = 0) -> Column:
    """Of scale 1. A whole shape up to 12 is minus the logarithm of a product of so many draws, numbered from
    ``shape * place`` on; any other inverts the distribution function at one draw."""
    if shape == int(shape) and shape <= 12:
        draws = (uniform_positive(seed, key, int(shape) * place + i) for i in range(int(shape)))
        return -F.ln(math.prod(draws, start=F.lit(1.0)))
    from .distributions import Gamma

    return Gamma.invcdf(uniform_positive(seed, key, place), 0.0, 1.0, shape)


def choose(seed: int, key: Column | str, p: list[float], place: int = 0) -> Column:
    """0-based index drawn with probabilities ``p``."""
    u, edge, out = uniform(seed, key, place), 0.0, None
    for i, share in enumerate(p[:-1]):
        edge += share
        out = F.when(u < edge, i) if out is None else out.when(u < edge, i)
    return F.lit(0) if out is None else out.otherwise(len(p) - 1)


def dirichlet(seed: int, key: Column | str, alpha: list[float]) -> Column:
    """array<double>: gamma draws over their sum. ``[1] * k`` is uniform over the simplex."""
    # Each element has draws of its own, from a seed of its own.
    parts = F.array(*(gamma(seed * 1009 + i, key, a) for i, a in enumerate(alpha)))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(parts, F.array_repeat(total, len(alpha)), lambda x, t: x / t)
