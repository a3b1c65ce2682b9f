"""Random sequences and shuffles, seeded per row so that partitioning does not matter."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet, col


def _per_row(make: Callable[[np.random.Generator, str], str], seed: int, key: Column | str, seq: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(k: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else make(np.random.default_rng([seed, int(i)]), t) for i, t in zip(k, s)])

    return run(F.abs(col(key)), col(seq))


def shuffled(seq, key, seed: int) -> Column:
    """The residues in random order."""
    return _per_row(lambda r, s: "".join(r.permutation(list(s))) if s else s, seed, key, seq)


def _doublets(rng: np.random.Generator, s: str) -> str:
    """An Euler path through the doublets of ``s`` from its first to its last residue: random last exits that
    form a tree towards the last residue, the other exits in random order before them."""
    if len(s) < 3:
        return s
    exits: dict[str, list[str]] = {}
    for a, b in zip(s, s[1:]):
        exits.setdefault(a, []).append(b)
    end = s[-1]
    while True:
        last = {a: x[rng.integers(len(x))] for a, x in exits.items() if a != end}
        reached = {end}
        for a in last:
            path = []
            while a not in reached and a not in path:
                path.append(a)
                a = last[a]
            if a in reached:
                reached.update(path)
        if reached >= last.keys():
            break
    for a, x in exits.items():
        if a in last:
            x.remove(last[a])
        rng.shuffle(x)
        if a in last:
            x.append(last[a])
    out, at = [s[0]], dict.fromkeys(exits, 0)
    for _ in range(len(s) - 1):
        a = out[-1]
        out.append(exits[a][at[a]])
        at[a] += 1
    return "".join(out)


def shuffled_doublets(seq, key, seed: int) -> Column:
    """A shuffle that keeps the count of every two neighbours."""
    return _per_row(_doublets, seed, key, seq)


def markov(seq, key, seed: int, order: int) -> Column:
    """As many residues drawn from the sequence's own composition (order 0) or transitions (order 1)."""

    def make(rng, s):
        if not s:
            return s
        if order == 0:
            return "".join(rng.choice(list(s), len(s)))
        exits: dict[str, list[str]] = {}
        for a, b in zip(s, s[1:]):
            exits.setdefault(a, []).append(b)
        out = [s[0]]
        while len(out) < len(s):
            x = exits.get(out[-1])
            out.append(x[rng.integers(len(x))] if x else s[rng.integers(len(s))])
        return "".join(out)

    return _per_row(make, seed, key, seq)


def generate(spark: SparkSession, n: int, length: int, abc: Alphabet, seed: int, frequencies: list[float] | None = None) -> DataFrame:
    """(id, seq): independent residues; equal frequencies if none are given. No Python: each residue is a
    hash of seed, id and place, put through the cumulative frequencies."""
    p = np.asarray(frequencies or [1.0 / abc.k] * abc.k)
    edges = np.cumsum(p / p.sum())
    u = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 40)) / float(1 << 40)

    def pick(i):
        case = F.when(u(i) < float(edges[0]), abc.symbols[0])
        for e, c in zip(edges[1:-1], abc.symbols[1:]):
            case = case.when(u(i) < float(e), c)
        return case.otherwise(abc.symbols[abc.k - 1])

    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), pick), "").alias("seq"))
