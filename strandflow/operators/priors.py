"""Dirichlet priors and mixtures over count vectors (array<double>)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random, special
from ..functions.alphabet import col

#: One pseudocount for each residue.
LAPLACE_AMINO, LAPLACE_DNA = (1.0,) * 20, (1.0,) * 4


def posterior_mean(counts: Column | str, alpha: tuple[float, ...]) -> Column:
    """(c + alpha) over their sum."""
    raised = F.zip_with(col(counts), F.array(*map(F.lit, alpha)), lambda c, a: c + a)
    total = F.aggregate(col(counts), F.lit(float(sum(alpha))), lambda s, c: s + c)
    return F.zip_with(raised, F.array_repeat(total, len(alpha)), lambda x, t: x / t)


def log_density_column(p: Column | str, alpha: tuple[float, ...]) -> Column:
    """Log density of probability vectors; places where p is 0 are skipped."""
    front = math.lgamma(sum(alpha)) - sum(math.lgamma(a) for a in alpha)
    terms = F.zip_with(col(p), F.array(*map(F.lit, alpha)), lambda x, a: F.when(x > 0, (a - 1) * F.ln(x)).otherwise(0.0))
    return F.lit(front) + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def log_density(p: np.ndarray, alpha: np.ndarray) -> float:
    """Places where p is 0 are skipped."""
    seen = p > 0
    out = math.lgamma(alpha.sum()) - sum(math.lgamma(a) for a in alpha)
    return out + float(((alpha[seen] - 1) * np.log(p[seen])).sum())


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    alpha: np.ndarray

    def log_terms(self, counts: np.ndarray) -> np.ndarray:
        """n x K log-probabilities of count vectors under each component, without the multinomial factor."""
        a, lg = self.alpha, special.lgamma
        a0, n = a.sum(1), counts.sum(1)
        inner = (lg(counts[:, None, :] + a[None]) - lg(a)[None]).sum(2)
        return lg(a0)[None, :] - lg(n[:, None] + a0[None, :]) + inner

    def log_prob(self, counts: np.ndarray) -> np.ndarray:
        t = self.log_terms(counts) + np.log(self.weights)
        top = t.max(1)
        return top + np.log(np.exp(t - top[:, None]).sum(1))

    def posterior_weights(self, counts: np.ndarray) -> np.ndarray:
        t = self.log_terms(counts) + np.log(self.weights)
        w = np.exp(t - t.max(1)[:, None])
        return w / w.sum(1)[:, None]

    def posterior_mean(self, counts: np.ndarray) -> np.ndarray:
        w = self.posterior_weights(counts)
        part = (counts[:, None, :] + self.alpha[None]) / (counts.sum(1)[:, None] + self.alpha.sum(1)[None])[:, :, None]
        return (w[:, :, None] * part).sum(1)

    def valid(self, tolerance: float = 1e-6) -> bool:
        return abs(self.weights.sum() - 1) <= tolerance and bool((self.alpha > 0).all())

    def same(self, other: Mixture, tolerance: float) -> bool:
        return self.alpha.shape == other.alpha.shape and bool(np.abs(self.weights - other.weights).max() <= tolerance and np.abs(self.alpha - other.alpha).max() <= tolerance)

    def component(self, k: int) -> tuple[float, ...]:
        return tuple(float(a) for a in self.alpha[k])

    def with_component(self, k: int, alpha) -> Mixture:
        changed = self.alpha.copy()
        changed[k] = alpha
        return Mixture(self.weights, changed)

    def column(self, what: str, counts: Column | str) -> Column:
        """``log_prob``, ``log_terms``, ``posterior_weights`` or ``posterior_mean`` of a column of count vectors."""
        kind = T.DoubleType() if what == "log_prob" else T.ArrayType(T.DoubleType())

        @F.pandas_udf(kind)
        def run(c: pd.Series) -> pd.Series:
            out = getattr(self, what)(np.stack(c.to_numpy()).astype(float)) if len(c) else []
            return pd.Series(list(out))

        return run(col(counts))

    def text(self) -> str:
        lines = [f"{len(self.weights)} {self.alpha.shape[1]}"]
        return "\n".join(lines + [" ".join(repr(float(x)) for x in (w, *a)) for w, a in zip(self.weights, self.alpha)]) + "\n"


def read_mixture(text: str) -> Mixture:
    """``K Q``, then for each component its weight and Q parameters; weights are scaled to 1."""
    numbers = [float(x) for line in text.splitlines() for x in line.split("#")[0].split()]
    k, q = int(numbers[0]), int(numbers[1])
    grid = np.array(numbers[2 : 2 + k * (q + 1)]).reshape(k, q + 1)
    return Mixture(grid[:, 0] / grid[:, 0].sum(), grid[:, 1:])


def fit(counts: np.ndarray, k: int, steps: int = 200, seed: int = 1) -> tuple[Mixture, float]:
    """A mixture of ``k`` components by conjugate gradients on the logarithms; also the negative
    log-likelihood. ``counts`` are the distinct vectors of a bounded sample."""
    q, rng = counts.shape[1], np.random.default_rng(seed)
    of = lambda x: Mixture((lambda w: w / w.sum())(np.exp(x[:k] - x[:k].max())), np.exp(np.clip(x[k:], -20, 20)).reshape(k, q))
    nll = lambda x: -float(of(x).log_prob(counts).sum())

    def gradient(x):
        out = np.empty(len(x))
        for i in range(len(x)):
            e = np.zeros(len(x))
            e[i] = 1e-5
            out[i] = (nll(x + e) - nll(x - e)) / 2e-5
        return out

    x, value, _ = special.minimize(nll, gradient, rng.normal(0, 0.1, k + k * q), steps)
    return of(x), value


def sample(spark, n: int, alpha: tuple[float, ...], seed: int) -> DataFrame:
    """(id, p): draws of a Dirichlet; each id has its own draws, so partitions do not matter."""
    return spark.range(n).select("id", random.dirichlet(seed, "id", list(alpha)).alias("p"))


def sample_uniform(spark, n: int, k: int, seed: int) -> DataFrame:
    """(id, p): draws that are uniform over the simplex of ``k`` shares."""
    return sample(spark, n, (1.0,) * k, seed)
