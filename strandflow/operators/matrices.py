"""Matrices: coordinate tables (m, i, j, v) for what is relational, numpy for what is not."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["m", "i", "j"]


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy(KEY).agg(F.sum("v").alias("v"))


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def transpose(a: DataFrame) -> DataFrame:
    return a.select("m", F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select("m", F.col("i").alias("k"), "j", F.col("v").alias("w"))
    return a.select("m", "i", F.col("j").alias("k"), "v").join(right, ["m", "k"]).groupBy(KEY).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def identity(spark, m: int, n: int) -> DataFrame:
    i = spark.range(n)
    return i.select(F.lit(m).cast("bigint").alias("m"), F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"), F.col("id").alias("_i")).select("m", "i", "j", F.when(F.col("_i") == F.col("j"), 1.0).otherwise(0.0).alias("v"))


def element(a: DataFrame, i: int, j: int) -> DataFrame:
    """(m, v): one element of each matrix."""
    return a.where((F.col("i") == i) & (F.col("j") == j)).select("m", "v")


def replaced(a: DataFrame, changes: DataFrame) -> DataFrame:
    """``a`` with the elements that ``changes`` (m, i, j, v) names set anew."""
    new = changes.select(*KEY, F.col("v").alias("_new"), F.lit(True).alias("_set"))
    return a.join(new, KEY, "left").select(*KEY, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("v")).alias("v"))


def upper(a: DataFrame) -> DataFrame:
    """The elements on and above the diagonal: what a table keeps of a symmetric matrix."""
    return a.where("i <= j")


def from_upper(a: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix from its upper one."""
    return a.unionByName(transpose(a.where("i < j")))


def summary(a: DataFrame) -> DataFrame:
    """(m, total, low, high, frobenius)."""
    return a.groupBy("m").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius"))


def symmetric(a: DataFrame, tolerance: float) -> DataFrame:
    """(m, is_symmetric)."""
    t = transpose(a).withColumnRenamed("v", "w")
    return a.join(t, KEY).groupBy("m").agg((F.max(F.abs(F.col("v") - F.col("w"))) <= tolerance).alias("is_symmetric"))


# Dense


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, l, u) with a[rows] = l @ u, pivoting on the largest element of each column."""
    u, n = np.array(a, float), len(a)
    rows, l = np.arange(n), np.eye(n)
    for k in range(n):
        p = k + int(np.abs(u[k:, k]).argmax())
        if abs(u[p, k]) < 1e-15:
            raise ValueError("singular matrix")
        if p != k:
            u[[k, p]], rows[[k, p]] = u[[p, k]], rows[[p, k]]
            l[[k, p], :k] = l[[p, k], :k]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
        u[k + 1 :, k] = 0.0
    return rows, l, u


def inverse(a: np.ndarray) -> np.ndarray:
    lu(a)  # raises for a singular matrix
    return np.linalg.inv(a)


def exponential(a: np.ndarray, t: float = 1.0) -> np.ndarray:
    """exp(t a) by scaling, a Taylor series and squaring."""
    x = np.asarray(a, float) * t
    norm = float(np.linalg.norm(x))
    squarings = max(0, int(np.ceil(np.log2(norm / 0.1)))) if norm > 0.1 else 0
    x = x / 2**squarings
    out = term = np.eye(len(x))
    for k in range(1, 31):
        term = term @ x / k
        out = out + term
        if np.abs(term).max() < 1e-18:
            break
    for _ in range(squarings):
        out = out @ out
    return out


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in falling order and vectors of a symmetric matrix, each vector's largest element positive."""
    if np.abs(a - a.T).max() > 1e-12 * max(1.0, np.abs(a).max()):
        raise ValueError("not symmetric")
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(a))])
    return values, vectors * sign


def eigen_reversible(q: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, right, left) with q = right @ diag(values) @ left, for q symmetric under pi."""
    root = np.sqrt(pi)
    values, v = eigen((lambda s: (s + s.T) / 2)(q * root[:, None] / root[None, :]))
    return values, v / root[:, None], v.T * root[None, :]


def exponential_from_eigen(parts: tuple[np.ndarray, np.ndarray, np.ndarray], t: float) -> np.ndarray:
    values, right, left = parts
    return (right * np.exp(values * t)) @ left


def per_matrix(a: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``make`` of each square matrix."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        n = int(max(f["i"].max(), f["j"].max())) + 1
        x = np.zeros((n, n))
        x[f["i"], f["j"]] = f["v"]
        y = make(x)
        i, j = np.indices(y.shape)
        return pd.DataFrame({"m": key[0], "i": i.ravel(), "j": j.ravel(), "v": y.ravel()})

    return a.select("m", "i", "j", "v").groupBy("m").applyInPandas(run, "m long, i long, j long, v double")


def table(spark, m: int, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(m, i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "m long, i long, j long, v double")


# Rate matrices


def from_exchangeability(s: np.ndarray, pi: np.ndarray) -> np.ndarray:
    q = np.asarray(s, float) * np.asarray(pi, float)[None, :]
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(1))
    return q


def scaled(q: np.ndarray, pi: np.ndarray, rate: float = 1.0) -> np.ndarray:
    """With ``rate`` substitutions expected in unit time."""
    own = -float((np.asarray(pi) * np.diag(q)).sum())
    if own <= 0:
        raise ValueError("no substitutions")
    return q * (rate / own)


def jukes_cantor(k: int) -> np.ndarray:
    return scaled(from_exchangeability(np.ones((k, k)), np.full(k, 1 / k)), np.full(k, 1 / k))


def hky(transition: float, transversion: float, pi) -> np.ndarray:
    """In the order A, C, G, T; A-G and C-T are transitions."""
    s = np.full((4, 4), float(transversion))
    for i, j in ((0, 2), (1, 3)):
        s[i, j] = s[j, i] = transition
    return scaled(from_exchangeability(s, np.asarray(pi)), np.asarray(pi))


def kimura(transition: float, transversion: float) -> np.ndarray:
    return hky(transition, transversion, [0.25] * 4)


def felsenstein(pi) -> np.ndarray:
    return hky(1.0, 1.0, pi)


def is_rate_matrix(q: np.ndarray, tolerance: float = 1e-9) -> bool:
    off = q - np.diag(np.diag(q))
    return bool(np.abs(q.sum(1)).max() <= tolerance and (np.diag(q) <= 0).all() and (off >= 0).all())


def is_probability_matrix(p: np.ndarray, tolerance: float = 1e-9) -> bool:
    return bool(np.abs(p.sum(1) - 1).max() <= tolerance and p.min() >= -tolerance and p.max() <= 1 + tolerance)


def relative_entropy(p: np.ndarray, pi: np.ndarray) -> float:
    """Bits of P against its stationary frequencies."""
    pi = np.asarray(pi)
    return float((pi[:, None] * p * np.log2(p / pi[None, :])).sum())


def expected_score(p: np.ndarray, pi: np.ndarray) -> float:
    pi = np.asarray(pi)
    return float((pi[:, None] * pi[None, :] * np.log2(p / pi[None, :])).sum())


#: The published WAG exchangeabilities, the lower triangle row by row in the order ACDEFGHIKLMNPQRSTVWY.
_WAG = """
    1.027040 0.738998 0.030295 1.582850 0.021352 6.174160 0.210494 0.398020 0.046730 0.081134
    1.416720 0.306674 0.865584 0.567717 0.049931 0.316954 0.248972 0.930676 0.570025 0.679371
    0.249410 0.193335 0.170135 0.039437 0.127395 1.059470 0.030450 0.138190 0.906265 0.074034
    0.479855 2.584430 0.088836 0.373558 0.890432 0.323832 0.397915 0.384287 0.084805 0.154263
    2.115170 0.061304 0.499462 3.170970 0.257555 0.893496 0.390482 0.103754 0.315124 1.190630
    0.174100 0.404141 4.257460 0.934276 4.854020 0.509848 0.265256 5.429420 0.947198 0.096162
    1.125560 3.956290 0.554236 3.012010 0.131528 0.198221 1.438550 0.109404 0.423984 0.682355
    0.161444 0.243570 0.696198 0.099929 0.556896 0.415844 0.171329 0.195081 0.908598 0.098818
    0.616783 5.469470 0.099921 0.330052 4.294110 0.113917 3.894900 0.869489 1.545260 1.543640
    0.933372 0.551571 0.528191 0.147304 0.439157 0.102711 0.584665 2.137150 0.186979 5.351420
    0.497671 0.683162 0.635346 0.679489 3.035500 3.370790 1.407660 1.071760 0.704939 0.545931
    1.341820 0.740169 0.319440 0.967130 0.344739 0.493905 3.974230 1.613280 1.028870 1.224190
    2.121110 0.512984 0.374866 0.822765 0.171903 0.225833 0.473307 1.458160 1.386980 0.326622
    1.516120 2.030060 0.795384 0.857928 0.554413 4.378020 2.006010 1.002140 0.152335 0.588731
    0.649892 0.187247 0.118358 7.821300 0.305434 1.800340 2.058450 0.196246 0.314887 0.301281
    0.251849 0.232739 1.388230 0.113133 0.717070 0.129767 0.156557 1.529640 0.336983 0.262569
    0.212483 0.137505 0.665309 0.515706 0.071917 0.139405 0.215737 1.163920 0.523742 0.110864
    0.365369 0.240735 0.543833 0.325711 0.196303 6.454280 0.103604 3.873440 0.420170 0.133264
    0.398618 0.428437 1.086000 0.216046 0.227710 0.381533 0.786993 0.291148 0.314730 2.485390
"""


def wag(pi=None) -> np.ndarray:
    """Amino acid rates of one substitution in unit time, for frequencies ``pi`` or the table's own."""
    from .scores import BACKGROUNDS

    s, f = np.zeros((20, 20)), np.asarray(BACKGROUNDS["wag"] if pi is None else pi, float)
    s[np.tril_indices(20, -1)] = [float(x) for x in _WAG.split()]
    return scaled(from_exchangeability(s + s.T, f), f)


#: The order of published amino acid rate files.
PAML_ORDER = "ARNDCQEGHILKMFPSTWYV"


def read_paml(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(exchangeabilities, frequencies) in alphabetical order from a lower triangle and 20 frequencies."""
    numbers = [float(x) for x in text.split()][:210]
    if len(numbers) < 210:
        raise ValueError("210 numbers are needed")
    s = np.zeros((20, 20))
    s[np.tril_indices(20, -1)] = numbers[:190]
    s += s.T
    order = [PAML_ORDER.index(c) for c in sorted(PAML_ORDER)]
    return s[np.ix_(order, order)], np.array(numbers[190:])[order]
