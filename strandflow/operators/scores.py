"""Residue score matrices, background frequencies and what is computed from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.alphabet import AMINO, Alphabet, col

#: Background frequencies in the order ACDEFGHIKLMNPQRSTVWY.
BACKGROUNDS = {
    "bl62": (0.074, 0.025, 0.054, 0.054, 0.047, 0.074, 0.026, 0.068, 0.058, 0.099, 0.025, 0.045, 0.039, 0.034, 0.052, 0.057, 0.051, 0.073, 0.013, 0.032),
    "wag": (0.086628, 0.019308, 0.057045, 0.058059, 0.038432, 0.083252, 0.024431, 0.048466, 0.062029, 0.086209, 0.019503, 0.039089, 0.045763, 0.036728, 0.043972, 0.069518, 0.061013, 0.070896, 0.014386, 0.035274),
    "sw34": (0.075520, 0.016973, 0.053029, 0.063204, 0.040762, 0.068448, 0.022406, 0.057284, 0.059398, 0.093399, 0.023569, 0.045293, 0.049262, 0.040231, 0.051573, 0.072214, 0.057454, 0.065252, 0.012513, 0.031985),
    "sw50": (0.0787945, 0.0151600, 0.0535222, 0.0668298, 0.0397062, 0.0695071, 0.0229198, 0.0590092, 0.0594422, 0.0963728, 0.0237718, 0.0414386, 0.0482904, 0.0395639, 0.0540978, 0.0683364, 0.0540687, 0.0673417, 0.0114135, 0.0304133),
    "uniform": (0.05,) * 20,
}


def background(spark, name: str) -> DataFrame:
    """(name, aa, f)."""
    return spark.createDataFrame([(name, a, f) for a, f in zip(AMINO.symbols, BACKGROUNDS[name])], "name string, aa string, f double")


@dataclass(frozen=True)
class ScoreMatrix:
    """Scores of every two symbols of an alphabet."""

    name: str
    scores: np.ndarray
    abc: Alphabet = AMINO

    def canonical(self) -> np.ndarray:
        return self.scores[: self.abc.k, : self.abc.k]

    def score(self, a: Column | str, b: Column | str) -> Column:
        """Score of two code columns, null where one is null."""
        flat = F.array(*(F.lit(int(x)) for x in self.scores.ravel()))
        # The place is tested first: generated code reads an element of a constant array for a null place too.
        return F.when(col(a).isNotNull() & col(b).isNotNull(), F.element_at(flat, col(a) * self.abc.kp + col(b) + 1))

    def score_symbols(self, a: Column | str, b: Column | str) -> Column:
        """Null for a symbol outside the alphabet."""
        return self.score(self.abc.encode(a), self.abc.encode(b))

    def table(self, spark) -> DataFrame:
        s = self.abc.symbols
        rows = [(self.name, s[i], s[j], int(v)) for (i, j), v in np.ndenumerate(self.canonical())]
        return spark.createDataFrame(rows, "matrix string, a string, b string, s int")

    def highest(self) -> int:
        """Of two canonical symbols."""
        return int(self.canonical().max())

    def lowest(self) -> int:
        return int(self.canonical().min())

    def is_symmetric(self) -> bool:
        return bool((self.canonical() == self.canonical().T).all())

    def expected(self, fi, fj) -> float:
        return float(np.asarray(fi) @ self.canonical() @ np.asarray(fj))

    def relative_entropy(self, f, scale: float) -> float:
        """Bits of the pairs that the scores imply at ``scale``; the frequencies must sum to 1 and the
        implied pairs nearly so."""
        f = np.asarray(f)
        if abs(f.sum() - 1) > 1e-6:
            raise ValueError("frequencies must sum to 1")
        p = np.outer(f, f) * np.exp(scale * self.canonical())
        if abs(p.sum() - 1) > 0.05:
            raise ValueError("the scale does not fit these frequencies")
        p = p / p.sum()
        return float((p * scale * self.canonical()).sum() / math.log(2))

    def scale_for(self, fi, fj) -> tuple[float, np.ndarray]:
        """The scale at which the implied pairs sum to 1, and the pairs."""
        base, s = np.outer(fi, fj), self.canonical()
        if (base * s).sum() >= 0 or s.max() <= 0:
            raise ValueError("scores need a negative mean and a positive maximum")
        f = lambda x: float((base * np.exp(x * s)).sum()) - 1
        high = 0.5
        while f(high) < 0:
            high *= 2
        scale = special.bisect(f, high * 1e-6, high, 1e-14) if f(high * 1e-6) < 0 else high
        return scale, base * np.exp(scale * s)

    def with_degenerates(self, other: int | None = None) -> ScoreMatrix:
        """Degenerate symbols score the rounded mean over their members. ``other``: the score of ``*`` and
        ``~``, the least score if None."""
        abc, s = self.abc, np.zeros((self.abc.kp, self.abc.kp), int)
        k = abc.k
        low = int(self.canonical().min()) if other is None else other
        own = [[abc.symbols.index(c) for c in m] for m in abc.members]
        nearest = lambda v: int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))
        for i in range(abc.kp):
            for j in range(abc.kp):
                a, b = own[i], own[j]
                if a and b:
                    s[i, j] = nearest(float(np.mean([[self.scores[x, y] for y in b] for x in a])))
                elif abc.symbols[i] in "*~" or abc.symbols[j] in "*~":
                    s[i, j] = 1 if i == j and abc.symbols[i] == "*" and other is None else low
        s[:k, :k] = self.canonical()
        return ScoreMatrix(self.name, s, abc)

    def text(self) -> str:
        head = self.abc.symbols[: self.abc.k]
        lines = ["   " + "".join(f"{c:>4}" for c in head)]
        return "\n".join(lines + [f"{c:<3}" + "".join(f"{int(v):>4}" for v in row) for c, row in zip(head, self.canonical())]) + "\n"


def identity_matrix(match: int = 1, mismatch: int = -1, abc: Alphabet = AMINO) -> ScoreMatrix:
    s = np.full((abc.kp, abc.kp), mismatch)
    np.fill_diagonal(s, match)
    return ScoreMatrix("identity", s, abc).with_degenerates()


def read_scores(text: str, name: str = "read", abc: Alphabet = AMINO) -> ScoreMatrix:
    """A matrix in the common text form: # comments, a line of column letters, a line per row letter."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    head, *body = rows
    known = [abc.symbols.find(c) for c in head]
    if min(known) < 0 or not set(abc.symbols[: abc.k]) <= set(head):
        raise ValueError("columns must be symbols of the alphabet, every canonical one among them")
    s = np.zeros((abc.kp, abc.kp), int)
    for letter, *values in body:
        if len(values) != len(head) or letter not in abc.symbols:
            raise ValueError(f"bad row {letter}")
        s[abc.symbols.index(letter), known] = [int(v) for v in values]
    return ScoreMatrix(name, s, abc)


def from_pairs(p: np.ndarray, fi, fj, scale: float, abc: Alphabet = AMINO) -> ScoreMatrix:
    """round(ln(p_ij / f_i f_j) / scale)."""
    s = np.zeros((abc.kp, abc.kp), int)
    s[: abc.k, : abc.k] = np.rint(np.log(p / np.outer(fi, fj)) / scale)
    return ScoreMatrix("implied", s, abc)


def by_name(spark, folder: str, name: str, abc: Alphabet = AMINO) -> ScoreMatrix | None:
    """The matrix that the file ``name`` of a folder of published text files holds, whatever the name's case; None
    without such a file."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower(F.element_at(F.split("path", "/"), -1)) == name.lower())
    found = files.select("content").limit(1).collect()
    return read_scores(bytes(found[0].content).decode(), name, abc) if found else None
