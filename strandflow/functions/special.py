"""Special functions: plain numbers for drivers, numpy for batches, Columns where built-in functions can say them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import col


def digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_p_q(a: float, x: float) -> tuple[float, float]:
    """The regularized incomplete gamma functions P and Q: a series below a + 1, a continued fraction
    above, so that neither loses its small values."""
    if x <= 0:
        return 0.0, 1.0
    if math.isinf(x):
        return 1.0, 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return front * total, 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h, front * h


def chi_squared_tail(df: float, x: float) -> float:
    """The probability of ``x`` or more."""
    return gamma_p_q(df / 2, x / 2)[1]


# Batches: whole arrays in each step, none value by value.


def gamma_p_q_all(a: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gamma_p_q`` of an array; NaN stays NaN."""
    x = np.asarray(x, float)
    p, q = np.where(x <= 0, 0.0, 1.0), np.where(x <= 0, 1.0, 0.0)
    p[np.isnan(x)] = q[np.isnan(x)] = np.nan
    low, high = (x > 0) & (x < a + 1), (x >= a + 1) & np.isfinite(x)
    front = lambda y: np.exp(a * np.log(y) - y - math.lgamma(a))
    if low.any():
        y, n = x[low], a
        term = total = np.full(len(y), 1 / a)
        while (term > total * 1e-17).any():
            n += 1
            term = term * y / n
            total = total + term
        p[low] = front(y) * total
        q[low] = 1 - p[low]
    if high.any():
        y, tiny = x[high], 1e-300
        b = y + 1 - a
        c, d = np.full(len(y), 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where((t := an * d + b) == 0, tiny, t)
            c = np.where((t := b + an / c) == 0, tiny, t)
            h = h * (d * c)
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        q[high] = front(y) * h
        p[high] = 1 - q[high]
    return p, q


def erfc(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    tail = gamma_p_q_all(0.5, np.where(np.isinf(x), np.inf, x * x))[1]
    return np.where(x >= 0, tail, 2 - tail)


#: The terms of Stirling's series for ln gamma and its two derivatives.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DIGAMMA = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
_TRIGAMMA = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)
SHIFT = 10


def _series(terms: tuple[float, ...], r):
    """terms[0] + terms[1] r + ... by Horner's rule; of numbers, arrays or Columns."""
    out = terms[-1]
    for t in terms[-2::-1]:
        out = out * r + t
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers: SHIFT steps of the recurrence, then Stirling's series."""
    x = np.asarray(x, float)
    rising = np.ones_like(x)
    for i in range(SHIFT):
        rising = rising * (x + i)
    y = x + SHIFT
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + _series(_STIRLING, 1 / (y * y)) / y - np.log(rising)


# Columns of positive numbers, in generated code.


def log_gamma_column(x: Column | str) -> Column:
    x = col(x)
    y = x + SHIFT
    rising = x
    for i in range(1, SHIFT):
        rising = rising * (x + i)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + _series(_STIRLING, 1 / (y * y)) / y - F.ln(rising)


def digamma_column(x: Column | str) -> Column:
    x = col(x)
    y = x + SHIFT
    down = sum((1 / (x + i) for i in range(1, SHIFT)), 1 / x)
    r = 1 / (y * y)
    return F.ln(y) - 0.5 / y + _series(_DIGAMMA, r) * r - down


def trigamma_column(x: Column | str) -> Column:
    x = col(x)
    y = x + SHIFT
    down = sum((1 / ((x + i) * (x + i)) for i in range(1, SHIFT)), 1 / (x * x))
    r = 1 / (y * y)
    return 1 / y + r / 2 + _series(_TRIGAMMA, r) * r / y + down


def by_batch(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column | str], Column]:
    """A Column function from one of whole arrays, for what no built-in function can say."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    return lambda x: run(col(x))


def erfc_column(x: Column | str) -> Column:
    return by_batch(erfc)(x)


def incomplete_gamma_column(a: float, x: Column | str, upper: bool = False) -> Column:
    """The regularized incomplete gamma function P(a, x), or Q(a, x)."""
    return by_batch(lambda v: gamma_p_q_all(a, v)[int(upper)])(x)


def chi_squared_tail_column(df: float, x: Column | str) -> Column:
    return incomplete_gamma_column(df / 2, col(x) / 2, upper=True)


def bisect_column(f: Callable[[Column], Column], low, high, steps: int = 60) -> Column:
    """A root of ``f`` between the Columns or numbers ``low`` and ``high``, at which its signs differ, by
    ``steps`` halvings; ``f`` may use its argument only."""
    a, b = (F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in (low, high))
    start = F.struct(a.alias("a"), b.alias("b"), (f(a) > 0).alias("s"))

    def halve(z, _):
        m = (z["a"] + z["b"]) / 2
        same = (f(m) > 0) == z["s"]
        return F.struct(F.when(same, m).otherwise(z["a"]).alias("a"), F.when(same, z["b"]).otherwise(m).alias("b"), z["s"].alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda z: (z["a"] + z["b"]) / 2)


def newton_column(f: Callable[[Column], Column], slope: Callable[[Column], Column], start, steps: int = 50) -> Column:
    """A root of ``f`` by ``steps`` Newton steps from ``start``."""
    x = start.cast("double") if isinstance(start, Column) else F.lit(float(start))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda z, _: z - f(z) / slope(z))


def bisect(f, low: float, high: float, tolerance: float = 1e-12, steps: int = 200) -> float:
    """A root between two points of opposite sign."""
    a, b = f(low), f(high)
    if a == 0 or b == 0:
        return low if a == 0 else high
    if (a > 0) == (b > 0):
        raise ValueError("no change of sign between the ends")
    for _ in range(steps):
        middle = (low + high) / 2
        value = f(middle)
        if value == 0 or high - low < tolerance * max(1.0, abs(middle)):
            return middle
        low, high = (middle, high) if (value > 0) == (a > 0) else (low, middle)
    return (low + high) / 2


def newton(f, slope, x: float, tolerance: float = 1e-12, steps: int = 100) -> float:
    for _ in range(steps):
        move = f(x) / slope(x)
        x -= move
        if abs(move) <= tolerance * max(1.0, abs(x)):
            return x
    raise ValueError("no convergence")


def minimize(f, gradient, x, steps: int = 200, tolerance: float = 1e-10) -> tuple[np.ndarray, float, bool]:
    """(x, value, converged): nonlinear conjugate gradients (Polak-Ribiere, restarted) with a
    backtracking line search that first grows its step."""
    x = np.asarray(x, float)
    value, g = f(x), np.asarray(gradient(x), float)
    d, step = -g, 1.0 / (1.0 + np.abs(g).sum())
    for _ in range(steps):
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
        if slope == 0:
            return x, value, True
        step *= 2
        while True:
            trial = x + step * d
            new = f(trial)
            if np.isfinite(new) and new <= value + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-18:
                return x, value, True
        after = np.asarray(gradient(trial), float)
        beta = max(0.0, float(after @ (after - g)) / max(float(g @ g), 1e-300))
        done = abs(value - new) <= tolerance * (abs(value) + abs(new) + 1e-12) and np.abs(after).max() < 1e-5 * (1 + abs(new))
        x, value, d, g = trial, new, beta * d - after, after
        if done:
            return x, value, True
    return x, value, False
