"""Array functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import col

_NEG_INF, _INF = float("-inf"), float("inf")


def total(v) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x)


def fill(n: int | Column, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def scale(v, factor) -> Column:
    return F.transform(col(v), lambda x: x * factor)


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def add_scaled(a, b, factor) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y * factor)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def largest(v) -> Column:
    return F.array_max(col(v))


def smallest(v) -> Column:
    return F.array_min(col(v))


def argmax(v) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(col(v), F.array_max(col(v))) - 1


def argmin(v) -> Column:
    return F.array_position(col(v), F.array_min(col(v))) - 1


def normalize(v) -> Column:
    """Divided by the sum; equal shares if the sum is 0."""
    s, n = total(v), F.size(col(v))
    return F.when(s == 0, F.array_repeat(1.0 / n, n)).otherwise(F.zip_with(col(v), F.array_repeat(s, n), lambda x, y: x / y))


def entropy(p) -> Column:
    """In bits; terms with p <= 0 are 0."""
    return total(F.transform(col(p), lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)))


def relative_entropy(p, q) -> Column:
    """In bits; infinite where q is 0 and p is not."""
    return total(F.zip_with(col(p), col(q), lambda x, y: F.when(x <= 0, 0.0).when(y <= 0, _INF).otherwise(x * F.log2(x / y))))


def log_sum(v) -> Column:
    """ln of the sum of exponentials, shifted by the maximum."""
    top = F.array_max(col(v))
    shifted = F.zip_with(col(v), F.array_repeat(top, F.size(col(v))), lambda x, m: F.exp(x - m))
    return F.when(F.abs(top) == _INF, top).otherwise(top + F.ln(total(shifted)))


def log_normalize(v) -> Column:
    """Probabilities of log-probabilities."""
    return F.zip_with(col(v), F.array_repeat(log_sum(v), F.size(col(v))), lambda x, s: F.exp(x - s))


def log(v) -> Column:
    return F.transform(col(v), lambda x: F.when(x > 0, F.ln(x)).otherwise(_NEG_INF))


def exp(v) -> Column:
    return F.transform(col(v), lambda x: F.exp(x))


def ascending(v) -> Column:
    return F.sort_array(col(v), True)


def descending(v) -> Column:
    return F.sort_array(col(v), False)


def reverse(v) -> Column:
    return F.reverse(col(v))


def all_finite(v) -> Column:
    return F.forall(col(v), lambda x: ~F.isnan(x) & (F.abs(x) < _INF))


def all_log(v) -> Column:
    """Log-probabilities: no NaN, none above 0; -inf may be."""
    return F.forall(col(v), lambda x: ~F.isnan(x) & (x <= 0))


def shift_right(v, value) -> Column:
    return F.concat(F.array(F.lit(value)), F.slice(col(v), F.lit(1), F.size(col(v)) - 1))


def shift_left(v, value) -> Column:
    return F.concat(F.slice(col(v), F.lit(2), F.size(col(v)) - 1), F.array(F.lit(value)))


def any_greater(a, b) -> Column:
    return F.exists(F.zip_with(col(a), col(b), lambda x, y: x > y), lambda t: t)


def any_at_least(a, b) -> Column:
    return F.exists(F.zip_with(col(a), col(b), lambda x, y: x >= y), lambda t: t)


def select(mask, a, b) -> Column:
    """b where the mask is set, else a."""
    both = F.zip_with(col(a), col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(col(mask), both, lambda m, z: F.when(m, z["y"]).otherwise(z["x"]))


def add_saturated(a, b, low: int, high: int) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: F.least(F.greatest(x.cast("bigint") + y.cast("bigint"), F.lit(low)), F.lit(high)))


def subtract_saturated(a, b, low: int, high: int) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: F.least(F.greatest(x.cast("bigint") - y.cast("bigint"), F.lit(low)), F.lit(high)))
