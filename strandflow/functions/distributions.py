"""Probability distributions as Column functions of x; parameters are numbers or columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special
from .alphabet import col

_INF = float("inf")


def _log1m_exp(y: Column) -> Column:
    """log(1 - exp(-y)) for y > 0 without cancellation."""
    return F.when(y < math.log(2), F.ln(-F.expm1(-y))).otherwise(F.log1p(-F.exp(-y)))


class Exponential:
    @staticmethod
    def _y(x, mu, rate):
        return (col(x) - mu) * rate

    @classmethod
    def pdf(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y < 0, 0.0).otherwise(rate * F.exp(-y))

    @classmethod
    def log_pdf(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y < 0, -_INF).otherwise(F.ln(F.lit(rate)) - y)

    @classmethod
    def cdf(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y < 0, 0.0).otherwise(-F.expm1(-y))

    @classmethod
    def log_cdf(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y <= 0, -_INF).otherwise(_log1m_exp(y))

    @classmethod
    def surv(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y < 0, 1.0).otherwise(F.exp(-y))

    @classmethod
    def log_surv(cls, x, mu, rate):
        y = cls._y(x, mu, rate)
        return F.when(y < 0, 0.0).otherwise(-y)

    @staticmethod
    def invcdf(p, mu, rate):
        return F.lit(mu) - F.log1p(-col(p)) / rate

    @staticmethod
    def invsurv(p, mu, rate):
        return F.lit(mu) - F.ln(col(p)) / rate


class Gumbel:
    @staticmethod
    def _e(x, mu, rate):
        return F.exp(-(col(x) - mu) * rate)

    @classmethod
    def pdf(cls, x, mu, rate):
        return F.exp(cls.log_pdf(x, mu, rate))

    @classmethod
    def log_pdf(cls, x, mu, rate):
        z = (col(x) - mu) * rate
        return F.ln(F.lit(rate)) - z - F.exp(-z)

    @classmethod
    def cdf(cls, x, mu, rate):
        return F.exp(-cls._e(x, mu, rate))

    @classmethod
    def log_cdf(cls, x, mu, rate):
        return -cls._e(x, mu, rate)

    @classmethod
    def surv(cls, x, mu, rate):
        return -F.expm1(-cls._e(x, mu, rate))

    @classmethod
    def log_surv(cls, x, mu, rate):
        e = cls._e(x, mu, rate)
        return F.when(e < 1e-300, -(col(x) - mu) * rate).otherwise(_log1m_exp(e))

    @staticmethod
    def invcdf(p, mu, rate):
        return F.lit(mu) - F.ln(-F.ln(col(p))) / rate

    @staticmethod
    def invsurv(p, mu, rate):
        return F.lit(mu) - F.ln(-F.log1p(-col(p))) / rate


class Gev:
    """``shape`` (a number) > 0 has a heavy right tail, 0 is the Gumbel distribution."""

    @staticmethod
    def _log_t(x, mu, rate, shape):
        """-ln of the cdf, logged; null outside the support."""
        y = (col(x) - mu) * rate
        t = 1 + shape * y
        return -y if abs(shape) < 1e-12 else F.when(t > 0, -F.log1p(shape * y) / shape)

    @classmethod
    def log_pdf(cls, x, mu, rate, shape):
        s = cls._log_t(x, mu, rate, shape)
        return F.coalesce(F.ln(F.lit(rate)) + s * (1 + shape) - F.exp(s), F.lit(-_INF))

    @classmethod
    def pdf(cls, x, mu, rate, shape):
        return F.exp(cls.log_pdf(x, mu, rate, shape))

    @classmethod
    def cdf(cls, x, mu, rate, shape):
        beyond = F.when(F.lit(shape) < 0, 1.0).otherwise(0.0)
        return F.coalesce(F.exp(-F.exp(cls._log_t(x, mu, rate, shape))), beyond)

    @classmethod
    def surv(cls, x, mu, rate, shape):
        beyond = F.when(F.lit(shape) < 0, 0.0).otherwise(1.0)
        return F.coalesce(-F.expm1(-F.exp(cls._log_t(x, mu, rate, shape))), beyond)

    @staticmethod
    def invcdf(p, mu, rate, shape):
        y = -F.ln(-F.ln(col(p)))
        return F.lit(mu) + (y if abs(shape) < 1e-12 else F.expm1(shape * y) / shape) / rate


class Weibull:
    @staticmethod
    def _u(x, mu, rate):
        return (col(x) - mu) * rate

    @classmethod
    def pdf(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        at_edge = _INF if shape < 1 else float(rate) if shape == 1 else 0.0
        return F.when(u < 0, 0.0).when(u == 0, at_edge).otherwise(F.exp(cls.log_pdf(x, mu, rate, shape)))

    @classmethod
    def log_pdf(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        at_edge = _INF if shape < 1 else math.log(rate) if shape == 1 else -_INF
        return F.when(u < 0, -_INF).when(u == 0, at_edge).otherwise(math.log(rate * shape) + (shape - 1) * F.ln(u) - F.pow(u, F.lit(float(shape))))

    @classmethod
    def cdf(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        return F.when(u <= 0, 0.0).otherwise(-F.expm1(-F.pow(u, F.lit(float(shape)))))

    @classmethod
    def log_cdf(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        return F.when(u <= 0, -_INF).otherwise(_log1m_exp(F.pow(u, F.lit(float(shape)))))

    @classmethod
    def surv(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        return F.when(u <= 0, 1.0).otherwise(F.exp(-F.pow(u, F.lit(float(shape)))))

    @classmethod
    def log_surv(cls, x, mu, rate, shape):
        u = cls._u(x, mu, rate)
        return F.when(u <= 0, 0.0).otherwise(-F.pow(u, F.lit(float(shape))))

    @staticmethod
    def invcdf(p, mu, rate, shape):
        return F.lit(mu) + F.pow(-F.log1p(-col(p)), F.lit(1.0 / shape)) / rate


#: Spark has no erfc and no incomplete gamma.
_udf = special.by_batch


#: The published rational approximation of the normal quantile (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(c, x):
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + k
    return out


def normal_quantile(p) -> Column:
    p = col(p)
    low, q = F.sqrt(-2 * F.ln(p)), p - 0.5
    high, r = F.sqrt(-2 * F.log1p(-p)), (p - 0.5) * (p - 0.5)
    tail = lambda t: _poly(_C, t) / (_poly(_D, t) * t + 1)
    middle = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return F.when((p <= 0) | (p >= 1), float("nan")).when(p < 0.02425, tail(low)).when(p > 1 - 0.02425, -tail(high)).otherwise(middle)


class Normal:
    @staticmethod
    def log_pdf(x, mu, sigma):
        z = (col(x) - mu) / sigma
        return -z * z / 2 - math.log(sigma * math.sqrt(2 * math.pi))

    @classmethod
    def pdf(cls, x, mu, sigma):
        return F.exp(cls.log_pdf(x, mu, sigma))

    @staticmethod
    def cdf(x, mu, sigma):
        return _udf(lambda v: 0.5 * special.erfc(-(v - mu) / sigma / math.sqrt(2)))(x)

    @staticmethod
    def surv(x, mu, sigma):
        return _udf(lambda v: 0.5 * special.erfc((v - mu) / sigma / math.sqrt(2)))(x)

    @staticmethod
    def invcdf(p, mu, sigma):
        return F.lit(mu) + F.lit(sigma) * normal_quantile(p)


class Lognormal:
    @staticmethod
    def log_pdf(x, mu, sigma):
        x = col(x)
        z = (F.ln(x) - mu) / sigma
        return F.when(x <= 0, -_INF).otherwise(-z * z / 2 - F.ln(x) - math.log(sigma * math.sqrt(2 * math.pi)))

    @classmethod
    def pdf(cls, x, mu, sigma):
        return F.when(col(x) <= 0, 0.0).otherwise(F.exp(cls.log_pdf(x, mu, sigma)))

    @staticmethod
    def _log(x):
        return F.when(col(x) > 0, F.ln(col(x))).otherwise(-_INF)

    @classmethod
    def cdf(cls, x, mu, sigma):
        return Normal.cdf(cls._log(x), mu, sigma)

    @classmethod
    def surv(cls, x, mu, sigma):
        return Normal.surv(cls._log(x), mu, sigma)

    @staticmethod
    def invcdf(p, mu, sigma):
        return F.exp(Normal.invcdf(p, mu, sigma))


class Gamma:
    @staticmethod
    def log_pdf(x, mu, rate, shape):
        y = (col(x) - mu) * rate
        return F.when(y <= 0, -_INF).otherwise(math.log(rate) - math.lgamma(shape) + (shape - 1) * F.ln(y) - y)

    @classmethod
    def pdf(cls, x, mu, rate, shape):
        return F.when(col(x) <= mu, 0.0).otherwise(F.exp(cls.log_pdf(x, mu, rate, shape)))

    @staticmethod
    def _pq(which):
        def of(x, mu, rate, shape):
            return _udf(lambda v: special.gamma_p_q_all(shape, (v - mu) * rate)[which])(x)

        return of

    @classmethod
    def cdf(cls, x, mu, rate, shape):
        return cls._pq(0)(x, mu, rate, shape)

    @classmethod
    def surv(cls, x, mu, rate, shape):
        return cls._pq(1)(x, mu, rate, shape)

    @classmethod
    def log_cdf(cls, x, mu, rate, shape):
        c = cls.cdf(x, mu, rate, shape)
        return F.when(c > 0, F.ln(c)).otherwise(-_INF)

    @classmethod
    def log_surv(cls, x, mu, rate, shape):
        s = cls.surv(x, mu, rate, shape)
        return F.when(s > 0, F.ln(s)).otherwise(-_INF)

    @staticmethod
    def invcdf(p, mu, rate, shape):
        def of(q: np.ndarray) -> np.ndarray:
            inside = (q > 0) & (q < 1)
            p = np.where(inside, q, 0.5)
            low, high = np.zeros(len(p)), np.full(len(p), max(shape, 1.0))
            while (short := special.gamma_p_q_all(shape, high)[0] < p).any():
                high = np.where(short, high * 2, high)
            for _ in range(60):
                middle = (low + high) / 2
                under = special.gamma_p_q_all(shape, middle)[0] < p
                low, high = np.where(under, middle, low), np.where(under, high, middle)
            return np.where(inside, mu + (low + high) / 2 / rate, np.where(q == 0, mu, np.where(q == 1, np.inf, np.nan)))

        return _udf(of)(p)
