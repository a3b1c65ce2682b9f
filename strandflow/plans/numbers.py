"""Queries of vectors, distributions, samples, matrices, rates, scores and priors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import vectors as vec
from ..functions.alphabet import AMINO
from ..operators import matrices, priors, scores, statistics
from .inputs import frame, oracle

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_V = "vec_id, list_transform(embedding, lambda x: x::double) as v"


def vectors(spark, d):
    return frame(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def r6(**columns):
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query("vector_reductions", f"""select vec_id, round(list_sum(v), 6) as total, round(list_sum(list_transform(v, lambda x: x * x)), 6) as dot, round(list_max(v), 6) as high, round(list_min(v), 6) as low,
    list_position(v, list_max(v))::bigint - 1 as argmax, list_position(v, list_min(v))::bigint - 1 as argmin from (select {_V} from embeddings)""")
def _(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", *r6(total=vec.total("v"), dot=vec.dot("v", "v"), high=vec.largest("v"), low=vec.smallest("v")), vec.argmax("v").alias("argmax"), vec.argmin("v").alias("argmin"))


@query("vector_logs", f"""select vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) as log_sum, round(list_sum(list_transform(v, lambda x: case when x > 0 then ln(x) else 0 end)), 6) as logs, round(list_sum(list_transform(v, lambda x: exp(x))), 6) as exps from (select {_V} from embeddings)""")
def _(spark, d):
    v = vectors(spark, d)
    logs = vec.total(F.filter(vec.log("v"), lambda x: x > float("-inf")))
    return v.select("vec_id", *r6(log_sum=vec.log_sum("v"), logs=logs, exps=vec.total(vec.exp("v"))))


@query("vector_information", f"""select vec_id, round(-list_sum(list_transform(p, lambda x: x * log2(x))), 6) as entropy, round(list_sum(list_transform(list_zip(p, q), lambda z: z[1] * log2(z[1] / z[2]))), 6) as divergence
    from (select vec_id, list_transform(a, lambda x: x / list_sum(a)) as p, list_transform(b, lambda x: x / list_sum(b)) as q from (select vec_id, list_transform(v, lambda x: exp(x)) as a, list_transform(v, lambda x: exp(-x)) as b from (select {_V} from embeddings)))""")
def _(spark, d):
    v = vectors(spark, d).select("vec_id", vec.normalize(vec.exp("v")).alias("p"), vec.log_normalize(vec.scale("v", -1.0)).alias("q"))
    return v.select("vec_id", *r6(entropy=vec.entropy("p"), divergence=vec.relative_entropy("p", "q")))


@query("vector_arithmetic", f"""select vec_id, round(v[1] + v[64] * 2, 6) as first, round(v[64] + v[1] * 2, 6) as last, round(list_sort(v)[1], 6) as least, round(list_reverse_sort(v)[1], 6) as most, true as finite, false as logs from (select {_V} from embeddings)""")
def _(spark, d):
    v = vectors(spark, d).withColumn("s", vec.add_scaled("v", vec.reverse("v"), 2.0))
    return v.select("vec_id", *r6(first=F.col("s")[0], last=F.col("s")[63], least=vec.ascending("v")[0], most=vec.descending("v")[0]), vec.all_finite("v").alias("finite"), vec.all_log(vec.fill(3, 1.0)).alias("logs"))


@query("vector_sums", f"select vec_id, round(v[1] + v[64], 6) as added, greatest(least(floor(v[1] * 1000)::bigint - floor(v[64] * 1000)::bigint, 127), -128)::bigint as saturated, 3 as filled from (select {_V} from embeddings)")
def _(spark, d):
    v = vectors(spark, d).withColumns({"r": vec.reverse("v"), "k": F.transform("v", lambda x: F.floor(x * 1000).cast("bigint"))})
    return v.select("vec_id", *r6(added=vec.add("v", "r")[0]), vec.subtract_saturated("k", F.reverse("k"), -128, 127)[0].alias("saturated"), F.size(vec.fill(3, 1.0)).alias("filled"))


@query("lane_operations", f"""select vec_id, round(v[63], 6) as shifted_right, round(v[2], 6) as shifted_left, len(list_filter(list_zip(v, list_reverse(v)), lambda z: z[1] > z[2])) > 0 as any_greater, true as any_at_least,
    round(case when v[1] > 0 then v[1] else v[64] end, 6) as selected, least(greatest(floor(v[1] * 1000)::bigint * 2, -128), 127)::bigint as saturated from (select {_V} from embeddings)""")
def _(spark, d):
    v = vectors(spark, d).withColumns({"r": vec.reverse("v"), "k": F.transform("v", lambda x: F.floor(x * 1000).cast("bigint")), "mask": F.transform("v", lambda x: x > 0)})
    return v.select("vec_id", *r6(shifted_right=vec.shift_right("v", 0.0)[63], shifted_left=vec.shift_left("v", 0.0)[0]), vec.any_greater("v", "r").alias("any_greater"), vec.any_at_least("v", "v").alias("any_at_least"), *r6(selected=vec.select("mask", "r", "v")[0]), vec.add_saturated("k", "k", -128, 127)[0].alias("saturated"))


_X = "select event_id, value as x, (value - 0.005) / 491 as p from events"


@query("exponential_distribution", f"select event_id, round(case when x < 10 then 0 else 0.01 * exp(-(x - 10) * 0.01) end, 6) as pdf, round(case when x < 10 then 0 else 1 - exp(-(x - 10) * 0.01) end, 6) as cdf, round(case when x < 10 then 1 else exp(-(x - 10) * 0.01) end, 6) as surv, round(case when x < 10 then 0 else -(x - 10) * 0.01 end, 6) as log_surv, round(10 - ln(1 - p) / 0.01, 6) as quantile from ({_X})")
def _(spark, d):
    e = samples(spark, d)
    a = (10.0, 0.01)
    D = dist.Exponential
    return e.select("event_id", *r6(pdf=D.pdf("x", *a), cdf=D.cdf("x", *a), surv=D.surv("x", *a), log_surv=D.log_surv("x", *a), quantile=D.invcdf("p", *a)))


def samples(spark, d):
    return frame(spark, d, "events").select("event_id", F.col("value").alias("x"), ((F.col("value") - 0.005) / 491).alias("p"))


@query("gumbel_distribution", f"select event_id, round(0.02 * exp(-z - exp(-z)), 6) as pdf, round(exp(-exp(-z)), 6) as cdf, round(1 - exp(-exp(-z)), 6) as surv, round(-exp(-z), 6) as log_cdf, round(ln(0.02) - z - exp(-z), 6) as log_pdf, round(50 - ln(-ln(p)) / 0.02, 6) as quantile from (select *, (x - 50) * 0.02 as z from ({_X}))")
def _(spark, d):
    a, D = (50.0, 0.02), dist.Gumbel
    return samples(spark, d).select("event_id", *r6(pdf=D.pdf("x", *a), cdf=D.cdf("x", *a), surv=D.surv("x", *a), log_cdf=D.log_cdf("x", *a), log_pdf=D.log_pdf("x", *a), quantile=D.invcdf("p", *a)))


@query("gev_distribution", f"select event_id, round(0.02 * pow(t, -1 / 0.2 - 1) * exp(-pow(t, -1 / 0.2)), 6) as pdf, round(exp(-pow(t, -1 / 0.2)), 6) as cdf, round(1 - exp(-pow(t, -1 / 0.2)), 6) as surv, round(50 + (pow(-ln(p), -0.2) - 1) / 0.2 / 0.02, 6) as quantile from (select *, 1 + 0.2 * (x - 50) * 0.02 as t from ({_X}))")
def _(spark, d):
    a, D = (50.0, 0.02, 0.2), dist.Gev
    return samples(spark, d).select("event_id", *r6(pdf=D.pdf("x", *a), cdf=D.cdf("x", *a), surv=D.surv("x", *a), quantile=D.invcdf("p", *a)))


@query("weibull_distribution", f"select event_id, round(0.01 * 1.5 * pow(x * 0.01, 0.5) * exp(-pow(x * 0.01, 1.5)), 6) as pdf, round(1 - exp(-pow(x * 0.01, 1.5)), 6) as cdf, round(exp(-pow(x * 0.01, 1.5)), 6) as surv, round(-pow(x * 0.01, 1.5), 6) as log_surv, round(pow(-ln(1 - p), 1 / 1.5) / 0.01, 6) as quantile from ({_X})")
def _(spark, d):
    a, D = (0.0, 0.01, 1.5), dist.Weibull
    return samples(spark, d).select("event_id", *r6(pdf=D.pdf("x", *a), cdf=D.cdf("x", *a), surv=D.surv("x", *a), log_surv=D.log_surv("x", *a), quantile=D.invcdf("p", *a)))


@query("lognormal_density", f"select event_id, round(exp(-power((ln(x) - 4) / 0.8, 2) / 2) / x / (0.8 * sqrt(2 * pi())), 6) as pdf, round(-power((ln(x) - 4) / 0.8, 2) / 2 - ln(x) - ln(0.8 * sqrt(2 * pi())), 6) as log_pdf from ({_X})")
def _(spark, d):
    a, D = (4.0, 0.8), dist.Lognormal
    return samples(spark, d).select("event_id", *r6(pdf=D.pdf("x", *a), log_pdf=D.log_pdf("x", *a)))


@query("gamma_density", f"select event_id, round(ln(0.02) - lgamma(2.5) + 1.5 * ln(x * 0.02) - x * 0.02, 6) as log_pdf from ({_X})")
def _(spark, d):
    return samples(spark, d).select("event_id", *r6(log_pdf=dist.Gamma.log_pdf("x", 0.0, 0.02, 2.5)))


_S = "samples as (select event_type as grp, value as x from events)"


def over_samples(sql: str) -> str:
    return f"with {_S} {sql}"


def grouped(spark, d):
    return frame(spark, d, "samples")


def rounded(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


@query("histogram", over_samples("select grp, floor((x - 0) / 25)::bigint as bin, count(*) as n from samples where floor(x / 25) between 0 and 19 group by all"))
def _(spark, d):
    return statistics.histogram(grouped(spark, d), 0.0, 25.0, 20)


@query("sample_moments", over_samples("select grp, count(x) as n, round(avg(x), 6) as mean, round(var_samp(x), 6) as variance, round(stddev_samp(x), 6) as stddev from samples group by grp"))
def _(spark, d):
    return rounded(statistics.moments(grouped(spark, d)), "mean", "variance", "stddev")


@query("chi_squared", over_samples("select grp, round(sum((o - e) ** 2 / e), 6) as chi2 from (select grp, k, count(x) filter (floor(x / 50) = k) as o, count(*) / 10.0::double as e from samples, (select unnest(range(0, 10)) as k) group by all) group by grp"))
def _(spark, d):
    s = grouped(spark, d)
    expected = s.groupBy("grp").agg((F.count(F.lit(1)) / 10.0).alias("e")).select("grp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))).alias("bin"), "e")
    return rounded(statistics.chi_squared(statistics.histogram(s, 0.0, 50.0), expected), "chi2")


@query("tail_at", over_samples("select grp, 400.0::double as cut, count(*) filter (x >= 400) as n_tail, count(*) as n, round(count(*) filter (x >= 400) / count(*), 6) as share from samples group by grp"))
def _(spark, d):
    return rounded(statistics.tail_at(grouped(spark, d), 0.0, 25.0, 410.0), "share")


@query("ranked_value", over_samples("select grp, x from (select grp, x, row_number() over (partition by grp order by x desc) as r from samples) where r = 6"))
def _(spark, d):
    return statistics.ranked(grouped(spark, d), 5)


@query("tail_by_mass", over_samples("select grp, x, (r - (n - ceil(n * 0.05)) - 1)::bigint as place from (select grp, x, row_number() over (partition by grp order by x) as r, count(*) over (partition by grp) as n from samples) where r > n - ceil(n * 0.05)"))
def _(spark, d):
    return statistics.tail_by_mass(grouped(spark, d), 0.05)


@query("goodness_of_fit", f"""with {_S}, h as (select grp, floor(x / 100)::bigint as bin, count(*)::double as o from samples group by all), n as (select grp, sum(o) as n from h group by grp), e as (select grp, o, n * (exp(-0.02 * 100 * bin) - exp(-0.02 * 100 * (bin + 1))) as e from h join n using (grp)),
    s as (select grp, count(*)::int as bins, 2 * sum(o * ln(o / e)) as g, sum((o - e) ** 2 / e) as c, (count(*) - 1) / 2.0 as a from e group by grp)
    select grp, bins, round(g, 6) as g, abs(round(1 - list_sum(list_transform(range(0, 900), lambda k: exp((a + k) * ln(g / 2) - g / 2 - lgamma(a + k + 1.0::double)))), 6)) as g_p, round(c, 6) as chi2, abs(round(1 - list_sum(list_transform(range(0, 900), lambda k: exp((a + k) * ln(c / 2) - c / 2 - lgamma(a + k + 1.0::double)))), 6)) as chi2_p from s""")
def _(spark, d):
    h = statistics.histogram(grouped(spark, d), 0.0, 100.0)
    fit = statistics.goodness(h, lambda x: dist.Exponential.cdf(x, 0.0, 0.02), 0.0, 100.0, least=0.0)
    return fit.select("grp", "bins", F.round("g", 6).alias("g"), F.abs(F.round("g_p", 6)).alias("g_p"), F.round("chi2", 6).alias("chi2"), F.abs(F.round("chi2_p", 6)).alias("chi2_p"))


@query("g_test", """select l_returnflag, round(2 * ((case when ca > 0 then ca * ln(ca / (na * (ca + cb) / (na + nb))) else 0 end) + (case when na > ca then (na - ca) * ln((na - ca) / (na * (na + nb - ca - cb) / (na + nb))) else 0 end)
    + (case when cb > 0 then cb * ln(cb / (nb * (ca + cb) / (na + nb))) else 0 end) + (case when nb > cb then (nb - cb) * ln((nb - cb) / (nb * (na + nb - ca - cb) / (na + nb))) else 0 end)), 6) as g
    from (select l_returnflag, count(*) filter (l_linestatus = 'O' and l_quantity > 25)::double as ca, count(*) filter (l_linestatus = 'O')::double as na, count(*) filter (l_linestatus <> 'O' and l_quantity > 25)::double as cb, count(*) filter (l_linestatus <> 'O')::double as nb from lineitem group by 1)""")
def _(spark, d):
    big, o = F.col("l_quantity") > 25, F.col("l_linestatus") == "O"
    n = lambda c: F.sum(c.cast("bigint"))
    t = frame(spark, d, "lineitem").groupBy("l_returnflag").agg(n(o & big).alias("ca"), n(o).alias("na"), n(~o & big).alias("cb"), n(~o).alias("nb"))
    return t.select("l_returnflag", F.round(statistics.g_test("ca", "na", "cb", "nb")[0], 6).alias("g"))


@query("linear_regression", """select grp, count(*) as n, round(regr_intercept(y, x), 6) as a, round(regr_slope(y, x), 6) as b, round(corr(x, y), 6) as cc from (select l_returnflag as grp, l_quantity as x, l_extendedprice as y from lineitem) group by grp""")
def _(spark, d):
    rows = frame(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(statistics.regression(rows).select("grp", "n", "a", "b", "cc"), "a", "b", "cc")


@query("weighted_regression", """with t as (select l_returnflag as grp, l_quantity as x, l_extendedprice as y, 1 / power(1 + l_tax, 2) as w from lineitem), s as (select grp, sum(w) as s, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from t group by grp)
    select grp, round((s * sxy - sx * sy) / (s * sxx - sx * sx), 4) as b, round(sqrt(s / (s * sxx - sx * sx)), 6) as sigma_b from s""")
def _(spark, d):
    rows = frame(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (1 + F.col("l_tax")).alias("sd"))
    return statistics.regression(rows, "sd").select("grp", F.round("b", 4).alias("b"), F.round("sigma_b", 6).alias("sigma_b"))


@query("fit_exponential", over_samples("select grp, round(min(x), 6) as mu, round(1 / (avg(x) - min(x)), 6) as rate from samples group by grp"))
def _(spark, d):
    return rounded(statistics.fit_exponential(grouped(spark, d)), "mu", "rate")


@query("fit_exponential_rate", over_samples("select grp, round(1 / avg(x - 0.001), 6) as rate from samples group by grp"))
def _(spark, d):
    return rounded(statistics.fit_exponential_rate(grouped(spark, d), 0.001), "rate")


@query("fit_lognormal", over_samples("select grp, round(avg(ln(x)), 6) as mu, round(stddev_pop(ln(x)), 6) as sigma from samples group by grp"))
def _(spark, d):
    return rounded(statistics.fit_lognormal(grouped(spark, d)), "mu", "sigma")


@query("fit_gumbel_location", over_samples("select grp, round(-ln(avg(exp(-0.05 * x))) / 0.05, 6) as mu from samples group by grp"))
def _(spark, d):
    return rounded(statistics.fit_gumbel_location(grouped(spark, d), 0.05), "mu")


@query("fit_gumbel_censored_location", over_samples("select grp, round(-ln((sum(exp(-0.05 * x)) filter (x >= 20) + count(*) filter (x < 20) * exp(-0.05 * 20)) / count(*) filter (x >= 20)) / 0.05, 6) as mu from samples group by grp"))
def _(spark, d):
    return rounded(statistics.fit_gumbel_censored_location(grouped(spark, d), 0.05, 20.0), "mu")


def _bisected(value: str, low: str, high: str, falls: str, more: str = "") -> str:
    """SQL that halves (low, high) 200 times in each group, by whether ``falls``, an expression of ``k`` that is positive
    below the root, is; then ``value`` of the root ``k``. ``xs`` is the group's values."""
    return f"""with recursive {_S}, g as (select grp, list(x) as xs from samples group by grp), p as (select *{more} from g),
    b as (select p.*, {low} as lo, {high} as hi, 0 as n from p union all select * exclude (k, up) replace (case when up then k else lo end as lo, case when up then hi else k end as hi, n + 1 as n) from (select *, {falls} > 0 as up from (select *, (lo + hi) / 2 as k from b where n < 200)))
    select grp, {value} from (select *, (lo + hi) / 2 as k from b where n = 200)"""


_SUMS = "list_sum(list_transform(ys, lambda y: exp(-k * y)))", "list_sum(list_transform(ys, lambda y: y * exp(-k * y)))"


@query("fit_gumbel", _bisected(f"round(low - ln({_SUMS[0]} / len(ys)) / k, 4) as mu, round(k, 6) as rate", "1e-6::double", "10.0::double", f"1 / k - list_avg(ys) + {_SUMS[1]} / {_SUMS[0]}", ", list_min(xs) as low, list_transform(xs, lambda x: x - list_min(xs)) as ys"))
def _(spark, d):
    return _fitted(statistics.fit_gumbel(grouped(spark, d)))


def _fitted(f):
    return f.select("grp", F.round("mu", 4).alias("mu"), F.round("rate", 6).alias("rate"))


_CUT = 20.0


@query("fit_gumbel_censored", _bisected(f"round(20 - ln(({_SUMS[0]} + z) / len(ys)) / k, 4) as mu, round(k, 6) as rate", "1e-6::double", "10.0::double", f"1 / k - list_avg(ys) + {_SUMS[1]} / ({_SUMS[0]} + z)", ", list_transform(list_filter(xs, lambda x: x >= 20), lambda x: x - 20) as ys, len(list_filter(xs, lambda x: x < 20)) as z"))
def _(spark, d):
    return _fitted(statistics.fit_gumbel_censored(grouped(spark, d), _CUT))


@query("fit_gamma", _bisected("round(k / m, 6) as rate, round(k, 6) as shape", "1e-3::double", "1000.0::double", "ln(k) - (ln(k + 30) - 0.5 / (k + 30) - 1 / (12 * pow(k + 30, 2)) + 1 / (120 * pow(k + 30, 4)) - list_sum(list_transform(range(0, 30), lambda i: 1 / (k + i)))) - gap", ", list_avg(xs) as m, ln(list_avg(xs)) - list_avg(list_transform(xs, lambda x: ln(x))) as gap"))
def _(spark, d):
    return rounded(statistics.fit_gamma(grouped(spark, d), 0.0), "rate", "shape")


_POWERS = "list_sum(list_transform(ys, lambda y: exp(k * (y - top))))", "list_sum(list_transform(ys, lambda y: y * exp(k * (y - top))))"


@query("fit_weibull", _bisected(f"round(low, 6) as mu, round(exp(-top) / pow({_POWERS[0]} / len(ys), 1 / k), 6) as rate, round(k, 6) as shape, true as converged", "1e-3::double", "100.0::double", f"1 / k + list_avg(ys) - {_POWERS[1]} / {_POWERS[0]}", ", list_min(xs) as low, ln(list_max(xs) - list_min(xs)) as top, list_transform(list_filter(xs, lambda x: x > list_min(xs)), lambda x: ln(x - list_min(xs))) as ys"))
def _(spark, d):
    return rounded(statistics.fit_weibull(grouped(spark, d)), "mu", "rate", "shape")


def _best(f, nll, *names):
    """(grp, is_least): whether no step of a thousandth in one parameter lowers the negative log-likelihood, a Column
    over x, of each group at its fit."""
    moves = [(0, 0.0), *((i, s * 1e-3) for i in range(len(names)) for s in (-1, 1))]
    moved = lambda i, by: [F.col(n) * (1 + by) if j == i else F.col(n) for j, n in enumerate(names)]
    sums = f.groupBy("grp").agg(*(F.sum(nll(*moved(*m))).alias(f"v{k}") for k, m in enumerate(moves)))
    return sums.select("grp", F.least(*(F.col(f"v{k}") for k in range(1, len(moves)))).__ge__(F.col("v0") - 1e-9 * F.abs("v0")).alias("is_least"))


@query("fit_gumbel_truncated", "select distinct event_type as grp, true as is_least from events")
def _(spark, d):
    s = grouped(spark, d).where(F.col("x") >= _CUT)

    def nll(mu, rate):
        z = rate * (F.col("x") - mu)
        return -F.ln(rate) + z + F.exp(-z) + F.ln(-F.expm1(-F.exp(-rate * (_CUT - mu))))

    return _best(s.join(statistics.fit_gumbel_truncated(s, _CUT), "grp"), nll, "mu", "rate")


@query("fit_gev", "select distinct event_type as grp, true as is_least from events")
def _(spark, d):
    s = grouped(spark, d)

    def nll(mu, rate, shape):
        t = 1 + shape * rate * (F.col("x") - mu)
        return F.when(t > 0, -F.ln(rate) + (1 + 1 / shape) * F.ln(t) + F.pow(t, -1 / shape)).otherwise(float("inf"))

    return _best(s.join(statistics.fit_gev(s), "grp"), nll, "mu", "rate", "shape")


@query("fit_of_equal_values", "select grp, null::double as mu, null::double as rate, null::double as shape from (select unnest(['a', 'b']) as grp)")
def _(spark, d):
    """Groups that no distribution fits: one value, and one value many times."""
    s = spark.createDataFrame([("a", 3.0)] + [("b", 5.0)] * 9, "grp string, x double")
    both = statistics.fit_gumbel(s).join(statistics.fit_gamma(s, 0.0).select("grp", "shape"), "grp")
    for f in (statistics.fit_gev(s), statistics.fit_weibull(s), statistics.fit_gumbel_censored(s, 9.0).withColumn("converged", F.lit(False))):
        both = both.join(f.where("not converged").select("grp"), "grp")
    return both.select("grp", "mu", "rate", "shape")


_M = "mat as (select (n_regionkey)::bigint as m, i::bigint as i, j::bigint as j, ((i * 7 + j * 3 + n_regionkey) % 5)::double as v from (select distinct n_regionkey from nation), (select unnest(range(0, 6)) as i), (select unnest(range(0, 6)) as j))"


def small_matrices(spark, d):
    m = frame(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("m")).distinct()
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")))
    cells = m.withColumn("i", i).withColumn("j", i)
    return cells.withColumn("v", ((F.col("i") * 7 + F.col("j") * 3 + F.col("m")) % 5).cast("double"))


@query("matrix_multiply", f"with {_M} select a.m, a.i, b.j, sum(a.v * b.v) as v from mat a join mat b on a.m = b.m and a.j = b.i group by all")
def _(spark, d):
    return matrices.multiply(small_matrices(spark, d), small_matrices(spark, d))


@query("matrix_add_transpose", f"with {_M} select a.m, a.i, a.j, a.v * 2 + b.v as v from mat a join mat b on a.m = b.m and a.i = b.j and a.j = b.i")
def _(spark, d):
    a = small_matrices(spark, d)
    return matrices.add(matrices.scale(a, 2.0), matrices.transpose(a))


@query("matrix_summary", f"with {_M} select m, sum(v) as total, min(v) as low, max(v) as high, round(sqrt(sum(v * v)), 6) as frobenius from mat group by m")
def _(spark, d):
    return rounded(matrices.summary(small_matrices(spark, d)), "frobenius")


@query("matrix_symmetric", f"with {_M} select a.m, max(abs(a.v - b.v)) <= 1e-9 as is_symmetric from mat a join mat b on a.m = b.m and a.i = b.j and a.j = b.i group by a.m")
def _(spark, d):
    return matrices.symmetric(small_matrices(spark, d), 1e-9)


@query("matrix_identity", "select 3::bigint as m, i::bigint as i, j::bigint as j, (i = j)::int::double as v from (select unnest(range(0, 5)) as i), (select unnest(range(0, 5)) as j)")
def _(spark, d):
    return matrices.identity(spark, 3, 5)


_UNIT = f"with {_M} select m, i, j, (i = j)::int::double as v from mat"


@query("matrix_exponential", _UNIT)
def _(spark, d):
    """exp(A) times exp(-A)."""
    of = lambda t: matrices.per_matrix(small_matrices(spark, d), lambda x: matrices.exponential(x, t))
    return _clean(matrices.multiply(of(0.1), of(-0.1)))


def _clean(a):
    """Rounded to 6 places, without a negative zero."""
    return a.select("m", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("matrix_exponential_rate", f"with {_M} select a.m, a.i, b.j, round(sum(a.v * b.v), 3) as v from mat a join mat b on a.m = b.m and a.j = b.i group by all")
def _(spark, d):
    """The second derivative of exp(tA) at 0, by differences: A times A."""
    h = 1e-3
    second = lambda x: (matrices.exponential(x, h) - 2 * np.eye(len(x)) + matrices.exponential(x, -h)) / h**2
    return matrices.per_matrix(small_matrices(spark, d), second).select("m", "i", "j", F.round("v", 3).alias("v"))


@query("matrix_inverse", _UNIT)
def _(spark, d):
    """A + 10 I times its inverse."""
    raised = matrices.per_matrix(small_matrices(spark, d), lambda x: x + 10 * np.eye(len(x)))
    return _clean(matrices.multiply(raised, matrices.per_matrix(raised, matrices.inverse)))


@query("matrix_factors", f"with {_M} select m, i, j, v + case when i = j then 10 else 0 end as v from mat")
def _(spark, d):
    """The product of the two triangular factors, its rows put back in order."""

    def product(x):
        order, low, high = matrices.lu(x + 10 * np.eye(len(x)))
        out = np.empty_like(x)
        out[order] = np.tril(low) @ np.triu(high)
        return out

    return _clean(matrices.per_matrix(small_matrices(spark, d), product))


@query("matrix_eigenvalues", f"with {_M}, s as (select a.m, a.i, a.j, a.v + b.v as v from mat a join mat b on a.m = b.m and a.i = b.j and a.j = b.i) select m, round(sum(v) filter (i = j), 6) as trace, round(sum(v * v), 6) as squares, true as falling from s group by m")
def _(spark, d):
    values = matrices.per_matrix(small_matrices(spark, d), lambda x: np.diag(matrices.eigen(x + x.T)[0])).where("i = j")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"])
    return values.groupBy("m").agg(F.round(F.sum("v"), 6).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("squares"), (ordered == F.sort_array(F.collect_list("v"), False)).alias("falling"))


@query("matrix_elements", f"with {_M} select m, i, j, case when i = 1 and j = 2 then v + 100 else v end as v, (select b.v from mat b where b.m = mat.m and b.i = 3 and b.j = 4) as picked from mat")
def _(spark, d):
    a = small_matrices(spark, d)
    changed = matrices.replaced(a, matrices.element(a, 1, 2).select("m", F.lit(1).cast("bigint").alias("i"), F.lit(2).cast("bigint").alias("j"), (F.col("v") + 100).alias("v")))
    return changed.join(matrices.element(a, 3, 4).withColumnRenamed("v", "picked"), "m").select("m", "i", "j", "v", "picked")


@query("matrix_upper", f"with {_M} select a.m, a.i, a.j, a.v + b.v as v from mat a join mat b on a.m = b.m and a.i = b.j and a.j = b.i")
def _(spark, d):
    """A symmetric matrix from its upper triangle."""
    a = small_matrices(spark, d)
    return matrices.from_upper(matrices.upper(matrices.add(a, matrices.transpose(a)))).select("m", "i", "j", "v")


@query("jukes_cantor_probability", "select 1::bigint as m, i::bigint as i, j::bigint as j, round(case when i = j then 0.25 + 0.75 * exp(-4 * 0.3 / 3) else 0.25 - 0.25 * exp(-4 * 0.3 / 3) end, 6) as v from (select unnest(range(0, 4)) as i), (select unnest(range(0, 4)) as j)")
def _(spark, d):
    return rounded(matrices.table(spark, 1, matrices.exponential(matrices.jukes_cantor(4), 0.3)), "v")


@query("rate_matrices", """with p as (select unnest([0.1, 0.2, 0.3, 0.4]::double[]) as p, unnest([0, 1, 2, 3]) as j), r as (select a.j as i, b.j as j, case when abs(a.j - b.j) = 2 then 2.0 else 1.0 end * b.p as q, a.p as pi from p a, p b where a.j <> b.j), n as (select sum(pi * q) as s from r)
    select 2::bigint as m, i::bigint as i, j::bigint as j, round(q / s, 6) as v from r, n union all select 2, i, i, round(-sum(q) / any_value(s), 6) from r, n group by i""")
def _(spark, d):
    return rounded(matrices.table(spark, 2, matrices.hky(2.0, 1.0, [0.1, 0.2, 0.3, 0.4])), "v")


_PI = "p as (select unnest([0.1, 0.2, 0.3, 0.4]::double[]) as p, unnest([0, 1, 2, 3]) as j)"


@query("reversible_exponential", f"with {_PI}, b as (select 1 / (1 - sum(p * p)) as b from p), t as (select unnest([0, 1, 2, 3]) as t) select t::bigint as m, i.j::bigint as i, p.j::bigint as j, round(case when i.j = p.j then exp(-b * t) else 0 end + (1 - exp(-b * t)) * p.p, 6) as v from t, b, p, p i")
def _(spark, d):
    """Equal rates have a closed form."""
    pi = np.array([0.1, 0.2, 0.3, 0.4])
    parts = matrices.eigen_reversible(matrices.felsenstein(pi), pi)
    out = matrices.table(spark, 0, matrices.exponential_from_eigen(parts, 0.0))
    for t in (1, 2, 3):
        out = out.unionByName(matrices.table(spark, t, matrices.exponential_from_eigen(parts, float(t))))
    return _clean(out)


_RATES = {"jukes_cantor": (lambda: matrices.jukes_cantor(4), [0.25] * 4), "kimura": (lambda: matrices.kimura(4.0, 1.0), [0.25] * 4), "felsenstein": (lambda: matrices.felsenstein([0.1, 0.2, 0.3, 0.4]), [0.1, 0.2, 0.3, 0.4]), "hky": (lambda: matrices.hky(3.0, 1.0, [0.1, 0.2, 0.3, 0.4]), [0.1, 0.2, 0.3, 0.4]), "wag": (matrices.wag, scores.BACKGROUNDS["wag"])}


@query("rate_checks", "select name, true as is_rate, true as reversible, 1.0::double as changes, 2.5::double as scaled, true as is_probability, true as keeps_frequencies, true as informative, true as scores_low from (select unnest(['jukes_cantor', 'kimura', 'felsenstein', 'hky', 'wag']) as name)")
def _(spark, d):
    """What each rate matrix must hold: rows of sum 0, detailed balance, one change in unit time, and of its
    probabilities at 0.4 rows of sum 1, the same frequencies, positive entropy and a negative mean score."""
    rows = []
    for name, (make, pi) in _RATES.items():
        q, pi = make(), np.asarray(pi) / np.sum(pi)
        p = matrices.exponential(q, 0.4)
        changes = lambda x: round(float(-(pi * np.diag(x)).sum()), 4)  # noqa: B023, E731
        flow = pi[:, None] * q
        rows.append((name, matrices.is_rate_matrix(q), bool(np.allclose(flow, flow.T, atol=1e-5)), changes(q), changes(matrices.scaled(q, pi, 2.5)), matrices.is_probability_matrix(p), bool(np.allclose(pi @ p, pi, atol=1e-5)), matrices.relative_entropy(p, pi) > 0, matrices.expected_score(p, pi) < 0))
    return spark.createDataFrame(rows, "name string, is_rate boolean, reversible boolean, changes double, scaled double, is_probability boolean, keeps_frequencies boolean, informative boolean, scores_low boolean")


@query("exchangeability_rates", "with p as (select unnest([0.1, 0.2, 0.3, 0.4]::double[]) as p, unnest([0, 1, 2, 3]) as j), r as (select a.j as i, b.j as j, (1 + a.j + b.j) * b.p as q from p a, p b where a.j <> b.j) select 4::bigint as m, i::bigint as i, j::bigint as j, round(q, 6) as v from r union all select 4, i, i, round(-sum(q), 6) from r group by i")
def _(spark, d):
    i, j = np.indices((4, 4))
    return _clean(matrices.table(spark, 4, matrices.from_exchangeability(1.0 + i + j, np.array([0.1, 0.2, 0.3, 0.4]))))


@query("kimura_probability", "with c as (select 1 / (2.0 + 4.0) * 4 as b) select 5::bigint as m, i::bigint as i, j::bigint as j, round(case when i = j then 0.25 + 0.25 * exp(-b * 0.3) + 0.5 * exp(-(4 + 1) / 2.0 * b * 0.3) when abs(i - j) = 2 then 0.25 + 0.25 * exp(-b * 0.3) - 0.5 * exp(-(4 + 1) / 2.0 * b * 0.3) else 0.25 - 0.25 * exp(-b * 0.3) end, 6) as v from c, (select unnest(range(0, 4)) as i), (select unnest(range(0, 4)) as j)")
def _(spark, d):
    """Transitions four times as fast as transversions, against the closed form."""
    return _clean(matrices.table(spark, 5, matrices.exponential(matrices.kimura(4.0, 1.0), 0.3)))


@query("score_pairs", oracle("seqs", sql="select id, sum(case when x = y then 1 else -1 end)::bigint as score from (select id, unnest(string_split(seq, '')) as x, unnest(string_split(reverse(seq), '')) as y from seqs) group by id"))
def _(spark, d):
    m = scores.identity_matrix()
    both = F.arrays_zip(AMINO.digitize("seq").alias("x"), AMINO.digitize(F.reverse("seq")).alias("y"))
    rows = frame(spark, d, "seqs").select("id", F.explode(both).alias("z"))
    return rows.groupBy("id").agg(F.sum(m.score("z.x", "z.y").cast("bigint")).alias("score"))


@query("background_entropy", "select 'uniform' as name, round(log2(20), 6) as bits")
def _(spark, d):
    f = scores.background(spark, "uniform")
    return f.groupBy("name").agg(F.round(-F.sum(F.col("f") * F.log2("f")), 6).alias("bits"))


@query("score_scale", "with b(name, f) as (values " + ", ".join(f"('{n}', {list(f)}::double[])" for n, f in scores.BACKGROUNDS.items()) + "), p as (select name, list_transform(f, lambda x: x / list_sum(f)) as f from b) select name, round(9 * list_sum(list_transform(f, lambda x: x * x)) - 4, 6) as expected, true as closes, true as informative from p")
def _(spark, d):
    """Scores of 5 and -4: their mean, and whether the pairs that they imply at their scale sum to 1."""
    rows = []
    for name, f in scores.BACKGROUNDS.items():
        f = np.array(f) / sum(f)
        m = scores.identity_matrix(5, -4)
        scale, p = m.scale_for(f, f)
        rows.append((name, round(m.expected(f, f), 6), bool(abs(p.sum() - 1) < 1e-9), m.relative_entropy(f, scale) > 0))
    return spark.createDataFrame(rows, "name string, expected double, closes boolean, informative boolean")


@query("score_tables", "select 'AMINO' as matrix, 4 as highest, -3 as lowest, true as is_symmetric, true as read_back, true as by_name, true as from_pairs")
def _(spark, d):
    """A matrix written to a folder as text and found there by its name; and its scores from the pairs it implies."""
    from ..sources import scratch

    i, j = np.indices((20, 20))
    s = np.where(i == j, 4, -1 - (i + j) % 3)
    m = scores.ScoreMatrix("AMINO", np.pad(s, (0, 9)))
    folder = scratch.folder(spark, "scores")
    spark.createDataFrame([(m.text(),)], "value string").coalesce(1).write.text(f"{folder}/AMINO")
    found = scores.by_name(spark, f"{folder}/AMINO", spark.read.format("binaryFile").load(f"{folder}/AMINO").select("path").first()[0].rsplit("/", 1)[1])
    f = np.full(20, 0.05)
    scale, p = m.scale_for(f, f)
    back = scores.read_scores(m.text(), "AMINO")
    same = lambda x: bool((x.canonical() == m.canonical()).all())
    return spark.createDataFrame([(m.name, m.highest(), m.lowest(), m.is_symmetric(), same(back), same(found), same(scores.from_pairs(p, f, f, scale)))], "matrix string, highest int, lowest int, is_symmetric boolean, read_back boolean, by_name boolean, from_pairs boolean")


@query("score_symbols", "select a || b as pair, case when a = '!' or b = '!' then -9 when a = b then 5 else -4 end::int as score from (select unnest(['A', 'W', 'c', '!']) as a0), (select unnest(['A', 'W', 'C', '!']) as b), lateral (select upper(a0) as a)")
def _(spark, d):
    m = scores.identity_matrix(5, -4)
    a = spark.createDataFrame([("A",), ("W",), ("c",), ("!",)], "a string")
    b = spark.createDataFrame([("A",), ("W",), ("C",), ("!",)], "b string")
    return a.crossJoin(b).select(F.concat(F.upper("a"), F.col("b")).alias("pair"), F.coalesce(m.score_symbols("a", "b"), F.lit(-9)).cast("int").alias("score"))  # four rows each


@query("dirichlet_posterior", oracle("seqs", sql="select id, round((length(regexp_replace(seq, '[^A]', '', 'g')) + 1) / (length(seq) + 4.0::double), 6) as a, round((length(regexp_replace(seq, '[^T]', '', 'g')) + 1) / (length(seq) + 4.0::double), 6) as t from seqs"))
def _(spark, d):
    from ..functions.alphabet import DNA

    p = frame(spark, d, "seqs").select("id", priors.posterior_mean(DNA.count_vector("seq"), priors.LAPLACE_DNA).alias("p"))
    return p.select("id", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[3], 6).alias("t"))


_MIX = priors.Mixture(np.array([0.4, 0.6]), np.array([[1.0, 1.0, 1.0, 1.0], [5.0, 2.0, 2.0, 5.0]]))


def _dm(alpha, weight):
    total = sum(alpha)
    terms = " + ".join(f"lgamma({c} + {a}) - lgamma({a})" for c, a in zip("acgt", alpha))
    return f"(ln({weight}::double) + lgamma({total}) - lgamma(n + {total}) + {terms})"


@query("mixture_dirichlet", oracle("seqs", sql=f"""select id, round(greatest(u, w) + ln(1 + exp(-abs(u - w))), 6) as log_prob, round(1 / (1 + exp(w - u)), 6) as first from (select id, {_dm((1.0, 1.0, 1.0, 1.0), 0.4)} as u, {_dm((5.0, 2.0, 2.0, 5.0), 0.6)} as w
    from (select id, length(seq)::double as n, {", ".join(f"length(regexp_replace(seq, '[^{x}]', '', 'g'))::double as {x.lower()}" for x in "ACGT")} from seqs))"""))
def _(spark, d):
    from ..functions.alphabet import DNA

    c = frame(spark, d, "seqs").select("id", DNA.count_vector("seq").alias("c"))
    return c.select("id", F.round(_MIX.column("log_prob", "c"), 6).alias("log_prob"), F.round(_MIX.column("posterior_weights", "c")[0], 6).alias("first"))


_COUNTS = ", ".join(f"length(regexp_replace(seq, '[^{x}]', '', 'g'))::double as {x.lower()}" for x in "ACGT")


@query("mixture_posterior", oracle("seqs", sql=f"""select id, round(w1 * (a + 1) / (n + 4) + (1 - w1) * (a + 5) / (n + 14), 6) as a, round(w1 * (c + 1) / (n + 4) + (1 - w1) * (c + 2) / (n + 14), 6) as c from (select *, 1 / (1 + exp(w - u)) as w1 from (select *, {_dm((1.0, 1.0, 1.0, 1.0), 0.4)} as u, {_dm((5.0, 2.0, 2.0, 5.0), 0.6)} as w
    from (select id, length(seq)::double as n, {_COUNTS} from seqs)))"""))
def _(spark, d):
    from ..functions.alphabet import DNA

    p = frame(spark, d, "seqs").select("id", _MIX.column("posterior_mean", DNA.count_vector("seq")).alias("p"))
    return p.select("id", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[1], 6).alias("c"))


@query("mixture_components", oracle("seqs", sql=f"""select id, round({_dm((1.0, 1.0, 1.0, 1.0), 1.0)}, 6) as first, round({_dm((6.0, 2.0, 2.0, 5.0), 1.0)}, 6) as second, true as is_valid, false as is_same, 1.0::double as alpha from (select id, length(seq)::double as n, {_COUNTS} from seqs)"""))
def _(spark, d):
    """Components of a mixture that was written as text, read back, and given another component."""
    from ..functions.alphabet import DNA

    back = priors.read_mixture(_MIX.text())
    changed = back.with_component(1, (6.0, 2.0, 2.0, 5.0))
    t = frame(spark, d, "seqs").select("id", changed.column("log_terms", DNA.count_vector("seq")).alias("t"))
    return t.select("id", F.round(F.col("t")[0], 6).alias("first"), F.round(F.col("t")[1], 6).alias("second"), F.lit(back.valid() and back.same(_MIX, 1e-12)).alias("is_valid"), F.lit(changed.same(_MIX, 1e-12)).alias("is_same"), F.lit(changed.component(0)[0]).alias("alpha"))
