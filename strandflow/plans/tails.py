"""Queries of the distributions' logarithms, tails and inverses, special functions, solvers and random draws."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import random, special
from ..operators import priors
from .inputs import frame
from .numbers import r6, rounded, samples

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_X = "select event_id, value as x, (value - 0.005) / 491 as p from events"


def _normal_cdf(z: str) -> str:
    """SQL of the normal distribution function by its series of positive terms."""
    terms = f"list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 2.0::double) - k * ln(2) - lgamma(k + 1.0::double)))))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms})"


def _gamma_p(a: str, x: str, terms: int = 200) -> str:
    """SQL of the regularized incomplete gamma function by its series."""
    return f"(case when {x} <= 0 then 0.0 else list_sum(list_transform(range(0, {terms}), lambda k: exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1.0::double)))) end)"


@query("normal_and_gamma_tails", f"""select event_id, round(exp(-z * z / 2) / (50 * sqrt(2 * pi())), 6) as normal_pdf, round(c, 6) as normal_cdf, round(1 - c, 6) as normal_surv, round(l, 6) as lognormal_cdf, round(1 - l, 6) as lognormal_surv, round(g, 6) as gamma_cdf, round(1 - g, 6) as gamma_surv
    from (select event_id, z, {_normal_cdf('z')} as c, {_normal_cdf('w')} as l, {_gamma_p('2.5', 'y')} as g from (select event_id, (x - 100) / 50 as z, (ln(x) - 4) / 0.8 as w, x * 0.02 as y from ({_X})))""")
def _(spark, d):
    N, L, G = dist.Normal, dist.Lognormal, dist.Gamma
    return samples(spark, d).select("event_id", *r6(normal_pdf=N.pdf("x", 100.0, 50.0), normal_cdf=N.cdf("x", 100.0, 50.0), normal_surv=N.surv("x", 100.0, 50.0), lognormal_cdf=L.cdf("x", 4.0, 0.8), lognormal_surv=L.surv("x", 4.0, 0.8), gamma_cdf=G.cdf("x", 0.0, 0.02, 2.5), gamma_surv=G.surv("x", 0.0, 0.02, 2.5)))


@query("quantiles", f"select event_id, round(p, 6) as normal, round(p, 6) as lognormal, round(p, 6) as gamma, round(p, 6) as exponential, round(p, 6) as gumbel from ({_X})")
def _(spark, d):
    """The probability of each quantile: of the lower tail for three, of the upper for the last two."""
    N, L, G, E, U = dist.Normal, dist.Lognormal, dist.Gamma, dist.Exponential, dist.Gumbel
    return samples(spark, d).select("event_id", *r6(normal=N.cdf(N.invcdf("p", 10.0, 3.0), 10.0, 3.0), lognormal=L.cdf(L.invcdf("p", 1.0, 0.5), 1.0, 0.5), gamma=G.cdf(G.invcdf("p", 1.0, 0.4, 2.5), 1.0, 0.4, 2.5), exponential=E.surv(E.invsurv("p", 5.0, 0.3), 5.0, 0.3), gumbel=U.surv(U.invsurv("p", 5.0, 0.3), 5.0, 0.3)))


@query("upper_quantiles", f"select event_id, round(5 - ln(p) / 0.3, 6) as exponential, round(5 - ln(-ln(1 - p)) / 0.3, 6) as gumbel from ({_X} where value > 1)")
def _(spark, d):
    return samples(spark, d).where("x > 1").select("event_id", *r6(exponential=dist.Exponential.invsurv("p", 5.0, 0.3), gumbel=dist.Gumbel.invsurv("p", 5.0, 0.3)))


@query("log_distributions", f"""select event_id, round(ln(0.01) - 0.01 * x, 6) as exponential_log_pdf, round(ln(1 - exp(-0.01 * x)), 6) as exponential_log_cdf, round(ln(1 - exp(-exp(-z))), 6) as gumbel_log_surv,
    round(ln(0.02) - (1 + 1 / 0.2) * ln(1 + 0.2 * z) - pow(1 + 0.2 * z, -1 / 0.2), 6) as gev_log_pdf, round(ln(0.01 * 1.5) + 0.5 * ln(0.01 * x) - pow(0.01 * x, 1.5), 6) as weibull_log_pdf, round(ln(1 - exp(-pow(0.01 * x, 1.5))), 6) as weibull_log_cdf,
    round(-power((x - 100) / 50, 2) / 2 - ln(50 * sqrt(2 * pi())), 6) as normal_log_pdf, round(exp(ln(0.02) - lgamma(2.5) + 1.5 * ln(x * 0.02) - x * 0.02), 6) as gamma_pdf, round(ln(g), 5) as gamma_log_cdf, round(ln(1 - g), 5) as gamma_log_surv
    from (select *, (x - 50) * 0.02 as z, {_gamma_p('2.5', '(x * 0.02)')} as g from ({_X} where value > 1))""")
def _(spark, d):
    E, U, V, W, N, G = dist.Exponential, dist.Gumbel, dist.Gev, dist.Weibull, dist.Normal, dist.Gamma
    e, u, v, w, g = (0.0, 0.01), (50.0, 0.02), (50.0, 0.02, 0.2), (0.0, 0.01, 1.5), (0.0, 0.02, 2.5)
    x = samples(spark, d).where("x > 1")
    logs = r6(exponential_log_pdf=E.log_pdf("x", *e), exponential_log_cdf=E.log_cdf("x", *e), gumbel_log_surv=U.log_surv("x", *u), gev_log_pdf=V.log_pdf("x", *v), weibull_log_pdf=W.log_pdf("x", *w), weibull_log_cdf=W.log_cdf("x", *w), normal_log_pdf=N.log_pdf("x", 100.0, 50.0), gamma_pdf=G.pdf("x", *g))
    return x.select("event_id", *logs, F.round(G.log_cdf("x", *g), 5).alias("gamma_log_cdf"), F.round(G.log_surv("x", *g), 5).alias("gamma_log_surv"))


@query("special_functions", f"""select event_id, round(lgamma(y), 6) as log_gamma, round(ln(y + 30) - 0.5 / (y + 30) - 1 / (12 * pow(y + 30, 2)) + 1 / (120 * pow(y + 30, 4)) - list_sum(list_transform(range(0, 30), lambda i: 1 / (y + i))), 6) as digamma,
    round(1 / (y + 30) + 0.5 / pow(y + 30, 2) + 1 / (6 * pow(y + 30, 3)) - 1 / (30 * pow(y + 30, 5)) + list_sum(list_transform(range(0, 30), lambda i: 1 / pow(y + i, 2))), 6) as trigamma,
    round(2 - 2 * {_normal_cdf('(y / 25 * sqrt(2.0))')}, 6) as erfc, round(exp(-y / 2) * (1 + y / 2), 6) as chi_squared_4, round(exp(-y) * (1 + y + y * y / 2), 6) as upper_gamma_3, round(1 - exp(-y) * (1 + y + y * y / 2), 6) as lower_gamma_3 from (select event_id, x / 10 + 0.1 as y from ({_X}))""")
def _(spark, d):
    s = samples(spark, d).select("event_id", (F.col("x") / 10 + 0.1).alias("y"))
    return s.select("event_id", *r6(log_gamma=special.log_gamma_column("y"), digamma=special.digamma_column("y"), trigamma=special.trigamma_column("y"), erfc=special.erfc_column(F.col("y") / 25), chi_squared_4=special.chi_squared_tail_column(4, "y"), upper_gamma_3=special.incomplete_gamma_column(3.0, "y", True), lower_gamma_3=special.incomplete_gamma_column(3.0, "y")))


@query("log_gamma_batches", f"select event_id, round(lgamma(x), 6) as value from ({_X})")
def _(spark, d):
    return samples(spark, d).select("event_id", F.round(special.by_batch(special.lgamma)("x"), 6).alias("value"))


@query("roots", f"select event_id, round(sqrt(x), 6) as bisected, round(sqrt(x), 6) as by_newton, round(sqrt(x), 6) as batch_newton from ({_X})")
def _(spark, d):
    """Square roots as the roots of y * y - x, which the solvers see as a function of y alone."""
    scaled = samples(spark, d).select("event_id", "x", F.lit(2.0).alias("two"))
    root2 = special.bisect_column(lambda y: y * y - 2.0, 0.0, F.col("two"))
    newton2 = special.newton_column(lambda y: y * y - 2.0, lambda y: 2 * y, F.col("two"))
    driver = special.newton(lambda y: y * y - 2.0, lambda y: 2 * y, special.bisect(lambda y: y * y - 2.0, 0.0, 2.0, 1e-3))
    of = lambda r: F.sqrt(F.col("x") / 2) * r
    return scaled.select("event_id", *r6(bisected=of(root2), by_newton=of(newton2), batch_newton=of(F.lit(driver))))


@query("minima", "select l_returnflag as grp, round(avg(l_quantity), 3) as x, round(avg(l_discount), 3) as y from lineitem group by 1")
def _(spark, d):
    """The point of least squared distance to each group's rows, by conjugate gradients on the group's moments."""
    m = frame(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b"))

    @F.pandas_udf("array<double>")
    def least(a: pd.Series, b: pd.Series) -> pd.Series:
        found = lambda u, v: special.minimize(lambda p: float((p[0] - u) ** 2 + 3 * (p[1] - v) ** 2), lambda p: [2 * (p[0] - u), 6 * (p[1] - v)], [0.0, 0.0], tolerance=1e-16)[0]
        return pd.Series([found(u, v).tolist() for u, v in zip(a, b)])

    return m.select("grp", least("a", "b").alias("p")).select("grp", F.round(F.col("p")[0], 3).alias("x"), F.round(F.col("p")[1], 3).alias("y"))


def _draw(seed: int, key: str, place: str | int) -> str:
    """SQL of ``random.uniform``."""
    return f"(list_reduce(list_transform(range(1, 14), lambda i: (strpos('0123456789abcdef', substr(md5('{seed}:' || {key} || ':' || {place}), i, 1)) - 1)::bigint), lambda a, b: a * 16 + b) / 4503599627370496.0::double)"


_HALF = 2.0**-53


@query("random_draws", f"""select event_id, round(u, 9) as uniform, round(u + {_HALF!r}, 9) as positive, floor(u * 10)::bigint as integer, round(sqrt(-2 * ln(u + {_HALF!r})) * cos(2 * pi() * w), 6) as gaussian, round(-ln((u + {_HALF!r}) * (w + {_HALF!r})), 6) as gamma_2,
    case when u < 0.2 then 0 when u < 0.5 then 1 else 2 end::int as choice from (select event_id, {_draw(5, 'event_id', 0)} as u, {_draw(5, 'event_id', 1)} as w from events)""")
def _(spark, d):
    k = samples(spark, d).select("event_id")
    own = (5, "event_id")
    return k.select("event_id", F.round(random.uniform(*own), 9).alias("uniform"), F.round(random.uniform_positive(*own), 9).alias("positive"), random.integer(*own, 10).alias("integer"), *r6(gaussian=random.gaussian(*own), gamma_2=random.gamma(*own, 2.0)), random.choose(*own, [0.2, 0.3, 0.5]).alias("choice"))


@query("random_gamma", f"select event_id, round({_draw(6, 'event_id', 0)} + {_HALF!r}, 6) as share from events")
def _(spark, d):
    """The distribution function at draws of a broken shape: the uniform draw that each inverts."""
    return samples(spark, d).select("event_id", F.round(dist.Gamma.cdf(random.gamma(6, "event_id", 0.7), 0.0, 1.0, 0.7), 6).alias("share"))


_EXP = lambda seed, place=0: f"-ln({_draw(seed, 'id', place)} + {_HALF!r})"


def _shares(parts: list[str]) -> str:
    total = " + ".join(parts)
    return ", ".join(f"round(({p}) / ({total}), 6) as p{i}" for i, p in enumerate(parts))


@query("dirichlet_sample", f"select id, {_shares([_EXP(7063), f'({_EXP(7064)}) + ({_EXP(7064, 1)})', f'({_EXP(7065)}) + ({_EXP(7065, 1)}) + ({_EXP(7065, 2)})'])} from (select unnest(range(0, 200)) as id)")
def _(spark, d):
    return priors.sample(spark, 200, (1.0, 2.0, 3.0), 7).select("id", *(F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)))


@query("dirichlet_uniform", f"select id, {_shares([_EXP(8072 + i) for i in range(3)])} from (select unnest(range(0, 200)) as id)")
def _(spark, d):
    return priors.sample_uniform(spark, 200, 3, 8).select("id", *(F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)))


_SHARE = "(select vec_id, list_transform(e, lambda x: x / list_sum(e)) as p from (select vec_id, list_transform(embedding[1:3], lambda x: exp(x::double)) as e from embeddings))"


@query("dirichlet_density", f"select vec_id, round(lgamma(6.0) - lgamma(1.0) - lgamma(2.0) - lgamma(3.0) + ln(p[2]) + 2 * ln(p[3]), 6) as log_pdf from {_SHARE}")
def _(spark, d):
    e = frame(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double"))).alias("e"))
    p = e.select("vec_id", F.transform("e", lambda x: x / (F.col("e")[0] + F.col("e")[1] + F.col("e")[2])).alias("p"))
    return p.select("vec_id", F.round(priors.log_density_column("p", (1.0, 2.0, 3.0)), 6).alias("log_pdf"))


@query("mixture_fit", "select true as is_valid, 2 as components, true as improved, true as repeats")
def _(spark, d):
    """Two components fitted to the residue counts of the nations' sequences, of which there are 25."""
    from ..functions.alphabet import DNA

    c = frame(spark, d, "msa").select("msa_id", DNA.count_vector("aln").alias("c")).select("msa_id", *(F.col("c")[i].alias(f"c{i}") for i in range(4)))
    rows = c.groupBy("msa_id").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(4))).orderBy("msa_id").collect()
    counts = np.array([[r[f"c{i}"] for i in range(4)] for r in rows])
    flat = priors.Mixture(np.array([0.5, 0.5]), np.ones((2, 4)))
    (found, value), (again, _) = priors.fit(counts, 2, steps=60), priors.fit(counts, 2, steps=60)
    return spark.createDataFrame([(found.valid(), len(found.weights), bool(value <= -flat.log_prob(counts).sum()), found.same(again, 1e-12))], "is_valid boolean, components int, improved boolean, repeats boolean")


@query("expected_tail", """with h as (select event_type as grp, floor(value / 25)::bigint as bin, count(*) as n from events where value < 500 group by all), t as (select event_type as grp, count(*) filter (value >= 100) as n_tail from events group by 1)
    select grp, bin, n, round(n_tail * (case when bin * 25 <= 100 then 1 else exp(-0.01 * (bin * 25 - 100)) end - case when bin * 25 + 25 <= 100 then 1 else exp(-0.01 * (bin * 25 - 75)) end), 6) as e from h join t using (grp)""")
def _(spark, d):
    from ..operators import statistics

    s = frame(spark, d, "samples")
    h = statistics.histogram(s, 0.0, 25.0, 20).join(statistics.tail_at(s, 0.0, 25.0, 100.0).select("grp", "n_tail"), "grp")
    return rounded(statistics.expected_tail(h, 0.01, 100.0, 0.0, 25.0), "e").select("grp", "bin", "n", "e")


@query("sorted_data", "select event_type as grp, row_number() over (partition by event_type order by value) - 1 as place, value as x from events")
def _(spark, d):
    from ..operators import statistics

    return statistics.sorted_data(frame(spark, d, "samples")).select("grp", "place", "x")


