"""Mixing sources to target weights: Poisson replication with hash-seeded draws, then a global shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, parts

#: Weight of a source with n rows: n ** ALPHA, so that large sources shrink and small ones grow.
ALPHA = 0.5
SEED = "mix-1"


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """(source, n, rate, cdf): rows of each source, the mean number of copies of a document that brings
    it to its weight, and the distribution function of a Poisson count of that mean.

    Without ``weights`` a source weighs ``n ** alpha``; a source missing from ``weights`` gets none.
    ``total``: rows wanted in all, as many as there are if None. Null is a source of its own.
    """
    n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "name string, w double")
        n = n.join(given, n.source.eqNullSafe(given.name), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = n.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    want = F.col("all_n") if total is None else F.lit(total)
    r = n.crossJoin(sums).select("source", "n", F.when(F.col("all_w") > 0, want * F.col("w") / F.col("all_w") / F.col("n")).otherwise(0.0).alias("rate"))  # crossJoin: with one row
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = r.select("*", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    up = Window.partitionBy("source").orderBy("k")
    terms = terms.withColumn("log_k", F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(up))
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("log_k"))).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    terms = terms.withColumn("mass", mass).withColumn("c", F.sum("mass").over(up))
    lists = terms.groupBy("source", "n", "rate").agg(F.sort_array(F.collect_list("c")).alias("cdf"))
    return lists


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None, seed: str = SEED) -> DataFrame:
    """(_row struct, rate, n_copies, copy, shuffle_key): each document as often as a Poisson draw says,
    in an order that hides sources.

    The draw inverts the distribution function at a number hashed from seed and doc_id, so a rerun, a
    retried task and a repeated row all draw alike; a null doc_id draws as the empty string. Rates
    stand in one row per source, written to the shared folder: Spark then knows their size, broadcasts
    them if they are small and joins otherwise, splitting the partitions of large sources. Copies go to
    partitions by a hash of document and copy, and are sorted by it there: a permutation of the rows
    in which partition k is no more like its source than any other. Empty tables give no rows; texts are
    carried, not read, so their length does not matter; columns of any name travel inside ``_row``.
    """
    table = materialize(rates(docs, weights, alpha, total), "rates").withColumnRenamed("source", "_source")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_own"), ident.alias("_id"), uniform(ident, seed).alias("_u"))
    drawn = left.join(table, F.col("_own").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("_u"))))
    copies = drawn.where("n_copies > 0").select("_row", "_id", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", uniform(F.concat("_id", F.lit("#"), F.col("copy").cast("string")), seed))
    return keyed.drop("_id").repartition(parts(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def op1(docs: DataFrame) -> DataFrame:
    out = mix(docs.select("doc_id", "source", "text"))
    return out.select("_row.doc_id", "_row.source", "n_copies", "copy", "shuffle_key", F.sha2(F.coalesce(F.col("_row.text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def stage(docs: DataFrame) -> DataFrame:
    """The documents' own columns, a row for each copy."""
    return mix(docs).select("_row.*")


_U = "(list_reduce(list_transform(range(1, 14), lambda i: strpos('0123456789abcdef', substr(md5({0}), i, 1)) - 1), lambda a, b: a * 16 + b) / 4503599627370496.0::double)"
SQL = f"""
with n as (select source, count(*) as n, pow(count(*)::double, {ALPHA}) as w from documents group by source),
r as (select source, n, (select sum(n) from n) * w / (select sum(w) from n) / n as rate from n),
t as (select source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::int)) as k from r),
l as (select source, rate, k, sum(case when k > 0 then ln(k) else 0 end) over (partition by source order by k) as log_k from t),
c as (select source, k, sum(exp(k * ln(rate) - rate - log_k)) over (partition by source order by k) as c from l),
u as (select doc_id, source, text, {_U.format(f"'{SEED}:' || doc_id")} as u from documents),
d as (select doc_id, u.source, text, count(*)::int as n_copies from u join c on u.source is not distinct from c.source and c <= u group by all)
select doc_id, source, n_copies, copy, {_U.format(f"'{SEED}:' || doc_id || '#' || copy")} as shuffle_key, sha256(text) as text_sha256
from (select *, unnest(generate_series(1, n_copies))::int as copy from d)
"""
