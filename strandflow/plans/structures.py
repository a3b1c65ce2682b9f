"""Queries of secondary structure, graphs and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import wuss
from ..functions.alphabet import DNA
from ..operators import graphs, tree
from ..sources import scratch
from .alignments import _PAIR
from .inputs import frame, oracle

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


#: A nested structure of n stems with a lettered pair around it, by key.
_SS = "'a' || repeat('<', ({k} % 4 + 1)::int) || '..' || repeat('>', ({k} % 4 + 1)::int) || 'A' || repeat('(.', ({k} % 3)::int) || repeat(')', ({k} % 3)::int)"


def structures(spark, d):
    text = _SS.replace("::int", "").replace("{k}", "c_custkey")
    return frame(spark, d, "customer").selectExpr("c_custkey as id", *[text.replace("repeat('<', (c_custkey % 4 + 1))", "repeat('<', cast(c_custkey % 4 + 1 as int))").replace("repeat('>', (c_custkey % 4 + 1))", "repeat('>', cast(c_custkey % 4 + 1 as int))").replace("(c_custkey % 3)", "cast(c_custkey % 3 as int)") + " as ss"])


_S = f"s as (select c_custkey as id, {_SS.format(k='c_custkey')} as ss from customer)"


@query("wuss_text", f"with {_S} select id, ss, regexp_replace(ss, '[A-Za-z]', '.', 'g') as nested, reverse(translate(ss, '<>()aA', '><)(Aa')) as turned, length(regexp_replace(ss, '[^<(a]', '', 'g'))::int as n_pairs from s")
def _(spark, d):
    return structures(spark, d).select("id", "ss", wuss.without_pseudoknots("ss").alias("nested"), wuss.reverse("ss").alias("turned"), wuss.count_pairs("ss").alias("n_pairs"))


@query("wuss_valid", f"with {_S} select id, true as valid from s")
def _(spark, d):
    return structures(spark, d).select("id", wuss.valid("ss").alias("valid"))


@query("wuss_simple", f"with {_S} select id, translate(ss, '<>aA', '()()') as simple from s")
def _(spark, d):
    return structures(spark, d).select("id", wuss.to_simple(wuss.partners("ss")).alias("simple"))


@query("wuss_rewritten", f"with {_S} select id, true as brackets, true as letters, true as whole from s")
def _(spark, d):
    """Whether each way to write the pairs is read as the same pairs."""
    p = structures(spark, d).withColumn("p", wuss.partners("ss"))
    text = p.select("id", "p", wuss.to_brackets("p").alias("b"), wuss.to_letters("p").alias("l"), wuss.to_full("p").alias("f"))
    return text.select("id", *((wuss.partners(c) == F.col("p")).alias(n) for c, n in (("b", "brackets"), ("l", "letters"), ("f", "whole"))))


# Links: orders of one customer segment whose keys are neighbours in a small ring of each customer group.

_VERTEX = "v as (select (s_nationkey)::bigint as g, s_suppkey as i from supplier)"
_LINK = "l as (select a.g, a.i, b.i as j from v a join v b on a.g = b.g and a.i < b.i and (a.i * 7 + b.i * 13) % 3 = 0)"


def vertices(spark, d):
    return frame(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("g"), F.col("s_suppkey").alias("i"))


def _dealt(v):
    """The rows of a small file dealt to all tasks, each of which makes its own pairs."""
    return v.repartition(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "i")


def links(spark, d):
    v = vertices(spark, d)
    v, w = _dealt(v), v.withColumnRenamed("i", "j")
    return v.join(w, "g").where("i < j and (i * 7 + j * 13) % 3 = 0").select("g", "i", "j")


@query("independent_set_valid", "select 0::bigint as n_inside")
def _(spark, d):
    v, e = vertices(spark, d), links(spark, d)
    chosen = graphs.independent_set(v, e).withColumn("side", F.when(F.col("chosen"), "S"))
    return graphs.inside_links(e, chosen).agg(F.count(F.lit(1)).alias("n_inside"))


@query("independent_set_maximal", f"with {_VERTEX}, {_LINK} select count(*) as n from v")
def _(spark, d):
    v, e = vertices(spark, d), links(spark, d)
    s = graphs.independent_set(v, e)
    near = graphs.both_ways(e).join(s.where("chosen").select("g", F.col("i").alias("j")), ["g", "j"], "left_semi").select("g", "i").distinct().withColumn("covered", F.lit(True))
    done = s.join(near, ["g", "i"], "left").where("chosen or covered")
    return done.agg(F.count(F.lit(1)).alias("n"))


@query("random_split_valid", "select 0::bigint as n_crossing")
def _(spark, d):
    e = links(spark, d)
    return graphs.crossing_links(e, graphs.random_split(vertices(spark, d), e, 0.3)).agg(F.count(F.lit(1)).alias("n_crossing"))


@query("intra_pairs", f"with {_VERTEX}, {_LINK} select i % 2 = 0 as side, count(*) as n from l where i % 2 = j % 2 group by all")
def _(spark, d):
    sides = vertices(spark, d).withColumn("side", F.col("i") % 2 == 0)
    return graphs.inside_links(links(spark, d), sides).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("independent_pair", "select 0::bigint as crossing, 0::bigint as open, true as larger_first")
def _(spark, d):
    """Links between the two sides, vertices that could still join one, and whether side 1 is the larger."""
    v, e = vertices(spark, d), links(spark, d)
    return _pair_checks(e, graphs.independent_pair(v, e))


def _pair_checks(e, sides):
    near = graphs.both_ways(e).join(sides.select("g", F.col("i").alias("j"), F.col("side").alias("sj")), ["g", "j"]).groupBy("g", "i").agg(F.max((F.col("sj") == 1).cast("int")).alias("by_one"), F.max((F.col("sj") == 2).cast("int")).alias("by_two"))
    left = sides.where("side = 0").join(near, ["g", "i"], "left").where("coalesce(by_one, 0) = 0 or coalesce(by_two, 0) = 0")
    sizes = sides.groupBy("g").agg(F.sum((F.col("side") == 1).cast("int")).alias("n1"), F.sum((F.col("side") == 2).cast("int")).alias("n2")).agg(F.min(F.col("n1") >= F.col("n2")).alias("larger_first"))
    crossing = graphs.crossing_links(e, sides.where("side > 0")).agg(F.count(F.lit(1)).alias("crossing"))
    return crossing.crossJoin(left.agg(F.count(F.lit(1)).alias("open"))).crossJoin(sizes).select("crossing", "open", "larger_first")  # one row each


@query("greedy_independent_set", "select 0::bigint as inside, 0::bigint as open")
def _(spark, d):
    """Links within the set, and vertices that could still join it."""
    v, e = vertices(spark, d), links(spark, d)
    s = graphs.greedy_independent_set(v, e)
    inside = graphs.inside_links(e, s.where("label = 1"), "label").agg(F.count(F.lit(1)).alias("inside"))
    near = graphs.both_ways(e).join(s.where("label = 1").select("g", F.col("i").alias("j")), ["g", "j"], "left_semi").select("g", "i").distinct()
    left = s.where("label = 0").join(near, ["g", "i"], "left_anti").agg(F.count(F.lit(1)).alias("open"))
    return inside.crossJoin(left)  # one row each


@query("greedy_bipartite_split", "select 0::bigint as crossing, 0::bigint as open, true as larger_first")
def _(spark, d):
    v, e = vertices(spark, d), links(spark, d)
    return _pair_checks(e, graphs.greedy_bipartite_split(v, e).withColumnRenamed("label", "side"))


def _relabel_rounds(n: int) -> str:
    rounds = [f"a0 as (select g, i, true as a from v), b as (select g, i, j from l union select g, j, i from l)"]  # noqa: F541
    for k in range(n):
        rounds.append(f"c{k} as (select x.g, x.i, count(*) as near, count(*) filter (x.a = y.a) as own from a{k} x join b on b.g = x.g and b.i = x.i join a{k} y on y.g = b.g and y.i = b.j group by all)")
        rounds.append(f"a{k + 1} as (select a{k}.g, a{k}.i, case when 2 * coalesce(own, 0) > coalesce(near, 0) then not a else a end as a from a{k} left join c{k} on c{k}.g = a{k}.g and c{k}.i = a{k}.i)")
    return ", ".join(rounds)


@query("relabel_split", f"with {_VERTEX}, {_LINK}, {_relabel_rounds(10)} select g, i, a::int as in_a from a10")
def _(spark, d):
    return graphs.relabel_split(vertices(spark, d), links(spark, d))


@query("bipartite_matching", f"with {_VERTEX}, {_LINK}, x as (select distinct g, i from l) select g, count(*) as n, true as linked, true as apart, true as maximal from x group by g")
def _(spark, d):
    """Whether mates are linked and no two share one, and whether every link has an end that is matched."""
    e = links(spark, d)
    m = graphs.matching(e)
    mates = m.where("mate is not null").select("g", "i", F.col("mate").alias("j"))
    strange = mates.join(e, ["g", "i", "j"], "left_anti").groupBy("g").agg(F.lit(False).alias("bad"))
    free = e.join(mates.select("g", "i"), ["g", "i"], "left_anti").join(mates.select("g", "j"), ["g", "j"], "left_anti").select("g").distinct().withColumn("free", F.lit(True))
    own = m.groupBy("g").agg(F.count(F.lit(1)).alias("n"), (F.count("mate") == F.count_distinct("mate")).alias("apart"))
    return own.join(strange, "g", "left").join(free, "g", "left").select("g", "n", F.col("bad").isNull().alias("linked"), "apart", F.col("free").isNull().alias("maximal"))


@query("matching_size", "select g, least(n, m) as n from (select s_nationkey::bigint as g, count(*) filter (s_suppkey % 2 = 0) as n, count(*) filter (s_suppkey % 2 = 1) as m from supplier group by 1) where least(n, m) > 0")
def _(spark, d):
    """Of all even vertices linked with all odd ones, as many as the fewer of the two."""
    v = vertices(spark, d)
    whole = _dealt(v.where("i % 2 = 0")).join(v.where("i % 2 = 1").withColumnRenamed("i", "j"), "g").select("g", "i", "j")
    return graphs.matching_size(graphs.matching(whole))


def _trees(spark, d, method):
    return tree.grouped_trees(frame(spark, d, "small_msa"), DNA, method)


_TREES = "select s_nationkey::bigint as tree_id, count(*) - 1 as merges, true as exact, true as rising from supplier group by 1 having count(*) > 1"


def _merge_checks(spark, d, method):
    """Whether each inner node lies at the height that its linkage gives to the leaves under its two children, and
    no node under an earlier one."""
    rows = frame(spark, d, "small_msa")
    each = tree.heights(rows, scratch.cut(tree.grouped_trees(rows, DNA, method), "nodes"), DNA, method)
    before = F.lag("height").over(Window.partitionBy("tree_id").orderBy("node"))
    each = each.withColumn("before", before)
    return each.groupBy("tree_id").agg(F.count(F.lit(1)).alias("merges"), (F.max(F.abs(F.col("height") - F.col("wanted"))) < 1e-9).alias("exact"), F.min(F.coalesce(F.col("height") >= F.col("before") - 1e-12, F.lit(True))).alias("rising"))


for _method in ("average", "weighted", "single", "complete"):
    query(f"tree_{_method}", _TREES)(lambda spark, d, m=_method: _merge_checks(spark, d, m))


@query("tree_text", "select s_nationkey::bigint as tree_id, true as is_same, true as is_valid from supplier group by 1 having count(*) > 1")
def _(spark, d):
    """Trees written as text and read again."""
    nodes = _trees(spark, d, "average")
    back = tree.read_newick(tree.newick_text(nodes))
    return tree.all_same(nodes, back, 1e-12).join(tree.all_valid(back), "tree_id")


@query("tree_paths", oracle("small_msa", sql=_PAIR.format("small_msa") + """, e as (select msa_id, i, j, 1 - pid as d from q union all select msa_id, j, i, 1 - pid from q),
    reach as (select msa_id, i, j, d from e union select r.msa_id, r.i, e.j, greatest(r.d, e.d) from reach r join e on e.msa_id = r.msa_id and e.i = r.j and e.j <> r.i)
    select msa_id as tree_id, least(i::varchar, j::varchar) as a, greatest(i::varchar, j::varchar) as b, round(2 * min(d), 6) as d from reach where i < j group by all""").replace(") , r as", "), r as").replace("with ", "with recursive ", 1))
def _(spark, d):
    """Between leaves of single linkage, twice the least distance at which a chain links them."""
    return tree.path_lengths(_trees(spark, d, "single")).select("tree_id", "a", "b", F.round("d", 6).alias("d"))


@query("tree_simulated", "select unnest(range(0, 20))::bigint as tree_id, 30::bigint as leaves, true as is_valid")
def _(spark, d):
    nodes = tree.simulated(spark, 20, 30, 4)
    return nodes.where("name is not null").groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves")).join(tree.all_valid(nodes), "tree_id")


@query("tree_sizes_agree", "select s_nationkey::bigint as tree_id, true as agree from supplier group by s_nationkey having count(*) > 1")
def _(spark, d):
    return tree.sizes_agree(_trees(spark, d, "average"))


@query("tree_leaf_depths", "select s_nationkey::bigint as tree_id, count(*) as leaves, 0.0::double as spread from supplier group by 1 having count(*) > 1")
def _(spark, d):
    """Average linkage puts all leaves at one depth."""
    depths = tree.leaf_depths(_trees(spark, d, "average"))
    return depths.groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"), (F.round(F.max("depth") - F.min("depth"), 6) + 0.0).alias("spread"))


@query("tree_leaves", oracle("small_msa", sql="select msa_id as tree_id, count(*) as leaves from small_msa group by msa_id having count(*) > 1"))
def _(spark, d):
    return _trees(spark, d, "single").where("name is not null").groupBy("tree_id").agg(F.count(F.lit(1)).alias("leaves"))
