"""Queries of alignment columns, pairs, clusters and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alphabet import DNA
from ..operators import alignment, clusters, markup, pairs
from .inputs import LENGTH, frame, oracle, spread

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_CELL = "cell as (select msa_id, idx, unnest(string_split(aln, '')) as x, generate_subscripts(string_split(aln, ''), 1) as col from {0})"
_COUNT = "cnt as (select msa_id, col, count(*) as n, count(*) filter (x not in ('-', '*', '~')) as n_residue, count(*) filter (x = '-') as n_gap, count(*) filter (x = '~') as n_missing from cell group by all)"


def over_cells(base: str, sql: str, more: str = "") -> str:
    return oracle(base, sql=f", {_CELL.format(base)}, {_COUNT}{more} {sql}").replace(")  ,", "),").replace(") ,", "),")


def kept(base: str, condition: str) -> str:
    return over_cells(base, f"""select m.msa_id, m.idx, coalesce(string_agg(x, '' order by col) filter (keep), '') as aln from {base} m left join (select cell.*, {condition} as keep from cell join cnt using (msa_id, col)) k on m.msa_id = k.msa_id and m.idx = k.idx group by all""")


@query("column_counts", over_cells("msa", "select msa_id, col::int as col, n_residue, n_gap, n_missing from cnt"))
def _(spark, d):
    return alignment.column_counts(frame(spark, d, "msa"), DNA)


@query("msa_composition", over_cells("msa", "select msa_id, x as symbol, count(*) as n from cell group by all"))
def _(spark, d):
    return alignment.composition(frame(spark, d, "msa"))


@query("minimal_gaps", kept("small_msa", "n_gap + n_missing < n"))
def _(spark, d):
    return alignment.minimal_gaps(frame(spark, d, "small_msa"), DNA).select("msa_id", "idx", "aln")


@query("without_gaps", kept("small_msa", "n_gap + n_missing = 0"))
def _(spark, d):
    return alignment.without_gaps(frame(spark, d, "small_msa"), DNA).select("msa_id", "idx", "aln")


@query("without_gappy_columns", kept("msa", "n_gap / n <= 0.1"))
def _(spark, d):
    return alignment.without_gappy_columns(frame(spark, d, "msa"), DNA, 0.1).select("msa_id", "idx", "aln")


@query("reference_line", over_cells("msa", "select msa_id, string_agg(case when n_residue / (n_residue + n_gap) >= 0.95 then 'x' else '.' end, '' order by col) as rf from cnt group by msa_id"))
def _(spark, d):
    return alignment.reference_line(frame(spark, d, "msa"), DNA, 0.95)


@query("fragments", oracle("msa", sql="select msa_id, idx, length(regexp_replace(aln, '^[-*~]+|[-*~]+$', '', 'g')) < 0.97 * length(aln) as is_fragment from msa"))
def _(spark, d):
    return alignment.fragments(frame(spark, d, "msa"), DNA, 0.97).select("msa_id", "idx", "is_fragment")


@query("row_subset", oracle("msa", sql="select msa_id, idx, aln from msa where idx % 3 = 0"))
def _(spark, d):
    rows = frame(spark, d, "msa")
    return alignment.subset(rows, rows.where("idx % 3 = 0")).select("msa_id", "idx", "aln")


@query("column_subset", oracle("msa", sql="select msa_id, idx, substring(aln, 2, 1) || substring(aln, 5, 2) as aln from msa"))
def _(spark, d):
    rows = frame(spark, d, "msa")
    cols = rows.select("msa_id").distinct().select("msa_id", F.explode(F.array(F.lit(2), F.lit(5), F.lit(6))).alias("col"))
    return alignment.select_columns(rows, cols).select("msa_id", "idx", "aln")


@query("extract_row", oracle("msa", sql="select msa_id, idx, name, regexp_replace(aln, '[-*~]', '', 'g') as seq from msa where idx = 17"))
def _(spark, d):
    return alignment.extract(frame(spark, d, "msa"), DNA, 17).select("msa_id", "idx", "name", "seq")


@query("msa_reverse_complement", oracle("msa", sql="select msa_id, idx, reverse(translate(aln, 'ACGT', 'TGCA')) as aln from msa"))
def _(spark, d):
    return alignment.reverse_complement(frame(spark, d, "msa"), DNA).select("msa_id", "idx", "aln")


@query("names_unique", oracle("msa", sql="select msa_id, count(*) = count(distinct name) as is_unique from msa group by msa_id"))
def _(spark, d):
    return alignment.names_unique(frame(spark, d, "msa"))


@query("msa_differences", oracle("msa", sql="select msa_id, idx, name, case when s = 'left' then aln else reverse(aln) end as aln, s as side from msa, (select unnest(['left', 'right']) as s) where aln <> reverse(aln) and idx % 2 = 0"))
def _(spark, d):
    rows = frame(spark, d, "msa")
    other = rows.withColumn("aln", F.when(F.col("idx") % 2 == 0, F.reverse("aln")).otherwise(F.col("aln")))
    return alignment.differences(rows, other)


@query("msa_guess", oracle("msa", sql="select msa_id, case when regexp_matches(arg_min(aln, idx), 'A') and regexp_matches(arg_min(aln, idx), 'C') and regexp_matches(arg_min(aln, idx), 'G') and regexp_matches(arg_min(aln, idx), 'T') then 'dna' end as kind from msa group by msa_id"))
def _(spark, d):
    return alignment.guess(frame(spark, d, "msa"))


def _columns(rows):
    """(msa_id, col, text): each column from the first row to the last."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "symbol"))), lambda z: z["symbol"]), "")
    return alignment.cells(rows).groupBy("msa_id", "col").agg(text.alias("text"))


_COLUMNS = ", t as (select msa_id, col, string_agg(x, '' order by idx) as text from cell group by all)"


@query("bootstrap_columns", over_cells("msa", "select msa_id, count(*) as columns, 0::bigint as strangers from t group by msa_id", _COLUMNS))
def _(spark, d):
    """How many columns there are, and how many that the alignment does not have."""
    rows = frame(spark, d, "msa")
    known = _columns(rows).select("msa_id", "text").distinct().withColumn("known", F.lit(1))
    drawn = _columns(alignment.resample_columns(rows, 1, True)).join(known, ["msa_id", "text"], "left")
    return drawn.groupBy("msa_id").agg(F.count(F.lit(1)).alias("columns"), F.sum(F.col("known").isNull().cast("bigint")).alias("strangers"))


@query("shuffle_columns", over_cells("msa", "select msa_id, array_to_string(list_sort(list(text)), ',') as columns from t group by msa_id", _COLUMNS))
def _(spark, d):
    """The alignment's columns, in order of text."""
    return _columns(alignment.resample_columns(frame(spark, d, "msa"), 1, False)).groupBy("msa_id").agg(F.array_join(F.sort_array(F.collect_list("text")), ",").alias("columns"))


@query("shuffle_within_columns", over_cells("msa", "select msa_id, col::int as col, string_agg(x, '' order by x) as symbols from cell group by all"))
def _(spark, d):
    """Each column's symbols, in order."""
    cells = alignment.cells(alignment.shuffle_within_columns(spread(spark, d, "msa"), 1))
    return cells.groupBy("msa_id", "col").agg(F.array_join(F.sort_array(F.collect_list("symbol")), "").alias("symbols"))


@query("row_numbers", oracle("msa", sql="select msa_id, count(*) as n, max(idx) as idx, 1.0::double as weight from msa group by msa_id"))
def _(spark, d):
    """Rows of each alignment, the place of its last name, and the weight that rows have if none are given."""
    rows = alignment.default_weights(frame(spark, d, "msa"))
    last = rows.groupBy("msa_id").agg(F.max_by("name", "idx").alias("name"), F.max("weight").alias("weight"))
    both = last.join(alignment.by_name(rows), "msa_id").join(alignment.row_count(rows), "msa_id")
    return both.select("msa_id", "n", F.element_at("rows", F.col("name")).alias("idx"), "weight")


_RF = "....xxxx~~~~" + "x" * 20


@query("flush_left_inserts", oracle("msa", sql="select msa_id, idx, regexp_replace(substring(aln, 1, 4), '-', '', 'g') || regexp_replace(substring(aln, 1, 4), '[^-]', '', 'g') || substring(aln, 5, 4) || regexp_replace(substring(aln, 9, 4), '-', '', 'g') || regexp_replace(substring(aln, 9, 4), '[^-]', '', 'g') || substring(aln, 13) as aln from msa"))
def _(spark, d):
    return frame(spark, d, "msa").select("msa_id", "idx", alignment.flush_left("aln", _RF).alias("aln"))


@query("broken_pairs", oracle("msa", sql="select msa_id, idx, case when idx % 2 = 0 then '<<....>>' when idx % 3 = 0 then '<......>' else '.<....>.' end as ss from msa"))
def _(spark, d):
    """A structure line when every column stays, when the second goes, or when the last does."""
    flags = lambda *gone: F.array(*(F.lit(i not in gone) for i in range(8)))
    keep = F.when(F.col("idx") % 2 == 0, flags()).when(F.col("idx") % 3 == 0, flags(1)).otherwise(flags(7))
    return frame(spark, d, "msa").select("msa_id", "idx", F.lit("<<....>>").alias("line"), keep.alias("keep")).select("msa_id", "idx", alignment.without_broken_pairs("line", "keep").alias("ss"))


def _markup(rows):
    """No lines yet."""
    return rows.sparkSession.createDataFrame([], markup.SCHEMA)


@query("markup_edits", oracle("small_msa", sql="""select msa_id, 'gf' as kind, null::varchar as name, 'AU' as tag, 'second' as text, 1::bigint as place from small_msa group by msa_id union all select msa_id, 'gf', null, 'CC', 'a remark', 2 from small_msa group by msa_id
    union all select msa_id, 'gs', name, 'AC', 'P' || idx, 2 + row_number() over (partition by msa_id order by name) from small_msa union all select msa_id, 'gr', name, 'SS', repeat('.', 32), 2 + count(*) over (partition by msa_id) + row_number() over (partition by msa_id order by name) from small_msa
    union all select msa_id, 'gc', null, 'RF', repeat('x', 32), 3 + 2 * count(*) from small_msa group by msa_id"""))
def _(spark, d):
    """An author set twice, a remark, and then an accession, a structure and column marks."""
    rows = frame(spark, d, "small_msa")
    m = markup.set_of_alignments(_markup(rows), rows, markup.IDENTIFIER, "family")
    m = markup.set_of_alignments(markup.set_of_alignments(m, rows, markup.AUTHOR, "first"), rows, markup.AUTHOR, "second")
    m = markup.add_to_alignments(m, rows, "CC", "a remark")
    m = markup.set_of_rows(m, rows, markup.ACCESSION, F.concat(F.lit("P"), F.col("idx").cast("string")))
    m = markup.set_of_residues(m, rows, markup.STRUCTURE, "." * LENGTH)
    return markup.add_to_columns(m, rows, "RF", "x" * LENGTH).where("tag <> 'ID'")


_PAIR = """, r as (select msa_id, idx, aln, length(regexp_replace(aln, '[-*~]', '', 'g')) as n from {0}),
p as (select a.msa_id, a.idx as i, b.idx as j, a.n as n_i, b.n as n_j,
  len(list_filter(list_zip(string_split(a.aln, ''), string_split(b.aln, '')), lambda z: z[1] not in ('-', '*', '~') and z[2] not in ('-', '*', '~'))) as n_both,
  len(list_filter(list_zip(string_split(a.aln, ''), string_split(b.aln, '')), lambda z: z[1] = z[2] and z[1] not in ('-', '*', '~'))) as n_same
  from r a join r b on a.msa_id = b.msa_id and a.idx < b.idx),
q as (select *, n_same / least(n_i, n_j)::double as pid, n_both / (n_i + n_j - n_both)::double as pm from p)"""


def over_pairs(base: str, sql: str, more: str = "") -> str:
    return oracle(base, sql=_PAIR.format(base) + more + " " + sql).replace(") , r as", "), r as")


@query("pair_identity", over_pairs("msa", "select msa_id, i, j, round(pid, 6) as pid, round(pm, 6) as match from q"))
def _(spark, d):
    p = pairs.pairs(frame(spark, d, "msa"), DNA, LENGTH)
    return p.select("msa_id", "i", "j", pairs.rounded(pairs.identity()).alias("pid"), pairs.rounded(pairs.match()).alias("match"))


@query("pair_identity_blocked", over_pairs("msa", "select msa_id, i, j, round(pid, 6) as pid from q"))
def _(spark, d):
    p = pairs.blocked_pairs(frame(spark, d, "msa"), DNA, LENGTH, 3)
    return p.select("msa_id", "i", "j", pairs.rounded(pairs.identity()).alias("pid"))


@query("evolutionary_distance", over_pairs("msa", """select msa_id, i, j, case when 1 - (1 - pid) * 4 / 3 > 1e-9 then round(-0.75 * ln(1 - (1 - pid) * 4 / 3), 6) end as jc, case when 1 - (1 - pid) * 4 / 3 > 1e-9 and n_both > 0 then round(exp(-0.75 * ln(1 - (1 - pid) * 4 / 3) * 8 / 3) * (1 - pid) * pid / n_both, 6) end as jc_var,
    case when 1 - (1 - pid) - 0.2 * (1 - pid) ** 2 > 1e-9 then round(-ln(1 - (1 - pid) - 0.2 * (1 - pid) ** 2), 6) end as kimura from q"""))
def _(spark, d):
    p = pairs.pairs(frame(spark, d, "msa"), DNA, LENGTH).withColumn("pid", pairs.identity())
    finite = lambda c, rest: F.when(rest > 1e-9, pairs.rounded(c))
    x = 1 - F.col("pid")
    jc_rest = 1 - x * 4 / 3
    return p.select("msa_id", "i", "j", finite(pairs.jukes_cantor("pid", 4), jc_rest).alias("jc"), finite(pairs.jukes_cantor_variance("pid", 4, "n_both"), F.when(F.col("n_both") > 0, jc_rest)).alias("jc_var"), finite(pairs.kimura("pid"), 1 - x - 0.2 * x * x).alias("kimura"))


@query("distance_matrix", over_pairs("small_msa", "select msa_id, i, j, round(1 - pid, 6) as d from q union all select msa_id, j, i, round(1 - pid, 6) from q union all select msa_id, idx, idx, 0.0::double from r"))
def _(spark, d):
    rows = frame(spark, d, "small_msa")
    return pairs.matrix(pairs.distances(rows, DNA, LENGTH), rows).select("msa_id", "i", "j", F.round("d", 6).alias("d"))


@query("pair_averages", over_pairs("msa", "select msa_id, count(*) as n_pairs, round(avg(pid), 6) as avg_identity, round(avg(pm), 6) as avg_match, round(avg((pid >= 0.6)::int), 6) as connectivity from q group by msa_id"))
def _(spark, d):
    a = pairs.averages(frame(spark, d, "msa"), DNA, LENGTH, 0.6)
    return a.select("msa_id", "n_pairs", *(F.round(c, 6).alias(c) for c in ("avg_identity", "avg_match", "connectivity")))


@query("pair_averages_sampled", over_pairs("msa", f"select msa_id, count(*) as n_pairs, round(avg(pid), 6) as avg_identity, round(avg(pm), 6) as avg_match, round(avg((pid >= 0.6)::int), 6) as connectivity from q where ((msa_id * 16807 + i * 48271 + j * 69621 + 42) % {pairs._PRIME} * 48271 + 11) % {pairs._PRIME} * 69621 % {pairs._PRIME} < {int(0.2 * pairs._PRIME)} group by msa_id"))
def _(spark, d):
    a = pairs.averages(frame(spark, d, "msa"), DNA, LENGTH, 0.6, sample=0.2)
    return a.select("msa_id", "n_pairs", *(F.round(c, 6).alias(c) for c in ("avg_identity", "avg_match", "connectivity")))


@query("cluster_counts", over_pairs("small_msa", "select msa_id, count(distinct root) as n from c group by msa_id", """, link as (select msa_id, i, j from q where 1 - pid <= 0.4 union all select msa_id, j, i from q where 1 - pid <= 0.4),
reach as (select msa_id, idx, idx as root from small_msa union select l.msa_id, l.j, r.root from reach r join link l on l.msa_id = r.msa_id and l.i = r.idx), c as (select msa_id, idx, min(root) as root from reach group by all)""").replace("with ", "with recursive ", 1))
def _(spark, d):
    """Of rows linked by their distances."""
    rows = frame(spark, d, "small_msa")
    return clusters.count(clusters.by_distance(rows, pairs.distances(rows, DNA, LENGTH), 0.4))


_ROOTS = """, link as (select msa_id, i, j from q where pid >= 0.7 union all select msa_id, j, i from q where pid >= 0.7),
reach as (select msa_id, idx, idx as root from small_msa union select l.msa_id, l.j, r.root from reach r join link l on l.msa_id = r.msa_id and l.i = r.idx),
c as (select msa_id, idx, min(root) as root from reach group by all)"""


@query("single_linkage", over_pairs("small_msa", "select msa_id, idx, root, (dense_rank() over (partition by msa_id order by root) - 1)::int as cluster from c", _ROOTS).replace("with ", "with recursive ", 1))
def _(spark, d):
    return clusters.numbered(clusters.by_identity(frame(spark, d, "small_msa"), DNA, LENGTH, 0.7))


@query("blosum_weights", over_pairs("small_msa", "select c.msa_id, idx, round(count(*) over (partition by c.msa_id) / k::double / count(*) over (partition by c.msa_id, root), 6) as weight from c join (select msa_id, count(distinct root) as k from c group by all) u on u.msa_id = c.msa_id", _ROOTS).replace("with ", "with recursive ", 1))
def _(spark, d):
    w = clusters.blosum_weights(frame(spark, d, "small_msa"), DNA, LENGTH, 0.7)
    return w.select("msa_id", "idx", F.round("weight", 6).alias("weight"))


@query("position_weights", over_cells("msa", """select msa_id, idx, round(w * count(*) over (partition by msa_id) / sum(w) over (partition by msa_id), 6) as weight
    from (select cell.msa_id, idx, sum(1.0::double / (r * k.n)) / count(*) as w from cell join k on cell.msa_id = k.msa_id and cell.col = k.col and cell.x = k.x join (select msa_id, col, count(*) as r from k group by all) u on u.msa_id = k.msa_id and u.col = k.col group by all)""",
    ", k as (select msa_id, col, x, count(*) as n from cell where x in ('A','C','G','T') group by all)"))
def _(spark, d):
    w = clusters.position_weights(frame(spark, d, "msa"), DNA)
    return w.select("msa_id", "idx", F.round("weight", 6).alias("weight"))


@query("identity_filter", over_pairs("small_msa", "select msa_id, idx, list_contains(kept, idx) as kept from w join (select msa_id as m, kept from f where k = n) on m = msa_id", """, near as (select msa_id, j as idx, list(i) as before from q where pid >= 0.7 group by all),
w as (select s.msa_id, s.idx, coalesce(before, []) as before, row_number() over (partition by s.msa_id order by s.idx) as r, count(*) over (partition by s.msa_id) as n from small_msa s left join near on near.msa_id = s.msa_id and near.idx = s.idx),
f as (select distinct msa_id, 0::bigint as k, n, []::bigint[] as kept from w union all select f.msa_id, k + 1, f.n, case when list_has_any(before, kept) then kept else list_append(kept, w.idx) end from f join w on w.msa_id = f.msa_id and w.r = k + 1)""").replace("with ", "with recursive ", 1))
def _(spark, d):
    return clusters.filter_by_identity(frame(spark, d, "small_msa"), DNA, 0.7)


@query("tree_weights", oracle("small_msa", sql="select msa_id, count(*) as n, count(*)::double as total, true as positive from small_msa group by msa_id"))
def _(spark, d):
    w = clusters.tree_weights(frame(spark, d, "small_msa"), DNA)
    return w.groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total"), (F.min("weight") >= 0).alias("positive"))


@query("msa_checksum", over_cells("small_msa", """select msa_id, ((h3 + (h3 << 15)) & 4294967295)::bigint as checksum from (select msa_id, xor(h2, h2 >> 11) as h3 from (select msa_id, (h + (h << 3)) & 4294967295 as h2 from (
    select msa_id, list_reduce(list_prepend(0::bigint, list((instr('ACGT-RYMKSWHBVDN*~', x) - 1)::bigint order by idx, col)), lambda h, c: xor((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295, ((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295) >> 6)) as h from cell group by msa_id)))"""))
def _(spark, d):
    return alignment.checksum(frame(spark, d, "small_msa"), DNA)


@query("msa_valid", oracle("msa", sql="select msa_id, true as is_valid from msa group by msa_id"))
def _(spark, d):
    return alignment.valid(frame(spark, d, "msa"), DNA)
