"""Queries of residue-level functions, translation and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codon, sequence
from ..functions.alphabet import ALPHABETS, AMINO, DNA, guess_type
from ..sources import files
from .inputs import frame, oracle

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@query("seqstat", oracle("seqs", sql="select count(*) as n, sum(length(seq))::bigint as total, min(length(seq))::int as shortest, max(length(seq))::int as longest, round(avg(length(seq)), 1) as mean from seqs"))
def _(spark, d):
    return files.statistics(frame(spark, d, "seqs"))


@query("alphabet_encode", oracle("mixed", sql="select id, array_to_string(list_transform(string_split(seq, ''), lambda c: instr('ACGT-RYMKSWHBVDN*~', c) - 1), ',') as codes from mixed"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", F.array_join(DNA.digitize("seq"), ",").alias("codes"))


@query("alphabet_round_trip", oracle("mixed", sql="select id, seq as text from mixed"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", DNA.textize(DNA.digitize("seq")).alias("text"))


@query("synonyms", oracle("mixed", sql="select id, replace(replace(seq, '-', '-'), 'U', 'T') as text from mixed"))
def _(spark, d):
    rewritten = F.lower(F.translate("seq", "T-N", "U_X"))
    return frame(spark, d, "mixed").select("id", DNA.canonical(rewritten).alias("text"))


@query("valid_sequences", "select c_custkey as id, regexp_full_match(upper(c_name), '[ACGTUXI_.\\-RYMKSWHBVDN*~]*') as dna, regexp_full_match(upper(c_mktsegment), '[A-Z_.\\-*~]*') as amino from customer")
def _(spark, d):
    return frame(spark, d, "customer").select(F.col("c_custkey").alias("id"), DNA.valid("c_name").alias("dna"), AMINO.valid("c_mktsegment").alias("amino"))


@query("reverse_complement", oracle("mixed", sql="select id, reverse(translate(seq, 'ACGTRYMKHDBV', 'TGCAYRKMDHVB')) as rc from mixed"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", DNA.reverse_complement("seq").alias("rc"))


@query("residue_classes", oracle("mixed", sql="""select c.class, count(*) as n from (select case when x in ('A','C','G','T') then 'canonical' when x = '-' then 'gap' when x = 'N' then 'unknown' when x = '*' then 'nonresidue' when x = '~' then 'missing' else 'degenerate' end as class
    from (select unnest(string_split(seq, '')) as x from mixed)) c group by 1"""))
def _(spark, d):
    codes = frame(spark, d, "mixed").select(F.explode(DNA.digitize("seq")).alias("c"))
    kind = F.when(DNA.is_canonical("c"), "canonical").when(DNA.is_gap("c"), "gap").when(DNA.is_degenerate("c"), "degenerate").when(DNA.is_unknown("c"), "unknown").when(DNA.is_nonresidue("c"), "nonresidue").when(DNA.is_missing("c"), "missing")
    return codes.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("dealign", oracle("mixed", sql="select id, regexp_replace(seq, '[-*~]', '', 'g') as seq, length(regexp_replace(seq, '[-*~]', '', 'g'))::int as n from mixed"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", DNA.dealign("seq").alias("seq"), DNA.residue_count("seq").alias("n"))


@query("degenerate_to_unknown", oracle("mixed", sql="select id, regexp_replace(seq, '[RYMKSWHBVD]', 'N', 'g') as seq from mixed"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", DNA.degenerate_to_unknown("seq").alias("seq"))


@query("residue_counts", oracle("mixed", sql="""select id, round(sum(case x when 'A' then 1 when 'R' then .5 when 'N' then .25 else 0 end)::double, 6) as a, round(sum(case x when 'C' then 1 when 'Y' then .5 when 'N' then .25 else 0 end)::double, 6) as c,
    round(sum(case x when 'G' then 1 when 'R' then .5 when 'N' then .25 else 0 end)::double, 6) as g, round(sum(case x when 'T' then 1 when 'Y' then .5 when 'N' then .25 else 0 end)::double, 6) as t
    from (select id, unnest(string_split(seq, '')) as x from mixed) group by id"""))
def _(spark, d):
    v = frame(spark, d, "mixed").select("id", DNA.count_vector("seq").alias("v"))
    return v.select("id", *(F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate("acgt")))


@query("guess_alphabet", """with t as (select doc_id, upper(coalesce(text, '')) as t from documents),
    c as (select doc_id, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n, length(regexp_replace(t, '[^EFIJLOPQZ]', '', 'g')) as only_aa from t)
    select doc_id, case when n <= 10 then null when only_aa > 0 then 'amino' end as kind from c where n <= 10 or only_aa > 0""")
def _(spark, d):
    docs = frame(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return docs.select("doc_id", guess_type("t").alias("kind"))


@query("guess_sequences", oracle("seqs", sql="select id, case when length(regexp_replace(seq, '[^A]', '', 'g')) > 0 and length(regexp_replace(seq, '[^C]', '', 'g')) > 0 and length(regexp_replace(seq, '[^G]', '', 'g')) > 0 and length(regexp_replace(seq, '[^T]', '', 'g')) > 0 then 'dna' end as kind from seqs"))
def _(spark, d):
    return frame(spark, d, "seqs").select("id", guess_type("seq").alias("kind"))


@query("checksum", oracle("seqs", sql="""select id, ((h3 + (h3 << 15)) & 4294967295)::bigint as checksum from (select id, xor(h2, h2 >> 11) as h3 from (select id, (h + (h << 3)) & 4294967295 as h2 from (
    select id, list_reduce(list_prepend(0::bigint, list_transform(string_split(seq, ''), lambda c: (instr('ACGT', c) - 1)::bigint)), lambda h, c: xor((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295, ((((h + c) & 4294967295) + (((h + c) & 4294967295) << 10)) & 4294967295) >> 6)) as h from seqs)))"""))
def _(spark, d):
    return frame(spark, d, "seqs").select("id", sequence.checksum(DNA.digitize("seq")).alias("checksum"))


@query("subsequence", oracle("seqs", sql="select id, substring(seq, 11, 20) as piece from seqs"))
def _(spark, d):
    return frame(spark, d, "seqs").select("id", sequence.subsequence("seq", 10, 30).alias("piece"))


@query("fetch_range", oracle("seqs", sql="""select id, case when least(a, b) < 1 or greatest(a, b) > length(seq) then null when a <= b then substring(seq, a, b - a + 1) else reverse(translate(substring(seq, b, a - b + 1), 'ACGT', 'TGCA')) end as piece
    from (select id, seq, (id % 50)::int as a, (id * 7 % 110)::int as b from seqs)"""))
def _(spark, d):
    s = frame(spark, d, "seqs")
    return s.select("id", sequence.fetch_range(DNA, "seq", (F.col("id") % 50).cast("int"), (F.col("id") * 7 % 110).cast("int")).alias("piece"))


@query("average_score", oracle("mixed", sql="""select id, round(sum(case x when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 when 'R' then 2.5 when 'Y' then 5 when 'N' then 3.75 else 0 end)::double, 6) as average,
    round(sum(case x when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 when 'R' then (.1 * 1 + .3 * 4) / .4 when 'Y' then (.2 * 2 + .4 * 8) / .6 when 'N' then .1 + .4 + 1.2 + 3.2 else 0 end)::double, 6) as expected
    from (select id, unnest(string_split(seq, '')) as x from mixed) group by id"""))
def _(spark, d):
    scores, p = F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0))), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))
    codes = frame(spark, d, "mixed").select("id", F.explode(DNA.digitize("seq")).alias("c"))
    return codes.groupBy("id").agg(F.round(F.sum(DNA.average_score("c", scores)), 6).alias("average"), F.round(F.sum(DNA.expected_score("c", scores, p)), 6).alias("expected"))


@query("symbol_match", oracle("mixed", sql="""select id, round(sum(case when x = '-' or y = '-' then 0 when x = y and x in ('A','C','G','T') then 1 when x = y and x in ('R','Y') then .5 when x = 'N' and y = 'N' then .25
    when x || y in ('AR','GR','RA','RG','CY','TY','YC','YT') then .5 when 'N' in (x, y) and (x in ('A','C','G','T') or y in ('A','C','G','T')) then .25 when 'N' in (x, y) then .25 else 0 end)::double, 6) as match
    from (select id, unnest(string_split(seq, '')) as x, unnest(string_split(reverse(seq), '')) as y from mixed) group by id"""))
def _(spark, d):
    both = F.arrays_zip(DNA.digitize("seq").alias("x"), DNA.digitize(F.reverse("seq")).alias("y"))
    rows = frame(spark, d, "mixed").select("id", F.explode(both).alias("z"))
    return rows.groupBy("id").agg(F.round(F.sum(DNA.match("z.x", "z.y")), 6).alias("match"))


_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_AA = "substring('" + _CODE + "', ((instr('TCAG', substring({s}, i, 1)) - 1) * 16 + (instr('TCAG', substring({s}, i + 1, 1)) - 1) * 4 + instr('TCAG', substring({s}, i + 2, 1)))::int, 1)"


@query("translate", oracle("seqs", sql=f"select id, f.frame::int as frame, array_to_string(list_transform(range(f.frame + 1, length(seq) - 1, 3), lambda i: {_AA.format(s='seq')}), '') as protein from seqs, (select unnest([0, 1, 2]) as frame) f"))
def _(spark, d):
    return codon.three_frames(frame(spark, d, "seqs"), "seq").select("id", "frame", "protein")


_AA_OF = _AA.replace("{s}", "{s}").format(s="codon").replace("codon, i + 1", "codon, 2").replace("codon, i + 2", "codon, 3").replace("codon, i,", "codon, 1,")
_READINGS = ", ".join(f"('{s}', '{b}')" for s, m in zip(DNA.symbols, DNA.members) for b in m)


@query("translate_ambiguous", oracle("mixed", sql=f""", sym(s, b) as (values {_READINGS}), cod as (select id, k, substring(seq, k * 3 + 1, 3) as c from (select id, seq, unnest(range(0, length(seq) // 3))::int as k from mixed)),
    readings as (select id, k, a.b || y.b || z.b as codon from cod join sym a on a.s = c[1] join sym y on y.s = c[2] join sym z on z.s = c[3]), aas as (select id, k, count(distinct {_AA_OF}) as n, min({_AA_OF}) as aa from readings group by all)
    select id, string_agg(case when n = 1 then aa else 'X' end, '' order by cod.k) as protein from cod left join aas using (id, k) group by id""").replace(") , sym", "), sym"))
def _(spark, d):
    return frame(spark, d, "mixed").select("id", codon.translate("seq", codon.CODES[11]).alias("protein"))


@query("codon_table", f"""select 1 as code_id, a || b || c as codon, substring('{_CODE}', ((instr('TCAG', a) - 1) * 16 + (instr('TCAG', b) - 1) * 4 + instr('TCAG', c))::int, 1) as aa, a || b || c in ('ATG', 'CTG', 'TTG') as is_start
    from (select unnest(['T','C','A','G']) as a), (select unnest(['T','C','A','G']) as b), (select unnest(['T','C','A','G']) as c)""")
def _(spark, d):
    return codon.CODES[1].table(spark)


@query("open_reading_frames", oracle("seqs", sql=f""", s as (select id, seq, 'forward' as strand from seqs union all select id, reverse(translate(seq, 'ACGT', 'TGCA')), 'reverse' from seqs),
    c as (select id, strand, f as frame, k, length(seq) as n, f + 3 * k as pos, substring(seq, f + 3 * k + 1, 3) as codon from (select *, unnest(range(0, (length(seq) - f) // 3))::int as k from s, (select unnest([0, 1, 2])::int as f))),
    a as (select *, {_AA_OF} as aa from c), g as (select *, coalesce(sum((aa = '*')::int) over (partition by id, strand, frame order by k rows between unbounded preceding and 1 preceding), 0) as seg from a),
    w as (select *, min(case when codon in ('ATG', 'CTG', 'TTG') then k end) over (partition by id, strand, frame, seg) as k0 from g),
    o as (select id, strand, frame, (k0 * 3 + frame)::int as begins, 'M' || coalesce(string_agg(aa, '' order by k) filter (k > k0 and aa <> '*'), '') as protein, coalesce(max(case when aa = '*' then pos + 3 end), any_value(n))::int as ends, any_value(n)::int as n from w where k0 is not null group by id, strand, frame, seg, k0)
    select id, begins as start, ends as "end", frame, strand, protein, case when strand = 'forward' then begins else n - ends end as forward_start, case when strand = 'forward' then ends else n - begins end as forward_end from o where length(protein) >= 8""").replace(") , s as", "), s as"))
def _(spark, d):
    return codon.find_orfs(frame(spark, d, "seqs"), "id", "seq", shortest=8)


@query("windows", oracle("seqs", sql="""select id, (k * 20 + 1)::bigint as window_start, least(k * 20 + 26, length(seq))::bigint as window_end, substring(seq, (k * 20 + 1)::int, 26) as "window", least(k * 20 + 26, length(seq)) = length(seq) as complete
    from (select id, seq, unnest(range(0, greatest(1, ceil((length(seq) - 6) / 20.0))::int)) as k from seqs)"""))
def _(spark, d):
    return sequence.windows(frame(spark, d, "seqs"), "seq", 20, 6).select("id", "window_start", "window_end", "window", "complete")


@query("reverse_windows", oracle("seqs", sql="""select id, (n - a + 1)::bigint as window_start, (n - b + 1)::bigint as window_end, substring(rc, a::int, (b - a + 1)::int) as "window", b = n as complete from (
    select id, n, rc, k * 20 - least(k * 20, 6) + 1 as a, least((k + 1) * 20, n) as b from (select id, length(seq) as n, reverse(translate(seq, 'ACGT', 'TGCA')) as rc, unnest(range(0, ceil(length(seq) / 20.0)::int)) as k from seqs))"""))
def _(spark, d):
    return sequence.reverse_windows(frame(spark, d, "seqs"), "seq", DNA, 20, 6).select("id", "window_start", "window_end", "window", "complete")


@query("fasta_text", oracle("seqs", sql="select '>' || name || chr(10) || substring(seq, 1, 60) || chr(10) || substring(seq, 61) as value from seqs"))
def _(spark, d):
    return files.fasta_text(frame(spark, d, "seqs").select("name", "seq"))


@query("residue_codes", oracle("mixed", sql="select id, len(list_filter(string_split(seq, ''), lambda c: c not in ('-', '*', '~'))) as residues, 4 as gap, 15 as unknown from mixed"))
def _(spark, d):
    codes = frame(spark, d, "mixed").select("id", DNA.digitize("seq").alias("c"))
    return codes.select("id", F.size(F.filter("c", DNA.is_residue)).cast("bigint").alias("residues"), F.lit(DNA.symbols.index(DNA.gap)).alias("gap"), F.lit(DNA.symbols.index(DNA.unknown)).alias("unknown"))


@query("degenerate_scores", "select [1.0, 2.0, 4.0, 8.0, 0.0, 2.5, 5.0, 1.5, 6.0, 3.0, 4.5, 3.667, 4.667, 2.333, 4.333, 3.75, 0.0, 0.0]::double[] as average, [1.0, 2.0, 4.0, 8.0, 0.0, 3.25, 6.0, 1.667, 6.286, 3.2, 6.6, 5.286, 5.333, 2.833, 5.625, 4.9, 0.0, 0.0]::double[] as expected")
def _(spark, d):
    """The vector of all symbols' scores from those of A, C, G and T, in order of code."""
    scores, p = F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0))), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))
    short = lambda v: F.transform(v, lambda x: F.round(x, 3))
    return spark.range(1).select(short(DNA.fill_scores(scores)).alias("average"), short(DNA.fill_scores(scores, p)).alias("expected"))


@query("genetic_codes", "select unnest([1, 2, 6, 7]) as id, unnest([true, true, true, false]) as known, unnest([61, 60, 63, 0]) as any_starts, unnest(['ATG', 'ATG', 'ATG', '']) as only_start, unnest(['*', 'W', '*', '']) as tga")
def _(spark, d):
    found = [(i, codon.by_id(i)) for i in (1, 2, 6, 7)]
    return spark.createDataFrame([(i, c is not None, len(c.any_start().starts) if c else 0, ",".join(c.only_atg().starts) if c else "", c.amino["TGA"] if c else "") for i, c in found], "id int, known boolean, any_starts int, only_start string, tga string")


@query("sequence_records", oracle("seqs", sql="select id, name, seq, 'AC' || id as accession, upper(name) as description, 'table' as source, id % 2 = 0 as same, length(seq)::int + 4 as n from seqs"))
def _(spark, d):
    """Records with every field set, compared with themselves under another name for odd ids, and lengthened."""
    s = frame(spark, d, "seqs")
    full = s.select("id", sequence.record("name", "seq", accession=F.concat(F.lit("AC"), F.col("id").cast("string")), description=F.upper("name"), source=F.lit("table")).alias("a"), sequence.record(F.when(F.col("id") % 2 == 0, F.col("name")).otherwise("other"), "seq").alias("b"))
    longer = F.size(sequence.appended(DNA, DNA.digitize("a.seq"), F.lit("acgu")))
    return full.select("id", "a.*", sequence.same("a", "b").alias("same"), longer.alias("n"))


@query("text_lines", "select doc_id, case when length(t) = 0 then 0 else len(string_split(regexp_replace(t, '\\n$', ''), chr(10))) end::int as n, string_split(regexp_replace(t, '\\n$', ''), chr(10))[2] as second from (select doc_id, coalesce(text, '') as t from documents)")
def _(spark, d):
    t = frame(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return t.select("doc_id", sequence.line_count("t").cast("int").alias("n"), sequence.line_at("t", 1).alias("second"))


@query("gap_free_symbols", "select unnest(['dna', 'rna', 'amino']) as name, unnest([15, 15, 26])::int as n_residue_symbols")
def _(spark, d):
    return spark.createDataFrame([(a.name, len(a.residues)) for a in ALPHABETS.values()], "name string, n_residue_symbols int")
