"""Queries that write a derived table in each file format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alphabet import DNA
from ..operators import matrices
from ..sources import files, scratch
from .inputs import frame, oracle, spread

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _number():
    """The alignment's number, as the folder of its file names it."""
    return F.regexp_extract("path", r"msa_id=(\d+)", 1).cast("bigint").alias("msa_id")


_ROWS = oracle("small_msa", sql="select msa_id, row_number() over (partition by msa_id order by idx) - 1 as idx, name, aln from small_msa")


def _written(spark, d, kind, markup=None):
    path = scratch.folder(spark, kind)
    files.write_alignments(frame(spark, d, "small_msa"), path, kind, markup)
    return f"{path}/*/*.txt"


def _alignment_query(kind: str):
    @query(f"alignments_{kind}", _ROWS)
    def _(spark, d):
        back = files.read_alignments(spark, _written(spark, d, kind), "stockholm" if kind == "pfam" else kind)
        return back.select(_number(), "idx", "name", "aln")


for _kind in ("stockholm", "pfam", "afa", "clustal", "phylip", "a2m", "psiblast", "selex"):
    _alignment_query(_kind)


@query("alignments_split", _ROWS)
def _(spark, d):
    """Of one large file that Spark's reader splits by alignment."""
    rows = frame(spark, d, "small_msa")
    named = rows.select("msa_id", F.lit("gf").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit("ID").alias("tag"), F.concat(F.lit("fam"), F.col("msa_id").cast("string")).alias("text"), F.lit(0).alias("place")).distinct()
    path = scratch.folder(spark, "families")
    files.alignment_text(rows, "stockholm", named).select("value").coalesce(1).write.text(path)
    return files.read_stockholm(spark, path).select(F.substring("id", 4, 20).cast("bigint").alias("msa_id"), "idx", "name", "aln")


def _marks(rows):
    """A line of each kind of markup for each alignment of (msa_id, idx, name, aln)."""
    whole = rows.groupBy("msa_id").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"), F.max(F.length("aln")).alias("columns"))
    none, dots = F.lit(None).cast("string"), F.rpad(F.lit(""), LENGTH, ".")
    line = lambda kind, name, tag, text, place: F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(tag).alias("tag"), text.alias("text"), F.lit(place).alias("place"))
    first = F.concat(F.lit("s"), F.col("first").cast("string"))
    every = F.array(line("gf", none, "CC", F.concat(F.lit("rows "), F.col("n").cast("string")), 0), line("gs", first, "OS", F.lit("an organism"), 1), line("gr", first, "SS", F.translate(dots, ".", "<"), 2), line("gc", none, "RF", F.translate(dots, ".", "x"), 3))
    return whole.select("msa_id", F.explode(every).alias("m")).select("msa_id", "m.*")


LENGTH = 32


@query("markup_stockholm", oracle("small_msa", sql=f"""select msa_id, u.kind as kind, u.name as name, u.tag as tag, u.text as text from (select msa_id, unnest([{{'kind': 'gf', 'name': null::varchar, 'tag': 'CC', 'text': 'rows ' || count(*)}},
    {{'kind': 'gs', 'name': 's' || min(idx), 'tag': 'OS', 'text': 'an organism'}}, {{'kind': 'gr', 'name': 's' || min(idx), 'tag': 'SS', 'text': repeat('<', {LENGTH})}}, {{'kind': 'gc', 'name': null, 'tag': 'RF', 'text': repeat('x', {LENGTH})}}]) as u from small_msa group by msa_id)"""))
def _(spark, d):
    rows = frame(spark, d, "small_msa")
    return files.read_markup(spark, _written(spark, d, "stockholm", _marks(rows)), "stockholm").select(_number(), "kind", "name", "tag", "text")


@query("inserts_a2m", oracle("small_msa", sql="select msa_id, row_number() over (partition by msa_id order by idx) - 1 as idx, name, regexp_replace(substring(aln, 1, 4), '-', '', 'g') || substring(aln, 5) as aln from small_msa"))
def _(spark, d):
    """With four insert columns: residues come back, and gaps in the inserts do not."""
    rows = frame(spark, d, "small_msa")
    rf = rows.select("msa_id").distinct().select("msa_id", F.lit("gc").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit("RF").alias("tag"), F.lit("." * 4 + "x" * (LENGTH - 4)).alias("text"), F.lit(0).alias("place"))
    back = files.read_alignments(spark, _written(spark, d, "a2m", rf), "a2m")
    width = F.length("aln") - (LENGTH - 4)
    return back.select(_number(), "idx", "name", F.concat(F.regexp_replace(F.expr(f"substring(aln, 1, length(aln) - {LENGTH - 4})"), "-", ""), F.expr(f"substring(aln, length(aln) - {LENGTH - 5})")).alias("aln")).where(width >= 0)


_SEQS = oracle("seqs", sql="select name, 'AC' || id || '.1' as accession, 'made of ' || name as description, seq from seqs")


def _records(spark, d):
    return spread(spark, d, "seqs").select("name", F.concat(F.lit("AC"), F.col("id").cast("string"), F.lit(".1")).alias("accession"), F.concat(F.lit("made of "), F.col("name")).alias("description"), "seq")


def _sequence_query(kind: str):
    def written(spark, d):
        path = scratch.folder(spark, kind)
        files.write_sequences(_records(spark, d), path, kind)
        return path + "/*.txt"

    @query(f"sequences_{kind}", _SEQS)
    def _(spark, d):
        return files.read_sequences(spark, written(spark, d), kind).select("name", "accession", "description", "seq")

    split = {"genbank": files.read_genbank, "embl": files.read_embl}[kind]

    @query(f"sequences_{kind}_split", _SEQS)
    def _(spark, d):
        return split(spark, written(spark, d)).select("name", "accession", "description", "seq")


for _kind in ("genbank", "embl"):
    _sequence_query(_kind)


_FASTA = oracle("seqs", sql="select name, 'AC' || id || '.1 made of ' || name as description, seq from seqs")


@query("sequences_fasta", _FASTA)
def _(spark, d):
    path = scratch.folder(spark, "fasta")
    files.write_sequences(_records(spark, d), path)
    return files.read_fasta(spark, path).select("name", "description", "seq")


@query("sequences_fasta_gzip", _FASTA)
def _(spark, d):
    path = scratch.folder(spark, "fasta-gz")
    files.write_sequences(_records(spark, d), path, "fasta", "gzip")
    return files.read_sequences(spark, path + "/*.gz").select("name", "description", "seq")


@query("sequences_from_memory", oracle("seqs", sql="select name, seq from seqs"))
def _(spark, d):
    """Each record from a column of file contents, its format found by its first bytes."""
    texts = files.genbank_text(spread(spark, d, "seqs"))
    held = texts.select(F.lit("memory").alias("path"), F.col("value").cast("binary").alias("content"))
    return files.parse_sequences(held).select("name", "seq")


@query("sequences_of_alignments", oracle("small_msa", sql="select name, replace(aln, '-', '') as seq from small_msa"))
def _(spark, d):
    return files.read_sequences(spark, _written(spark, d, "stockholm")).select("name", "seq")


_SHOWN = (("x.fa", ">s1\nACGT\n", "fasta", "fasta"), ("x.sto", "# STOCKHOLM 1.0\n//\n", "stockholm", "stockholm"), ("x.gbk", "\nLOCUS       x\n", "genbank", "genbank"), ("x.embl", "ID   x; SV 1\n", "embl", "embl"), ("x.aln", "CLUSTAL W\n", "clustal", None), ("x.phy", " 3 40\na  ACGT\n", "phylip", "phylip"), ("x.slx", "s1 ACGT\n", None, "selex"), ("x.txt", "nothing\n", None, None))


@query("format_detection", "select unnest([" + ", ".join(f"{{'path': '{p}{g}', 'gzip': {str(bool(g)).lower()}, 'by_content': {repr(c) if c else 'null::varchar'}, 'by_name': {repr(n) if n else 'null::varchar'}}}" for p, _, c, n in _SHOWN for g in ("", ".gz")) + "], recursive := true)")
def _(spark, d):
    import gzip

    rows = [(p + g, bytearray(gzip.compress(t.encode()) if g else t.encode())) for p, t, _, _ in _SHOWN for g in ("", ".gz")]
    return files.kinds_of(spark.createDataFrame(rows, "path string, content binary"))


@query("reformatted", _ROWS)
def _(spark, d):
    """Stockholm to Clustal; the rows are joined to their alignment again by name."""
    path = scratch.folder(spark, "reformatted")
    files.reformat(spark, _written(spark, d, "stockholm"), path, "clustal")
    back = files.read_alignments(spark, path + "/*/*.txt", "clustal").select("idx", "name", "aln")
    return back.join(frame(spark, d, "small_msa").select("msa_id", "name"), "name").select("msa_id", "idx", "name", "aln")


@query("reformatted_to_fasta", oracle("small_msa", sql="select name, replace(aln, '-', '') as seq from small_msa"))
def _(spark, d):
    path = scratch.folder(spark, "unaligned")
    files.reformat(spark, _written(spark, d, "selex"), path, "fasta", "selex")
    return files.read_fasta(spark, path).select("name", "seq")


@query("paml_rates", "select 9::bigint as m, i::bigint as i, j::bigint as j, case when i = j then 0.0 else 1.0 + (least(i, j) + greatest(i, j)) % 5 end::double as v from (select unnest(range(0, 20)) as i), (select unnest(range(0, 20)) as j)")
def _(spark, d):
    """A rate file's lower triangle, in its own order of residues, read into alphabetical order."""
    order = [sorted(matrices.PAML_ORDER).index(c) for c in matrices.PAML_ORDER]
    value = lambda a, b: 1 + (min(a, b) + max(a, b)) % 5
    text = "\n".join(" ".join(str(value(order[i], order[j])) for j in range(i)) for i in range(1, 20)) + "\n" + " ".join(["0.05"] * 20)
    return matrices.table(spark, 9, matrices.read_paml(text)[0])


@query("text_rows_to_alignment", oracle("msa", sql="select msa_id, idx, name, aln, true as fits from msa"))
def _(spark, d):
    """Rows given as text: symbols in any case, synonyms replaced."""
    from ..operators import alignment

    given = frame(spark, d, "msa").withColumn("aln", F.lower(F.translate("aln", "T", "U")))
    return alignment.from_text(given, DNA).select("msa_id", "idx", "name", "aln", DNA.valid("aln").alias("fits"))
