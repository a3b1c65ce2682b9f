"""Queries of integer codes, Huffman, packing, lookups, blocks and random sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.alphabet import DNA
from ..operators import codes, resampling
from ..sources import binary, files, indexed, scratch
from .inputs import frame, oracle, spread

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def keys(spark, d):
    return frame(spark, d, "orders").select(F.col("o_orderkey").alias("v"))


@query("varint", "select o_orderkey as v, greatest(1, ceil(length(bin(o_orderkey)) / 7.0))::int as size, o_orderkey as decoded from orders")
def _(spark, d):
    return keys(spark, d).select("v", codecs.varint_size("v").alias("size"), codecs.varint_decode(codecs.varint_encode("v")).alias("decoded"))


@query("exp_golomb", "select v, repeat('0', (length(bin(v // 4 + 1)) - 1)::int) || bin(v // 4 + 1) || lpad(bin(v % 4), 2, '0') as bits, v as decoded from (select o_orderkey as v from orders)")
def _(spark, d):
    k = keys(spark, d).withColumn("bits", codecs.exp_golomb("v", 2))
    return k.select("v", "bits", codecs.exp_golomb_decode("bits", 2).alias("decoded"))


@query("rice", "select v, repeat('1', (v // 4096)::int) || '0' || lpad(bin(v % 4096), 12, '0') as bits, v as decoded from (select o_orderkey as v from orders)")
def _(spark, d):
    k = keys(spark, d).withColumn("bits", codecs.rice("v", 12))
    return k.select("v", "bits", codecs.rice_decode("bits", 12).alias("decoded"))


@query("elias_delta", "select v, repeat('0', (length(bin(length(bin(v)))) - 1)::int) || bin(length(bin(v))) || substring(bin(v), 2) as bits, v as decoded from (select o_orderkey + 1 as v from orders)")
def _(spark, d):
    k = keys(spark, d).select((F.col("v") + 1).alias("v")).withColumn("bits", codecs.elias_delta("v"))
    return k.select("v", "bits", codecs.elias_delta_decode("bits").alias("decoded"))


@query("huffman_lengths", "select 4::bigint as n_symbols, true as whole")
def _(spark, d):
    s = frame(spark, d, "seqs")
    code = codes.Huffman.build(codes.symbol_counts(s, "seq"))
    back = s.select((code.decode(code.encode("seq")) == F.col("seq")).alias("ok"))
    return back.agg(F.lit(len(code.words)).cast("bigint").alias("n_symbols"), F.min("ok").alias("whole"))


@query("huffman_code", oracle("seqs", sql="select id, array_to_string(list_transform(string_split(seq, ''), lambda c: case c when 'A' then '110' when 'C' then '111' when 'G' then '10' else '0' end), '') as bits, seq as decoded, 1.75::double as mean from seqs"))
def _(spark, d):
    """By a code for given counts: 1, 1, 2 and 4 in eight."""
    counts = {"A": 1.0, "C": 1.0, "G": 2.0, "T": 4.0}
    code = codes.Huffman.build(counts)
    bits = frame(spark, d, "seqs").select("id", code.encode("seq").alias("bits"))
    return bits.select("id", "bits", code.decode("bits").alias("decoded"), F.lit(code.mean_length(counts)).alias("mean"))


@query("packed_residues", oracle("mixed", sql="select id, ceil(length(seq) / 6.0)::bigint as words, true as whole from mixed"))
def _(spark, d):
    m = frame(spark, d, "mixed").select("id", DNA.digitize("seq").alias("c"))
    p = m.withColumns({"five": codes.packed("c"), "two": codes.packed("c", True)})
    return p.select("id", F.size("five").cast("bigint").alias("words"), ((codes.unpacked("five") == F.col("c")) & (codes.unpacked("two") == F.col("c"))).alias("whole"))


@query("ordered_map", "select l_partkey as key, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) as value from lineitem group by l_partkey")
def _(spark, d):
    e = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return codes.ordered_map(e)


@query("ordered_map_lookup", "with m as (select l_partkey as key, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) as value from lineitem group by 1) select min(key) as least_key, arg_min(value, key) as least_value, max(key) as greatest_key, arg_max(value, key) as greatest_value, (select value from m where key = 7) as seventh from m")
def _(spark, d):
    e = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    m = codes.ordered_map(e)
    return codes.ends(m).crossJoin(codes.found(m, 7).select(F.col("value").alias("seventh")))  # one row each


@query("ordered_map_listing", "select row_number() over (order by key) - 1 as place, key, value from (select l_partkey as key, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) as value from lineitem group by 1)")
def _(spark, d):
    e = frame(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return codes.in_order(codes.ordered_map(e))


def _one_file(spark, d):
    path = scratch.folder(spark, "indexed")
    files.fasta_text(frame(spark, d, "seqs").coalesce(1).sortWithinPartitions("id").select("name", "seq")).write.text(path)
    return path


_PLACES = "p as (select id, name, seq, length(name) + 2 as head, coalesce(sum(length(name) + 2 + 98) over (order by id rows between unbounded preceding and 1 preceding), 0)::bigint as pos from seqs)"


@query("index_from_scan", oracle("seqs", sql=f", {_PLACES} select name, pos as \"offset\", pos + head as data_offset, (pos + head + 97)::bigint as end_offset, 96::bigint as seq_len, 61::bigint as bytes_per_line, 60::bigint as residues_per_line from p").replace(") , p", "), p"))
def _(spark, d):
    return indexed.scan_fasta(spark, _one_file(spark, d)).drop("path")


def _index(spark, d):
    """An index with an alias for every tenth name, written and read again."""
    path = scratch.folder(spark, "index")
    aliases = frame(spark, d, "seqs").where("id % 10 = 0").select(F.concat(F.lit("alias"), F.col("id").cast("string")).alias("alias"), "name")
    indexed.write(indexed.build(indexed.scan_fasta(spark, _one_file(spark, d)), aliases), path)
    return indexed.read(spark, path)


_ASKED = ["s7", "alias20", "s3", "nobody"]


@query("index_lookup", oracle("seqs", sql="select a.place::bigint as place, a.asked as asked, s.name as name, length(seq)::bigint as seq_len, 0 as file_id, 'fasta' as kind from (values (0, 's7', 's7'), (1, 'alias20', 's20'), (2, 's3', 's3')) a(place, asked, name) join seqs s on s.name = a.name"))
def _(spark, d):
    index = _index(spark, d)
    found = indexed.lookup(index, _ASKED)
    return found.join(index[0].select("file_id", "kind"), "file_id").select("place", "asked", "name", "seq_len", "file_id", "kind")


@query("index_fetch", oracle("seqs", sql="select a.asked as asked, s.seq as seq from (values ('s7', 's7'), ('alias20', 's20'), ('s3', 's3')) a(asked, name) join seqs s on s.name = a.name union all select 's9:50-70', substring(seq, 50, 21) from seqs where name = 's9' union all select 's9:70-50', reverse(translate(substring(seq, 50, 21), 'ACGT', 'TGCA')) from seqs where name = 's9' union all select 's9:90-97', null"))
def _(spark, d):
    """Whole records and ranges by a seek to their place."""
    index = _index(spark, d)
    rows = indexed.fetch(spark, index, _ASKED)
    rows += [(f"s9:{a}-{b}", indexed.fetch_range(spark, index, "s9", a, b, DNA)) for a, b in ((50, 70), (70, 50), (90, 97))]
    return spark.createDataFrame(rows, "asked string, seq string")


_INDEX_ROWS = oracle("seqs", sql=f", {_PLACES} select 'key' as kind, name, '-' as target, 0::bigint as file_id, pos as \"offset\", pos + head as data_offset, 96::bigint as seq_len from p union all select 'alias', 'alias' || id, name, -1, -1, -1, -1 from seqs where id % 10 = 0 union all select 'file', 'seqs.fa', '-', 0, -1, -1, -1").replace(") , p", "), p")


def _index_file(spark, d, make):
    """One index file of all keys, made from the scan's rows, stored and read again."""
    keys = [(r.name, 0, r.offset, r.data_offset, r.seq_len) for r in indexed.scan_fasta(spark, _one_file(spark, d)).orderBy("offset").collect()]
    aliases = {"alias" + k[0][1:]: k[0] for k in keys if int(k[0][1:]) % 10 == 0}
    path = scratch.folder(spark, "binary") + "/seqs.idx"
    binary.put(spark.createDataFrame([(path, bytearray(make(keys, aliases)))], "path string, content binary"))
    return binary.parse_indexes(files.whole_files(spark, path)).drop("path").fillna("-").fillna(-1)


@query("index_file", _INDEX_ROWS)
def _(spark, d):
    return _index_file(spark, d, lambda keys, aliases: binary.index_bytes(keys, ["seqs.fa"], aliases))


@query("disk_index_file", _INDEX_ROWS)
def _(spark, d):
    return _index_file(spark, d, lambda keys, aliases: binary.disk_index_bytes(keys, [("seqs.fa", 61, 60)], aliases))


@query("disk_index_file_swapped", _INDEX_ROWS)
def _(spark, d):
    return _index_file(spark, d, lambda keys, aliases: binary.disk_index_bytes(keys, [("seqs.fa", 61, 60)], aliases, "<"))


def _database(spark, d, make, base):
    path = scratch.folder(spark, "database")
    binary.put(make(base, DNA, path, 3))
    return path


@query("sequence_database", oracle("seqs", sql="select name, 'dna' as alphabet, seq from seqs"))
def _(spark, d):
    return binary.read_databases(spark, _database(spark, d, binary.make_databases, frame(spark, d, "seqs"))).select("name", "alphabet", "seq")


@query("sequence_database_headers", oracle("seqs", sql="select 'dna' as alphabet, count(*)::bigint as sequences, sum(length(seq))::bigint as residues from seqs"))
def _(spark, d):
    h = binary.headers(files.whole_files(spark, _database(spark, d, binary.make_databases, frame(spark, d, "seqs"))))
    return h.groupBy("alphabet").agg(F.sum("sequences").alias("sequences"), F.sum("residues").alias("residues"))


def _packed(spark, d):
    return _database(spark, d, binary.make_packed, frame(spark, d, "mixed").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("AC"), F.col("id").cast("string")).alias("accession"), F.when(F.col("id") % 2 == 0, F.lit("even")).alias("description"), F.when(F.col("id") % 3 == 0, F.col("id").cast("int")).alias("taxonomy_id"), "seq"))


@query("packed_database", oracle("mixed", sql="select 'm' || id as name, 'AC' || id as accession, case when id % 2 = 0 then 'even' end as description, case when id % 3 = 0 then id::int else -1 end as taxonomy_id, 'dna' as alphabet, seq from mixed"))
def _(spark, d):
    return binary.read_databases(spark, _packed(spark, d)).fillna(-1, ["taxonomy_id"]).select("name", "accession", "description", "taxonomy_id", "alphabet", "seq")


@query("packed_database_chunk", oracle("mixed", sql="select true as known, 6::bigint as n"))
def _(spark, d):
    """Two records from the second on, of each of three databases: all of them in the table."""
    some = binary.read_databases(spark, _packed(spark, d), 1, 2).select("name", "seq")
    m = frame(spark, d, "mixed").select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"), "seq", F.lit(True).alias("known"))
    return some.join(m, ["name", "seq"], "left").agg(F.min(F.coalesce("known", F.lit(False))).alias("known"), F.count(F.lit(1)).alias("n"))


@query("packed_database_headers", oracle("mixed", sql="select 'dna' as alphabet, count(*)::bigint as sequences, sum(length(seq))::bigint as residues from mixed"))
def _(spark, d):
    h = binary.headers(files.whole_files(spark, _packed(spark, d) + "/*.dsqi"))
    return h.groupBy("alphabet").agg(F.sum("sequences").alias("sequences"), F.sum("residues").alias("residues"))


@query("name_index", oracle("seqs", sql="select name, length(seq)::bigint as seq_len, row_number() over (order by id) - 1 as ordinal, row_number() over (order by name) - 1 as sorted_ordinal from seqs"))
def _(spark, d):
    return codes.name_index(frame(spark, d, "seqs"), "id")


@query("alias_lookup", oracle("seqs", sql="select 'alias' || id as key, name, length(seq)::bigint as seq_len from seqs where id % 10 = 0"))
def _(spark, d):
    s = frame(spark, d, "seqs")
    aliases = s.where("id % 10 = 0").select(F.concat(F.lit("alias"), F.col("id").cast("string")).alias("alias"), "name")
    return codes.with_aliases(codes.name_index(s, "id"), aliases).where(F.col("key").startswith("alias")).select("key", "name", "seq_len")


@query("byte_offsets", oracle("seqs", sql="select id, (100 + ((id % 96) // 60) * 61 + (id % 96) % 60)::bigint as at from seqs"))
def _(spark, d):
    return frame(spark, d, "seqs").select("id", codes.byte_offset(F.lit(100), F.col("id") % 96 + 1, 60, 61).alias("at"))


@query("fetch_by_name", "select n as place, 's' || (5 - n) as name, 96 as length from (select unnest(range(0, 3)) as n)")
def _(spark, d):
    s = frame(spark, d, "seqs").withColumnRenamed("id", "idx")
    return files.fetch(s, ["s5", "s4", "s3"]).select("place", "name", F.length("seq").alias("length"))


@query("marked_blocks", "select l_orderkey as grp, l_linenumber, sum((l_quantity > 40)::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice rows unbounded preceding)::bigint as block from lineitem")
def _(spark, d):
    rows = frame(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), "l_linenumber", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("place"))
    return codes.blocks(rows, "place", F.col("l_quantity") > 40).select("grp", "l_linenumber", "block")


def _kept(column, sql_name):
    return oracle("seqs", sql=f"select id, {sql_name} as kept from seqs")


_SORTED = "array_to_string(list_sort(string_split(seq, '')), '')"


@query("shuffled_residues", _kept("s", _SORTED))
def _(spark, d):
    s = spread(spark, d, "seqs").select("id", resampling.shuffled("seq", "id", 3).alias("s"))
    return s.select("id", F.array_join(F.array_sort(F.filter(F.split("s", ""), lambda c: c != "")), "").alias("kept"))


@query("shuffled_doublets", _kept("s", "array_to_string(list_sort(list_transform(range(1, length(seq)), lambda i: substring(seq, i::int, 2))), '')"))
def _(spark, d):
    s = spread(spark, d, "seqs").select("id", resampling.shuffled_doublets("seq", "id", 3).alias("s"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    return s.select("id", F.array_join(F.array_sort(pairs), "").alias("kept"))


@query("markov_residues", oracle("seqs", sql="select id, length(seq)::int as n0, length(seq)::int as n1 from seqs"))
def _(spark, d):
    s = spread(spark, d, "seqs")
    return s.select("id", F.length(resampling.markov("seq", "id", 3, 0)).alias("n0"), F.length(resampling.markov("seq", "id", 3, 1)).alias("n1"))


@query("generated_sequences", "select unnest(range(0, 100))::bigint as id, 50 as n, true as known, 0::bigint as others")
def _(spark, d):
    """By given frequencies, and by frequencies that leave one residue."""
    s = resampling.generate(spark, 100, 50, DNA, 5, [0.1, 0.2, 0.3, 0.4])
    one = resampling.generate(spark, 100, 50, DNA, 6, [0.0, 0.0, 1.0, 0.0]).select("id", F.length(F.regexp_replace("seq", "G", "")).cast("bigint").alias("others"))
    return s.join(one, "id").select("id", F.length("seq").alias("n"), F.col("seq").rlike("^[ACGT]+$").alias("known"), "others")
