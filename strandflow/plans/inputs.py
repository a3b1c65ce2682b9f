"""Sequence-shaped tables derived from the star schema, by SQL text that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

HEX = "'0123456789abcdef'"


def hashed(key: str, blocks: int, letters: str) -> str:
    """SQL of ``blocks`` times 32 letters from hashes of ``key``."""
    text = " || ".join(f"md5(cast({key} as string) || ':{i}')" for i in range(blocks))
    return f"translate({text}, {HEX}, '{letters}')"


def _family(key: str, group: str) -> str:
    """32 columns in eight pieces, each the group's own or one drawn for the row."""
    letters = "ACGTACGTACGTAC-N"
    piece = lambda k, i: f"substring({hashed(k, 1, letters)}, {4 * i + 1}, 4)"
    own = f"cast({group} as string) || '#'"
    return " || ".join(f"case when substring(md5(cast({key} as string) || '!'), {i + 1}, 1) < 'c' then {piece(own, i)} else {piece(key, i)} end" for i in range(8))


LENGTH = 32

SQL = {
    "seqs": f"select cast(c_custkey as bigint) as id, 's' || cast(c_custkey as string) as name, {hashed('c_custkey', 3, 'ACGTACGTACGTACGT')} as seq from customer",
    "mixed": f"select cast(c_custkey as bigint) as id, {hashed('c_custkey', 2, 'ACGT-ACGTNACGTRY')} as seq from customer",
    "msa": f"select cast(c_nationkey as bigint) as msa_id, cast(c_custkey as bigint) as idx, 's' || cast(c_custkey as string) as name, {_family('c_custkey', 'c_nationkey')} as aln from customer",
    "small_msa": f"select cast(s_nationkey as bigint) as msa_id, cast(s_suppkey as bigint) as idx, 's' || cast(s_suppkey as string) as name, {_family('s_suppkey', 's_nationkey')} as aln from supplier",
    "samples": "select event_type as grp, value as x from events",
    "vectors": "select vec_id as id, embedding as v from embeddings",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived or a plain table; only the tables that it names are opened."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    source = text.rsplit(" from ", 1)[1].strip()
    return spark.sql(text.replace(f" from {source}", " from {src}"), src=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``frame`` with its source's rows dealt to all tasks before they are derived: a small file that holds many rows
    is read by one task, and what is made of each row would be too."""
    text = SQL[name]
    source = text.rsplit(" from ", 1)[1].strip()
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns[0])
    return spark.sql(text.replace(f" from {source}", " from {src}"), src=dealt)


def oracle(*names: str, sql: str) -> str:
    """``sql`` over the named derived tables."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names) + " " + sql
