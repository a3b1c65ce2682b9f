"""Single-linkage clusters, weights and filters of alignment rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import Alphabet
from ..sources import scratch
from . import alignment, pairs, tree


def linked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(msa_id, idx, root): connected components of edges (msa_id, i, j) within each alignment, root the
    smallest idx. A round gives each node its neighbours' smallest label and then that label's own
    label; the rounds end when none changes, and each ends with a written table."""
    both = scratch.cut(edges.select("msa_id", "i", "j").unionByName(edges.select("msa_id", F.col("j").alias("i"), F.col("i").alias("j"))), "links")
    labels = nodes.select("msa_id", "idx", F.col("idx").alias("root"))
    while True:
        near = both.join(labels.withColumnRenamed("idx", "j"), ["msa_id", "j"]).groupBy("msa_id", F.col("i").alias("idx")).agg(F.min("root").alias("near"))
        step = labels.join(near, ["msa_id", "idx"], "left").select("msa_id", "idx", "root", F.least("root", "near").alias("r"))
        jump = step.select("msa_id", F.col("idx").alias("r"), F.col("r").alias("rr"))
        after = scratch.cut(step.join(jump, ["msa_id", "r"]).select("msa_id", "idx", F.col("rr").alias("root"), (F.col("rr") != F.col("root")).alias("moved")), "labels")
        labels = after.drop("moved")
        if after.where("moved").isEmpty():
            return labels


def by_identity(rows: DataFrame, abc: Alphabet, length: int, least: float) -> DataFrame:
    """(msa_id, idx, root) of rows linked at an identity of ``least`` or more."""
    return linked_components(rows, pairs.pairs(rows, abc, length).where(pairs.identity() >= least))


def by_distance(rows: DataFrame, distances: DataFrame, most: float) -> DataFrame:
    """(msa_id, idx, root) of rows linked at a distance of ``most`` or less in (msa_id, i, j, d)."""
    return linked_components(rows, distances.where(F.col("d") <= most))


def count(clusters: DataFrame) -> DataFrame:
    """(msa_id, n): clusters of each alignment."""
    return clusters.groupBy("msa_id").agg(F.count_distinct("root").alias("n"))


def numbered(clusters: DataFrame) -> DataFrame:
    """Adds ``cluster``: 0, 1, ... in order of each cluster's first row."""
    roots = clusters.select("msa_id", "root").distinct()
    n = roots.groupBy("msa_id").agg(F.sort_array(F.collect_list("root")).alias("r"))
    return clusters.join(n, "msa_id").select("msa_id", "idx", "root", (F.array_position("r", F.col("root")) - 1).cast("int").alias("cluster"))


def blosum_weights(rows: DataFrame, abc: Alphabet, length: int, least: float) -> DataFrame:
    """(msa_id, idx, weight): one over the size of the row's cluster, scaled to a mean of 1."""
    c = by_identity(rows, abc, length, least)
    size = c.groupBy("msa_id", "root").agg(F.count(F.lit(1)).alias("size"))
    total = size.groupBy("msa_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    return c.join(size, ["msa_id", "root"]).join(total, "msa_id").select("msa_id", "idx", (F.col("n") / F.col("k") / F.col("size")).alias("weight"))


def position_weights(rows: DataFrame, abc: Alphabet, keep: DataFrame | None = None) -> DataFrame:
    """(msa_id, idx, weight): each column shares one among its kinds of canonical residue and then among
    the rows of a kind; a row's share over its residue count, scaled to a mean of 1. ``keep``: (msa_id,
    col) of the columns that count."""
    letters = abc.symbols[: abc.k]
    long = alignment.cells(rows).where(F.col("symbol").isin(*letters)).select("msa_id", "col", "symbol")
    if keep is not None:
        long = long.join(keep.select("msa_id", "col"), ["msa_id", "col"], "left_semi")
    # One row for each column, of K counts summed before the exchange, then one for each alignment: its size is the alignment's width.
    count = [F.sum((F.col("symbol") == c).cast("bigint")) for c in letters]
    columns = long.groupBy("msa_id", "col").agg(F.array(*count).alias("n"))
    kinds = F.size(F.filter("n", lambda x: x > 0))
    share = F.transform("n", lambda x: F.when(x > 0, 1 / (kinds * x)).otherwise(F.lit(0.0)))
    lists = columns.select("msa_id", "col", share.alias("s")).groupBy("msa_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "s"))).alias("shares"))
    chars = F.filter(F.split("aln", ""), lambda c: c != "")
    own = F.transform(chars, lambda c, i: F.get(F.try_element_at("shares", i + 1), F.instr(F.lit(letters), c) - 1))
    seen = F.filter("own", lambda x: x.isNotNull())
    every = rows.join(lists, "msa_id", "left").select("msa_id", "idx", own.alias("own")).select("msa_id", "idx", seen.alias("v"))
    every = every.select("msa_id", "idx", F.coalesce(F.try_divide(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), F.size("v")), F.lit(0.0)).alias("w"))
    total = every.groupBy("msa_id").agg(F.sum("w").alias("t"), F.count(F.lit(1)).alias("n"))
    return every.join(total, "msa_id").select("msa_id", "idx", F.when(F.col("t") > 0, F.col("w") * F.col("n") / F.col("t")).otherwise(1.0).alias("weight"))


def per_alignment(rows: DataFrame, make: Callable[[list[int], list[str]], list], schema: str) -> DataFrame:
    """``make`` of each alignment's idx and aln in order of idx; one alignment is held at a time."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("idx")
        out = make(f["idx"].tolist(), f["aln"].tolist())
        return pd.DataFrame([(key[0], *r) for r in out], columns=[x.split()[0] for x in schema.split(", ")])

    return tree.dealt(rows.select("msa_id", "idx", "aln"), "msa_id").groupBy("msa_id").applyInPandas(run, schema)


def identity_table(texts: list[str], abc: Alphabet) -> np.ndarray:
    """Identities of every two texts."""
    every = np.arange(len(texts))
    out = np.empty((len(texts), len(texts)))
    known = pairs.Identities(texts, abc)
    for lo in range(0, len(texts), 256):
        out[lo : lo + 256] = known.between(every[lo : lo + 256], every)
    return out


def filter_by_identity(rows: DataFrame, abc: Alphabet, most: float, prefer_coverage: bool = False) -> DataFrame:
    """(msa_id, idx, kept): in order of idx, or of falling residue count, a row is dropped if its identity
    to one kept before is ``most`` or more. The order decides, so an alignment is one group."""

    def make(idx, texts):
        pid = identity_table(texts, abc)
        count = [sum(c in abc.residues for c in t) for t in texts]
        order = sorted(range(len(idx)), key=lambda i: (-count[i], i) if prefer_coverage else i)
        kept: list[int] = []
        for i in order:
            if not kept or pid[i, kept].max() < most:
                kept.append(i)
        chosen = set(kept)
        return [(x, i in chosen) for i, x in enumerate(idx)]

    return per_alignment(rows, make, "msa_id long, idx long, kept boolean")


def tree_weights(rows: DataFrame, abc: Alphabet) -> DataFrame:
    """(msa_id, idx, weight): branch lengths of the average-linkage tree, shared downwards in proportion to
    what lies below, scaled to a mean of 1; 1 each if there is no length."""

    def make(idx, texts):
        n = len(idx)
        if n == 1:
            return [(idx[0], 1.0)]
        t = tree.linkage_of_rows(texts, abc, "average")
        below = [0.0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            below[node] = sum(below[c] + t.length[c] for c in t.children(node))
        weight = [0.0] * (2 * n - 1)
        for node in range(2 * n - 2, n - 1, -1):
            a, b = t.children(node)
            part = [below[c] + t.length[c] for c in (a, b)]
            total = sum(part)
            for c, p in zip((a, b), part):
                got = weight[node] * (p / total if total > 0 else t.size[c] / t.size[node])
                weight[c] = got + t.length[c]
        total = sum(weight[:n])
        return [(x, w * n / total if total > 0 else 1.0) for x, w in zip(idx, weight)]

    return per_alignment(rows, make, "msa_id long, idx long, weight double")
