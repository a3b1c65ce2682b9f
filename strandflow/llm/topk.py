"""Exact top-k search: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Bytes of the queries that one pass over the candidates answers: the bound on what is broadcast.
QUERY_BYTES = 16 << 20
CANDIDATE_BLOCK = 8192
DIMENSION_BLOCK = 16
#: Candidates that set the first lower bounds; any set gives a valid bound.
PILOT = 4096


def _vectors(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of a batch of (id, fixed dimension list), rows of equal dimension."""
    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and float(np.abs(flat).max()) ** 2 * (len(flat) / b.num_rows) >= 2.0**53:
        raise ValueError("components beyond the exact range: dimension times the largest square must be under 2**53")
    return b.column(0).to_numpy(zero_copy_only=False), flat.reshape(b.num_rows, -1) if b.num_rows else flat.reshape(0, 0)


class Block:
    """A block of candidates in vertical layout, one contiguous row per dimension, with the norms of
    what lies beyond each block of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, width: int = DIMENSION_BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.columns = ids[order], np.ascontiguousarray(vectors[order].T)
        self.cuts = list(range(0, self.columns.shape[0], width)) + [self.columns.shape[0]]
        self.rest = remaining(vectors[order], self.cuts)

    def search(self, query_id: int, q: np.ndarray, q_rest: list[float], k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that may be among the k best, given that k score ``floor`` or more elsewhere.

        After each block of dimensions a candidate can gain at most the product of the remaining
        norms (Cauchy-Schwarz); those whose bound is under the k-th best lower bound go, and the
        survivors are compacted. Sums are of integers below 2**53, hence exact.
        """
        alive = np.flatnonzero(self.ids != query_id)
        score = np.zeros(len(alive))
        whole = True
        for n, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            part = self.columns[lo:hi]
            score = score + (q[lo:hi] @ part)[alive] if whole else score + q[lo:hi] @ part[:, alive]
            slack = q_rest[n + 1] * self.rest[n + 1][alive] * (1 + 1e-9)
            if len(alive) > k:
                floor = max(floor, np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= floor
            if not keep.all():
                alive, score, whole = alive[keep], score[keep], False
            if not len(alive):
                break
        if len(alive) > k:  # ties at the k-th place go to smaller ids
            order = np.lexsort((self.ids[alive], -score))[:k]
            alive, score = alive[order], score[order]
        return self.ids[alive], score


def remaining(vectors: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Norms of the dimensions from each cut on."""
    return [np.sqrt((vectors[:, lo:] ** 2).sum(1)) for lo in cuts]


def quantized(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v array<double>, dim): floor(scale * x); vectors that are null or hold a null or non-finite
    component are left out, as are rows without an id."""
    x = F.col(vector_col)
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(good & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"), F.size(x).alias("dim"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products.

    ``candidates`` and ``queries``: (id, v, dim). Only vectors of a query's dimension are compared; a
    query is no candidate of its own id. A query is a distinct pair of id and vector: rows that repeat it
    are answered once, two vectors of one id each for itself. Repeated rows of one id count as so many
    candidates. Empty tables give no rows. Scores are exact; vectors for which they might not be, as
    dimension times the largest squared component is 2**53 or more, are refused with an error.

    Queries are taken in blocks of QUERY_BYTES. A block is broadcast to one pass over all candidates, its
    answers are written to the shared folder and the broadcast is destroyed before the next one is made,
    so what is broadcast never grows with the table.
    """
    spark = candidates.sparkSession
    found = []
    asked = queries.dropDuplicates(["id", "v"])
    for dim, n in sorted(asked.groupBy("dim").count().collect()):  # a few numbers
        near, wanted = candidates.where(F.col("dim") == dim).select("id", "v"), asked.where(F.col("dim") == dim).select("id", "v")
        started = _lower_bounds(near, wanted, dim, k)
        blocks = -(-n * 8 * max(dim, 1) // QUERY_BYTES)
        for block in range(blocks):
            rows = started.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == block).toArrow().combine_chunks().to_batches()
            if rows:
                found.append(_block(near, rows[0], dim, k, len(found) << 40))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    every = reduce(DataFrame.unionByName, found)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cuts(dim: int) -> list[int]:
    return list(range(0, dim, DIMENSION_BLOCK)) + [dim]


def _lower_bounds(near: DataFrame, wanted: DataFrame, dim: int, k: int) -> DataFrame:
    """(id, v, floor): each query with the score of its k-th best pilot candidate, written so that it is
    worked out once, on the executors."""
    pilot = near.limit(PILOT).toArrow().combine_chunks().to_batches()
    sent = near.sparkSession.sparkContext.broadcast(_vectors(pilot[0]) if pilot else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*sent.value) if sent.value else None
        for b in batches:
            ids, vectors = _vectors(b)
            floors = np.full(len(ids), -np.inf)
            for i, rest in enumerate(zip(*remaining(vectors, _cuts(dim)))):
                if block and len(score := block.search(int(ids[i]), vectors[i], rest, k, -np.inf)[1]) >= k:
                    floors[i] = score.min()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(floors)], names=["id", "v", "floor"])

    out = materialize(wanted.mapInArrow(run, "id long, v array<double>, floor double"), "queries")
    sent.destroy()
    return out


def _block(near: DataFrame, asked: pa.RecordBatch, dim: int, k: int, base: int) -> DataFrame:
    """(query, query_id, vec_id, score): for each query of a block, numbered from ``base``, what may be among
    its k best, at most k of each CANDIDATE_BLOCK. Written, so that the broadcast can go."""
    ids, vectors = _vectors(asked)
    sent = near.sparkSession.sparkContext.broadcast((ids, vectors, asked.column(2).to_numpy(zero_copy_only=False)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, floors = sent.value
        floors, rests = floors.copy(), list(zip(*remaining(vectors, _cuts(dim))))
        held, size = [], 0

        def flush():
            block, out = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
            for i in range(len(ids)):
                got, score = block.search(int(ids[i]), vectors[i], rests[i], k, floors[i])
                if len(got):
                    out.append((np.full(len(got), base + i), np.full(len(got), ids[i]), got, score.astype(np.int64)))
                    if len(got) >= k:
                        floors[i] = max(floors[i], score.min())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["query", "query_id", "vec_id", "score"])

        for b in batches:
            if b.num_rows:
                held.append(_vectors(b))
                size += b.num_rows
                if size >= CANDIDATE_BLOCK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    out = materialize(near.mapInArrow(search, "query long, query_id long, vec_id long, score long"), "answers")
    sent.destroy()
    return out


def op10(embeddings: DataFrame) -> DataFrame:
    rows = quantized(embeddings, "vec_id", "embedding", 64.0)
    return top_k(rows, rows.where("id % 20 = 0"), 20)


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
