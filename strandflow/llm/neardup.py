"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import LOWER, UPPER, materialize, parts

SHINGLE = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 40 bands of 4 ranks: a pair at similarity 0.75 shares no band once in about 4 million pairs.
BANDS, ROWS = 40, 4
#: Members that one copy of a hub's text serves.
SERVED = 64

_BAND = np.uint64(63)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_K, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, A-Z lower-cased; of fewer words, one
    of the whole sequence; none without words."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(h):
        return h
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        s = s * _K + h[j : len(h) - k + 1 + j]
    return np.unique(mix(s))


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """The SuperMinHash signature of distinct 64-bit hashes, as step << 32 | random.

    Every element walks its own random permutation of the ``m`` slots, offering its step plus a random
    fraction to the slot it meets; ranks of one element are thus correlated, which lowers the variance.
    All elements walk in step, so the walk stops at the first step beyond the largest rank held.
    """
    best, steps = np.full(m, np.iinfo(np.int64).max, np.int64), np.arange(1, m + 1, dtype=np.uint64) * _K
    for lo in range(0, len(elements), 8192):
        x = elements[lo : lo + 8192]
        rows = np.arange(len(x))
        perm = np.broadcast_to(np.arange(m, dtype=np.int16), (len(x), m)).copy()
        for j in range(m):
            if best.max() < (j << 32):
                break
            r = mix(x + steps[j])
            k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
            slot = perm[rows, k]
            perm[rows, k] = perm[:, j]
            np.minimum.at(best, slot, (r >> np.uint64(32)).astype(np.int64) | (j << 32))
    return best


def ranks16(signature: np.ndarray) -> np.ndarray:
    """16 bits of each rank: what is kept of a signature. Unequal ranks agree once in 65,536."""
    return (mix(signature.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def band_keys(ranks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands keys of n x m ranks; the low 6 bits are the band's number."""
    s = ranks.reshape(len(ranks), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), s.shape[:2])
    for j in range(s.shape[2]):
        key = mix(key * _K + s[:, :, j])
    return (key & ~_BAND | np.arange(bands, dtype=np.uint64)).view(np.int64)


#: What a bucket with more than CROWD classes is split by: FINE keys of FINE_ROWS ranks each, drawn once.
CROWD, FINE, FINE_ROWS = 4096, 70, 6
_FINE = np.stack([np.random.default_rng([5, i]).choice(BANDS * ROWS, FINE_ROWS, replace=False) for i in range(FINE)])
#: Rows of a class that are looked up instead of dealt out, at least; and how many such classes there may be.
HOT_ROWS, HOT_CLASSES = 1000, 100_000
#: Share of equal ranks under which a pair is not verified: 5 deviations under PERCENT at 160 ranks.
LEAST_SHARE = 0.58

_SKETCH = "doc_id long, version long, n_shingles long, s1 long, s2 long, ranks binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: size and 128-bit key of its shingle set, and its ranks (null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, s1, s2, ranks = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t)
                size.append(len(s))
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                s1.append(int(digest[0]))
                s2.append(int(digest[1]))
                ranks.append(ranks16(super_minhash(s, BANDS * ROWS)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(ranks, pa.binary())], names=["doc_id", "version", "n_shingles", "s1", "s2", "ranks"])

    return docs.select("doc_id", _version(), "text").mapInArrow(run, _SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _keyed(rows: DataFrame, keys, count: int, extra: str = "") -> DataFrame:
    """(b, rep[, c]): ``count`` keys of each row of (rep, ranks[, b, c])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            k = keys(_matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False) if extra else None)
            out = [pa.array(k.ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), count))]
            if extra:
                out.append(pa.array(np.repeat(b.column(3).to_numpy(zero_copy_only=False), count)))
            yield pa.RecordBatch.from_arrays(out, names=["b", "rep", "c"][: len(out)])

    return rows.mapInArrow(run, "b long, rep long" + extra)


def _fine_keys(ranks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    key = bucket.view(np.uint64)[:, None] + np.arange(1, FINE + 1, dtype=np.uint64)[None] * _K
    for j in range(FINE_ROWS):
        key = mix(key * _K + ranks[:, _FINE[:, j]].astype(np.uint64))
    return (key | _BAND).view(np.int64)


def _mixed(members: DataFrame, least: int = 2) -> DataFrame:
    """The (b, n) of the buckets of (b, rep, c) that hold ``least`` classes, of different components."""
    return members.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where(f"lo < hi and n >= {least}").select("b", "n")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list], np.ndarray]]:
    """Streams (b, x, y, block, rep, c, crowds, ranks, ...) by b, x and y: each group's bucket, its rows from
    ``block`` on, and which pairs of rows are candidates, as a matrix.

    Candidates are classes of different components, one of block x and one of y (any two if x = y), that
    first meet in this band, as far as bands go in which neither is in a crowded bucket (in fine buckets:
    that meet in no such band), and that have LEAST_SHARE of their ranks equal.
    """

    def close(held, band, apart):
        block, c, crowds = (np.array([h[i] for h in held], np.int64) for i in (0, 2, 3))
        m = np.frombuffer(b"".join(h[4] for h in held), "<u2").reshape(len(held), -1)
        open_ = (crowds[:, None] >> np.arange(BANDS) & 1) == 0
        least, out = LEAST_SHARE * m.shape[1], np.zeros((len(held), len(held)), bool)
        for i in range(len(held) - 1):
            other = i + 1 + np.flatnonzero((c[i + 1 :] != c[i]) & ((block[i + 1 :] != block[i]) | (not apart)))
            same = m[other] == m[i]
            near = same.sum(1) >= least
            shared = same[near].reshape(-1, BANDS, ROWS).all(2) & open_[i]
            out[i, other[near]] = shared.argmax(1) == band if band < BANDS else ~shared.any(1)
        return out

    at, held = None, []
    for b in batches:
        for row in zip(*(col.to_pylist() for col in b.columns)):
            if row[:3] != at:
                if len(held) > 1:
                    yield at[0], held, close(held, at[0] & 63, at[1] != at[2])
                at, held = row[:3], []
            held.append(row[3:])
    if len(held) > 1:
        yield at[0], held, close(held, at[0] & 63, at[1] != at[2])


_RANKED = "b long, rep long, c long, crowds long, ranks binary"


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (b, rep, c, crowds, ranks) that are one of a candidate pair, never the pairs."""
    for bucket, held, pairs in _groups(batches):
        found = [held[i] for i in np.flatnonzero(pairs.any(0) | pairs.any(1))]
        if found:
            _, rep, c, crowds, ranks = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in (rep, c, crowds)), pa.array(ranks, pa.binary())], names=["b", "rep", "c", "crowds", "ranks"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links among the candidate pairs, decided on full sets. What comes out is links, never candidates."""
    for _, held, pairs in _groups(batches):
        sets: dict[int, np.ndarray] = {}

        def full(i):
            if i not in sets:
                sets[i] = shingles(held[i][5])
            return sets[i]

        found = [(held[i][1], held[j][1]) for i, j in zip(*np.nonzero(pairs)) if linked(full(i), full(j))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (max, min)], names=["u", "v"])


#: What a task holds of one bucket at once: rows when ranks are compared, bytes of text when sets are.
HELD_ROWS, HELD_BYTES = CROWD, 32 << 20


def _in_blocks(rows: DataFrame, weight, held: int, more: list[str], run, ddl: str) -> DataFrame:
    """``run`` over the rows of each bucket b, a group of at most about ``held`` in ``weight`` at a time.

    A heavier bucket is dealt into blocks by a hash of rep, and each two blocks x <= y are a group, so that
    every pair of rows meets once whatever the bucket's size.
    """
    n = parts(rows.sparkSession)
    blocks = rows.groupBy("b").agg(F.ceil(F.sum(weight) / held).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "b").withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("b", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "c", "crowds", "ranks", *more)
    return dealt.repartition(n, "b", "x", "y").sortWithinPartitions("b", "x", "y", "rep").mapInArrow(run, ddl)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _version():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version")


def verified(texts: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (u, v) of ``pairs`` (u, v) whose full sets meet the threshold.

    v is a hub: its text is sent once for every SERVED members, so that neither a hub with many members
    nor a member with many hubs lands in one task. Rows of a hub stream with the hub first; one set is
    held at a time.
    """
    n = parts(texts.sparkSession)
    load = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("salts"))
    members = pairs.join(load, "v").select(F.col("u").alias("doc_id"), F.col("v").alias("hub"), F.pmod(F.hash("u"), F.col("salts")).alias("salt"), F.lit(1).alias("member"))
    hubs = load.select(F.col("v").alias("doc_id"), F.col("v").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    routed = members.unionByName(hubs).join(texts, "doc_id").select("hub", "salt", "member", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            u, v = [], []
            for hub, member, doc_id, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                s = shingles(text)
                if not member:
                    held = (held if at == hub else []) + [s]
                    at = hub
                elif at == hub:
                    if any(linked(s, h, percent) for h in held):
                        u.append(doc_id)
                        v.append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return routed.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Rows of equal sets form a class, named by its smallest doc_id; only classes are banded and
    compared, so a group of copies costs what one document does. In a band's bucket every class is a
    candidate of the smallest, the hub. A class is verified first against the hub it meets most often,
    then against its other hubs that are not yet in its component, and at last every two classes that
    still share a bucket from different components and have LEAST_SHARE of their ranks in common. Crowded
    buckets, as a passage in many documents makes them, are split by longer keys first; those decide the
    pairs that share crowded buckets only. So a link is missed only if chance keeps the pair's ranks apart.

    Empty texts and null texts are linked with nothing; rows without a doc_id are kept and have no
    component; rows that share a doc_id count as one node, repeated rows get equal verdicts; empty tables
    give no rows. Texts are read whole whatever their length; only doc_id and text of ``docs`` are read.
    """
    sketch = materialize(sketches(docs), "sketch")
    known = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    full = sketch.where(known)
    classes = materialize(full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("ranks").alias("ranks")), "classes")
    reps = classes.select("rep", "ranks").dropDuplicates(["rep", "ranks"])
    band = _keyed(reps, lambda ranks, _: band_keys(ranks), BANDS)
    hubs = band.groupBy("b").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("b", "hub")
    shared = materialize(band.join(hubs.hint("merge"), "b"), "shared")
    votes = materialize(shared.where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("votes")), "votes")
    involved = votes.select(F.col("rep").alias("doc_id")).unionByName(votes.select(F.col("hub").alias("doc_id"))).distinct()
    texts = materialize(docs.where("doc_id is not null").select("doc_id", "text").join(involved.hint("merge"), "doc_id", "left_semi"), "texts")

    first = votes.groupBy("rep").agg(F.max(F.struct("votes", (-F.col("hub")).alias("h"))).alias("best")).select(F.col("rep").alias("u"), (-F.col("best.h")).alias("v"))
    edges = materialize(verified(texts, first), "links")
    group = components(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes are in different components so far."""
        a = group.select(F.col("node").alias("u"), F.col("component").alias("cu"))
        b = group.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        return pairs.join(a, "u", "left").join(b, "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")

    tried = votes.select(F.col("rep").alias("u"), F.col("hub").alias("v"))
    again = materialize(apart(tried.join(first, ["u", "v"], "left_anti")), "again")
    more = materialize(verified(texts, again), "links")
    if more.limit(1).count():
        edges = edges.unionByName(more)
        group = components(edges)

    label = group.select(F.col("node").alias("rep"), F.col("component").alias("c"))
    seen = shared.select("b", "rep").join(label, "rep", "left").select("b", "rep", F.coalesce("c", "rep").alias("c"))
    left = materialize(seen.join(_mixed(seen, 3), "b"), "mixed")  # of two classes one is the hub, and the pair was verified
    crowded = left.where(F.col("n") > CROWD).select("rep", "b", "c").join(reps, "rep").select("rep", "ranks", "b", "c")
    fine = _keyed(crowded, _fine_keys, FINE, ", c long")
    fine = materialize(fine.join(_mixed(fine).select("b"), "b", "left_semi"), "fine")
    buckets = left.where(F.col("n") <= CROWD).select("b", "rep", "c").unionByName(fine)
    crowds = left.where(F.col("n") > CROWD).groupBy("rep").agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("crowds"))  # the bands in which it is in a crowded bucket
    ranked = buckets.join(reps, "rep").join(crowds, "rep", "left").select("b", "rep", "c", "ranks", F.coalesce("crowds", F.lit(0)).alias("crowds"))
    chosen = materialize(_in_blocks(ranked, F.lit(1), HELD_ROWS, [], _promising, _RANKED).dropDuplicates(["b", "rep"]), "promising")
    bodies = texts.select(F.col("doc_id").alias("rep"), "text")
    loaded = chosen.join(bodies, "rep")
    weight = F.greatest(F.octet_length("text"), F.lit(HELD_BYTES // HELD_ROWS))  # short texts are bounded in number
    rest = materialize(_in_blocks(loaded, weight, HELD_BYTES, ["text"], _alike, "u long, v long").distinct(), "links")
    if rest.limit(1).count():
        group = components(edges.unionByName(rest))

    # A class over ``hot`` rows is looked up in a table of at most HOT_CLASSES classes; only smaller ones meet their rows by an exchange.
    found = classes.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    found = materialize(found, "found")
    hot = max(HOT_ROWS, sketch.count() // HOT_CLASSES)
    large = materialize(found.where(F.col("n") > hot).select("s1", "s2", F.col("component").alias("of")), "large")
    rows = sketch.select("doc_id", "version", "n_shingles", "s1", "s2")
    looked = rows.where(known).join(large, ["s1", "s2"], "left")
    small = looked.where("of is null").drop("of").join(found.where(F.col("n") <= hot).select("s1", "s2", "component"), ["s1", "s2"])
    every = small.unionByName(looked.where("of is not null").withColumnRenamed("of", "component")).unionByName(rows.where(~known).withColumn("component", F.col("doc_id")))
    return every.select("doc_id", "version", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))).alias("kept"))


def op5(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    left = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), _version().alias("_version"))
    return left.join(gone, ["_id", "_version"], "left_anti").select("_row.*")


SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from p where 100 * k >= 75 * (na + nb - k) union all select b, a from p where 100 * k >= 75 * (na + nb - k)),
r as (select doc_id, doc_id as c from documents union select l.b, r.c from r join l on r.doc_id = l.a),
m as (select doc_id, min(c) as component_id from r group by doc_id)
select s.doc_id, len(s.s)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join m using (doc_id)
"""
