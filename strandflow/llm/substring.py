"""Substring dedup: suffix automata of reference shards remove passages that an earlier document has."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import _K, mix, word_hashes
from .shared import materialize, parts

#: Words of a window: a window found in a smaller document is removed.
SPAN = 13
#: Words of an anchor. A window's anchor is the one of its SPAN - ANCHOR + 1 with the least hash.
ANCHOR = 6
#: Passages of one anchor that one automaton may hold; more are compared window by window.
SHARD = 2000
#: Passages that a task combines before the exchange.
COMBINE = 2_000_000

_DECIDED = np.int64(1 << 62)
_K2, _K6 = (np.uint64(pow(int(_K), n, 1 << 64)) for n in (2, 6))


class SuffixAutomaton:
    """Of several sequences; ``matches`` gives, for each place of another one, the length of the longest
    suffix up to it that is found in one of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of ``q`` for the strings that end in ``p`` and ``c``; edges that mean those go to it."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence) -> None:
        at = 0
        for c in sequence:
            q = self.next[at].get(c)
            if q is not None:
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, q, c)
                continue
            new, p = self._state(self.length[at] + 1, 0, {}), at
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            at = new

    def matches(self, sequence) -> Iterator[int]:
        at = n = 0
        for c in sequence:
            while at and c not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if c in self.next[at]:
                at = self.next[at][c]
                n += 1
            yield n


def _passages(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, content hash, first window and number of windows of each passage: a run of windows with
    one anchor occurrence. Two hashes of whole windows, first and last, name the content."""
    w2 = h[:-1] * _K + h[1:]
    w4 = w2[:-2] * _K2 + w2[2:]
    w6 = w4[:-2] * _K2 + w2[4:]
    w12 = w6[:-6] * _K6 + w6[6:]
    windows = w12[: len(h) - SPAN + 1] * _K + h[SPAN - 1 :]
    anchors = mix(w6)
    place = sliding_window_view(anchors, SPAN - ANCHOR + 1).argmin(1) + np.arange(len(windows))
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(windows)) - 1
    content = mix(mix(windows[first]) + windows[last] * _K + (last - first).astype(np.uint64))
    return anchors[place[first]].view(np.int64), content.view(np.int64), first, last - first + 1


def _version():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version")


def _where(version: int, first, count):
    """Text (24 bits of its hash), first window (34 bits) and number of windows (4 bits) in one number."""
    return np.int64((version & 0xFFFFFF) << 38) | (first.astype(np.int64) << 4) | count


def _spans(places, version: int) -> list[tuple[int, int]]:
    own = version & 0xFFFFFF
    return [((p >> 4) & ((1 << 34) - 1), p & 15) for p in places if (p >> 38) & 0xFFFFFF == own]


def occurrences(docs: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, place) of every passage, combined within a task: of one content only
    the smallest document's row is open; the others' are decided and spread by a random anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            anchor, content, doc, place = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, content, anchor))
            anchor, content, doc, place = anchor[order], content[order], doc[order], place[order]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))
            owner = doc[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            done = doc > owner
            anchor = np.where(done, mix((content ^ doc).view(np.uint64)).view(np.int64), anchor)
            place = np.where(done, place | _DECIDED, place)
            for lo in range(0, len(doc), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in (anchor, content, doc, place)], names=["anchor", "content", "doc_id", "place"])

        for b in batches:
            for doc_id, version, text in zip(*(c.to_pylist() for c in b.columns)):
                h = word_hashes(text.encode("utf-8", "surrogatepass"))
                if len(h) >= SPAN:
                    anchor, content, first, count = _passages(h)
                    held.append((anchor, content, np.full(len(first), doc_id), _where(version, first, count)))
                    size += len(first)
            if size >= COMBINE:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", _version(), "text")
    return rows.mapInArrow(run, "anchor long, content long, doc_id long, place long")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams passages by anchor, content and document. kind 0: removed whole, as a smaller document has
    the same passage. kind 1: every place of a content in its first document, where its anchor has other
    contents too."""
    # The last row's anchor, content and owner; whether that anchor has two contents so far; if not, its open rows.
    prev, contested, pending = None, False, []

    def rows(kind, anchor, doc, place):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind), pa.int8()), pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(place, pa.int64())], names=["kind", "anchor", "doc_id", "place"])

    for b in batches:
        if not b.num_rows:
            continue
        anchor, content, doc, place = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        done = (place & _DECIDED) != 0
        if done.any():
            yield rows(0, anchor[done], doc[done], place[done] & ~_DECIDED)
            anchor, content, doc, place = anchor[~done], content[~done], doc[~done], place[~done]
            if not len(doc):
                continue
        other = np.append(prev is None or anchor[0] != prev[0], anchor[1:] != anchor[:-1])
        new = other | np.append(prev is None or content[0] != prev[1], content[1:] != content[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        owner = np.where(at >= 0, doc[at], prev[2] if prev else 0)
        own = doc == owner
        if not own.all():
            yield rows(0, anchor[~own], doc[~own], place[~own])
        group = np.cumsum(other)  # 0: the anchor that the last batch ended in
        several = np.bincount(group, weights=new & ~other, minlength=1) > 0
        several[0] |= contested
        if pending and several[0] and not other[0]:
            for p in pending:
                yield rows(1, *p)
        out = own & several[group]
        if out.any():
            yield rows(1, anchor[out], doc[out], place[out])
        contested = bool(several[group[-1]])
        if group[-1] or contested:
            pending = []
        if not contested:
            last = own & (group == group[-1])
            pending.append((anchor[last], doc[last], place[last]))
        prev = (anchor[-1], content[-1], owner[-1])


def _extract(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """The contested passages' words; of an anchor with too many, a row per window with its hash for
    an anchor and no words."""
    # Written, so that Spark knows its size: at most one anchor for every SHARD rows, broadcast if that is small.
    heavy = materialize(contested.groupBy("anchor").agg((F.count(F.lit(1)) > SHARD).alias("heavy")).where("heavy"), "heavy")
    marked = contested.join(heavy, "anchor", "left").select("anchor", "doc_id", "place", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    lists = marked.groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "place", "heavy")).alias("found"))
    both = _texts(docs).join(lists, "doc_id").select("doc_id", "version", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, version, text, found in zip(*(c.to_pylist() for c in b.columns)):
                words = text.encode("utf-8", "surrogatepass").split()
                for f in found:
                    for first, count in _spans([f["place"]], version):
                        if not f["heavy"]:
                            out.append((f["anchor"], doc_id, f["place"], b" ".join(words[first : first + count + SPAN - 1])))
                            continue
                        for i in range(first, first + count):
                            window = word_hashes(b" ".join(words[i : i + SPAN]))
                            key = np.uint64(0)
                            for x in mix(window + np.arange(SPAN, dtype=np.uint64) * _K):
                                key = mix(np.atleast_1d(key + x))[0]
                            out.append((int(key.view(np.int64)), doc_id, int(_where(version, np.asarray(i), 1)), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "doc_id", "place", "words"])

    return both.mapInArrow(run, "anchor long, doc_id long, place long, words binary")


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams a shard's passages by document: each is held against the automaton of all smaller
    documents' passages, then joins it. Windows whose match reaches SPAN words go."""
    shard, doc, automaton, waiting = None, None, None, {}  # waiting: the document's passages and where they match
    for b in batches:
        found = []
        for anchor, doc_id, place, text in zip(*(c.to_pylist() for c in b.columns)):
            if anchor != shard:
                shard, doc, automaton, waiting = anchor, doc_id, None, {}
            elif doc_id != doc:
                automaton = automaton or SuffixAutomaton()
                for w in waiting:
                    automaton.add(w.split(b" "))
                doc, waiting = doc_id, {}
            if text not in waiting:
                waiting[text] = [i - SPAN + 1 for i, n in enumerate(automaton.matches(text.split(b" "))) if n >= SPAN] if automaton else []
            base = place - (place & 15)
            found += [(doc_id, base + (i << 4) + 1) for i in waiting[text]]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["doc_id", "place"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _version(), "text")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, places) of the windows to remove from each document that loses any.

    Every window has an anchor that depends on its words alone, so equal windows of two documents lie
    in passages of one anchor. Passages with equal content are settled by the smallest document; where
    an anchor has several contents, every place of each in its first document goes to the anchor's shard, whose
    automaton is built of the passages of ever larger documents. The corpus is its own reference and has
    no size bound, so shards travel by an exchange on the anchor and not by a broadcast.
    """
    n = parts(docs.sparkSession)
    ordered = occurrences(docs).repartition(n, "anchor").sortWithinPartitions("anchor", "content", "doc_id")
    settled = materialize(ordered.mapInArrow(_settle, "kind tinyint, anchor long, doc_id long, place long"), "settled")
    found = materialize(_extract(docs, settled.where("kind = 1").select("anchor", "doc_id", "place")), "passages")
    shards = found.where("words is not null").repartition(n, "anchor").sortWithinPartitions("anchor", "doc_id", "place")
    matched = shards.mapInArrow(_match, "doc_id long, place long")
    single = found.where("words is null")
    owner = single.groupBy("anchor").agg(F.min("doc_id").alias("owner"))
    repeated = single.join(owner, "anchor").where("doc_id > owner").select("doc_id", "place")
    every = settled.where("kind = 0").select("doc_id", "place").unionByName(matched).unionByName(repeated)
    return every.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_removed and kept_text: the words left, joined by one space.

    Null and empty texts have no words. Rows without a doc_id keep all words; rows that share a doc_id do
    not remove each other's words. A document under SPAN words keeps them all. Texts are read whole,
    whatever their length; other columns are not read; empty tables give no rows.
    """
    both = _texts(docs).join(removals(docs), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for version, text, places in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                cut.append(_without(words, [(first, first + count + SPAN - 1) for first, count in _spans(places or (), version)]))
            yield _kept(b.column(0), cut)

    return both.mapInArrow(run, _KEPT)


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _without(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """Number of words, how many lie in ``spans`` (first, end), and the others joined by one space."""
    gone = np.zeros(len(words) + 1, np.int64)
    for first, end in spans:
        gone[first] += 1
        gone[end] -= 1
    left = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g] if spans else words
    return len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")


def _kept(ids: pa.Array, cut: list[tuple[int, int, str]]) -> pa.RecordBatch:
    total, removed, kept = zip(*cut) if cut else ((), (), ())
    return pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


#: Words of one broadcast automaton, and of all: a reference beyond that is refused.
SHARD_WORDS, REFERENCE_WORDS = 250_000, 2_000_000


def remove_known(docs: DataFrame, reference: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` (doc_id, text) as ``remove_repeats`` gives them, without every maximal run of ``span`` words or
    more that a text of ``reference`` (text) holds.

    For a reference whose size is known to be small, as a set of benchmark passages: its distinct texts are
    counted, and over REFERENCE_WORDS words are refused. They are broadcast in shards of SHARD_WORDS; each
    Python worker builds a shard's suffix automaton once and streams its documents past it for their
    matching statistics. No shuffle of ``docs``. Null and empty texts of either side match nothing.
    """
    texts = reference.where("text is not null").select("text").distinct()
    n = texts.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"a reference of {n} words is over the {REFERENCE_WORDS} that may be broadcast; use remove_repeats on a table with both")
    shards, size = [[]], 0
    for (t,) in texts.toLocalIterator():
        words = t.encode("utf-8", "surrogatepass").split()
        if size and size + len(words) > SHARD_WORDS:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    sent = [docs.sparkSession.sparkContext.broadcast(s) for s in shards]
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = []
            for text in b.column(1).to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = []
                for i, s in enumerate(sent if len(words) >= span else ()):
                    found += [(at - n + 1, at + 1) for at, n in enumerate(_automaton((name, i), s).matches(words)) if n >= span]
                cut.append(_without(words, found))
            yield _kept(b.column(0), cut)

    return docs.select("doc_id", "text").mapInArrow(run, _KEPT)


_automata: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(key: tuple[str, int], sent) -> SuffixAutomaton:
    """One for each Python worker and shard; those of another reference are let go."""
    if key not in _automata:
        for other in [k for k in _automata if k[0] != key[0]]:
            del _automata[other]
        _automata[key] = SuffixAutomaton()
        for words in sent.value:
            _automata[key].add(words)
    return _automata[key]


def op4(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(range(1, greatest(len(w) - 11, 1))) as i, w from w),
x as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as x from g),
h as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by x) as first from x) where doc_id > first),
c as (select distinct doc_id, unnest(range(i, i + 13)) as k from h),
a as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from w),
r as (select a.doc_id, a.k, a.word, c.k is not null as gone from a left join c on a.doc_id = c.doc_id and a.k = c.k),
s as (select doc_id, count(*)::bigint as n_words, count(*) filter (gone)::bigint as n_removed, coalesce(string_agg(word, ' ' order by k) filter (not gone), '') as kept from r group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join s using (doc_id)
"""
