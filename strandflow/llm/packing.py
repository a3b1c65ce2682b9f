"""Packing token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
#: Tails are cut into parts of at most this many tokens, so that a window has several to balance with.
MAX_PART = 256
#: Windows that are packed at once: the bound on a task's memory.
BLOCK_WINDOWS = 512
#: Characters that are encoded at once, with one text at least.
BATCH = 24_000_000

#: The tokenizer's own split of a text into pieces that are encoded alone; a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose class every Unicode version and library agrees.
PLAIN = re.compile("[\n\x20-\x7e\xa1-\xac\xae-\u024f\u2010-\u2027\u2030-\u203a]*")


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary by bytes. Its strings stand for bytes: visible Latin-1 for itself, the other
    bytes in order from code point 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in visible]
    of = {chr(x): x for x in visible} | {chr(256 + i): x for i, x in enumerate(hidden)}
    return {bytes(of[c] for c in token): rank for token, rank in vocabulary.items() if all(c in of for c in token)}


def _splits_by_pieces(described: dict) -> bool:
    """Whether a tokenizer's file describes byte pairs, whole words unmerged, split by PIECES and by nothing else."""
    split, model = described["pre_tokenizer"] or {}, described["model"]
    plain = described["normalizer"] is None and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
    return plain and model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    A run without white space, with the single space before it, is encoded independently of its
    neighbours. A batch's distinct runs are therefore encoded once, as one text in which each run's
    first token is the one that begins with a space, and every text is gathered from them. A text with
    other white space than single inner spaces and newlines is split alone; one that holds an added
    token's string or an unusual character goes to the tokenizer whole, and so do all texts if the file
    describes any other tokenizer than byte-level pairs split by PIECES.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _splits_by_pieces(json.loads(self.tokenizer.to_str()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(self.tokenizer.get_vocab(with_added_tokens=False))
        self.merge = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, text: str) -> bytes:
        return array("I", self.merge.encode_ordinary(text)).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return [self.whole(t) for t in texts]
        out, fast = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if not PLAIN.fullmatch(t) or any(a in t for a in self.added):
                out[i] = self.whole(t)
            elif not t or "  " in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n":
                out[i] = self.split(t)
            else:
                fast.append(i)
        if fast:
            lists = pc.split_pattern(pa.array([texts[i] for i in fast], pa.large_string()), " ")
            runs = lists.values.dictionary_encode()
            distinct = pa.ListArray.from_arrays(pa.array([0, len(runs.dictionary)], pa.int32()), runs.dictionary.cast(pa.string()))
            ids = self.merge.encode_to_numpy(" " + pc.binary_join(distinct, " ")[0].as_py())
            starts = np.append(np.flatnonzero(self.spaced[ids]), len(ids)).astype(np.int64) * 4
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(ids.astype("<u4"))])
            gathered = coded.take(runs.indices)
            at = np.frombuffer(gathered.buffers()[1], np.int64)[gathered.offset :]
            data, edges = memoryview(gathered.buffers()[2]), lists.offsets.to_pylist()
            for i, lo, hi in zip(fast, edges, edges[1:]):
                out[i] = self.split(texts[i].split(" ", 1)[0]) + bytes(data[at[lo + 1] : at[hi]])
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def differencing(sizes: list[int], ways: int) -> tuple[np.ndarray, np.ndarray]:
    """The set (0 to ways - 1) of each of ``sizes``, and the sets' sums, near-equal.

    The sizes in falling order give partial partitions of one item per set each, the balanced start of
    multiway differencing. The two partial partitions of largest spread are merged with opposing
    imbalances, the largest set of one with the smallest of the other, until one is left. A merge
    relabels sets, so a partial partition holds the items and, for each, its set.
    """
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable")
    values = np.asarray(sizes, np.int64)[order]
    heap = []
    for lo in range(0, len(order), ways):
        own = order[lo : lo + ways]
        sums = np.zeros(ways, np.int64)
        sums[ways - len(own) :] = values[lo : lo + ways][::-1]
        sets = np.arange(ways - 1, ways - 1 - len(own), -1)
        heap.append((-int(sums[-1] - sums[0]), lo, sums, own, sets))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tick, a, items, sets = heapq.heappop(heap)
        _, _, b, more, other = heapq.heappop(heap)
        sums = a + b[::-1]
        rising = np.argsort(sums, kind="stable")
        place = np.empty(ways, np.int64)
        place[rising] = np.arange(ways)
        sums = sums[rising]
        joined = np.concatenate([place[sets], place[ways - 1 - other]])
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), tick, sums, np.concatenate([items, more]), joined))
    _, _, sums, items, sets = heap[0]
    out = np.empty(len(order), np.int64)
    out[items] = sets
    return out, sums


def windows(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size: near-equal windows of at most ``capacity``, whose count rises as long
    as one is over it."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        sets, sums = differencing(sizes, ways)
        if sums[-1] <= capacity:
            return sets
        ways += 1


def cut(n: int, capacity: int, max_part: int) -> list[int]:
    """Full windows, then the tail in equal parts of at most ``max_part``."""
    full, tail = divmod(n, capacity)
    k = -(-tail // max_part)
    return [capacity] * full + [tail // k + (i < tail % k) for i in range(k)]


_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, max_part: int = MAX_PART, text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """A row per piece of each document: where it starts, its length and CRC, its sequence and place there.

    One narrow pass without a shuffle: a task packs its rows in blocks of ``block_windows`` windows.
    A document's full windows are sequences of their own; the tails meet in the differencing. A null
    text is empty and has the end id alone. Repeated rows and null ids are packed each for itself; empty
    tables give no rows. Texts of any length are encoded whole, one at a time beyond BATCH characters.
    Sequence ids hold the partition's number above and a counter below, so a retried task gives the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        serial = part << 32
        ready, tails, held = [], [], 0

        def flush():
            nonlocal serial, tails, held
            if tails:
                sets = windows([t[2] for t in tails], capacity)
                used, sets = np.unique(sets, return_inverse=True)
                at = [0] * len(used)
                for t, w in zip(tails, sets.tolist()):
                    ready.append((*t, serial + w, at[w]))
                    at[w] += t[2]
                serial += len(used)
            tails, held = [], 0

        def out():
            columns = list(zip(*ready))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _DDL.split(", ")])

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            groups = np.cumsum([len(t) for t in texts]) // BATCH if texts else []
            coded = (ids for _, some in groupby(zip(groups, texts), lambda x: x[0]) for ids in encode([t for _, t in some]))
            for doc_id, ids in zip(b.column(0).to_pylist(), coded):
                ids += b"\0\0\0\0"
                total, start = len(ids) // 4, 0
                for n in cut(total, capacity, max_part):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                    if n == capacity:
                        ready.append((doc_id, start, n, crc, total, serial, 0))
                        serial += 1
                    else:
                        tails.append((doc_id, start, n, crc, total))
                        held += n
                    start += n
                if held >= block_windows * capacity:
                    flush()
                if len(ready) > 20_000:
                    yield out()
        flush()
        if ready:
            yield out()

    return docs.select("doc_id", text).mapInArrow(run, _DDL)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())


def stage(docs: DataFrame) -> DataFrame:
    return pack(docs, tokenizer_path())
