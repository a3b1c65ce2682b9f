"""Binary files of the field: name indexes and packed sequence databases, as rows of (path, content).

A file is parsed or made in one task from its bytes; Parquet tables (``indexed.write``) are the form for large
ones. Content rows are stored by ``put``, which streams one file at a time through the store's own client.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO, DNA, RNA, Alphabet
from ..operators import codes

#: Fixed values of the formats: first bytes, versions, the numbers of the alphabets.
INDEX, INDEX_VERSION = b"ZSSI", 2
DISK_INDEX = 0xD3D3C9B3
DATABASE, DATABASE_VERSION = b"ZSQD", 1
PACKED = 0xC4D3D1B1
ALPHABETS = (DNA, RNA, AMINO)
STUB = "Easel dsqdata v1 x"

KEYS = "path string, kind string, name string, target string, file_id long, offset long, data_offset long, seq_len long"
SEQUENCES = "path string, idx long, name string, accession string, description string, taxonomy_id int, alphabet string, seq string"
#: Keys that one index file may hold.
MOST_KEYS = 10_000_000


class _Reader:
    """Numbers and texts from the front of a file's bytes."""

    def __init__(self, data: bytes, order: str = "<"):
        self.data, self.at, self.order = data, 0, order

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str) -> int:
        return struct.unpack(self.order + kind, self.take(struct.calcsize(kind)))[0]

    def text(self) -> str:
        return self.take(self.number("I")).decode()

    def until_zero(self) -> str:
        end = self.data.index(b"\0", self.at)
        return self.take(end + 1 - self.at)[:-1].decode()

    def padded(self, n: int) -> str:
        return self.take(n).split(b"\0", 1)[0].decode()


def parse_index(data: bytes) -> list[tuple]:
    """(kind, name, target, file_id, offset, data_offset, seq_len) of a little-endian index: its keys, then its
    files with their number, then its aliases with the name they stand for. Version 1 has keys only."""
    r = _Reader(data)
    if r.take(4) != INDEX:
        raise ValueError("no index")
    version = r.number("I")
    if version not in (1, INDEX_VERSION):
        raise ValueError(f"unknown version {version}")
    n = r.number("Q")
    files, aliases = (r.number("I"), r.number("I")) if version > 1 else (0, 0)
    out = []
    for _ in range(n):
        name, place = r.text(), [r.number("Q") for _ in range(3)]
        out.append(("key", name, None, r.number("H") if version > 1 else 0, *place))
    out += [("file", r.text(), None, i, None, None, None) for i in range(files)]
    for _ in range(aliases):
        alias = r.text()
        out.append(("alias", alias, out[r.number("Q")][1], None, None, None, None))
    return out


def index_bytes(keys: list[tuple], files: list[str], aliases: dict[str, str]) -> bytes:
    """An index of keys (name, file_id, offset, data_offset, seq_len), files and aliases of known names."""
    if len(keys) > MOST_KEYS:
        raise ValueError(f"{len(keys)} keys: one file holds {MOST_KEYS}")
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    place = {k[0]: i for i, k in enumerate(keys)}
    out = [INDEX, struct.pack("<IQII", INDEX_VERSION, len(keys), len(files), len(aliases))]
    out += [text(name) + struct.pack("<QQQH", offset, data, n, file_id) for name, file_id, offset, data, n in keys]
    out += [text(f) for f in files]
    out += [text(a) + struct.pack("<Q", place[name]) for a, name in aliases.items()]
    return b"".join(out)


def parse_disk_index(data: bytes) -> list[tuple]:
    """Rows as ``parse_index`` gives them, of an index of records of fixed size, in either byte order."""
    magic = struct.unpack(">I", data[:4])[0]
    if magic not in (DISK_INDEX, int.from_bytes(DISK_INDEX.to_bytes(4, "little"), "big")):
        raise ValueError("no disk index")
    r = _Reader(data, ">" if magic == DISK_INDEX else "<")
    r.at = 8  # after the magic number and flags
    wide = {4: "I", 8: "Q"}[r.number("I")]
    files, primary, secondary = r.number("H"), r.number("Q"), r.number("Q")
    file_len, key_len, alias_len, file_size, key_size, alias_size = (r.number("I") for _ in range(6))
    file_at, key_at, alias_at = (r.number(wide) for _ in range(3))
    out = []
    for i in range(primary):
        r.at = key_at + key_size * i
        name, file_id, offset, data_offset = r.padded(key_len), r.number("H"), r.number(wide), r.number(wide)
        out.append(("key", name, None, file_id, offset, data_offset, max(r.number("q"), 0)))
    for i in range(files):
        r.at = file_at + file_size * i
        out.append(("file", r.padded(file_len), None, i, None, None, None))
    for i in range(secondary):
        r.at = alias_at + alias_size * i
        alias = r.padded(alias_len)
        out.append(("alias", alias, r.padded(key_len), None, None, None, None))
    return out


def disk_index_bytes(keys: list[tuple], files: list[tuple[str, int, int]], aliases: dict[str, str], order: str = ">") -> bytes:
    """A disk index of the arguments of ``index_bytes``, but for files (path, bytes per line, residues per line);
    keys and aliases are sorted, so that a reader may halve its way to one."""
    widest = lambda texts: max([len(t.encode()) for t in texts], default=0) + 1
    f, p, s = widest([x[0] for x in files]), widest([k[0] for k in keys]), widest(aliases)
    sizes = (f + 16, p + 26, s + p)
    start = 54 + 24
    places = (start, start + sizes[0] * len(files), start + sizes[0] * len(files) + sizes[1] * len(keys))
    pack = lambda kind, *v: struct.pack(order + kind, *v)
    out = [pack("I", DISK_INDEX), pack("IIHQQ", 0, 8, len(files), len(keys), len(aliases)), pack("6I", f, p, s, *sizes), pack("3Q", *places)]
    out += [path.encode().ljust(f, b"\0") + pack("4I", 1, int(bpl > 0), bpl, rpl) for path, bpl, rpl in files]
    out += [name.encode().ljust(p, b"\0") + pack("HQQq", file_id, offset, data, n) for name, file_id, offset, data, n in sorted(keys)]
    out += [a.encode().ljust(s, b"\0") + name.encode().ljust(p, b"\0") for a, name in sorted(aliases.items())]
    return b"".join(out)


def parse_indexes(files: DataFrame) -> DataFrame:
    """KEYS rows of the index files of (path, content), of either kind."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, c in zip(f["path"], f["content"]) for r in (parse_index(c) if c[:4] == INDEX else parse_disk_index(c))]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in KEYS.split(", ")])
            yield frame.astype({c: "Int64" for c in ("file_id", "offset", "data_offset", "seq_len")})

    return files.select("path", "content").mapInPandas(run, KEYS)


# Packed databases


def database_bytes(records: list[tuple[str, bytes]], abc: Alphabet) -> bytes:
    """A database of (name, codes): a header with the numbers of sequences and residues, then the records."""
    head = DATABASE + struct.pack("<IB3xQQ4x", DATABASE_VERSION, ALPHABETS.index(abc), len(records), sum(len(c) for _, c in records))
    return head + b"".join(struct.pack("<IQ", len(n.encode()), len(c)) + n.encode() + c for n, c in records)


def parse_header(data: bytes) -> tuple[str, int, int]:
    """(alphabet, sequences, residues)."""
    r = _Reader(data)
    if r.take(4) != DATABASE:
        raise ValueError("no database")
    if (version := r.number("I")) != DATABASE_VERSION:
        raise ValueError(f"unknown version {version}")
    kind = r.number("B")
    r.take(3)
    return ALPHABETS[kind].name, r.number("Q"), r.number("Q")


def parse_database(data: bytes) -> list[tuple]:
    """(idx, name, accession, description, taxonomy_id, alphabet, seq) of every record."""
    name, _, _ = parse_header(data)
    symbols = next(a for a in ALPHABETS if a.name == name).symbols
    r, out = _Reader(data), []
    r.take(32)
    while r.at < len(data):
        long_name, n = r.number("I"), r.number("Q")
        out.append((len(out), r.take(long_name).decode(), None, None, None, name, "".join(symbols[c] for c in r.take(n))))
    return out


def packed_bytes(records: list[tuple], abc: Alphabet, basename: str) -> dict[str, bytes]:
    """The four files of a packed database of (name, accession, description, taxonomy_id, codes): a text stub, an
    index of ends, the names, and 32-bit words of codes. One tag ties them together."""
    tag = zlib.crc32(basename.encode())
    names, words, ends = [], [], []
    n_names = n_words = 0
    for name, accession, description, taxonomy, seq in records:
        own = b"\0".join((x or "").encode() for x in (name, accession, description)) + b"\0" + struct.pack("<i", -1 if taxonomy is None else taxonomy)
        packed = codes.pack2(seq) if abc is not AMINO else codes.pack5(seq)
        n_names, n_words = n_names + len(own), n_words + len(packed)
        names.append(own)
        words.append(struct.pack(f"<{len(packed)}I", *packed))
        ends.append(struct.pack("<qq", n_names - 1, n_words - 1))
    longest = [max([len((r[i] or "").encode()) for r in records], default=0) for i in range(3)]
    residues = [len(r[4]) for r in records]
    head = struct.pack("<7I3Q", PACKED, tag, ALPHABETS.index(abc) + 1, 0, *longest, max(residues, default=0), len(records), sum(residues))
    data = struct.pack("<II", PACKED, tag)
    return {"": f"{STUB}{tag}\n".encode(), ".dsqi": head + b"".join(ends), ".dsqm": data + b"".join(names), ".dsqs": data + b"".join(words)}


def parse_packed(stub: bytes, index: bytes, names: bytes, words: bytes, first: int = 0, count: int | None = None) -> list[tuple]:
    """``parse_database``'s rows of a packed database: ``count`` records from ``first`` on, found by the index."""
    tag = int(stub.split()[3][1:])
    heads = [struct.unpack("<II", x[:8]) for x in (index, names, words)]
    if any(h != (PACKED, tag) for h in heads):
        raise ValueError("the files do not belong together")
    kind = struct.unpack("<I", index[8:12])[0]
    if not 1 <= kind <= 3:
        raise ValueError("unknown alphabet")
    total = struct.unpack("<Q", index[36:44])[0]
    end = lambda i: struct.unpack_from("<qq", index, 52 + 16 * i) if i >= 0 else (-1, -1)
    abc, out = ALPHABETS[kind - 1], []
    for i in range(first, total if count is None else min(total, first + count)):
        (name_end, word_end), (name_start, word_start) = end(i), end(i - 1)
        r = _Reader(names[8 + name_start + 1 : 8 + name_end + 1])
        name, accession, description = (r.until_zero() for _ in range(3))
        taxonomy = r.number("i")
        seq = codes.unpack(list(struct.unpack_from(f"<{word_end - word_start}I", words, 8 + 4 * (word_start + 1))))
        out.append((i, name, accession or None, description or None, None if taxonomy == -1 else taxonomy, abc.name, "".join(abc.symbols[c] for c in seq)))
    return out


def _sequences(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SEQUENCES.split(", ")]).astype({"taxonomy_id": "Int32"})


def make_databases(seqs: DataFrame, abc: Alphabet, folder: str, parts: int) -> DataFrame:
    """(path, content): (name, seq) as ``parts`` databases in ``folder``, each made by one task."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f"{folder}/part-{key[0]:05d}.db", database_bytes([(n, bytes(c.tolist())) for n, c in zip(f["name"], f["codes"])], abc))], columns=["path", "content"])

    rows = seqs.select("name", abc.digitize("seq").alias("codes"), F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part"))
    return rows.groupBy("part").applyInPandas(run, "path string, content binary")


def make_packed(seqs: DataFrame, abc: Alphabet, folder: str, parts: int) -> DataFrame:
    """(path, content): (name, [accession], [description], [taxonomy_id], seq) as ``parts`` packed databases of
    four files each."""
    has = lambda c, kind: F.col(c) if c in seqs.columns else F.lit(None).cast(kind).alias(c)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        base = f"{folder}/part-{key[0]:05d}"
        own = lambda x: None if x is None or x != x else x
        rows = [(n, own(a), own(d), None if own(t) is None else int(t), [int(x) for x in c]) for n, a, d, t, c in f[["name", "accession", "description", "taxonomy_id", "codes"]].itertuples(index=False)]
        return pd.DataFrame([(base + end, data) for end, data in packed_bytes(rows, abc, base).items()], columns=["path", "content"])

    rows = seqs.select("name", has("accession", "string"), has("description", "string"), has("taxonomy_id", "int"), abc.digitize("seq").alias("codes"), F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part"))
    return rows.groupBy("part").applyInPandas(run, "path string, content binary")


def put(files: DataFrame) -> None:
    """Stores each (path, content), one file at a time."""
    spark = files.sparkSession
    for r in files.toLocalIterator():
        where = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        try:
            stream.write(bytearray(r.content))
        finally:
            stream.close()


def headers(files: DataFrame) -> DataFrame:
    """(path, alphabet, sequences, residues) of the databases of (path, content), of either kind: a packed one shows
    them in its index."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, c in zip(f["path"], f["content"]):
                if c[:4] == DATABASE:
                    out.append((p, *parse_header(c)))
                elif p.endswith(".dsqi"):
                    out.append((p, ALPHABETS[struct.unpack("<I", c[8:12])[0] - 1].name, *struct.unpack("<QQ", c[36:52])))
            yield pd.DataFrame(out, columns=["path", "alphabet", "sequences", "residues"])

    return files.select("path", F.substring("content", 1, 64).alias("content")).mapInPandas(run, "path string, alphabet string, sequences long, residues long")


def parse_databases(files: DataFrame, first: int = 0, count: int | None = None) -> DataFrame:
    """SEQUENCES rows of every database of (path, content): of a packed one, ``count`` records from ``first`` on. The
    files of a packed database are brought together by name."""

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        held = {p[len(key[0]) :]: bytes(c) for p, c in zip(f["path"], f["content"])}
        data = held.get("", b"")
        if data[:4] == DATABASE:
            if first or count is not None:
                raise ValueError("this kind of database has no index of its records")
            return _sequences([(key[0], *r) for r in parse_database(data)])
        return _sequences([(key[0], *r) for r in parse_packed(data, held[".dsqi"], held[".dsqm"], held[".dsqs"], first, count)])

    base = F.regexp_replace("path", r"\.dsq[ims]$", "").alias("base")
    return files.select("path", "content", base).groupBy("base").applyInPandas(run, SEQUENCES)


def read_databases(spark: SparkSession, path: str, first: int = 0, count: int | None = None) -> DataFrame:
    return parse_databases(spark.read.format("binaryFile").load(path).select("path", "content"), first, count)
