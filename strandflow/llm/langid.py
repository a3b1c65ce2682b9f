"""Language ID by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Labelled documents of one language that training learns from at most, those of least hash, whole texts.
PER_LANGUAGE = 300
BUCKETS = 1 << 12
#: A prediction is ambiguous if the runner-up's score is within this of the best.
AMBIGUOUS = 0.2

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Square roots of hashed 1-, 2- and 3-gram counts of the letters, at unit length; None without a
    letter. Runs of other characters count as one space."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[np.uint32(32)], codes[keep], [np.uint32(32)]]).astype(np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(3266489917) + one[2:]
    count = sum(np.bincount((g * np.uint32(668265263)) >> shift, minlength=BUCKETS) for g in (one, two, three))
    x = np.sqrt(count.astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """+1/-1 codewords of ``n`` languages: all distinct splits up to 7 languages, else the random code
    of 200 tried with the largest least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        splits = list(itertools.product((1, -1), repeat=n - 1))[1:]
        return np.vstack([np.ones(len(splits)), np.array(splits).T])
    rng, bits = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    tried = (rng.choice((-1.0, 1.0), (n, bits)) for _ in range(200))
    return max(tried, key=lambda c: min(int((a != b).sum()) for a, b in itertools.combinations(c, 2)))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, x: np.ndarray) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous. A codeword's loss is the sum of the bits'
        logistic losses, each weighted by how well its classifier did in training; scores are the
        losses' softmax."""
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = x @ self.weights + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] - np.sort(p)[-2] < AMBIGUOUS)


def fit(samples: list[np.ndarray], labels: list[str], steps: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Model:
    """A logistic classifier per code bit, by gradient descent with momentum on all samples' features at once."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if len(languages) < 2:
        return Model(languages, code, w, b)
    x = np.stack(samples)
    index = {y: i for i, y in enumerate(languages)}
    own = np.array([index[y] for y in labels])
    target = code[own].astype(np.float32)
    share = (1.0 / np.bincount(own))[own].astype(np.float32)
    share = (share / share.sum())[:, None]
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = share * target / (1 + np.exp(target * (x @ w + b)))
        vw = 0.9 * vw + x.T @ pull - decay * w
        vb = 0.9 * vb + pull.sum(0)
        w, b = w + rate * vw, b + rate * vb
    right = (share * ((x @ w + b) * target > 0)).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1.0)
    return Model(languages, code, w, b, trust / trust.sum() * len(trust))


def training_sample(docs: DataFrame, held_out, per_language: int = PER_LANGUAGE) -> tuple[list[np.ndarray], list[str]]:
    """Features and labels of at most ``per_language`` documents of each language, picked by a hash of doc_id,
    never of the held-out fold; of rows that share doc_id and lang, one.

    A first pass estimates each language's distinct doc_ids; a second keeps the rows whose hash is under the
    share that leaves a few more than are wanted, whatever the language's size, and computes their features
    where they lie. An estimate too high by over a quarter only makes the sample smaller.
    What comes to the driver is bounded by ``per_language`` rows of BUCKETS numbers for each language.
    """
    order = F.xxhash64("doc_id")
    rows = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text", order.alias("h"))
    n = rows.groupBy(F.col("lang").alias("name")).agg(F.approx_count_distinct("doc_id").alias("n"))
    wanted = 1.25 * per_language + 8 * per_language**0.5
    limits = materialize(n.select("name", (F.least(F.lit(1.0), wanted / F.col("n")) * float(2**64) - float(2**63)).alias("limit")), "limits")
    some = rows.join(limits, F.col("lang") == F.col("name")).where(F.col("h") <= F.col("limit")).select("doc_id", "lang", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(3).to_pylist()]
            keep = pa.array([x is not None for x in found])
            packed = pa.array([x.tobytes() for x in found if x is not None], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(keep) for i in range(3)), packed], names=["doc_id", "lang", "h", "x"])

    one = some.mapInArrow(run, "doc_id long, lang string, h long, x binary").groupBy("lang", "doc_id", "h").agg(F.min("x").alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    got = one.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "h", "doc_id", "x").collect()
    got.sort(key=lambda r: r[:3])
    return [np.frombuffer(r.x, np.float32) for r in got], [r.lang for r in got]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each row: one narrow pass; ``und`` with score 0
    for a text that is null or has no letter, or if no language was learned. Texts are read whole; repeated
    rows get equal predictions, rows without a doc_id are of no fold, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                x = features(t)
                out.append(m.predict(x) if x is not None and m.languages else ("und", 0.0, False))
            lang, score, close = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    held = F.coalesce(fold(), F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def fold():
    """Whether a document is held out of training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op3(docs: DataFrame) -> DataFrame:
    return identify(docs, fit(*training_sample(docs.select("doc_id", "text", "lang"), fold())))
