"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Each word gives two tokens: the lower-cased word itself and its shape (letters as ``A`` or ``a``, other ones
as they are, runs shortened), so that words never seen before still count. The features are the hashed
one- and two-word grams of both, and a mark for a word that repeats the one before it. A feature's value is
its share of the text's grams. A score is the logistic of a sparse dot product.

The model learns from a bounded sample of labelled rows outside the held-out fold: about ``sample`` of them,
chosen by a hash of the id. Their features are hashed on the executors; no text comes to the driver. Null and
empty texts have no features and get the score of the bias. Without labelled rows of both kinds every score is
the prior (0.5 if there are no labels), as on empty tables. Of contradicting labels the larger counts, of several
texts with one id the last in order. Very long texts and words are read whole. Repeated rows are scored each for
itself; null ids are allowed; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import crc_mod, crc_mod_py, ddl, documents, labels, per_batch, texts

BITS = 18
SCALE = 30.0
SAMPLE, EPOCHS = 6000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.7
REMEMBERED = 200_000
SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
_RUN = re.compile(r"(.)\1+")


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, seed=9)


def shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUN.sub(r"\1", kinds)


class Grams:
    """Feature indices of a text, each as often as its gram occurs."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, bytes] = {}

    def tokens(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            found = _hash(b"w" + word.lower().encode()).to_bytes(8, "little") + _hash(b"s" + shape(word).encode()).to_bytes(8, "little")
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        flat = np.frombuffer(b"".join([self.tokens(w) for w in words]), "<u8").reshape(-1, 2)
        mul = np.uint64(0x9E3779B97F4A7C15)
        parts = []
        for h in flat.T:
            parts += [h, (h[:-1] * mul) ^ (h[1:] + np.uint64(1))]
        again = flat[1:, 0] == flat[:-1, 0]
        parts.append(np.where(again, np.uint64(_hash(b"again")), np.uint64(_hash(b"new"))))
        mixed = np.concatenate(parts)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> self.shift).astype(np.int64)


class FollowTheLeader:
    """Per-coordinate FTRL-proximal logistic regression; index 0 of the sums is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def scaled(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (shifted past the bias) and values of the features."""
    return np.concatenate([[0], at + 1]), np.concatenate([[1.0], SCALE * counts / max(1, counts.sum())])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray | None:
    """Weights, the bias first, from (places, values, label); None without rows of both labels."""
    if len({y for _, _, y in rows}) < 2:
        return None
    model = FollowTheLeader(bits)
    ready = [(at, x, float(y)) for at, x, y in rows]
    rng = np.random.default_rng(9)
    for _ in range(epochs):
        for k in rng.permutation(len(ready)):
            model.update(*ready[k])
    return model.weights(np.arange(len(model.z)))


HASHED = {"doc_id": pa.int64(), "at": pa.binary(), "counts": pa.binary(), "mark": pa.int64()}


def hashed(docs: DataFrame, features: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray]]]) -> list:
    """Rows (doc_id, places, counts, a hash of the text) of a bounded table of texts, in the order of their ids.
    Features are made on the executors, and each id comes once, with the last of its texts in order."""

    def run(batches):
        import xxhash

        of = features()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, counts = of(text)
                rows.append((doc_id, at.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), xxhash.xxh3_64_intdigest(text.encode()) >> 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(HASHED.values())], schema=pa.schema(list(HASHED.items())))

    once = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    found = once.mapInArrow(run, ddl(HASHED)).collect()
    return [(r["doc_id"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["counts"], "<i4"), r["mark"]) for r in sorted(found, key=lambda r: r["doc_id"])]


def sampled_labels(marks: DataFrame, label_col: str, fold: int, folds: int, sample: int) -> dict[int, int]:
    """Labels of about ``sample`` documents outside the held-out fold, by id; with contradicting labels the larger."""
    own = marks.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    own = own.where(crc_mod(F.col("doc_id"), folds) != fold)
    n = own.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))
    return {r["doc_id"]: r["label"] for r in own.where(share).collect()}


def with_ids(docs: DataFrame, ids: Iterable[int]) -> DataFrame:
    """(doc_id, text) of the documents with the given ids, a bounded sample that is broadcast."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    return texts(docs).join(F.broadcast(wanted), "doc_id", "left_semi")


def training_rows(docs: DataFrame, marks: DataFrame, label_col: str, fold: int, folds: int, sample: int, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(places, values, label) of about ``sample`` labelled documents outside the held-out fold, in a fixed order."""
    known = sampled_labels(marks, label_col, fold, folds, sample)

    def features():
        grams = Grams(bits)
        return lambda text: np.unique(grams(text), return_counts=True)

    rows = hashed(with_ids(docs, known), features) if known else []
    return [(*scaled(at, counts), known[i]) for i, at, counts, _ in rows]


def scored(docs: DataFrame, weights: np.ndarray | None, prior: float, threshold: float, fold: int, folds: int, bits: int = BITS) -> DataFrame:
    small = None if weights is None else weights.astype(np.float32)

    def run(batches):
        grams = Grams(bits)

        def score(ids, whole):
            out = []
            for text in whole:
                if small is None:
                    out.append(prior)
                    continue
                at = grams(text)
                z = float(small[0]) + (SCALE * float(small[at + 1].sum(dtype=np.float64)) / len(at) if len(at) else 0.0)
                out.append(1 / (1 + float(np.exp(-np.clip(z, -35, 35)))))
            return ids, [crc_mod_py(i, folds) == fold for i in ids], out, [int(s >= threshold) for s in out]

        yield from per_batch(score, SCORES)(batches)

    return texts(docs).mapInArrow(run, ddl(SCORES))


def quality_classifier(docs: DataFrame, marks: DataFrame, fold: int = 2, folds: int = 4, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on)."""
    rows = training_rows(docs, marks, "quality", fold, folds, sample)
    prior = sum(y for _, _, y in rows) / len(rows) if rows else 0.5
    return scored(docs, fit(rows), prior, THRESHOLD, fold, folds)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), labels(spark, sf_dir))
