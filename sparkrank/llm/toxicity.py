"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other training texts, marked or not, count as unlabelled. With
the class prior p, the risk of a linear scorer g over hashed words is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)]),

whose second term estimates the risk on clean texts and is kept from falling below zero: when a batch drives
it under, the step goes back along it instead (the correction that stops the fit from calling unlabelled
texts clean by heart). The loss is logistic, features are which hashed words and word beginnings a text
holds; those that are not clearly (by some standard errors) more frequent among distinct positives than among
all distinct training texts have no weight. The prior is the share of toxic rows among the training labels.

How many standard errors, and the score's zero point, are chosen on a fifth of the training sample that the fit
doesn't see: there the estimated share of wrong answers at a cut c, p * P_pos[g < c] + max(0, P_unl[g >= c] -
p * P_pos[g >= c]), is least; of a range of equally good cuts the middle one is taken. The score is the logistic
of g less that cut. Nothing is learned from the held-out fold.

The model learns from bounded samples: about ``sample`` positives and as many unlabelled texts times
``unlabelled``, chosen by a hash of the id, outside the held-out fold. Features are hashed on the executors; no
text comes to the driver. Null and empty texts hold no word and get the score of the bias. Without toxic labels
every score is 0, as on empty tables. Of several texts with one id the last in order is learned from, of equal
texts (ties) one. Very long texts are read whole. Repeated rows are scored each for itself; null ids are allowed;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import crc_mod, crc_mod_py, ddl, documents, labels, per_batch, texts
from sparkrank.llm.quality_classifier import hashed, sampled_labels, with_ids

BITS = 20
SAMPLE, UNLABELLED = 3000, 3
EPOCHS, BATCHES, STEP, DECAY = 30, 12, 0.15, 1e-4
#: Standard errors that are tried, and one of how many training texts judges them.
LEAST, JUDGES = (6.0, 4.0, 8.0), 5
#: Word beginnings of so many characters are features beside the whole word.
BEGINNINGS = (4, 5)
SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
REMEMBERED = 200_000
EDGES = ".,;:!?|\"'()[]#*$%&<>-"


class Words:
    """Distinct hashed words and word beginnings of a text."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        out, known = set(), self.known
        for word in set(text.lower().split()):
            at = known.get(word)
            if at is None:
                bare = word.strip(EDGES)
                own = [bare.encode(), *(b"\0" + bare[:n].encode() for n in BEGINNINGS if len(bare) > n)]
                at = tuple(xxhash.xxh64_intdigest(x, seed=2) >> (64 - self.bits) for x in own)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(word) <= 64:
                    known[word] = at
            out.update(at)
        return np.fromiter(out, np.int64, len(out))


class Rows:
    """Binary sparse rows over the training vocabulary."""

    def __init__(self, rows: list[np.ndarray]):
        self.lengths = np.array([len(r) for r in rows])
        self.ends = np.cumsum(self.lengths)
        self.index = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def take(self, which: np.ndarray) -> Rows:
        return Rows([self.index[self.ends[k] - self.lengths[k] : self.ends[k]] for k in which])

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return total[self.ends] - total[self.ends - self.lengths]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(g, self.lengths), minlength=size)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def gradient(sp: np.ndarray, su: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the non-negative risk in the scores g of positive and unlabelled texts, given their logistics."""
    clean = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
    # Derivatives of the two losses in g: s - 1 for loss(g), s for loss(-g).
    up = prior * (sp - 1) / len(sp)
    down_p, down_u = -prior * sp / len(sp), su / len(su)
    return (up + down_p, down_u) if clean >= 0 else (-down_p, -down_u)


def best_cut(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(estimated share of wrong answers, cut) on scores of positives and unlabelled texts; see the module."""
    values = np.unique(np.concatenate([p, u]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    caught = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    called = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    wrong = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    good = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    low, high = np.concatenate([[values[0] - 1], values]), np.concatenate([values, [values[-1] + 1]])
    widest = max(runs, key=lambda r: high[r[-1]] - low[r[0]])
    return float(wrong.min()), float((low[widest[0]] + high[widest[-1]]) / 2)


def trained(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: float, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weights by hash, bias) of the scorer g."""
    n_p, n = len(positive), len(positive) + len(unlabelled)
    in_p = np.bincount(np.concatenate([*positive, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << bits)
    in_all = in_p + np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << bits)
    excess = (in_p / n_p - in_all / n) / np.sqrt((in_all + 0.5) / n / n_p)
    vocabulary = np.flatnonzero((in_p >= 3) & (excess >= least))
    narrow = np.full(1 << bits, -1)
    narrow[vocabulary] = np.arange(len(vocabulary))
    p, u = (Rows([x[x >= 0] for x in (narrow[r] for r in rows)]) for rows in (positive, unlabelled))
    size = len(vocabulary)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    rng = np.random.default_rng(2)
    for epoch in range(EPOCHS):
        step = STEP * (1 - epoch / EPOCHS)
        for own_p, own_u in zip(np.array_split(rng.permutation(n_p), BATCHES), np.array_split(rng.permutation(len(unlabelled)), BATCHES), strict=True):
            if not len(own_p) or not len(own_u):
                continue
            bp, bu = p.take(own_p), u.take(own_u)
            gp, gu = gradient(_logistic(bp.dot(w) + b), _logistic(bu.dot(w) + b), prior)
            g = np.append(bp.back(gp, size) + bu.back(gu, size) + DECAY * w, gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            w, b = w - move[:-1], b - move[-1]
    whole = np.zeros(1 << bits, np.float32)
    whole[vocabulary] = w
    return whole, float(b)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS) -> tuple[np.ndarray, float] | None:
    """(weights by hash, bias less the cut); None without positives or unlabelled texts."""
    if not positive or not unlabelled:
        return None
    rng = np.random.default_rng(3)
    (learn_p, judge_p), (learn_u, judge_u) = (([rows[k] for k in order[len(rows) // JUDGES :]], [rows[k] for k in order[: len(rows) // JUDGES]]) for rows in (positive, unlabelled) for order in (rng.permutation(len(rows)),))
    if not judge_p or not judge_u:  # too few to set any aside
        learn_p, judge_p, learn_u, judge_u = positive, positive, unlabelled, unlabelled
    found = []
    for k, least in enumerate(LEAST):
        w, b = trained(learn_p, learn_u, prior, least, bits)
        g_p, g_u = (Rows(rows).dot(w.astype(np.float64)) + b for rows in (judge_p, judge_u))
        wrong, cut = best_cut(g_p, g_u, prior)
        found.append((wrong, k, w, b - cut))
    return min(found, key=lambda f: f[:2])[2:]


def scored(docs: DataFrame, model: tuple[np.ndarray, float] | None, fold: int, folds: int, bits: int = BITS) -> DataFrame:
    def run(batches):
        words = Words(bits)

        def score(ids, whole):
            out = []
            for text in whole:
                if model is None:
                    out.append(0.0)
                else:
                    z = float(model[0][words(text)].sum(dtype=np.float64)) + model[1]
                    out.append(1 / (1 + float(np.exp(-np.clip(z, -35, 35)))))
            return ids, [crc_mod_py(i, folds) == fold for i in ids], out, [int(s >= 0.5) for s in out]

        yield from per_batch(score, SCORES)(batches)

    return texts(docs).mapInArrow(run, ddl(SCORES))


def toxicity(docs: DataFrame, marks: DataFrame, fold: int = 0, folds: int = 5, sample: int = SAMPLE, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on)."""
    known = marks.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_mod(F.col("doc_id").cast("long"), folds) != fold))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    prior = ((n_toxic or 0) + 0.5) / (n + 1)  # never 0 or 1, however few the labels
    toxic = sampled_labels(known.where("toxic = 1"), "toxic", fold, folds, sample)
    rest = texts(docs.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id").cast("long"), folds) != fold)).select("doc_id", "text"))
    share = min(1.0, unlabelled * sample / max(1, rest.count()))
    chosen = rest.where(F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * share))  # about unlabelled * sample rows

    def features():
        words = Words()
        return lambda text: ((at := np.sort(words(text))), np.zeros(0, np.int64))

    def distinct(rows: DataFrame) -> list[np.ndarray]:
        return list({mark: at for _, at, _, mark in hashed(rows, features)}.values())

    model = fit(distinct(with_ids(docs, toxic)), distinct(chosen), prior) if toxic else None
    return scored(docs, model, fold, folds)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
