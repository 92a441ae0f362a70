"""A factorization machine over lattice codes and periodic tokens, trained on log-loss and on pairs of ranks.

Every field has a token: the embedding of its code, and where the field is a number a learned Fourier embedding of the
number besides, unless it is missing. The output is a bias, a weight for each code and the inner products of all pairs of
tokens. The loss is the mean log-loss plus ``rank_weight`` times the mean of log(1 + exp(s- - s+)) over pairs of a
positive and a negative row drawn in each task. Fields are hidden at random while training, as if missing.

Rows are dealt into batches once, each a row of packed numbers, and batches into shards of at most ``SHARD_BATCHES``. An epoch is one job:
a task takes a model through the batches of a shard, step by step; if there are several shards, parameters and moments of the model
are averaged over them before the next epoch. So up to 524,288 rows a model's steps follow one another as if on one machine,
beyond that shards take theirs side by side, and the number of jobs stays that of the epochs. The driver holds parameters, whose number
is bounded by ``table`` codes, not by rows. Outputs and gradients are worked out in 32-bit floats, parameters are kept in 64 bits. What
predicts is a moving average of the parameters.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.operators.encode import lattice_vocabulary
from sparkrank.operators.newton import LANES, _added
from sparkrank.plans.lineage import deleted, written

#: Batches that a task takes one after another in an epoch, at most.
SHARD_BATCHES = 64

PARAMS = {"width": 8, "frequencies": 4, "epochs": 12, "batch": 8192, "rate": 0.02, "decay": 1e-4, "average": 0.9, "rank_weight": 0.3, "hidden": 0.05, "least": 2, "table": 1 << 16, "clip": 5.0}


@dataclass
class Design:
    """What rows look like: ``fields`` with codes, ``numbers`` with values, the codes' offsets, and the values' ends. ``needs``: for
    each number which raw fields it is made of (numbers by raw fields), ``raw`` of which the first are numbers themselves, the last texts."""

    fields: list[str]
    numbers: list[str]
    sizes: list[int]
    mean: np.ndarray
    scale: np.ndarray
    needs: np.ndarray | None = None

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)


def fresh(design: Design, p: dict, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    v, n, w, k = sum(design.sizes), len(design.numbers), p["width"], p["frequencies"]
    return {
        "bias": np.zeros(1), "linear": np.zeros(v), "embed": 0.05 * rng.normal(size=(v, w)), "frequency": 0.5 * rng.normal(size=(n, k)),
        "project": rng.normal(size=(n, 2 * k, w)) * 0.1 / math.sqrt(2 * k), "shift": np.zeros((n, w)),
    }


def smooth_tokens(theta: dict[str, np.ndarray], values: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fourier embeddings of numbers (rows, numbers, width), zero where missing; and the waves, number by number."""
    k = theta["frequency"].shape[1]
    phase = values.T[:, :, None] * (2 * math.pi * theta["frequency"])[:, None, :]
    waves = np.empty((*phase.shape[:2], 2 * k), phase.dtype)
    np.sin(phase, out=waves[:, :, :k])
    np.cos(phase, out=waves[:, :, k:])
    return (waves @ theta["project"] + theta["shift"][:, None, :]).transpose(1, 0, 2) * ~missing[:, :, None], waves


def smooth_gradients(theta: dict[str, np.ndarray], values: np.ndarray, waves: np.ndarray, d_smooth: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of what makes the embeddings, from those of the embeddings (rows, numbers, width)."""
    k = theta["frequency"].shape[1]
    own = np.ascontiguousarray(d_smooth.transpose(1, 0, 2))
    d_waves = own @ theta["project"].transpose(0, 2, 1)
    d_phase = d_waves[:, :, :k] * waves[:, :, k:] - d_waves[:, :, k:] * waves[:, :, :k]
    by_value = np.ascontiguousarray(values.T)[:, None, :] @ d_phase
    return {"shift": own.sum(1), "project": waves.transpose(0, 2, 1) @ own, "frequency": 2 * math.pi * by_value[:, 0, :]}


def forward(theta: dict[str, np.ndarray], codes: np.ndarray, values: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Outputs of rows, and what the gradient needs. ``codes`` count through all fields; number j shares the token of field j."""
    tokens = theta["embed"][codes]
    smooth, waves = smooth_tokens(theta, values, missing)
    tokens[:, : values.shape[1]] += smooth
    total = tokens.sum(1)
    out = theta["bias"][0] + theta["linear"][codes].sum(1) + 0.5 * ((total**2).sum(1) - (tokens**2).sum((1, 2)))
    return out, (tokens, total, waves)


def backward(theta: dict[str, np.ndarray], codes: np.ndarray, values: np.ndarray, missing: np.ndarray, kept: tuple, pull: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of sum(pull * output)."""
    tokens, total, waves = kept
    d_tokens = pull[:, None, None] * (total[:, None, :] - tokens)
    out = {"bias": np.array([pull.sum()]), "linear": np.zeros_like(theta["linear"]), "embed": np.zeros_like(theta["embed"])}
    np.add.at(out["linear"], codes, np.broadcast_to(pull[:, None], codes.shape))
    np.add.at(out["embed"], codes, d_tokens)
    return out | smooth_gradients(theta, values, waves, d_tokens[:, : values.shape[1]] * ~missing[:, :, None])


def hidden(design: Design, rng: np.random.Generator, codes: np.ndarray, missing: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes and gaps with each field hidden at random: its code is that of a missing value, and its number is missing."""
    gone = rng.random(codes.shape) < rate
    return np.where(gone, design.offsets[None, :], codes), missing | gone[:, : missing.shape[1]]


@dataclass
class Net:
    """What a model is made of: functions as above, by name."""

    fresh: Callable
    forward: Callable
    backward: Callable
    hidden: Callable


MACHINE = Net(fresh, forward, backward, hidden)


def pulls(score: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], rank_weight: float, rows: int, of_pairs: int) -> tuple[float, np.ndarray]:
    """The loss of rows and pairs, of ``rows`` and ``of_pairs`` in all, and its derivative by each score."""
    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
    loss, pull = (np.logaddexp(0, score) - y * score).sum() / max(1, rows), (p - y) / max(1, rows)
    if rank_weight and len(pairs[0]) and of_pairs:
        margin = score[pairs[0]] - score[pairs[1]]
        less = rank_weight / of_pairs / (1 + np.exp(np.clip(margin, -500, 500)))
        loss += rank_weight * np.logaddexp(0, -margin).sum() / of_pairs
        np.add.at(pull, pairs[0], -less)
        np.add.at(pull, pairs[1], less)
    return float(loss), pull


def drawn_pairs(y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """As many pairs of a positive and a negative row as the rarer class has rows, each row once at most."""
    ones, zeros = np.flatnonzero(y > 0.5), np.flatnonzero(y < 0.5)
    n = min(len(ones), len(zeros))
    return rng.permutation(ones)[:n], rng.permutation(zeros)[:n]


def flat(theta: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([theta[c].ravel() for c in sorted(theta)])


def unflat(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for c in sorted(like):
        out[c] = vector[at : at + like[c].size].reshape(like[c].shape)
        at += like[c].size
    return out


def _unpacked(b, design):
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.int32).reshape(b.num_rows, len(design.fields)).astype(np.int64)
    values = np.frombuffer(b"".join(b.column("values").to_pylist()), np.float64).reshape(b.num_rows, len(design.numbers)).copy()
    missing = np.isnan(values)
    values[missing] = 0.0
    return codes, values, missing


class Adam:
    """Steps by running moments, weights shrunk a little each step, rate risen and fallen over the whole training."""

    def __init__(self, size: int, p: dict, steps: int):
        self.m, self.v, self.t, self.p, self.steps = np.zeros(size), np.zeros(size), 0, p, max(1, steps)

    def moved(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        norm = float(np.sqrt((g * g).sum()))
        g = g * min(1.0, self.p["clip"] / norm) if norm > 0 else g
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        part = self.t / self.steps
        rate = self.p["rate"] * (part / 0.2 if part < 0.2 else 0.5 * (1 + math.cos(math.pi * (part - 0.2) / 0.8)))
        step = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return w * (1 - rate * self.p["decay"]) - rate * step


def designed(train: DataFrame, test: DataFrame | None, id_col: str, label: str, fold: str, numbers: list[str], texts: list[str], p: dict, coded: bool = True) -> tuple[Design, DataFrame]:
    """(design, rows): rows (id, y, fold, batch, codes, values), test rows with a null fold. Codes are 0 missing, 1 rare, then by frequency; those
    beyond ``table`` in all fields share the rare one. Numbers have codes too if ``coded``."""
    fields = [*numbers, *texts] if coded else texts
    keep = [F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in texts]]
    both = train.select(*keep, F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"), F.lit(0).alias("part"))
    if test is not None:
        both = both.unionByName(test.select(*keep, F.lit(None).cast("double").alias("y"), F.lit(None).cast("int").alias("fold"), F.lit(1).alias("part")))
    both = written(both, "fm")
    ends = both.where("part = 0").agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(numbers)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(numbers)], F.count("*").alias("n")).first()
    words = lattice_vocabulary(both, fields, p["least"]).where(F.col("code") < max(3, p["table"] // max(1, len(fields))))
    words = written(words.select("field", "value", "code"), "fm-words")
    largest = {r["field"]: r["c"] for r in words.groupBy("field").agg(F.max("code").alias("c")).collect()}  # a row per field
    number = lambda k: np.array([ends[f"{k}{j}"] or 0.0 for j in range(len(numbers))], float)
    design = Design(fields, numbers, [largest.get(f, 1) + 1 for f in fields], number("m"), np.where(number("s") > 0, number("s"), 1.0))
    long = both.select("id", "part", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(int(o)).alias("offset"), F.lit(k).alias("place"), F.col(f).cast("string").alias("value")) for k, (f, o) in enumerate(zip(fields, design.offsets, strict=True))])).alias("f")).select("id", "part", "f.*")
    coded = long.join(words.select(F.col("field").alias("_f"), F.col("value").alias("_v"), "code"), (F.col("field") == F.col("_f")) & (F.col("value") == F.col("_v")), "left")
    code = F.col("offset") + F.when(F.col("value").isNull(), 0).otherwise(F.coalesce("code", F.lit(1)))
    wide = coded.groupBy("id", "part").agg(*[F.max(F.when(F.col("place") == k, code)).cast("int").alias(f"c{k}") for k in range(len(fields))])
    rows = both.select("id", "part", "y", "fold", *numbers).join(wide, ["id", "part"])
    batches = max(1, -(-int(ends["n"]) // p["batch"]))
    rows = rows.withColumn("batch", F.when(F.col("part") == 0, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(batches))).otherwise(-1).cast("int"))
    return design, rows


_BLOCKS = "shard int, batch int, y binary, fold binary, codes binary, values binary"


def _blocked(shards: int, key, rows):
    """A batch as one row, its rows by id."""
    rows = rows.sort_by("id")
    values = np.frombuffer(b"".join(rows.column("values").to_pylist()), np.float64).astype(np.float32)
    out = (rows.column("y").to_numpy(), rows.column("fold").to_numpy().astype(np.int32), values)
    y, fold, values = (v.tobytes() for v in out)
    codes, batch = b"".join(rows.column("codes").to_pylist()), key[0].as_py()
    return pa.table([pa.array([batch % shards], pa.int32()), pa.array([batch], pa.int32()), *(pa.array([v], pa.binary()) for v in (y, fold, codes, values))], names=[c.split()[0] for c in _BLOCKS.split(", ")])


def _trained(net: Net, design: Design, p: dict, m: int, shared, order: np.ndarray, epoch: int, steps: int, seed: int, blocks):
    """Takes model ``m`` through the batches of each shard in ``order``: [batches, batches * state, loss of each batch]."""
    shards: dict[int, dict[int, tuple]] = {}
    for b in blocks:
        for shard, batch, *own in zip(*(b.column(c) for c in ("shard", "batch", "y", "fold", "codes", "values")), strict=True):
            y, fold, codes, values = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(own, (np.float64, np.int32, np.int32, np.float32), strict=True))
            shards.setdefault(shard.as_py(), {})[batch.as_py()] = (y, fold, codes.reshape(len(y), -1), values.reshape(len(y), len(design.numbers)))
    like = net.fresh(design, p, 0) if shards else {}
    for shard, held in shards.items():
        state, t = shared.value[m]
        adam, losses = Adam(state.shape[1], p, steps), np.zeros(len(order))
        w, adam.m, adam.v, mean = state
        adam.t = t
        for place, batch in enumerate(order):
            if batch not in held:
                continue
            y, fold, codes, values = held[batch]
            rng = np.random.default_rng((seed, epoch, int(batch)))
            missing = np.isnan(values)
            values = np.where(missing, np.float32(0), values)
            if p["hidden"]:
                codes, missing = net.hidden(design, rng, codes, missing, p["hidden"])
            at = np.flatnonzero(fold != m)
            if not len(at):
                continue
            own, theta = (codes[at], values[at], missing[at]), unflat(w.astype(np.float32), like)
            score, kept = net.forward(theta, *own)
            pairs = drawn_pairs(y[at], rng)
            losses[place], pull = pulls(score.astype(np.float64), y[at], pairs, p["rank_weight"], len(at), len(pairs[0]))
            w = adam.moved(w, flat(net.backward(theta, *own, kept, pull.astype(np.float32))).astype(np.float64))
            mean = p["average"] * mean + (1 - p["average"]) * w
        s = np.concatenate([[len(held)], len(held) * np.concatenate([w, adam.m, adam.v, mean]), losses])
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([shard % LANES], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["fit", "lane", "s"])


_ROWS = "id long, y double, fold int, batch int, codes binary, values binary"
_ROW_SCHEMA = pa.schema([("id", pa.int64()), ("y", pa.float64()), ("fold", pa.int32()), ("batch", pa.int32()), ("codes", pa.binary()), ("values", pa.binary())])


def _packed(design, batches):
    for b in batches:
        if b.num_rows:
            codes = np.column_stack([b.column(f"c{k}").to_numpy(zero_copy_only=False) for k in range(len(design.fields))]).astype(np.int32)
            values = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in design.numbers]) if design.numbers else np.zeros((b.num_rows, 0))
            values = (np.where(np.isfinite(values), values, np.nan) - design.mean) / design.scale
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "y", "fold", "batch")), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array([r.tobytes() for r in values], pa.binary())], schema=_ROW_SCHEMA)


def _score(net, design, thetas, batches):
    for b in batches:
        if b.num_rows:
            own, fold = _unpacked(b, design), b.column("fold").to_numpy(zero_copy_only=False)
            each = {m: net.forward(t, *own)[0] for m, t in thetas.items()}
            mean = sum(each.values()) / len(each)
            score = np.array([each[int(f)][i] if f == f and f is not None else mean[i] for i, f in enumerate(fold)])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.isnan(fold.astype(np.float64))), pa.array(score)], names=["id", "sent", "score"])


def rank_fm_out_of_fold(train: DataFrame, test: DataFrame | None, id_col: str, numbers: list[str], texts: list[str], label: str, fold: str = "fold", params: dict | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame | None, list[float]]:
    """(id, score) of ``train`` by the model that left its fold out, of ``test`` the mean over the folds' models, both log-odds, and the mean loss of
    each step. Ids are longs, unique in each table."""
    p = settled(PARAMS, params)
    return trained_out_of_fold(MACHINE, *designed(train, test, id_col, label, fold, numbers, texts, p), id_col, p, seed, test is not None)


def settled(defaults: dict, params: dict | None) -> dict:
    if unknown := set(params or {}) - set(defaults):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return defaults | (params or {})


def trained_out_of_fold(net: Net, design: Design, rows: DataFrame, id_col: str, p: dict, seed: int, sent: bool) -> tuple[DataFrame, DataFrame | None, list[float]]:
    """Trains a ``net`` for each fold on the others' rows, all folds in one job an epoch."""
    table = written(rows.mapInArrow(partial(_packed, design), _ROWS), "fm-rows")
    train, spark = table.where("batch >= 0"), table.sparkSession
    batches = sorted(r["batch"] for r in train.select("batch").distinct().collect())  # a row per batch
    folds = sorted(int(r["fold"]) for r in train.select("fold").distinct().collect())  # a row per fold
    shards = max(1, -(-len(batches) // SHARD_BATCHES))
    blocks = train.groupBy("batch").applyInArrow(partial(_blocked, shards), _BLOCKS)
    blocks = written(blocks.repartition("shard"), "fm-blocks", ["shard"]).select(*[c.split()[0] for c in _BLOCKS.split(", ")])
    thetas = {m: net.fresh(design, p, seed + m) for m in folds}
    states = {m: (np.stack([w := flat(t), 0 * w, 0 * w, w]), 0) for m, t in thetas.items()}
    each, losses = -(-len(batches) // shards), []
    for epoch in range(p["epochs"]):
        order = np.array(batches)[np.random.default_rng((seed, epoch)).permutation(len(batches))]
        shared = spark.sparkContext.broadcast(states)
        passes = [blocks.mapInArrow(partial(_trained, net, design, p, m, shared, order, epoch, p["epochs"] * each, seed), "fit int, lane int, s binary") for m in folds]
        parts = reduce(DataFrame.unionByName, passes).groupBy("fit", "lane").applyInArrow(_added, "fit int, lane int, s binary")
        loss = []
        for r in parts.groupBy("fit").applyInArrow(_added, "fit int, lane int, s binary").collect():  # a row per model
            m, s = r["fit"], np.frombuffer(r["s"])
            size = states[m][0].shape[1]
            states[m] = (s[1 : 1 + 4 * size].reshape(4, size) / s[0], states[m][1] + each)
            loss.append(s[1 + 4 * size :])
        losses += np.mean(loss, 0).tolist()
        shared.destroy()
    averaged = {m: unflat(states[m][0][3], thetas[m]) for m in folds}
    scores = written(table.mapInArrow(partial(_score, net, design, averaged), "id long, sent boolean, score double"), "fm-scores")
    deleted(table)
    out = scores.where("not sent").select(F.col("id").alias(id_col), "score")
    return out, scores.where("sent").select(F.col("id").alias(id_col), "score") if sent else None, losses
