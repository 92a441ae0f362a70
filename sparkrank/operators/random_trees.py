"""Fully random trees: every node draws some features and one threshold each between the least and largest value that it
holds, and takes the best of these splits. All trees of all models grow together, level by level.

Rows stand in blocks, and each carries the node that it has reached in every tree. A level is two aggregates over the rows: least and largest
values by (model, tree, node, drawn feature), then rows and positives left of the drawn thresholds. For these a tree's rows are ordered
by node once a block, so that a node is a range of them. Both are summed inside a task first; what comes to the driver is bounded by trees and depth, not by rows. All sums are of whole
numbers and all draws are seeded by (seed, model, tree, node), so the same rows give the same trees in any partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.plans.lineage import deleted, written

PARAMS = {"trees": 50, "depth": 8, "least": 2, "features": None, "every": 3}


@dataclass
class Forest:
    """By model: (trees, nodes) arrays; node n has children 2n and 2n + 1, ``feature`` is -1 at leaves, rows up to the threshold go left."""

    columns: list[str]
    params: dict
    feature: dict[int, np.ndarray] = field(default_factory=dict)
    threshold: dict[int, np.ndarray] = field(default_factory=dict)
    value: dict[int, np.ndarray] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)

    def importance(self) -> list[tuple[str, float]]:
        whole = sum(self.gains.values()) or 1.0
        return sorted(((c, self.gains.get(c, 0.0) / whole) for c in self.columns), key=lambda r: (-r[1], r[0]))


def drawn(seed: int, model: int, tree: int, node: int, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A node's features, and where between least and largest value each one's threshold is."""
    rng = np.random.default_rng((seed, model, tree, node))
    return rng.permutation(width)[:count], rng.random(count)


def descend(nodes: np.ndarray, x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, steps: int) -> np.ndarray:
    """Nodes (rows, trees) after up to ``steps`` more levels. A missing value goes left."""
    trees, rows = np.arange(nodes.shape[1])[None, :], np.arange(len(nodes))[:, None]
    for _ in range(steps):
        f = feature[trees, nodes]
        right = x[rows, np.maximum(f, 0)] > threshold[trees, nodes]
        nodes = np.where(f >= 0, 2 * nodes + right, nodes)
    return nodes


#: Rows of a block: their values stay near the processor.
BLOCK_ROWS = 1 << 14
_STATE = "model int, rows int, y binary, x binary, nodes binary"
_STATE_SCHEMA = pa.schema([("model", pa.int32()), ("rows", pa.int32()), ("y", pa.binary()), ("x", pa.binary()), ("nodes", pa.binary())])


def _state(model: int, y: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """Rows of one model; ``x`` lies feature by feature, ``nodes`` tree by tree, in whole numbers of any width, or none if all are at the roots."""
    return pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([len(y)], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (y.astype(np.int8), x, nodes))], schema=_STATE_SCHEMA)


def _start(columns, batches):
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def whole(m, parts):
        y, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        return _state(m, y, np.ascontiguousarray(x.T), np.empty(0, np.uint8))

    for b in batches:
        if b.num_rows:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            models, y = b.column("model").to_numpy(), b.column("y").to_numpy()
            for m in np.unique(models).tolist():
                at = models == m
                held.setdefault(m, []).append((y[at], x[at]))
                if sum(len(c[0]) for c in held[m]) >= BLOCK_ROWS:
                    yield whole(m, held.pop(m))
    for m, parts in held.items():
        yield whole(m, parts)


def _kind(depth: int):
    return np.uint16 if 2 << depth <= 1 << 16 else np.uint32


def _blocks(width, trees, batches):
    for b in batches:
        for m, n, *own in zip(*(b.column(c) for c in _STATE_SCHEMA.names), strict=True):
            m, n, (y, x, nodes) = m.as_py(), n.as_py(), (v.as_buffer() for v in own)
            nodes = np.frombuffer(nodes, f"u{nodes.size // (trees * n)}").reshape(trees, n) if nodes.size else np.ones((trees, n), np.uint8)
            yield m, np.frombuffer(y, np.int8), np.frombuffer(x, np.float64).reshape(width, n), nodes


def _stepped(nodes: np.ndarray, x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, steps: int) -> np.ndarray:
    """Nodes of one tree's rows after up to ``steps`` more levels. A missing value goes left."""
    values, rows, nodes = x.reshape(-1), np.arange(x.shape[1]), nodes.astype(_kind(len(feature).bit_length() - 2))
    for _ in range(steps):
        f = feature[nodes]
        right = values[np.maximum(f, 0) * x.shape[1] + rows] > threshold[nodes]
        nodes = np.where(f >= 0, 2 * nodes + right, nodes).astype(nodes.dtype)
    return nodes


def _advanced(width, trees, level, steps, feature, threshold, batches):
    """Blocks whose rows have gone ``steps`` further, to the nodes of ``level``."""
    kind = np.min_scalar_type((2 << level) - 1)
    for m, y, x, nodes in _blocks(width, trees, batches):
        yield _state(m, y, x, np.stack([_stepped(nodes[t], x, feature[m][t], threshold[m][t], steps).astype(kind) for t in range(trees)]))


def _by_node(width, trees, depth, steps, feature, threshold, picked, batches):
    """For each block and tree with open nodes: (model, values in one row, rows of the block, y, rows ordered by open node, each range's begin, length and place).
    A place is the node's number in ``picked[model]`` (tree, node -> place, -1 if not open)."""
    for m, y, x, nodes in _blocks(width, trees, batches):
        for t in range(trees) if m in picked else ():
            own = _stepped(nodes[t], x, feature[m][t], threshold[m][t], steps)
            order = np.argsort(own, kind="stable")  # by digits: whole numbers of 16 bits
            count = np.bincount(own, minlength=picked[m].shape[1])
            seen = np.flatnonzero(count)
            begin, place = np.cumsum(count[seen]) - count[seen], picked[m][t, seen]
            if (shut := place < 0).any():
                order = order[np.repeat(~shut, count[seen])]
                seen, place = seen[~shut], place[~shut]
                begin = np.cumsum(count[seen]) - count[seen]
            if len(seen):
                yield m, x.reshape(-1), x.shape[1], y, order, begin, count[seen], place


_RANGES = "model int, place long, draw int, least double, largest double"
_COUNTS = "model int, place long, draw int, n long, positives long, n_left long, positives_left long"


def _ranges(state_args, drawn_features, batches):
    ends: dict[int, np.ndarray] = {}
    for m, values, n, _, order, begin, count, place in _by_node(*state_args, batches):
        own = drawn_features[m]
        low, high = ends.setdefault(m, np.stack([np.full(own.shape, np.inf), np.full(own.shape, -np.inf)]))
        for j in range(own.shape[1]):
            v = values[np.repeat(own[place, j] * n, count) + order]
            low[place, j] = np.fmin(low[place, j], np.fmin.reduceat(v, begin))
            high[place, j] = np.fmax(high[place, j], np.fmax.reduceat(v, begin))
    for m, (low, high) in ends.items():
        place, draw = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), m, np.int32)), pa.array(place), pa.array(draw.astype(np.int32)), pa.array(low[place, draw]), pa.array(high[place, draw])], names=[c.split()[0] for c in _RANGES.split(", ")])


def _counts(state_args, drawn_features, cuts, batches):
    sums: dict[int, np.ndarray] = {}
    for m, values, n, y, order, begin, count, place in _by_node(*state_args, batches):
        own = drawn_features[m]
        total = sums.setdefault(m, np.zeros((4, *own.shape), np.int64))
        ones = y[order].astype(np.int32)
        positives = np.add.reduceat(ones, begin)
        for j in range(own.shape[1]):
            left = ~(values[np.repeat(own[place, j] * n, count) + order] > np.repeat(cuts[m][place, j], count))
            for k, v in enumerate((count, positives, np.add.reduceat(left, begin, dtype=np.int32), np.add.reduceat(left * ones, begin))):
                total[k][place, j] += v  # a tree's places differ
    for m, total in sums.items():
        place, draw = np.nonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), m, np.int32)), pa.array(place), pa.array(draw.astype(np.int32)), *(pa.array(t[place, draw]) for t in total)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def purity(n: int, positives: int) -> float:
    """What a side adds to a split's worth: rows less their Gini impurity, up to a factor."""
    return (positives**2 + (n - positives) ** 2) / n if n else 0.0


def fit_many(rows: DataFrame, columns: list[str], label: str, model: str = "model", params: dict | None = None, seed: int = 42) -> Forest:
    """A forest for each value of the int column ``model``, on all its rows."""
    p = PARAMS | (params or {})
    if unknown := set(p) - set(PARAMS):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    width, trees, depth = len(columns), p["trees"], p["depth"]
    count = min(width, p["features"] or max(1, int(width**0.5)))
    out = Forest(columns, p)
    own = rows.select(F.col(model).cast("int").alias("model"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    state = written(own.mapInArrow(partial(_start, columns), _STATE), "trees", packed=True)
    open_nodes: dict[int, list[tuple[int, int]]] = {}
    for r in own.groupBy("model").agg(F.avg("y").alias("rate")).collect():  # a row per model
        m = r["model"]
        out.feature[m], out.threshold[m], out.value[m] = np.full((trees, 2 << depth), -1), np.zeros((trees, 2 << depth)), np.zeros((trees, 2 << depth))
        out.value[m][:, 1], open_nodes[m] = r["rate"], [(t, 1) for t in range(trees)]
    stale = 0
    for level in range(1, depth + 1):
        if not open_nodes:
            break
        picked, features, parts = {}, {}, {}
        for m, nodes in open_nodes.items():
            picked[m] = np.full((trees, 2 << depth), -1)
            for k, (t, n) in enumerate(nodes):
                picked[m][t, n] = k
            draws = [drawn(seed, m, t, n, width, count) for t, n in nodes]
            features[m], parts[m] = np.array([d[0] for d in draws]), np.array([d[1] for d in draws])
        args = (width, trees, depth, stale, out.feature, out.threshold, picked)
        ends = state.mapInArrow(partial(_ranges, args, features), _RANGES).groupBy("model", "place", "draw").agg(F.min("least").alias("least"), F.max("largest").alias("largest")).toArrow()
        cuts = {m: np.full(f.shape, np.nan) for m, f in features.items()}
        em, ep, ed, low, high = (ends.column(c).to_numpy() for c in ("model", "place", "draw", "least", "largest"))
        for m in cuts:
            at = (em == m) & (low < high)
            cuts[m][ep[at], ed[at]] = low[at] + parts[m][ep[at], ed[at]] * (high[at] - low[at])
        sums = state.mapInArrow(partial(_counts, args, features, cuts), _COUNTS).groupBy("model", "place", "draw").agg(*[F.sum(c).alias(c) for c in ("n", "positives", "n_left", "positives_left")]).collect()
        open_nodes = _decided(out, open_nodes, sums, features, cuts, p["least"])
        stale += 1
        if stale == p["every"] and level < depth and open_nodes:
            last, state = state, written(state.mapInArrow(partial(_advanced, width, trees, level, stale, out.feature, out.threshold), _STATE), "trees", packed=True)
            deleted(last)
            stale = 0
    deleted(state)
    return out


def _decided(out: Forest, open_nodes, sums, features, cuts, least: int) -> dict[int, list[tuple[int, int]]]:
    """Takes each open node's best split (of equal ones the first drawn); returns the nodes to go on with."""
    best: dict[tuple[int, int], tuple] = {}
    for r in sums:
        m, place, draw = r["model"], r["place"], r["draw"]
        n, pos, nl, pl = (int(r[c]) for c in ("n", "positives", "n_left", "positives_left"))
        if np.isnan(cuts[m][place, draw]) or nl < least or n - nl < least or pos in (0, n):
            continue
        gain = purity(nl, pl) + purity(n - nl, pos - pl) - purity(n, pos)
        if (m, place) not in best or (-gain, draw) < best[m, place][:2]:
            best[m, place] = (-gain, draw, n, pos, nl, pl)
    following: dict[int, list[tuple[int, int]]] = {}
    for (m, place), (gain, draw, n, pos, nl, pl) in sorted(best.items()):
        t, node = open_nodes[m][place]
        f = int(features[m][place, draw])
        out.feature[m][t, node], out.threshold[m][t, node] = f, cuts[m][place, draw]
        out.value[m][t, 2 * node], out.value[m][t, 2 * node + 1] = pl / nl, (pos - pl) / (n - nl)
        out.gains[out.columns[f]] = out.gains.get(out.columns[f], 0.0) - gain
        sides = ((2 * node, nl, pl), (2 * node + 1, n - nl, pos - pl))
        following.setdefault(m, []).extend((t, c) for c, size, ones in sides if size >= 2 * least and 0 < ones < size)
    return {m: nodes for m, nodes in following.items() if nodes}


def _score(columns, feature, threshold, value, depth, batches):
    for b in batches:
        if b.num_rows:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            models, score = b.column("model").to_numpy(), np.zeros(b.num_rows)
            for m in np.unique(models):
                at, m = np.flatnonzero(models == m), int(m)
                nodes = descend(np.ones((len(at), len(value[m])), np.int64), x[at], feature[m], threshold[m], depth)
                score[at] = value[m][np.arange(len(value[m]))[None, :], nodes].mean(1)
            kept = [c for c in b.schema.names if c.startswith("_key")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(score)], names=[*kept, "score"])


def predict(fitted: Forest, rows: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """``keys`` and ``score``, the mean of the trees' leaves, of each row by its model."""
    kinds = dict(rows.dtypes)
    own = rows.select(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.col(model).cast("int").alias("model"), *[F.col(c).cast("double").alias(c) for c in fitted.columns])
    schema = ", ".join([*(f"_key{j} {kinds[k]}" for j, k in enumerate(keys)), "score double"])
    out = own.mapInArrow(partial(_score, fitted.columns, fitted.feature, fitted.threshold, fitted.value, fitted.params["depth"]), schema)
    return out.select(*[F.col(f"_key{j}").alias(k) for j, k in enumerate(keys)], "score")


def trees_out_of_fold(train: DataFrame, test: DataFrame | None, id_col: str, columns: list[str], label: str, fold: str = "fold", params: dict | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame | None, Forest]:
    """Out-of-fold scores of ``train``, mean scores of ``test`` over the folds' forests, and the forests, all folds at once."""
    folds = sorted(int(r[fold]) for r in train.select(fold).distinct().collect())  # a row per fold
    every = F.explode(F.array(*[F.lit(k) for k in folds]))
    own = train.select(id_col, label, F.col(fold).cast("int").alias("_fold"), *columns)
    fitted = fit_many(own.withColumn("model", every).where("model <> _fold"), columns, label, params=params, seed=seed)
    oof = predict(fitted, own.withColumnRenamed("_fold", "model"), [id_col])
    if test is None:
        return oof, None, fitted
    scores = predict(fitted, test.select(id_col, *columns).withColumn("model", every), [id_col])
    return oof, scores.groupBy(id_col).agg(F.avg("score").alias("score")), fitted
