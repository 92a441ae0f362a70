"""Label statistics of the nearest rows of a labelled parent table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.operators.audit import numeric_columns
from sparkrank.operators.encode import levels
from sparkrank.operators.ranking import medians
from sparkrank.plans.lineage import deleted, written

#: Parent rows aimed at in a leaf, leaves of a class at most, rows sampled for a leaf; query rows of a task and at a time, and parent rows of a cell.
LEAF_ROWS, LEAVES, SAMPLED, QUERY_BLOCK, QUERY_ROWS, CELL_ROWS = 8_192, 1_024, 32, 32_768, 512, 256


def metric_space(parent: DataFrame, tables: list[DataFrame], columns: list[str], category_weight: float = 1.25) -> tuple[list[DataFrame], list[str]]:
    """Parent and other tables in the parent's units: numbers less their median over their sample deviation (missing:
    the median; deviation 1 where there is none), one column per parent category times ``category_weight``."""
    numbers = numeric_columns(parent, columns)
    middles = medians(parent, {c: F.col(c) for c in numbers})
    row = parent.agg(*[F.stddev_samp(c).alias(f"s_{c}") for c in numbers]).first() if numbers else None
    out = {}
    for c in numbers:
        m, s = middles[c] or 0.0, row[f"s_{c}"] or 1.0
        out[f"x_{c}"] = (F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s
    for c in (c for c in columns if c not in numbers):
        own = F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__"))
        for k, v in enumerate(levels(parent.select(own.alias(c)), [c])[c]):  # one column per category
            out[f"x_{c}_{k}"] = (own == v).cast("double") * category_weight
    return [df.withColumns(out) for df in (parent, *tables)], list(out)


@dataclass
class Tree:
    """Nodes with the box of what is below, its rows, and a split: up to ``cut`` in ``feature`` goes to the first of ``below``; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.feature[node] >= 0).any():
            f = np.maximum(self.feature[node], 0)
            node = np.where(inner, self.below[node, (x[np.arange(len(x)), f] > self.cut[node]).astype(int)], node)
        return self.leaf[node]

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.feature < 0)
        return self.low[at], self.high[at], self.rows[at]

    def fill(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> None:
        """Sets what leaves hold; children stand after their parents."""
        for n in reversed(range(len(self.feature))):
            if self.feature[n] < 0:
                self.low[n], self.high[n], self.rows[n] = low[self.leaf[n]], high[self.leaf[n]], rows[self.leaf[n]]
            else:
                a, b = self.below[n]
                self.low[n], self.high[n], self.rows[n] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b]), self.rows[a] + self.rows[b]

    def near(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) wherever a leaf's box is within the row's bound."""
        row, node, found = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(row):
            own = (self.rows[node] > 0) & (_box(self.low[node], self.high[node], x[row]) <= bound[row])
            row, node = row[own], node[own]
            end = self.feature[node] < 0
            found.append((row[end], self.leaf[node[end]]))
            row, node = np.repeat(row[~end], 2), self.below[node[~end]].ravel()
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])


def grown(x: np.ndarray, size: int) -> Tree:
    """Halves the widest column until at most ``size`` rows, or only equal ones, are together."""
    feature, cut, below, leaf, todo, leaves = [-1], [0.0], [[0, 0]], [-1], [(0, np.arange(len(x)))], 0
    while todo:
        node, at = todo.pop()
        own = x[at]
        if len(at) > size and len(at) and (own.min(0) < own.max(0)).any():
            with np.errstate(invalid="ignore"):
                spread = np.where(own.min(0) < own.max(0), np.nan_to_num(own.std(0), nan=np.inf), -1.0)
            f = int(spread.argmax())
            v = np.sort(own[:, f])
            middle = v[(len(v) - 1) // 2]
            middle = middle if middle < v[-1] else v[np.searchsorted(v, v[-1]) - 1]
            feature[node], cut[node], below[node] = f, middle, [len(feature), len(feature) + 1]
            for side in (own[:, f] <= middle, own[:, f] > middle):
                todo.append((len(feature), at[side]))
                feature.append(-1), cut.append(0.0), below.append([0, 0]), leaf.append(-1)
        else:
            leaf[node], leaves = leaves, leaves + 1
    n, d = len(feature), x.shape[1]
    return Tree(np.array(feature), np.array(cut), np.array(below), np.array(leaf), np.full((n, d), np.inf), np.full((n, d), -np.inf), np.zeros(n, np.int64))


def _box(low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of each row to its box: in floats, too, never more than to a point in it, as the sums go the same way."""
    square = np.zeros(np.broadcast_shapes(low.shape, x.shape)[:-1])
    for d in range(x.shape[-1]):
        gap = np.maximum(np.maximum(low[..., d] - x[..., d], x[..., d] - high[..., d]), 0.0)
        square += gap * gap
    return np.sqrt(square)


def _reach(boxes: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, k: int) -> np.ndarray:
    """A distance within which each row has ``k`` others for sure, if some box holds as many."""
    low, high, rows = (b[boxes[2] >= k] for b in boxes)
    square = np.zeros((len(x), len(low)))
    for d in range(x.shape[1]):
        gap = np.maximum(np.abs(x[:, d, None] - low[:, d]), np.abs(x[:, d, None] - high[:, d]))
        square += gap * gap
    return np.sqrt(square.min(1, initial=np.inf))


def _far(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    square = np.zeros((len(x), len(matrix)))
    for d in range(x.shape[1]):
        gap = x[:, d, None] - matrix[None, :, d]
        square += gap * gap
    return np.sqrt(square)


def _least(far: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least of each row, of equal ones the first."""
    if k >= far.shape[1]:
        return np.broadcast_to(np.arange(far.shape[1]), far.shape)
    at = np.argpartition(far, k - 1, axis=1)[:, :k]
    tied = (far <= np.take_along_axis(far, at[:, -1:], 1)).sum(1) > k
    if tied.any():
        at[tied] = np.argsort(far[tied], axis=1, kind="stable")[:, :k]
    return at


class Cells:
    """A leaf's rows in cells of a few hundred, in each by id."""

    def __init__(self, matrix: np.ndarray, ids: np.ndarray, k: int):
        self.matrix, self.ids, self.tree = matrix, ids, grown(matrix, max(CELL_ROWS, 4 * k))
        own = self.tree.leaves_of(matrix)
        order = np.lexsort((ids, own))
        self.rows = np.split(order, np.flatnonzero(np.diff(own[order])) + 1)
        self.low, self.high = (np.stack([f(matrix[r], 0) for r in self.rows]) for f in (np.min, np.max))
        self.sizes = np.array([len(r) for r in self.rows])

    def nearest(self, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, own row, distance) of the ``k`` nearest of each query among those within its bound, ties by id, in this order."""
        boxes = _box(self.low[None], self.high[None], x[:, None, :])
        first = boxes.argmin(1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bound = np.array(bound)
        self._compare(x, np.arange(len(x)), first, k, bound, found, True)
        if (open_ := np.isinf(bound)).any():
            bound[open_] = _reach((self.low, self.high, self.sizes), x[open_], k)
        boxes[np.arange(len(x)), first] = np.inf
        row, cell = np.nonzero((boxes <= bound[:, None]) & np.isfinite(boxes))
        self._compare(x, row, cell, k, bound, found, False)
        row, at, far = (np.concatenate(c) for c in zip(*found, strict=True))
        own = np.flatnonzero(far <= bound[row])
        own = own[np.lexsort((self.ids[at[own]], far[own], row[own]))]
        start = np.searchsorted(row[own], row[own], "left")
        own = own[np.arange(len(own)) - start < k]
        return row[own], at[own], far[own]

    def _compare(self, x, row, cell, k, bound, found, narrow) -> None:
        order = np.argsort(cell, kind="stable")
        row, cell = row[order], cell[order]
        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(cell)) + 1):
            if len(part):
                rows, q = self.rows[cell[part[0]]], row[part]
                far = _far(x[q], self.matrix[rows])
                at = _least(far, k)
                far = np.take_along_axis(far, at, 1)
                if narrow and at.shape[1] >= k:
                    bound[q] = np.fmin(bound[q], far.max(1))
                good = far <= bound[q][:, None]
                found.append((np.broadcast_to(q[:, None], at.shape)[good], rows[at][good], far[good]))


_FOUND = "q long, parent_id long, label int, distance double, kind int, leaf int, x binary"
_FOUND_SCHEMA = pa.schema([("q", pa.int64()), ("parent_id", pa.int64()), ("label", pa.int32()), ("distance", pa.float64()), ("kind", pa.int32()), ("leaf", pa.int32()), ("x", pa.binary())])


def _sound(columns: list[str], batches):
    """Rows without a gap among ``columns``."""
    for b in batches:
        good = ~np.isnan(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])).any(1)
        yield b.filter(pa.array(good))


def _placed(columns: list[str], trees: dict[int, Tree], of_all: bool, batches):
    """Rows with their leaf, in the tree of their kind or in every one."""
    for b in batches:
        if b.num_rows:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])
            for kind, tree in trees.items():
                at = np.arange(b.num_rows) if of_all else np.flatnonzero(b.column("kind").to_numpy() == kind)
                own = b.take(pa.array(at))
                names = [c for c in b.schema.names if c != "kind"]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(np.full(len(at), kind, np.int32)), pa.array(tree.leaves_of(x[at]).astype(np.int32))], names=[*names, "kind", "leaf"])


def _compared(columns: list[str], k: int, trees: dict[int, Tree], key, queries, parents):
    """Queries against a leaf of parents: the ``k`` nearest of each. With ``trees``: also which other leaves may hold nearer ones, and the bound."""
    kind, leaf = key[0].as_py(), key[1].as_py()
    out = []
    if queries.num_rows and parents.num_rows:
        ids, names = parents.column("i").to_numpy(), queries.column("q").to_numpy()
        cells = Cells(np.column_stack([parents.column(c).to_numpy() for c in columns]), ids, k)
        x = np.column_stack([queries.column(c).to_numpy() for c in columns]) if trees else np.frombuffer(b"".join(queries.column("x").to_pylist()), np.float64).reshape(-1, len(columns))
        limit = np.full(len(x), np.inf) if trees else queries.column("bound").to_numpy()
        for lo in range(0, len(x), QUERY_ROWS):
            part, q = x[lo : lo + QUERY_ROWS], names[lo : lo + QUERY_ROWS]
            row, at, far = cells.nearest(part, k, limit[lo : lo + QUERY_ROWS])
            n = len(row)
            out.append(pa.Table.from_arrays([pa.array(q[row]), pa.array(ids[at]), parents.column("y").take(pa.array(at)), pa.array(far), pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_FOUND_SCHEMA))
            if trees:
                bound = np.where(np.isnan(part).any(1), np.nan, np.inf)
                count = np.bincount(row, minlength=len(part))
                last = np.cumsum(count) - 1
                bound[count >= k] = far[last[count >= k]]
                if (open_ := np.isinf(bound)).any():
                    bound[open_] = _reach(trees[kind].boxes(), part[open_], k)
                row, other = trees[kind].near(part, bound)
                row, other = row[other != leaf], other[other != leaf]
                n = len(row)
                out.append(pa.Table.from_arrays([pa.array(q[row]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(bound[row]), pa.array(np.full(n, kind, np.int32)), pa.array(other.astype(np.int32)), pa.array([part[r].tobytes() for r in row], pa.binary())], schema=_FOUND_SCHEMA))
    return pa.concat_tables(out) if out else _FOUND_SCHEMA.empty_table()


def _met(queries: DataFrame, parents: DataFrame, query_rows: int, compared) -> DataFrame:
    """Every query row with the parents of its (kind, leaf); leaves with many queries are dealt to several tasks."""
    parts = queries.groupBy("kind", "leaf").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))  # a row per leaf
    rows = parts.collect()
    listed = lambda: F.broadcast(queries.sparkSession.createDataFrame(rows, "kind int, leaf int, parts int"))
    ours = queries.join(listed(), ["kind", "leaf"]).withColumn("part", F.expr("cast(pmod(xxhash64(q), parts) as int)"))
    theirs = parents.join(listed(), ["kind", "leaf"]).withColumn("part", F.expr("explode(sequence(0, parts - 1))"))
    return ours.groupBy("kind", "leaf", "part").cogroup(theirs.groupBy("kind", "leaf", "part")).applyInArrow(compared, _FOUND)


def neighbours(query: DataFrame, parent: DataFrame, key: str, parent_key: str, columns: list[str], label: str, k: int, block_rows: int = LEAF_ROWS, query_rows: int = QUERY_BLOCK) -> DataFrame:
    """(key, parent_id, label, distance, place): the ``k`` nearest parent rows of each query, ties by parent id, and
    the nearest of each class (place 0 to k - 1, or k and later where only a class needs it). Exact: of parents at the very same place
    only the first ``k`` of a class can count; the others of each class are split into leaves by a tree grown on a sample. A query is compared
    with its own leaf, and then with just those whose exact box is within the k-th distance found."""
    plain = [f"x{d}" for d in range(len(columns))]
    numbers = [F.col(c).cast("double").alias(x) for c, x in zip(columns, plain, strict=True)]
    kind = F.when(F.col("y") == 0, 0).when(F.col("y") == 1, 1).otherwise(2)
    theirs = parent.select(F.col(parent_key).cast("long").alias("i"), F.col(label).cast("int").alias("y"), *numbers).withColumn("kind", kind)
    theirs = theirs.mapInArrow(partial(_sound, plain), theirs.schema)
    same = Window.partitionBy("kind", *plain).orderBy("i")
    whole = written(theirs.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k).drop("n"), "knn-parents")
    counts = {r["kind"]: r["n"] for r in whole.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row per class
    if not counts:
        raise ValueError("the parent table is empty")
    trees, wide = {}, len(plain)
    for c, n in counts.items():
        leaves = min(LEAVES, -(-n // block_rows))
        sample = whole.where(F.col("kind") == c).select(*plain)
        sample = (sample.sample(min(1.0, LEAVES * SAMPLED / n), 7) if n > LEAVES * SAMPLED else sample).toArrow()  # bounded by the leaves
        trees[c] = grown(np.column_stack([sample.column(x).to_numpy() for x in plain]), max(1, -(-sample.num_rows // leaves)))
    types = ", ".join(["{}", *(f"{x} double" for x in plain), "kind int, leaf int"])
    leaved = written(whole.mapInArrow(partial(_placed, plain, trees, False), types.format("i long, y int")), "knn-leaves")
    deleted(whole)
    ends = leaved.groupBy("kind", "leaf").agg(F.count("*").alias("n"), *[F.min(x).alias(f"l{d}") for d, x in enumerate(plain)], *[F.max(x).alias(f"h{d}") for d, x in enumerate(plain)]).collect()  # a row per leaf
    for c, tree in trees.items():
        low, high, rows = np.full((len(tree.leaf), wide), np.inf), np.full((len(tree.leaf), wide), -np.inf), np.zeros(len(tree.leaf), np.int64)
        for r in ends:
            if r["kind"] == c:
                low[r["leaf"]], high[r["leaf"]], rows[r["leaf"]] = [r[f"l{d}"] for d in range(wide)], [r[f"h{d}"] for d in range(wide)], r["n"]
        tree.fill(low, high, rows)
    asked = query.select(F.col(key).cast("long").alias("q"), *numbers)
    asked = written(asked.mapInArrow(partial(_placed, plain, trees, True), types.format("q long")), "knn-queries")
    first = written(_met(asked, leaved, query_rows, partial(_compared, plain, k, trees)), "knn-first")
    others = first.where("leaf is not null").select("q", "kind", "leaf", F.col("distance").alias("bound"), "x")
    second = _met(others, leaved, query_rows, partial(_compared, plain, k, {}))
    found = first.where("leaf is null").unionByName(second)
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "parent_id")) - 1  # k rows a class and leaf at most
    return found.select(F.col("q").alias(key), "parent_id", "label", "distance", place.alias("place"))


def label_features(found: DataFrame, key: str, counts: list[int], prior: float, smoothing: float = 1.0) -> DataFrame:
    """Per query and count c: smoothed label mean, label mean weighted by 1 / max(distance, 1e-4), mean distance; and
    the least distance, the least to each class, and the margin between these."""
    out = []
    weight = 1.0 / F.greatest(F.col("distance"), F.lit(1e-4))
    for c in counts:
        near = F.col("place") < c
        out += [
            ((F.sum(F.when(near, F.col("label")).otherwise(0)) + prior * smoothing) / (c + smoothing)).alias(f"label_mean_{c}"),
            (F.sum(F.when(near, F.col("label") * weight).otherwise(0.0)) / F.sum(F.when(near, weight).otherwise(0.0))).alias(f"label_weighted_{c}"),
            F.avg(F.when(near, F.col("distance"))).alias(f"distance_mean_{c}"),
        ]
    least = [F.min(F.when(F.col("label") == y, F.col("distance"))).alias(f"distance_class_{y}") for y in (0, 1)]
    own = found.groupBy(key).agg(*out, F.min("distance").alias("distance_min"), *least)
    return own.withColumn("distance_margin", F.col("distance_class_0") - F.col("distance_class_1"))


def parent_features(df: DataFrame, parent: DataFrame, key: str, parent_key: str, columns: list[str], label: str, counts: list[int] | None = None, category_weight: float = 1.25, smoothing: float = 1.0) -> DataFrame:
    """The whole view: checks, metric space, neighbours, statistics; joined to ``df`` by key."""
    counts = sorted(set(counts or [1, 3, 5, 10, 25]))
    absent = [c for c in [*columns, label] if c not in parent.columns]
    if absent:
        raise ValueError(f"the parent table lacks {absent}")
    stats = parent.agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("prior"), F.sum((~F.col(label).cast("double").isin(0.0, 1.0)).cast("int")).alias("odd")).first()
    if stats["odd"]:
        raise ValueError("the parent's target isn't binary")
    if counts[0] < 1 or counts[-1] > stats["n"]:
        raise ValueError(f"neighbour counts {counts} don't fit {stats['n']} parent rows")
    (space, query), names = metric_space(parent, [df], columns, category_weight)
    found = neighbours(query, space, key, parent_key, names, label, counts[-1])
    return df.join(label_features(found, key, counts, stats["prior"], smoothing), key)
