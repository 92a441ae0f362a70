"""Boosted trees on histograms, many models at once: missing values find their own side, rounds stop by validation AUC.

Values become codes of quantile bins once, a missing value a code of its own, and rows blocks of a model's codes, feature
by feature. A level of a tree is one job for all models: tasks send their rows down the tree so far, add gradients up by
(model, node, feature, code), and the sums of a node are searched for the best split in one small group, with missing values
tried on both sides. Only splits come to the driver, a row per model and node. Gradients are summed in whole numbers, so that
the order of rows and tasks can't change a tree. Margins and gradients are written once a tree, so that no level works out
an older tree again. Validation rows are apart; their exact AUC of each round, found for some rounds together, decides which
number of rounds a model keeps, and when it stops.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.operators import exact_auc
from sparkrank.operators.ordered import fold_statistics
from sparkrank.plans.lineage import deleted, written

#: Gradients are whole multiples of one part of this.
SCALE = 1 << 24
PARAMS = {"rounds": 60, "depth": 4, "rate": 0.15, "bins": 64, "ridge": 1.0, "least": 10, "patience": 10, "every": 10, "row_share": 1.0, "column_share": 1.0, "gain": 1e-9}


@dataclass
class Tree:
    """Node n has children 2n and 2n + 1; ``feature`` is -1 at leaves. Codes up to ``code`` go left, missing ones if ``left`` says so."""

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def root(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n))

    def nodes(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The leaf of each row of codes; ``missing`` is each feature's code of a missing value."""
        return self.leaves(np.ascontiguousarray(x.T), missing)

    def leaves(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """:meth:`nodes` of codes that lie feature by feature."""
        inner, f = self.feature >= 0, np.maximum(self.feature, 0)
        code, here = np.arange(256), np.arange(len(f))[:, None]
        left = np.where(code == missing[f][:, None], self.left[:, None], code <= self.code[:, None])
        following = np.where(inner[:, None], 2 * here + ~left, here).ravel()  # by node and code
        n, steps = x.shape[1], int(np.flatnonzero(inner).max(initial=0)).bit_length()
        if not steps:
            return np.ones(n, np.int64)
        at, rows, flat, start = following[256 + x[f[1]].astype(np.int64)], np.arange(n), x.ravel(), f * n
        for _ in range(steps - 1):
            at = following[(at << 8) + flat[start[at] + rows]]
        return at


@dataclass
class Boosted:
    """Fitted models: trees, base margin, the number of trees kept, validation AUC by round, gain by feature."""

    columns: list[str]
    marks: list[np.ndarray]
    params: dict
    trees: dict[int, list[Tree]] = field(default_factory=dict)
    base: dict[int, float] = field(default_factory=dict)
    best: dict[int, int] = field(default_factory=dict)
    history: dict[int, list[float | None]] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=dict)

    @property
    def missing(self) -> np.ndarray:
        return np.array([len(m) + 1 for m in self.marks])

    def importance(self) -> list[tuple[str, float]]:
        whole = sum(self.gains.values()) or 1.0
        return sorted(((c, self.gains.get(c, 0.0) / whole) for c in self.columns), key=lambda r: (-r[1], r[0]))


def quantile_marks(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Up to ``bins`` - 1 marks a column, values of its own: a value's code is the number of marks below it."""
    ready = rows.select(*[F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) for c in columns])
    row = ready.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(c) for c in columns]).first()
    return [np.unique(np.array(row[c] or [], np.float64)) for c in columns]


def coded(x: np.ndarray, marks: list[np.ndarray]) -> np.ndarray:
    """Codes of a matrix with NaN for missing values; infinities are missing too."""
    out = np.empty(x.shape, np.uint8)
    for k, m in enumerate(marks):
        out[:, k] = np.where(np.isfinite(x[:, k]), np.searchsorted(m, x[:, k], "left"), len(m) + 1)
    return out


#: Rows of a block.
BLOCK_ROWS = 1 << 15
_BLOCK = "model int, part int, rows int, key binary, y binary, x binary, margin binary, g binary, h binary"
_TRAINED, _JUDGED = ["model", "rows", "key", "y", "x", "margin", "g", "h"], ["model", "rows", "y", "x", "margin"]
_BLOCKS = pa.schema([("model", pa.int32()), ("part", pa.int32()), ("rows", pa.int32()), *((c, pa.binary()) for c in ("key", "y", "x", "margin", "g", "h"))])


def _block(model: int, part: int, key: np.ndarray, y: np.ndarray, x: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    """Rows of one model, and their gradients if it trains on them; ``x`` lies feature by feature."""
    g, h = gradients(margin, y) if part == 0 else (np.empty(0), np.empty(0))
    values = (key, y, x, margin, g.astype(np.int32), h.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (model, part, len(y))] + [pa.array([v.tobytes()], pa.binary()) for v in values], schema=_BLOCKS)


def _code(columns, marks, base, keyed, batches):
    held: dict[tuple[int, int], list] = {}
    whole = lambda m, p, parts: _block(m, p, *(np.concatenate(c) for c in list(zip(*parts, strict=True))[:2]), np.concatenate([c[2] for c in parts]).T.copy(), np.full(sum(len(c[1]) for c in parts), base[m]))
    for b in batches:
        if b.num_rows:
            x = coded(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]), marks)
            models, part, y = b.column("model").to_numpy(), b.column("part").to_numpy(), b.column("y").to_numpy()
            key = b.column("key").to_numpy()
            for m, p in {*zip(models.tolist(), part.tolist(), strict=True)}:
                at = np.flatnonzero((models == m) & (part == p))
                held.setdefault((m, p), []).append((key[at] if keyed else key[:0], y[at], x[at]))
                if sum(len(c[1]) for c in held[m, p]) >= BLOCK_ROWS:
                    yield whole(m, p, held.pop((m, p)))
    for (m, p), parts in held.items():
        yield whole(m, p, parts)


def _read(b: pa.RecordBatch, width: int):
    """(model, rows, a reader of a column's numbers) of each block."""
    kinds = {"x": np.uint8, "g": np.int32, "h": np.int32, "key": np.int64}
    for i, (m, n) in enumerate(zip(b.column("model").to_pylist(), b.column("rows").to_pylist(), strict=True)):
        numbers = lambda c, i=i: np.frombuffer(b.column(c)[i].as_buffer(), kinds.get(c, np.float64))
        yield m, n, lambda c, n=n, numbers=numbers: numbers(c).reshape(width, n) if c == "x" else numbers(c)


def _drawn(key: np.ndarray, round_: int, seed: int, share: float) -> np.ndarray:
    """A share of the rows, anew each round, by a mix of the row's hash."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64((round_ * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64 < share


_SUMS = "model int, node int, s binary"


def gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss in whole parts of ``SCALE``."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    return np.rint((p - y) * SCALE).astype(np.int64), np.rint(p * (1 - p) * SCALE).astype(np.int64)


def _histograms(growing, open_nodes, missing, round_, seed, share, batches):
    """Sums over a task's rows by model and node: gradients, curvatures and rows by feature and code, in one array."""
    width, codes = len(missing), int(missing.max()) + 1
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for m, _, read in _read(b, width):
            if m not in open_nodes:
                continue
            x, g, h = read("x"), read("g"), read("h")
            if share < 1:
                at = np.flatnonzero(_drawn(read("key"), round_, seed, share))
                x, g, h = np.ascontiguousarray(x[:, at]), g[at], h[at]
            place = np.full(len(growing[m].feature), -1)
            place[open_nodes[m]] = np.arange(len(open_nodes[m]))
            node = place[growing[m].leaves(x, missing)]
            inside = node >= 0
            if not inside.all():
                x, g, h, node = x[:, inside], g[inside], h[inside], node[inside]
            start, g, h, size = node * codes, g.astype(np.float64), h.astype(np.float64), len(open_nodes[m]) * codes
            sums = total.setdefault(m, np.zeros((len(open_nodes[m]), 3, width, codes), np.int64))
            for f in range(width):
                spot = start + x[f]
                for k, v in enumerate((g, h, None)):  # sums of a block are whole numbers far below 2 ** 53
                    sums[:, k, f] += np.bincount(spot, v, size).astype(np.int64).reshape(-1, codes)
    for m, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([m] * len(sums), pa.int32()), pa.array(open_nodes[m], pa.int32()), pa.array([v.tobytes() for v in sums], pa.binary())], names=["model", "node", "s"])


def best_split(feature, code, g, h, n, missing, ridge: float, least: int, allowed=None) -> tuple | None:
    """(feature, code, missing go left, gain, (G, H) left, (G, H) right) of a node's histograms; the first of equal gains by
    feature, missing to the right first, then by code. None if no split has ``least`` rows on both sides."""
    width, codes = len(missing), int(missing.max()) + 1
    sums = np.zeros((3, width, codes), np.int64)
    for k, v in enumerate((g, h, n)):
        np.add.at(sums[k], (feature, code), v)
    rows = np.arange(width)
    gap = sums[:, rows, missing].copy()  # of missing values
    sums[:, rows, missing] = 0
    whole = (sums.sum(2) + gap)[:, 0]
    low = np.cumsum(sums, 2)
    worth = lambda s: (s[0] / SCALE) ** 2 / (s[1] / SCALE + ridge)
    best = None
    for side in (0, 1):
        left = low + gap[:, :, None] * side
        right = whole[:, None, None] - left
        gain = worth(left) + worth(right) - worth(whole)
        gain[(left[2] < least) | (right[2] < least) | (np.arange(codes)[None, :] >= missing[:, None])] = -np.inf
        if allowed is not None:
            gain[~allowed] = -np.inf
        for f in range(width):
            c = int(gain[f].argmax())
            if gain[f, c] > -np.inf and (best is None or (-gain[f, c], f, side) < (-best[3], best[0], best[2])):
                best = (f, c, side, float(gain[f, c]), tuple(left[:2, f, c] / SCALE), tuple(right[:2, f, c] / SCALE))
    return best


_SPLITS = "model int, node int, feature int, code int, left int, gain double, gl double, hl double, gr double, hr double"


def _split(missing, ridge, least, allowed, key, table):
    sums = sum(np.frombuffer(s, np.int64) for s in table.column("s").to_pylist()).reshape(3, len(missing), -1)
    feature, code = np.nonzero(sums[2])
    found = best_split(feature, code, *sums[:, feature, code], missing, ridge, least, allowed)
    names = [x.split()[0] for x in _SPLITS.split(", ")]
    kinds = [pa.int32()] * 5 + [pa.float64()] * 5
    if found is None:
        return pa.table([pa.array([], k) for k in kinds], names=names)
    values = [key[0].as_py(), key[1].as_py(), found[0], found[1], found[2], found[3], *found[4], *found[5]]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _advance(trees, missing, batches):
    """Blocks with margins and gradients after one more tree."""
    for b in batches:
        for m, _, read in _read(b, len(missing)):
            x, tree = read("x"), trees[m]
            yield _block(m, 0, read("key"), read("y"), x, read("margin") + tree.value[tree.leaves(x, missing)])


_STEPS = "model int, rows int, y binary, x binary, margin binary, steps binary"


def _judge(newer, missing, batches):
    """Validation blocks with their margins after ``newer`` trees, and after each of them."""
    for b in batches:
        for m, n, read in _read(b, len(missing)):
            x, margin, after = read("x"), read("margin"), []
            for tree in newer[m]:
                margin = margin + tree.value[tree.leaves(x, missing)]
                after.append(margin)
            values = (read("y"), x, margin, np.array(after))
            yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([n], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=[c.split()[0] for c in _STEPS.split(", ")])


def _ends(ranges, steps, batches):
    """Quantiles of each round's margins in a task's first block of each model."""
    seen = set()
    for b in batches:
        for m, n, read in _read(b, 1):
            if m not in seen:
                seen.add(m)
                said = [exact_auc.quantiles(s, ranges) for s in read("steps").reshape(steps, n)]
                yield pa.RecordBatch.from_arrays([pa.array([m] * steps, pa.int32()), pa.array(range(steps), pa.int32()), pa.array([v.tobytes() for v in said], pa.binary())], names=["model", "step", "s"])


#: Rows of a model that a task counts by margin at once.
PACKET_ROWS = 1 << 18


def _packets(marks, steps, batches):
    held: dict[int, list] = {}

    def sent(m, parts):
        y = np.concatenate([p[0] for p in parts])
        for k in range(steps):
            yield exact_auc.packets({(m, k): (np.concatenate([p[1][k] for p in parts]), y)}, marks)

    for b in batches:
        for m, n, read in _read(b, 1):
            held.setdefault(m, []).append((read("y").copy(), read("steps").reshape(steps, n).copy()))  # else all of the batch stays
            if sum(len(p[0]) for p in held[m]) >= PACKET_ROWS:
                yield from sent(m, held.pop(m))
    for m, parts in held.items():
        yield from sent(m, parts)


def _judgements(judged: DataFrame, steps: int, rows: int) -> dict[tuple[int, int], float | None]:
    """The exact AUC of each model after each of the newer ``steps`` rounds; ``rows``: the most that a model is judged by."""
    ranges, marks = max(1, -(-rows // exact_auc.RANGE_ROWS)), {}
    own = judged.select("model", "rows", "y", "steps")
    if ranges > 1:
        said: dict[tuple[int, int], list] = {}
        for r in own.mapInArrow(partial(_ends, ranges, steps), "model int, step int, s binary").collect():  # a row per task, model and round
            said.setdefault((r["model"], r["step"]), []).append(np.frombuffer(r["s"]))
        marks = {at: exact_auc.marks_of(s, ranges) for at, s in said.items()}
    return exact_auc.aucs(own.mapInArrow(partial(_packets, marks, steps), exact_auc.PACKETS))


def fit_many(rows: DataFrame, columns: list[str], label: str, id_col: str, model: str = "model", part: str = "part", params: dict | None = None, seed: int = 42) -> Boosted:
    """Fits a model for each value of the int column ``model`` on its rows with ``part`` 0; those with ``part`` 1 choose the number of
    rounds (without any, all rounds are kept), others take no part. Features are numbers that may be missing."""
    p = PARAMS | (params or {})
    if unknown := set(p) - set(PARAMS):
        raise ValueError(f"unknown settings {sorted(unknown)}")
    if not 2 <= p["bins"] <= 254:
        raise ValueError("bins are 2 to 254")
    # Nulls reach the tasks as NaN.
    own = rows.select(F.col(model).cast("int").alias("model"), F.col(part).cast("int").alias("part"), F.xxhash64(id_col).alias("key"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    out = Boosted(columns, quantile_marks(own.where("part = 0"), columns, p["bins"]), p)
    missing = out.missing
    rows_judged = 0
    for r in own.where("part in (0, 1)").groupBy("model").agg(F.avg(F.when(F.col("part") == 0, F.col("y"))).alias("rate"), F.sum("part").alias("judged")).collect():  # a row per model
        rate = min(max(r["rate"] if r["rate"] is not None else 0.5, 1e-6), 1 - 1e-6)
        m, rows_judged = r["model"], max(rows_judged, r["judged"])
        out.base[m], out.trees[m], out.best[m], out.history[m] = float(np.log(rate / (1 - rate))), [], 0 if r["judged"] else p["rounds"], []
    own = own.where("part in (0, 1)").withColumn("y", F.coalesce("y", F.lit(0.0)))
    code = partial(_code, columns, out.marks, out.base, p["row_share"] < 1)
    train, judged = (written(own.where(F.col("part") == k).mapInArrow(code, _BLOCK).select(*kept), "boosting", packed=True) for k, kept in enumerate((_TRAINED, _JUDGED)))
    going, done = set(out.base), 0
    while going and done < p["rounds"]:
        newer: dict[int, list[Tree]] = {m: [] for m in out.base}
        rounds = min(p["every"], p["rounds"] - done)
        for k in range(rounds):
            grown = _grow(train, sorted(going), missing, p, done + k, seed, out)
            for m in going:
                newer[m].append(grown[m])
                out.trees[m].append(grown[m])
            if done + k + 1 < p["rounds"]:
                last, train = train, _next(train, partial(_advance, grown, missing), _BLOCK, sorted(going))
                deleted(last)
        done += rounds
        if rows_judged:
            last, judged = judged, _next(judged, partial(_judge, newer, missing), _STEPS, sorted(going))
            deleted(last)
            for (m, _), auc in sorted(_judgements(judged, rounds, rows_judged).items()):
                out.history[m].append(auc)
        for m in sorted(going):
            auc = [-1.0 if a is None else a for a in out.history[m]]
            if auc and p["patience"] is None:
                out.best[m] = len(auc)
            elif auc:
                out.best[m] = int(np.argmax(auc)) + 1
                if len(auc) - out.best[m] >= p["patience"]:
                    going.discard(m)
    deleted(train)
    deleted(judged)
    return out


def _next(blocks: DataFrame, fn, schema: str, going: list[int]) -> DataFrame:
    """The blocks of ``going`` as ``fn`` makes them, written; a block is a large row, so few of them go together."""
    return written(blocks.where(F.col("model").isin(going)).mapInArrow(fn, schema), "boosting", packed=True)


def _grow(train: DataFrame, going: list[int], missing: np.ndarray, p: dict, round_: int, seed: int, out: Boosted) -> dict[int, Tree]:
    """One tree for each of ``going``, a job a level."""
    growing = {m: Tree.root(p["depth"]) for m in going}
    open_nodes: dict[int, list[int]] = {m: [1] for m in going}
    allowed = None
    if p["column_share"] < 1:
        allowed = np.zeros(len(missing), bool)
        allowed[np.random.default_rng((seed, round_)).permutation(len(missing))[: max(1, round(p["column_share"] * len(missing)))]] = True
    rows = train.select("model", "rows", "x", "g", "h", *(["key"] if p["row_share"] < 1 else []))
    for level in range(p["depth"]):
        fn = partial(_histograms, growing, open_nodes, missing, round_, seed, p["row_share"])
        found = rows.mapInArrow(fn, _SUMS).groupBy("model", "node").applyInArrow(partial(_split, missing, p["ridge"], p["least"], allowed), _SPLITS).collect()  # a row per model and node
        following: dict[int, list[int]] = {}
        for r in sorted(found, key=lambda r: (r["model"], r["node"])):
            if r["gain"] <= p["gain"]:
                continue
            tree, at = growing[r["model"]], r["node"]
            tree.feature[at], tree.code[at], tree.left[at] = r["feature"], r["code"], bool(r["left"])
            tree.value[2 * at], tree.value[2 * at + 1] = (-p["rate"] * r[f"g{s}"] / (r[f"h{s}"] + p["ridge"]) for s in "lr")
            out.gains[out.columns[r["feature"]]] = out.gains.get(out.columns[r["feature"]], 0.0) + r["gain"]
            following.setdefault(r["model"], []).extend((2 * at, 2 * at + 1))
        open_nodes = following
        if not open_nodes or level == p["depth"] - 1:
            break
    return growing


def _score(columns, marks, missing, base, trees, batches):
    for b in batches:
        if b.num_rows:
            x = coded(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns]), marks)
            models, f = b.column("model").to_numpy(), np.zeros(b.num_rows)
            for m in np.unique(models):
                at = np.flatnonzero(models == m)
                own = x[at].T.copy()
                f[at] = base[int(m)] + sum((t.value[t.leaves(own, missing)] for t in trees[int(m)]), np.zeros(len(at)))
            kept = [k for k, c in enumerate(b.schema.names) if c.startswith("_key")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(1 / (1 + np.exp(-np.clip(f, -500, 500))))], names=[*(b.schema.names[k] for k in kept), "score"])


def predict(fitted: Boosted, rows: DataFrame, keys: list[str], model: str = "model") -> DataFrame:
    """``keys`` and ``score`` of each row by its model's kept rounds."""
    kinds = dict(rows.dtypes)
    own = rows.select(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], F.col(model).cast("int").alias("model"), *[F.col(c).cast("double").alias(c) for c in fitted.columns])
    kept = {m: t[: fitted.best[m]] for m, t in fitted.trees.items()}
    schema = ", ".join([*(f"_key{j} {kinds[k]}" for j, k in enumerate(keys)), "score double"])
    out = own.mapInArrow(partial(_score, fitted.columns, fitted.marks, fitted.missing, fitted.base, kept), schema)
    return out.select(*[F.col(f"_key{j}").alias(k) for j, k in enumerate(keys)], "score")


def boosted_out_of_fold(train: DataFrame, test: DataFrame | None, id_col: str, columns: list[str], label: str, fold: str = "fold", categories: list[str] | None = None, params: dict | None = None, seed: int = 42, only: list[int] | None = None) -> tuple[DataFrame, DataFrame | None, Boosted]:
    """Out-of-fold scores (id, score) of ``train``, mean scores of ``test`` over the folds' models, and the models, all folds (or ``only`` some) at once. Each
    fold's rows choose its model's rounds. ``categories`` are read as ordered target statistics of the fold's own training rows."""
    categories = categories or []
    rows = train if hasattr(train, "_sparkrank_path") else written(train, "boosted")  # a row once, not once a model
    folds = sorted(r[fold] for r in rows.select(fold).distinct().collect() if only is None or r[fold] in only)  # a row per fold
    if categories:
        rows, test = fold_statistics(rows, test, id_col, label, categories, fold, folds, seed=seed)
        rows, test = written(rows, "boosted"), test if test is None else written(test, "boosted")
    models = [F.struct(F.lit(int(m)).alias("model"), *[F.col(f"_t{c}_{k}").alias(f"{name}__ts") for c, name in enumerate(categories)]) for k, m in enumerate(folds)]
    features = [*columns, *[f"{c}__ts" for c in categories]]
    each = lambda df, *more: df.select(id_col, *more, *columns, F.explode(F.array(*models)).alias("_m"))
    parts = each(rows, label, fold).select(id_col, label, "_m.model", F.when(F.col(fold) == F.col("_m.model"), 1).otherwise(0).alias("part"), *columns, *[f"_m.{c}__ts" for c in categories])
    if test is not None:
        theirs = test.select("*", *[F.lit(None).cast("double").alias(c) for c in columns if c not in test.columns])
        parts = parts.unionByName(each(theirs).select(id_col, F.lit(None).alias(label), "_m.model", F.lit(2).alias("part"), *columns, *[f"_m.{c}__ts" for c in categories]))
    fitted = fit_many(parts, features, label, id_col, params=params, seed=seed)
    oof = predict(fitted, parts.where("part = 1"), [id_col])
    if test is None:
        return oof, None, fitted
    return oof, predict(fitted, parts.where("part = 2"), [id_col]).groupBy(id_col).agg(F.avg("score").alias("score")), fitted
