"""Ridge logistic regression by Newton's method, many fits in one pass over the rows.

A fit is a fold left out (or none) and a strength of the loss. An iteration is one job: tasks add up, for every fit at
once, loss, gradient and curvature of their rows; the sums are added in two steps and solved by the driver, which so
gets a matrix of columns by columns a fit, whatever the rows. Columns are scaled, if asked for, by means and deviations
of the fit's own rows. Steps that don't lower the loss are halved, so the optimum is reached from any start.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.plans.lineage import written

TOLERANCE, ITERATIONS = 1e-12, 60
#: Groups that a fit's sums are added up in first.
LANES = 64


@dataclass
class Fit:
    """``weights`` are of the scaled columns, the intercept last; ``gradient`` is the largest part of the gradient at the end."""

    out: int | None
    c: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    gradient: float = float("inf")
    iterations: int = 0
    loss: float = float("inf")

    def plain(self) -> np.ndarray:
        """Weights of the columns as they are, the intercept last."""
        w = self.weights[:-1] / self.scale
        return np.append(w, self.weights[-1] - w @ self.mean)


def moments(df: DataFrame, columns: list[str], fold: str | None) -> dict[int | None, tuple[float, np.ndarray, np.ndarray]]:
    """(rows, means, variances) of each fold."""
    row = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.var_pop(c).alias(f"v{k}") for k, c in enumerate(columns)]]
    found = df.groupBy(F.col(fold).cast("int").alias("fold")).agg(*row) if fold else df.agg(*row).withColumn("fold", F.lit(None).cast("int"))
    pick = lambda r, t: np.array([r[f"{t}{k}"] or 0.0 for k in range(len(columns))], float)
    return {r["fold"]: (float(r["n"]), pick(r, "m"), pick(r, "v")) for r in found.collect()}  # a row per fold


def merged(parts: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several sets of rows together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / max(n, 1.0)
    return n, mean, sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / max(n, 1.0)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of logistic loss over rows with a last column of ones, in one vector."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    loss = np.logaddexp(0, z) - y * z
    return np.concatenate([[loss.sum()], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])


_PART = "fit int, lane int, s binary"


def _passes(columns, fits, lanes, batches):
    from pyspark import TaskContext

    lane = TaskContext.get().partitionId() % lanes
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            raw = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.empty((b.num_rows, 0))
            y, fold = b.column("_y").to_numpy(), b.column("_fold").to_numpy()
            for k, (out, mean, scale, w) in fits.items():
                at = slice(None) if out is None else fold != out
                x = (raw[at] - mean) / scale
                s = sums(np.column_stack([x, np.ones(len(x))]), y[at], w)
                total[k] = total[k] + s if k in total else s
    for k, s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lane], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["fit", "lane", "s"])


def _added(key, table):
    whole = sum(np.frombuffer(s) for s in table.column("s").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["fit", "lane", "s"])


def fit_many(df: DataFrame, columns: list[str], label: str, cases: list[tuple[int | None, float]], fold: str | None = None, scale: bool = True, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> list[Fit]:
    """The optimum of |w|**2 / 2 + c * (sum of logistic losses) for each case (fold left out or None, c); the intercept isn't penalised.
    It is reached where no part of the gradient exceeds ``tolerance`` * (1 + c * rows), or where floats allow no further step."""
    own = written(df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("_y"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold")), "logistic")
    by_fold = moments(own, columns, "_fold")
    fits, rows = [], []
    for out, c in cases:
        n, mean, var = merged([m for k, m in by_fold.items() if out is None or k != out] or [(0.0, np.zeros(len(columns)), np.zeros(len(columns)))])
        dev = np.sqrt(var)
        fits.append(Fit(out, c, mean if scale else np.zeros(len(columns)), np.where(dev > 0, dev, 1.0) if scale else np.ones(len(columns)), np.zeros(len(columns) + 1)))
        rows.append(n)
    size = len(columns) + 1
    ridge = np.append(np.ones(size - 1), 0.0)
    at = [f.weights.copy() for f in fits]
    steps: list[np.ndarray | None] = [None] * len(fits)
    going = {k for k in range(len(fits)) if rows[k]}
    for i in range(iterations):
        if not going:
            break
        asked = {k: (fits[k].out, fits[k].mean, fits[k].scale, at[k]) for k in going}
        parts = own.mapInArrow(partial(_passes, columns, asked, LANES), _PART).groupBy("fit", "lane").applyInArrow(_added, _PART)
        for r in parts.groupBy("fit").applyInArrow(_added, _PART).collect():  # a row per fit
            k, s = r["fit"], np.frombuffer(r["s"])
            f = fits[k]
            loss = f.c * s[0] + (ridge * at[k] ** 2).sum() / 2
            if loss > f.loss + 1e-12 * abs(f.loss) and steps[k] is not None and np.abs(steps[k]).max() > 1e-12:
                steps[k] = steps[k] / 2  # too far
                at[k] = f.weights + steps[k]
                continue
            gradient = f.c * s[1 : size + 1] + ridge * at[k]
            f.weights, f.loss, f.gradient, f.iterations = at[k], loss, float(np.abs(gradient).max()), i + 1
            if f.gradient <= tolerance * (1 + f.c * rows[k]):
                going.discard(k)
                continue
            curve = f.c * s[size + 1 :].reshape(size, size) + np.diag(ridge + 1e-12)
            steps[k] = -np.linalg.solve(curve, gradient)
            at[k] = f.weights + steps[k]
            if np.abs(steps[k]).max() <= 1e-13 * (1 + np.abs(f.weights).max()):
                going.discard(k)
    return fits


def probability(columns: list[str], weights: Column) -> Column:
    """The logistic function of columns times ``weights``, an array with the intercept last."""
    z = F.aggregate(F.zip_with(F.array(*[F.col(c).cast("double") for c in columns], F.lit(1.0)), weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def scored(df: DataFrame, keys: list[str], columns: list[str], fits: list[Fit], fold: str | None = None, tag: str | None = None, name: str = "score") -> DataFrame:
    """Scores of each row by the fit that left its fold out (``fold``), or by every fit, told apart by its place in ``tag``."""
    w = F.array(*[F.struct(F.lit(k).alias("_fit"), F.lit(f.out).cast("int").alias("_out"), F.array(*[F.lit(float(x)) for x in f.plain()]).alias("_w")) for k, f in enumerate(fits)])
    own = df.withColumn("_f", F.explode(F.filter(w, lambda f: f["_out"] == F.col(fold).cast("int")) if fold else w)).select("*", "_f._fit", "_f._w")
    return own.select(*keys, *([F.col("_fit").alias(tag)] if tag else []), probability(columns, F.col("_w")).alias(name))
