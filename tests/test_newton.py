"""Newton's method against the optimum's own conditions, and greedy rounds against a plain search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.operators import blend, newton, stack


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1.0, 50.0, 0.01] + [0.0, 300.0, 5.0]
    y = (x[:, 0] + (x[:, 1] - 300) / 40 + rng.logistic(size=500) > 0.4).astype(int)
    rows = [(i, int(y[i]), i % 4, *map(float, x[i]), 7.0) for i in range(500)]
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double, same double"), x, y


def at_optimum(x, y, w, c):
    """The gradient of |w|**2 / 2 + c * loss by central differences."""
    full = np.column_stack([x, np.ones(len(x))])
    value = lambda v: (v[:-1] ** 2).sum() / 2 + c * (np.logaddexp(0, full @ v) - y * (full @ v)).sum()
    step = 1e-4 / np.maximum(np.abs(full).mean(0), 1e-2)
    return [(value(w + e) - value(w - e)) / (2 * e.sum()) for e in np.diag(step)]


@pytest.mark.parametrize("scale", [True, False])
def test_fits_are_optima(table, scale):
    df, x, y = table
    x = np.column_stack([x, np.full(500, 7.0)])
    cases = [(None, 1.0), (0, 0.05), (3, 20.0)]
    for f in newton.fit_many(df, ["a", "b", "c", "same"], "y", cases, "fold", scale):
        own = np.arange(500) % 4 != f.out if f.out is not None else np.ones(500, bool)
        z = (x[own] - x[own].mean(0)) / np.where(x[own].std(0) > 1e-12, x[own].std(0), 1) if scale else x[own]
        assert f.gradient <= 1e-8 * (1 + f.c * own.sum()) and f.iterations <= 30
        scale_of = 1e-6 * (1 + f.c * np.abs(np.column_stack([z, np.ones(len(z))])).sum(0))
        assert (np.abs(at_optimum(z, y[own], f.weights, f.c)) <= scale_of).all()
        raw = np.append(f.weights[:-1] / f.scale, f.weights[-1] - (f.weights[:-1] / f.scale) @ f.mean)
        assert f.plain() == pytest.approx(raw)


def test_far_start_is_reached_by_halving(spark):
    rows = [(i, int(i >= 50), 0.001 * i + (1e6 if i == 99 else 0.0)) for i in range(100)]
    f = newton.fit_many(spark.createDataFrame(rows, "id long, y int, a double"), ["a"], "y", [(None, 1e6)], scale=False)[0]
    assert np.isfinite(f.weights).all() and f.gradient <= 1e-6 * (1 + 1e8)


def test_cross_fits_and_grid(spark, table):
    df, x, y = table
    got = {r["id"]: r["score"] for r in stack.cross_fitted(df, ["id"], ["a", "b"], "y").collect()}
    for k in range(4):
        own = np.arange(500) % 4 != k
        (f,) = newton.fit_many(df.where(F.col("fold") != k), ["a", "b"], "y", [(None, 1.0)])
        z = x[~own][:, :2] @ f.plain()[:-1] + f.plain()[-1]
        assert [got[i] for i in np.flatnonzero(~own)] == pytest.approx(1 / (1 + np.exp(-z)))
    c, auc, scores = stack.best_of_grid(df, ["id"], ["a", "b", "c"], "y", [0.001, 1.0])
    assert c in (0.001, 1.0) and 0.7 < auc < 1 and scores.count() == 500 and scores.columns == ["id", "y", "score"]
    one = df.where("y = 1")
    c, auc, scores = stack.best_of_grid(one, ["id"], ["a"], "y", [0.5, 1.0])
    assert (c, auc, scores.count()) == (0.5, None, one.count())  # one class only: no AUC, the first c


def plain_search(ranks, y, steps, gain):
    auc = lambda s: np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    chosen, total, last = dict.fromkeys(ranks, 0), 0, None
    for _ in range(steps):
        found = {m: auc(total + r) for m, r in ranks.items()}
        best = max(ranks, key=lambda m: found[m])
        if last is not None and found[best] < last + gain:
            break
        chosen[best], total, last = chosen[best] + 1, total + ranks[best], found[best]
    return {m: n / sum(chosen.values()) for m, n in chosen.items()}


def test_stable_weights_equal_a_plain_search(spark):
    rng = np.random.default_rng(6)
    y = (np.arange(120) % 3 == 0).astype(int)
    cols = {m: np.round(y * s + rng.random(120), 1) for m, s in (("p", 0.5), ("q", 0.4), ("r", -0.2))}
    rows = [(i, int(y[i]), *(float(v[i]) for v in cols.values())) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, p double, q double, r double")
    parts = blend.stratified_subsample(df, "id", "y", 0.7, 60, 3, 5).collect()
    weights = []
    for k in range(3):
        own = np.array([r["id"] for r in parts if r["round"] == k])
        assert len(own) == 60
        ranks = {m: np.array([(v[own] < a).sum() + ((v[own] == a).sum() + 1) / 2 for a in v[own]]) for m, v in cols.items()}
        weights.append(plain_search(ranks, y[own], 8, 1e-6))
    got = {r["model"]: r for r in blend.stable_weights(df, "id", "y", list(cols), 3, 0.7, 60, steps=8, seed=5).collect()}
    for m in cols:
        own = np.array([w[m] for w in weights])
        assert (got[m]["frequency"], got[m]["mean"], got[m]["deviation"]) == pytest.approx(((own > 0).mean(), own.mean(), own.std()))
    assert sum(r["weight"] for r in got.values()) == pytest.approx(1)


def test_greedy_weights_equal_a_plain_search(spark):
    rng = np.random.default_rng(7)
    y = (np.arange(90) % 4 == 0).astype(int)
    cols = {m: np.round(y * s + rng.random(90), 2) for m, s in (("p", 0.4), ("q", 0.35))}
    df = spark.createDataFrame([(i, int(y[i]), *(float(v[i]) for v in cols.values())) for i in range(90)], "id long, y int, p double, q double")
    ranks = {m: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v]) for m, v in cols.items()}
    weights, _ = blend.greedy_weights(df, "id", "y", list(cols), 5)
    assert weights == pytest.approx({m: w for m, w in plain_search(ranks, y, 5, 1e-6).items() if w})


def test_nonlinear_meta(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 360)
    a, b = rng.normal(size=360) + 0.8 * y, rng.normal(size=360) - 0.8 * y
    rows = [(i, int(y[i]), i % 3, float(a[i]), float(b[i]), None if i % 5 == 0 else 1.0) for i in range(360)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, `m.a` double, mb double, raw double").withColumnRenamed("m.a", "ma")
    scores, report = stack.nonlinear_meta(df, "id", ["ma", "mb"], ["raw"], "y", params={"rounds": 6, "depth": 2, "patience": None})
    assert scores.count() == report["rows"] == 360 and [f["rounds"] for f in report["folds"]] == [6, 6, 6] and report["auc"] > 0.65
    assert report["width"] == 2 + 3 + 3 + 2 and report["folds"][0]["rows"] == 120 and {c for c, _ in report["importance"]} >= {"ma", "mb", "logit_q50", "raw__missing"}
    part, report = stack.nonlinear_meta(df, "id", ["ma", "mb"], ["raw"], "y", only=[1], params={"rounds": 3, "depth": 2, "every": 2, "patience": 1})
    assert {r["fold"] for r in part.collect()} == {1} and part.count() == 120 and len(report["folds"]) == 1
