"""Gradients of the factorization machine and the cross network against finite differences, codes, and what both learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.operators import cross_net, rank_fm
from sparkrank.operators.ranking import roc_auc


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    design = rank_fm.Design(["a", "b", "t"], ["a", "b"], [5, 4, 3], np.zeros(2), np.ones(2))
    theta = rank_fm.fresh(design, rank_fm.PARAMS | {"width": 3, "frequencies": 2}, 1)
    theta = {c: v + 0.2 * rng.normal(size=v.shape) for c, v in theta.items()}
    codes = np.column_stack([rng.integers(0, n, 9) + o for n, o in zip(design.sizes, design.offsets, strict=True)])
    values, missing, y = rng.normal(size=(9, 2)), rng.random((9, 2)) < 0.3, rng.integers(0, 2, 9).astype(float)
    pairs = (np.array([0, 1, 2]), np.array([3, 4, 5]))
    loss = lambda t: rank_fm.pulls(rank_fm.forward(t, codes, values, missing)[0], y, pairs, 0.7, 9, 3)[0]
    score, kept = rank_fm.forward(theta, codes, values, missing)
    got = rank_fm.flat(rank_fm.backward(theta, codes, values, missing, kept, rank_fm.pulls(score, y, pairs, 0.7, 9, 3)[1]))
    at = rank_fm.flat(theta)
    want = [(loss(rank_fm.unflat(at + e, theta)) - loss(rank_fm.unflat(at - e, theta))) / 2e-6 for e in 1e-6 * np.eye(len(at))]
    assert got == pytest.approx(want, abs=1e-7)


def test_output_is_the_sum_over_pairs():
    rng = np.random.default_rng(4)
    design = rank_fm.Design(["a", "t"], ["a"], [3, 3], np.zeros(1), np.ones(1))
    theta = rank_fm.fresh(design, rank_fm.PARAMS, 2)
    theta["linear"] = rng.normal(size=6)
    codes, values, missing = np.array([[1, 4], [2, 5]]), np.array([[0.3], [0.0]]), np.array([[False], [True]])
    tokens = theta["embed"][codes]
    wave = np.concatenate([np.sin(2 * np.pi * 0.3 * theta["frequency"][0]), np.cos(2 * np.pi * 0.3 * theta["frequency"][0])])
    tokens[0, 0] += wave @ theta["project"][0] + theta["shift"][0]
    want = [theta["bias"][0] + theta["linear"][codes[i]].sum() + tokens[i, 0] @ tokens[i, 1] for i in range(2)]
    assert rank_fm.forward(theta, codes, values, missing)[0] == pytest.approx(want)


def test_pairs_take_each_row_once():
    y = np.array([1, 0, 0, 1, 0, 1, 0, 0.0])
    a, b = rank_fm.drawn_pairs(y, np.random.default_rng(1))
    assert len(a) == len(b) == 3 and (y[a] == 1).all() and (y[b] == 0).all() and len(set(a)) == len(set(b)) == 3


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x, t = rng.random(600), rng.integers(0, 3, 600)
    y = (((x * 4).astype(int) + t) % 2 == 0) ^ (rng.random(600) < 0.1)  # only both together say something
    rows = [(i, int(y[i]), i % 3, None if i % 29 == 0 else float(x[i]), None if i % 31 == 0 else "abc"[t[i]]) for i in range(600)]
    return spark.createDataFrame(rows, "id long, y int, fold int, x double, t string")


def test_design(spark, table):
    design, rows = rank_fm.designed(table, table.where("id < 20"), "id", "y", "fold", ["x"], ["t"], rank_fm.PARAMS | {"batch": 200})
    assert design.fields == ["x", "t"] and design.sizes == [21, 5] and design.offsets.tolist() == [0, 21]  # values of both tables are counted
    got = {(r["id"], r["part"]): r for r in rows.collect()}
    assert len(got) == 620 and {r["batch"] for (_, part), r in got.items() if part == 0} == {0, 1, 2} and all(r["batch"] == -1 for (_, part), r in got.items() if part)
    assert got[0, 0]["c0"] == 0 and got[1, 0]["c0"] == got[1, 1]["c0"] >= 2 and got[100, 0]["c0"] == 1 and got[31, 0]["c1"] == 21 and {r["c1"] for r in got.values()} == {21, 23, 24, 25}


def test_learns_what_fields_say_together(spark, table):
    p = {"epochs": 25, "batch": 300, "rate": 0.05, "hidden": 0.02}
    oof, scores, losses = rank_fm.rank_fm_out_of_fold(table, table.where("id < 20").withColumn("id", F.col("id") + 5000), "id", ["x"], ["t"], "y", params=p)
    both = oof.join(table.select("id", "y"), "id")
    assert both.count() == 600 and scores.count() == 20 and len(losses) == 50 and np.mean(losses[-5:]) < 0.8 * np.mean(losses[:5])
    assert roc_auc(both, "y", "score").first()["auc"] > 0.8
    with pytest.raises(ValueError, match="unknown settings"):
        rank_fm.rank_fm_out_of_fold(table, None, "id", ["x"], ["t"], "y", params={"deep": 1})


def test_cross_net_gradient_equals_finite_differences():
    rng = np.random.default_rng(6)
    design = rank_fm.Design(["t", "u"], ["a", "b", "cell"], [3, 4], np.zeros(3), np.ones(3))
    theta = cross_net.fresh(design, cross_net.PARAMS | {"width": 2, "frequencies": 2, "hidden_width": 5, "rank": 2, "layers": 2}, 1)
    theta = {c: v + 0.1 * rng.normal(size=v.shape) for c, v in theta.items()}
    codes = np.column_stack([rng.integers(0, n, 8) + o for n, o in zip(design.sizes, design.offsets, strict=True)])
    values, missing, y = rng.normal(size=(8, 3)), rng.random((8, 3)) < 0.3, rng.integers(0, 2, 8).astype(float)
    loss = lambda t: rank_fm.pulls(cross_net.forward(t, codes, values, missing)[0], y, ((), ()), 0.0, 8, 0)[0]
    score, kept = cross_net.forward(theta, codes, values, missing)
    got = cross_net.backward(theta, codes, values, missing, kept, rank_fm.pulls(score, y, ((), ()), 0.0, 8, 0)[1])
    assert set(got) == set(theta)
    at = rank_fm.flat(theta)
    want = [(loss(rank_fm.unflat(at + e, theta)) - loss(rank_fm.unflat(at - e, theta))) / 2e-6 for e in 1e-6 * np.eye(len(at))]
    assert rank_fm.flat(got) == pytest.approx(want, abs=1e-7)


def test_a_cell_is_hidden_with_what_it_is_made_of():
    needs = np.array([[1, 0, 0], [0, 1, 0], [1, 1, 0]], bool)
    design = rank_fm.Design(["t"], ["a", "b", "cell"], [4], np.zeros(3), np.ones(3), needs)
    codes, missing = np.full((4000, 1), 3), np.zeros((4000, 3), bool)
    codes, missing = cross_net.hidden(design, np.random.default_rng(2), codes, missing, 0.9)
    assert (missing[:, 2] == missing[:, 0] | missing[:, 1]).all() and 0 < missing[:, 0].mean() < 0.9 and set(codes[:, 0]) == {0, 3}


def test_cross_net_learns_from_cells(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(600), rng.random(600)
    y = (a > b) ^ (rng.random(600) < 0.05)
    rows = [(i, int(y[i]), i % 3, float(a[i]), float(b[i]), float(a[i] - b[i]), bool(i % 7), "pq"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, gap double, gap_valid boolean, t string")
    p = {"epochs": 20, "batch": 200, "rate": 0.02, "hidden": 0.2}
    oof, scores, losses = cross_net.cross_net_out_of_fold(df, df.where("id < 10").withColumn("id", F.col("id") + 900), "id", ["a", "b"], ["t"], "y", {"gap": ["a", "b"]}, params=p)
    both = oof.join(df.select("id", "y"), "id")
    assert both.count() == 600 and scores.count() == 10 and len(losses) == 60 and roc_auc(both, "y", "score").first()["auc"] > 0.85
    with pytest.raises(ValueError, match="aren't inputs"):
        cross_net.cross_net_out_of_fold(df, None, "id", ["a"], ["t"], "y", {"gap": ["a", "b"]})


def test_sources_of_the_budget():
    from sparkrank.plans import geometry

    assert geometry.cell_sources(["share_1", "daily_and_sleep", "screen_std", "width_0"]) == {
        "share_1": ["daily_screen_time_hours", "gaming_hours"], "daily_and_sleep": ["daily_screen_time_hours", "sleep_hours"],
        "screen_std": ["daily_screen_time_hours", "social_media_hours", "gaming_hours", "work_study_hours", "weekend_screen_time"], "width_0": ["daily_screen_time_hours", "social_media_hours", "gaming_hours", "work_study_hours"],
    }
