"""Ordered target statistics, boosted and fully random trees against single-machine readings of their definitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.operators import boosting, models, ordered, random_trees
from sparkrank.operators.ranking import roc_auc

RNG = np.random.default_rng(8)


def plain_statistics(rows, orders, weight, seed, prior):
    out = {}
    for i, y, c, learned in rows:
        parts = []
        for p in range(orders):
            key = lambda j: (hashlib.md5(f"{j}:{p}:{seed}".encode()).hexdigest(), j)  # noqa: B023, E731
            before = [yy for j, yy, cc, ll in rows if ll and cc == c and (not learned or key(j) < key(i))]
            parts.append((sum(before) + weight * prior) / (len(before) + weight))
        out[i] = sum(parts) / orders
    return out


def test_ordered_statistics(spark, monkeypatch):
    rows = [(i, int(RNG.random() < 0.4), [None, "a", "a", "a", "a", "b", "=", ""][i % 8] if i % 11 else "rare%d" % i, i % 5 > 0) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, y int, c string, learned boolean").withColumn("d", F.col("id") % 3)
    prior = np.mean([y for _, y, _, ok in rows if ok])
    got = {r["id"]: r for r in ordered.ordered_statistics(df, "id", "y", ["c", "d"], "learned", orders=3, weight=2.0).collect()}
    want = plain_statistics(rows, 3, 2.0, 42, prior)
    assert {i: r["c__ts"] for i, r in got.items()} == pytest.approx(want)
    assert {i: r["d__ts"] for i, r in got.items()} == pytest.approx(plain_statistics([(i, y, i % 3, ok) for i, y, _, ok in rows], 3, 2.0, 42, prior))
    # A row's own label is no part of its statistic: turned over, it moves all others that come later, but not its own.
    turned = df.withColumn("y", F.when(F.col("id") == 34, 1 - F.col("y")).otherwise(F.col("y")))
    other = {r["id"]: r["c__ts"] for r in ordered.ordered_statistics(turned, "id", "y", ["c"], "learned", orders=3, weight=2.0, prior=0.4).collect()}
    same = {r["id"]: r["c__ts"] for r in ordered.ordered_statistics(df, "id", "y", ["c"], "learned", orders=3, weight=2.0, prior=0.4).collect()}
    assert other[34] == same[34] and any(other[i] != same[i] for i in same)
    monkeypatch.setattr(ordered, "COARSE", 1)
    monkeypatch.setattr(ordered, "FINE", 1)
    again = {r["id"]: r["c__ts"] for r in ordered.ordered_statistics(df, "id", "y", ["c"], "learned", orders=3, weight=2.0).collect()}
    assert again == pytest.approx(want)


def test_statistics_by_group_and_without_training_rows(spark):
    df = spark.createDataFrame([(i, i % 2, "ab"[i % 3 % 2], m) for i in range(30) for m in (0, 1)], "id long, y int, c string, model int").withColumn("learn", F.col("id") % 4 != F.col("model"))
    got = ordered.ordered_statistics(df, "id", "y", ["c"], "learn", ["model"], orders=2)
    for m in (0, 1):
        one = ordered.ordered_statistics(df.where(f"model = {m}"), "id", "y", ["c"], "learn", orders=2)
        assert {r["id"]: r["c__ts"] for r in got.where(f"model = {m}").collect()} == pytest.approx({r["id"]: r["c__ts"] for r in one.collect()})


def split_by_trying(codes, g, h, missing, ridge, least):
    """Every feature, side of missing values and code tried on the rows themselves."""
    best = None
    worth = lambda at: (g[at].sum() / boosting.SCALE) ** 2 / (h[at].sum() / boosting.SCALE + ridge)
    for f in range(codes.shape[1]):
        for side in (0, 1):
            for c in range(missing[f]):
                left = np.where(codes[:, f] == missing[f], side == 1, codes[:, f] <= c)
                if left.sum() < least or (~left).sum() < least:
                    continue
                gain = worth(left) + worth(~left) - worth(np.ones(len(g), bool))
                if best is None or gain > best[3] + 1e-12:
                    best = (f, c, side, gain)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_split_equals_trying_all(seed):
    rng = np.random.default_rng(seed)
    marks = [np.arange(k) / k for k in (3, 1, 7)]
    x = rng.random((90, 3))
    x[rng.random((90, 3)) < 0.2] = np.nan
    codes, missing = boosting.coded(x, marks), np.array([len(m) + 1 for m in marks])
    g, h = boosting.gradients(rng.normal(size=90), rng.integers(0, 2, 90))
    table = [(f, c, g[at].sum(), h[at].sum(), at.sum()) for f in range(3) for c in range(missing[f] + 1) if (at := codes[:, f] == c).any()]
    got = boosting.best_split(*map(np.array, zip(*table, strict=True)), missing, 1.0, 5)
    want = split_by_trying(codes, g, h, missing, 1.0, 5)
    assert got[:3] == want[:3] and got[3] == pytest.approx(want[3])
    assert boosting.best_split(*map(np.array, zip(*table, strict=True)), missing, 1.0, 46) is None


def boosted_by_hand(x, y, marks, p):
    """Margins after each round, from the rows themselves."""
    codes, missing = boosting.coded(x, marks), np.array([len(m) + 1 for m in marks])
    rate = y.mean()
    margin, out = np.full(len(y), np.log(rate / (1 - rate))), []
    for _ in range(p["rounds"]):
        g, h = boosting.gradients(margin, y)
        add, groups = np.zeros(len(y)), [np.arange(len(y))]
        for _ in range(p["depth"]):
            following = []
            for at in groups:
                found = split_by_trying(codes[at], g[at], h[at], missing, p["ridge"], p["least"])
                if found is None or found[3] <= 1e-9:
                    continue
                f, c, side, _ = found
                left = np.where(codes[at, f] == missing[f], side == 1, codes[at, f] <= c)
                for part in (at[left], at[~left]):
                    add[part] = -p["rate"] * (g[part].sum() / boosting.SCALE) / (h[part].sum() / boosting.SCALE + p["ridge"])
                    following.append(part)
            groups = following
        margin = margin + add
        out.append(margin)
    return np.array(out)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 0] + (x[:, 1] > 0.3) + 0.6 * rng.normal(size=400) > 0.5).astype(int)
    x[rng.random((400, 4)) < 0.15] = np.nan
    x[y == 1, 3] = np.where(rng.random((y == 1).sum()) < 0.5, np.nan, x[y == 1, 3])  # a gap says something
    rows = [(i, int(y[i]), i % 4, *[None if np.isnan(v) else float(v) for v in x[i]], "uvw"[i % 3] if i % 7 else None) for i in range(400)]
    return spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double, d double, t string"), x, y


def test_boosting_equals_growing_by_hand(spark, table):
    df, x, y = table
    p = boosting.PARAMS | {"rounds": 5, "depth": 3, "every": 2, "bins": 12, "patience": 99}
    both = df.withColumn("model", F.explode(F.array(F.lit(0), F.lit(7)))).withColumn("part", ((F.col("model") == 7) & (F.col("fold") == 1)).cast("int"))
    fitted = boosting.fit_many(both, list("abcd"), "y", "id", params={k: p[k] for k in ("rounds", "depth", "every", "bins", "patience")})
    assert len(fitted.trees[0]) == 5 and fitted.best[0] == 5 and fitted.history[0] == [] and len(fitted.history[7]) == 5
    got = {(r["model"], r["id"]): r["score"] for r in boosting.predict(fitted, both, ["model", "id"]).collect()}
    margins = boosted_by_hand(x, y, fitted.marks, p)
    assert [got[0, i] for i in range(400)] == pytest.approx(1 / (1 + np.exp(-margins[-1])))
    own = np.arange(400) % 4 != 1
    tree = boosted_by_hand(x[own], y[own], fitted.marks, p)[fitted.best[7] - 1]
    assert [got[7, i] for i in np.flatnonzero(own)] == pytest.approx(1 / (1 + np.exp(-tree)))
    left = df.where("fold = 1").select("id", "y").collect()
    ranks = boosting.predict(fitted, both.where("part = 1"), ["id", "y"])
    assert roc_auc(ranks, "y", "score").first()["auc"] == pytest.approx(max(fitted.history[7])) and len(left) == 100
    again = boosting.fit_many(both.repartition(7), list("abcd"), "y", "id", params={k: p[k] for k in ("rounds", "depth", "every", "bins", "patience")})
    assert all((t.feature == u.feature).all() and (t.value == u.value).all() for m in (0, 7) for t, u in zip(fitted.trees[m], again.trees[m], strict=True))


def test_rounds_stop_by_auc(spark, table):
    df, _, _ = table
    noise = df.withColumns({"model": F.lit(0), "part": (F.col("fold") == 0).cast("int"), "a": F.pmod(F.xxhash64("id"), F.lit(17)).cast("double")})
    fitted = boosting.fit_many(noise, ["a"], "y", "id", params={"rounds": 60, "depth": 2, "patience": 4, "every": 4})
    best = int(np.argmax(fitted.history[0])) + 1
    assert fitted.best[0] == best and len(fitted.trees[0]) < 60 and best + 4 <= len(fitted.trees[0]) <= best + 8
    with pytest.raises(ValueError, match="unknown settings"):
        boosting.fit_many(noise, ["a"], "y", "id", params={"maxIter": 3})


def test_shares_draw_rows_and_columns():
    key = RNG.integers(-(1 << 62), 1 << 62, 20_000)
    a, b = boosting._drawn(key, 0, 1, 0.3), boosting._drawn(key, 1, 1, 0.3)
    assert abs(a.mean() - 0.3) < 0.02 and abs(b.mean() - 0.3) < 0.02 and abs((a & b).mean() - 0.09) < 0.02


def test_out_of_fold_with_gaps_and_categories(spark, table):
    df, _, _ = table
    e = models.Experiment("e", "catboost", params={"iterations": 6, "max_depth": 2, "subsample": 0.8, "colsample_bytree": 0.7})
    test = df.where("id < 50").drop("y").withColumn("id", F.col("id") + 1000)
    oof, scores, weights = models.out_of_fold(e, df, test, "id", ["a", "b", "c", "d", "t"], "y")
    both = oof.join(df.select("id", "y"), "id")
    assert both.count() == 400 and scores.count() == 50 and roc_auc(both, "y", "score").first()["auc"] > 0.75
    assert {c for c, _ in weights} == {"a", "b", "c", "d", "t"} and sum(w for _, w in weights) == pytest.approx(1)


def forest_by_hand(x, y, p, seed, model, count):
    """Leaf means of each row by each tree, grown node by node."""
    out = np.zeros((p["trees"], len(y)))
    for t in range(p["trees"]):

        def grow(node, at, level):
            out[t, at] = y[at].mean()
            if level == p["depth"] or len(at) < 2 * p["least"] and node > 1 or y[at].min() == y[at].max():
                return
            features, parts = random_trees.drawn(seed, model, t, node, x.shape[1], count)
            best = None
            for f, u in zip(features, parts, strict=True):
                low, high = np.nanmin(x[at, f]), np.nanmax(x[at, f])
                right = x[at, f] > low + u * (high - low)
                if low < high and min(right.sum(), (~right).sum()) >= p["least"]:
                    gain = sum(random_trees.purity(int(s.sum()), int(y[at][s].sum())) for s in (right, ~right))
                    if best is None or gain > best[0]:
                        best = (gain, right)
            if best is not None:
                grow(2 * node, at[~best[1]], level + 1)
                grow(2 * node + 1, at[best[1]], level + 1)

        grow(1, np.arange(len(y)), 0)
    return out.mean(0)


def test_random_trees_equal_a_twin(spark, table):
    df, x, y = table
    p = {"trees": 7, "depth": 5, "least": 3, "every": 2}
    both = df.withColumn("model", F.explode(F.array(F.lit(0), F.lit(3)))).where("model = 0 or fold <> 2")
    fitted = random_trees.fit_many(both.repartition(5), list("abcd"), "y", params=p, seed=11)
    got = {(r["model"], r["id"]): r["score"] for r in random_trees.predict(fitted, both, ["model", "id"]).collect()}
    assert [got[0, i] for i in range(400)] == pytest.approx(forest_by_hand(x, y, p, 11, 0, 2))
    own = np.flatnonzero(np.arange(400) % 4 != 2)
    assert [got[3, i] for i in own] == pytest.approx(forest_by_hand(x[own], y[own], p, 11, 3, 2))


def test_random_trees_out_of_fold(spark, table):
    df, _, _ = table
    e = models.Experiment("e", "extra_trees", seeds=(1, 2), params={"trees": 10, "max_depth": 4})
    oof, scores, weights = models.out_of_fold(e, df, df.where("id < 9"), "id", ["a", "b", "c", "d"], "y")
    both = oof.join(df.select("id", "y"), "id")
    assert both.count() == 400 and scores.count() == 9 and roc_auc(both, "y", "score").first()["auc"] > 0.7 and len(weights) == 4
    with pytest.raises(ValueError, match="numbers"):
        models.out_of_fold(e, df, None, "id", ["a", "t"], "y")


def test_workflow_of_own_trees(spark, tmp_path):
    from sparkrank.sources import tables
    from sparkrank.workflow import Run

    train, test, sample = tables.demo(spark, 240, 60)
    for name, df in (("train", train), ("test", test), ("sample", sample)):
        df.orderBy("id").coalesce(1).write.csv(f"{tmp_path}/{name}", header=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)
    few = {"rounds": 3, "max_depth": 2}
    tree = {
        "project": {"target": "addicted_label", "id_column": "id"}, "output": {"directory": f"{tmp_path}/out"}, "cv": {"n_splits": 2, "seed": 17},
        "data": {"train_path": f"{tmp_path}/train", "test_path": f"{tmp_path}/test", "sample_path": f"{tmp_path}/sample", "schema": schema}, "features": {"default_view": "engineered", "drop_columns": ["addiction_level"]},
        "training": {"models": ["catboost", "lightgbm", "extra_trees"]}, "models": {"catboost": few, "lightgbm": few, "extra_trees": {"trees": 4, "max_depth": 3}},
    }
    done = Run(spark, tree).fit()
    assert [d["name"] for d in done] == ["catboost", "lightgbm", "extra_trees"] and all(d["auc"] > 0.55 for d in done)
    names = {r["feature"] for r in spark.read.parquet(f"{tmp_path}/out/importance/catboost").collect()}
    assert {"gender", "stress_level", "daily_screen_time_hours"} <= names
    gaps = {r["feature"] for r in spark.read.parquet(f"{tmp_path}/out/importance/lightgbm").collect()}
    assert "gender__Female" in gaps and spark.read.parquet(f"{tmp_path}/out/predictions").where("split = 'test'").count() == 180


def test_small_blocks_and_ranges_give_the_same_trees_and_exact_figures(spark, table, monkeypatch):
    df, _, _ = table
    both = df.withColumns({"model": F.lit(0), "part": (F.col("fold") == 1).cast("int")})
    settings = {"rounds": 3, "depth": 2, "every": 3, "bins": 12, "patience": 99}
    one = boosting.fit_many(both, list("abcd"), "y", "id", params=settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 16)
    monkeypatch.setattr(boosting.exact_auc, "RANGE_ROWS", 9)
    many = boosting.fit_many(both, list("abcd"), "y", "id", params=settings)
    assert all((t.feature == u.feature).all() and (t.value == u.value).all() for t, u in zip(one.trees[0], many.trees[0], strict=True))
    assert many.history == one.history
    for k, auc in enumerate(many.history[0], 1):
        many.best[0] = k
        assert roc_auc(boosting.predict(many, both.where("part = 1"), ["id", "y"]), "y", "score").first()["auc"] == pytest.approx(auc, abs=1e-12)
