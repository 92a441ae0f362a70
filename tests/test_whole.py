"""Queries cover all their rows, on small tables made for the purpose."""

import numpy as np
import pytest

from sparkrank import queries
from sparkrank.fixtures import train
from sparkrank.operators import blend, boosting, models, random_trees


@pytest.fixture
def vectors(spark, tmp_path):
    """A folder with embeddings on both sides of ids 400 and 1400, and the same as arrays."""
    ids = np.array([*range(12), *range(395, 410), *range(1395, 1410), 5000])
    x = np.random.default_rng(5).normal(size=(len(ids), 64))
    labels = np.arange(len(ids)) * 7 % 10
    rows = [(int(i), int(c), v.tolist()) for i, c, v in zip(ids, labels, x, strict=True)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), ids, (labels < 5).astype(int), x


def test_knn_queries_answer_every_vector(spark, vectors):
    sf, ids, y, x = vectors
    parent = ids < 400
    features = {r["vec_id"]: r for r in queries.knn_label_features(spark, sf).collect()}
    margins = {r["vec_id"]: r for r in queries.knn_class_margin(spark, sf).collect()}
    assert sorted(features) == sorted(margins) == ids[~parent].tolist()
    for i, v in zip(ids[~parent].tolist(), x[~parent], strict=True):
        gap = np.sqrt(((x[parent] - v) ** 2).sum(axis=1))
        near = np.argsort(gap)[:5]
        weight = 1 / gap[near]
        wanted = [(y[parent][near].sum() + y[parent].mean()) / 6, (y[parent][near] * weight).sum() / weight.sum(), gap[near].mean(), gap.min()]
        assert [features[i][c] for c in ("label_mean_5", "label_weighted_5", "distance_mean_5", "distance_min")] == pytest.approx(wanted, abs=1e-6)
        zero, one = (gap[y[parent] == c].min() for c in (0, 1))
        assert [margins[i][c] for c in ("distance_class_0", "distance_class_1", "distance_margin")] == pytest.approx([zero, one, zero - one], abs=1e-6)


@pytest.mark.parametrize(("name", "most"), [("gbt_oof", {"rounds": 1, "depth": 1}), ("categorical_gbt_oof", {"rounds": 1, "depth": 1}), ("extra_trees_oof", {"trees": 2, "depth": 1})])
def test_tree_queries_score_every_train_row_with_the_operators_parameters(spark, sf, monkeypatch, name, most):
    used = []
    for module in (boosting, random_trees):
        fit = module.fit_many
        monkeypatch.setattr(module, "fit_many", lambda *a, params=None, fit=fit, **k: used.append(params) or fit(*a, params=most, **k))
    scored = [r["id"] for r in getattr(queries, name)(spark, sf).collect()]
    assert sorted(scored) == sorted(r["id"] for r in train(spark, sf).select("id").collect())
    assert used == [{}]


def test_adversarial_auc_judges_every_row(spark, tmp_path, monkeypatch):
    estimator = models._estimator
    monkeypatch.setattr(models, "_estimator", lambda model, params, *a: estimator(model, params | {"numTrees": 1, "maxDepth": 1}, *a))
    orders = spark.range(1, 11001).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "cast(id % 97 as double) as o_totalprice", "'1-URGENT' as o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    row = queries.adversarial_auc(spark, str(tmp_path)).first()
    assert sorted(v for c, v in row.asDict().items() if c != "auc") == [3300, 7700] and 0.4 < row["auc"] < 0.6


def test_rank_weights_are_searched_with_the_operators_defaults(spark, sf, monkeypatch):
    searched, sampled = [], []
    sample, search = blend.stratified_subsample, blend.greedy_rounds
    monkeypatch.setattr(blend, "greedy_rounds", lambda ranked, label, names, rounds, steps, gain: searched.append((rounds, steps, gain)) or search(ranked, label, names, rounds, 1, gain))
    monkeypatch.setattr(blend, "stratified_subsample", lambda df, id_col, label, share, cap, rounds, seed: sampled.append((share, cap, rounds)) or sample(df, id_col, label, share, cap, rounds, seed))
    assert queries.greedy_rank_weights(spark, sf).count() == queries.stable_rank_weights(spark, sf).count() == 4
    assert searched == [([0], 40, 1e-6)] and sampled == [(0.8, 120_000, 25)]
