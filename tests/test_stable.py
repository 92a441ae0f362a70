"""Stable weights are judged on all rows, beside a search over all of them, as in the system surveyed."""

import numpy as np
import pytest

from sparkrank.operators import blend


def test_stable_weights_are_scored_on_all_rows(spark):
    rng = np.random.default_rng(12)
    y = (np.arange(150) % 3 == 0).astype(int)
    cols = {m: np.round(y * s + rng.random(150), 1) for m, s in (("p", 0.5), ("q", 0.4), ("r", -0.2))}
    df = spark.createDataFrame([(i, int(y[i]), *(float(v[i]) for v in cols.values())) for i in range(150)], "id long, y int, p double, q double, r double")
    auc = lambda s, y: np.mean([(a > b + 1e-12) + (abs(a - b) <= 1e-12) / 2 for a in s[y == 1] for b in s[y == 0]])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    def search(ranks, y):
        total, last, chosen = 0, None, dict.fromkeys(ranks, 0)
        for _ in range(40):
            found = {m: auc(total + r, y) for m, r in ranks.items()}
            best = max(found, key=found.get)
            if last is not None and found[best] < last + 1e-6:
                break
            chosen[best], total, last = chosen[best] + 1, total + ranks[best], found[best]
        return {m: n / sum(chosen.values()) for m, n in chosen.items()}, last

    got = {r["model"]: r for r in blend.stable_weights(df, "id", "y", list(cols), 3, 0.7, 60, seed=5).collect()}
    whole = {m: rank(v) / 150 for m, v in cols.items()}
    weights, reached = search({m: rank(v) for m, v in cols.items()}, y)
    parts = blend.stratified_subsample(df, "id", "y", 0.7, 60, 3, 5).collect()
    samples = [np.array([r["id"] for r in parts if r["round"] == k]) for k in range(3)]
    each = [search({m: rank(v[own]) for m, v in cols.items()}, y[own])[1] for own in samples]
    for m in cols:
        assert (got[m]["auc"], got[m]["greedy"]) == pytest.approx((auc(cols[m], y), weights[m]))
        assert (got[m]["greedy_auc"], got[m]["round_auc_mean"], got[m]["round_auc_deviation"]) == pytest.approx((reached, np.mean(each), np.std(each)))
        assert got[m]["blend_auc"] == pytest.approx(auc(sum(got[k]["weight"] * whole[k] for k in cols), y), abs=2e-4)
