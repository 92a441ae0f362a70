"""The single-column audit against plain readings of its rules."""

import numpy as np
import pytest

from sparkrank.operators import audit


def auc(s, y):
    s, y = np.asarray(s, float), np.asarray(y)
    return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])


def coded(values, y, fold):
    out = []
    for v, f in zip(values, fold, strict=True):
        rest = [a for a, w, g in zip(y, values, fold, strict=True) if g != f]
        same = [a for a, w, g in zip(y, values, fold, strict=True) if g != f and w == v]
        prior = np.mean(rest)
        out.append((sum(same) + 20 * prior) / (len(same) + 20) if same else prior)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    rng = np.random.default_rng(seed)
    n = 240
    y, fold = rng.integers(0, 2, n), np.arange(n) % 3
    wide = np.round(rng.normal(size=n) + 0.4 * y, 1 + seed)
    ties = rng.integers(0, 40, n).astype(float)
    gaps = [None if rng.random() < 0.1 + 0.2 * a else float(v) for a, v in zip(y, wide, strict=True)]
    holes = [None if rng.random() < 0.2 else float(v) for v in ties]
    few, text = rng.integers(0, 4, n), ["pqr"[k] if k < 3 else None for k in rng.integers(0, 4, n)]
    rows = [(i, int(y[i]), int(fold[i]), float(wide[i]), gaps[i], holes[i], int(few[i]), text[i], 1.5, None) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, wide double, gaps double, holes double, few int, text string, same double, none string")
    got = {r["column"]: (r["method"], r["auc"]) for r in audit.univariate_audit(df, ["wide", "gaps", "holes", "few", "text", "same", "none"], "y").collect()}
    best = lambda a: max(a, 1 - a)
    filled = lambda v: [np.median([x for x in v if x is not None]) if x is None else x for x in v]
    lost = lambda v: [float(x is None) for x in v]
    want = {
        "wide": ("rank_auc_best_direction", best(auc(wide, y))), "gaps": ("rank_auc_best_direction", best(auc(filled(gaps), y))), "holes": ("rank_auc_best_direction", best(auc(filled(holes), y))),
        "few": ("oof_smoothed_target_encoding", auc(coded(few, y, fold), y)), "text": ("oof_smoothed_target_encoding", auc(coded(text, y, fold), y)), "same": ("oof_smoothed_target_encoding", None), "none": ("oof_smoothed_target_encoding", None),
        **{f"{c}:missing": ("missing_indicator", best(auc(lost(v), y))) for c, v in (("gaps", gaps), ("holes", holes), ("text", text))},
    }
    assert set(got) == set(want)
    for c, (method, a) in want.items():
        assert got[c][0] == method and got[c][1] == (pytest.approx(a) if a is not None else None)
