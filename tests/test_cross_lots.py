"""The cross network's folded first layer equals tokens one by one, in lots of any size."""

import math

import numpy as np
import pytest

from sparkrank.operators import cross_net, rank_fm


def plain(theta, codes, values, missing):
    """Every number's token, then the layers."""
    n, rows = values.shape[1], []
    for code, value, gone in zip(codes, values, missing, strict=True):
        tokens = []
        for j in range(n):
            phase = 2 * math.pi * theta["frequency"][j] * value[j]
            token = np.concatenate([np.sin(phase), np.cos(phase)]) @ theta["project"][j] + theta["shift"][j]
            tokens.append(0 * token if gone[j] else token)
        z = np.concatenate([*tokens, *theta["embed"][code], gone.astype(float)])
        x = first = np.tanh(z @ theta["in"] + theta["in_bias"])
        for layer in range(2):
            x = x + first * (x @ theta[f"down{layer}"] @ theta[f"up{layer}"] + theta[f"cross_bias{layer}"])
        rows.append(x @ theta["head"] + theta["bias"][0])
    return np.array(rows)


@pytest.mark.parametrize("texts", [0, 2])
def test_folded_layer_equals_tokens_in_lots_of_any_size(monkeypatch, texts):
    rng = np.random.default_rng(4)
    design = rank_fm.Design(["t", "u"][:texts], ["a", "b", "c"], [3, 4][:texts], np.zeros(3), np.ones(3))
    theta = {k: v + 0.2 * rng.normal(size=v.shape) for k, v in cross_net.fresh(design, cross_net.PARAMS, 1).items()}
    codes = rng.integers(0, 3, (70, texts)) + design.offsets[:texts].astype(int)
    values, missing, pull = rng.normal(size=(70, 3)), rng.random((70, 3)) < 0.3, rng.normal(size=70)
    found = []
    for lot in (1000, 32):
        monkeypatch.setattr(cross_net, "LOT_ROWS", lot)
        score, kept = cross_net.forward(theta, codes, values, missing)
        assert len(kept) == -(-70 // lot) and score == pytest.approx(plain(theta, codes, values, missing))
        found.append(cross_net.backward(theta, codes, values, missing, kept, pull))
    assert found[0].keys() == theta.keys()
    for k, v in theta.items():
        assert found[0][k] == pytest.approx(found[1][k], abs=1e-9)
        if not v.size:
            continue
        at, step = tuple(rng.integers(0, s) for s in v.shape), 1e-6
        moved = [theta | {k: v + step * s * (np.indices(v.shape) == np.reshape(at, (-1, *[1] * v.ndim))).all(0)} for s in (1, -1)]
        up, down = (plain(t, codes, values, missing) @ pull for t in moved)
        assert found[0][k][at] == pytest.approx((up - down) / (2 * step), rel=1e-4, abs=1e-6)
