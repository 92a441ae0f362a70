"""A cross network over masked tokens: numbers, what they allow (their cells), texts, and what is missing.

Every number and cell is a token, a learned Fourier embedding that is zero where the value is missing or not valid; a text is
the embedding of its code. Tokens and the flags of what is missing are projected to one vector, which is crossed with itself
through low-rank layers: x + x0 * (U (V x) + b). While training, raw fields are hidden at random, batch by batch at a rate drawn for
the batch; a cell goes with any raw field that it is made of. Training, averages and scores are those of
:mod:`sparkrank.operators.rank_fm`: a job an epoch for the models of all folds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.operators.rank_fm import PARAMS as TRAINING
from sparkrank.operators.rank_fm import Design, Net, designed, settled, trained_out_of_fold

PARAMS = TRAINING | {"hidden": 0.3, "rank_weight": 0.0, "hidden_width": 48, "rank": 12, "layers": 2, "width": 6}


def fresh(design: Design, p: dict, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    v, n, w, k, h, r = sum(design.sizes), len(design.numbers), p["width"], p["frequencies"], p["hidden_width"], p["rank"]
    wide = (n + len(design.fields)) * w + n
    out = {
        "bias": np.zeros(1), "embed": 0.1 * rng.normal(size=(v, w)), "frequency": 0.5 * rng.normal(size=(n, k)), "project": rng.normal(size=(n, 2 * k, w)) / math.sqrt(2 * k), "shift": np.zeros((n, w)),
        "in": rng.normal(size=(wide, h)) / math.sqrt(max(1, wide)), "in_bias": np.zeros(h), "head": rng.normal(size=h) / math.sqrt(h),
    }
    for layer in range(p["layers"]):
        out |= {f"down{layer}": rng.normal(size=(h, r)) / math.sqrt(h), f"up{layer}": rng.normal(size=(r, h)) / math.sqrt(r) * 0.5, f"cross_bias{layer}": np.zeros(h)}
    return out


def _layers(theta: dict[str, np.ndarray]) -> int:
    return sum(c.startswith("down") for c in theta)


#: Rows that are worked on at once: what is kept of them stays near the processor.
LOT_ROWS = 256


def _folded(theta: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The first layer without the tokens of numbers between: weights of the waves (all sines, then all cosines), by number and wave; what is
    added where all numbers are there; and what is added for each missing one, whose cosines are 1 and whose token is zero."""
    n, k = theta["frequency"].shape
    w = theta["embed"].shape[1]
    smooth, texts, flags = (theta["in"][a:b] for a, b in ((0, n * w), (n * w, len(theta["in"]) - n), (len(theta["in"]) - n, None)))
    by_number = smooth.reshape(n, w, -1)
    wave = theta["project"] @ by_number  # numbers, 2 k, hidden
    shift = (theta["shift"][:, None, :] @ by_number)[:, 0, :]
    waves = np.concatenate([wave[:, :k].reshape(n * k, -1), wave[:, k:].reshape(n * k, -1)])
    return waves, texts, shift.sum(0) + theta["in_bias"], flags - wave[:, k:].sum(1) - shift


def forward(theta: dict[str, np.ndarray], codes: np.ndarray, values: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Outputs of rows, and what the gradient needs, lot by lot."""
    folded = _folded(theta)
    done = [_lot(theta, folded, codes[a : a + LOT_ROWS], values[a : a + LOT_ROWS], missing[a : a + LOT_ROWS]) for a in range(0, len(values), LOT_ROWS)]
    return np.concatenate([d[0] for d in done]) if done else np.zeros(0, values.dtype), [d[1] for d in done]


def _lot(theta, folded, codes, values, missing):
    by_wave, by_text, always, gap = folded
    n, k = theta["frequency"].shape
    gone = missing.astype(values.dtype)
    values = values * (1 - gone)
    phase = np.repeat(values, k, 1) * (2 * math.pi * theta["frequency"]).astype(values.dtype).ravel()
    waves = np.empty((len(values), 2 * n * k), values.dtype)
    np.sin(phase, out=waves[:, : n * k])
    np.cos(phase, out=waves[:, n * k :])
    texts = theta["embed"][codes].reshape(len(values), -1)
    x = first = np.tanh(waves @ by_wave + gone @ gap + texts @ by_text + always)
    kept = []
    for layer in range(_layers(theta)):
        low = x @ theta[f"down{layer}"]
        high = low @ theta[f"up{layer}"] + theta[f"cross_bias{layer}"]
        kept.append((x, low, high))
        x = x + first * high
    return x @ theta["head"] + theta["bias"][0], (values, gone, waves, texts, first, kept, x)


def backward(theta: dict[str, np.ndarray], codes: np.ndarray, values: np.ndarray, missing: np.ndarray, saved: list[tuple], pull: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of sum(pull * output)."""
    n, k = theta["frequency"].shape
    w, by_wave, by_text = theta["embed"].shape[1], *_folded(theta)[:2]
    out: dict[str, np.ndarray] = {}
    for at, lot in enumerate(saved):
        rows = slice(at * LOT_ROWS, (at + 1) * LOT_ROWS)
        for c, v in _lot_gradients(theta, by_wave, by_text, codes[rows], lot, pull[rows]).items():
            out[c] = out[c] + v if at else v
    if not out:
        return {c: np.zeros_like(v) for c, v in theta.items()}
    # From the folded layer back to what it is made of.
    wave, lost, whole = out.pop("wave"), out.pop("lost"), out["in_bias"]
    wave = np.concatenate([wave[: n * k].reshape(n, k, -1), wave[n * k :].reshape(n, k, -1) - lost[:, None, :]], 1)
    by_number, there = theta["in"][: n * w].reshape(n, w, -1), whole[None, :] - lost
    out["project"] = wave @ by_number.transpose(0, 2, 1)
    out["shift"] = (there[:, None, :] @ by_number.transpose(0, 2, 1))[:, 0, :]
    smooth = theta["project"].transpose(0, 2, 1) @ wave + theta["shift"][:, :, None] * there[:, None, :]
    out["in"] = np.concatenate([smooth.reshape(n * w, -1), out.pop("texts"), lost])
    return out


def _lot_gradients(theta, by_wave, by_text, codes, saved, pull):
    values, gone, waves, texts, first, kept, last = saved
    n, k = theta["frequency"].shape
    out = {"bias": np.array([pull.sum()]), "head": last.T @ pull}
    d, d_first = pull[:, None] * theta["head"], np.zeros_like(first)
    for layer in reversed(range(len(kept))):
        x, low, high = kept[layer]
        d_first += d * high
        d_high = d * first
        out[f"up{layer}"], out[f"cross_bias{layer}"] = low.T @ d_high, d_high.sum(0)
        d_low = d_high @ theta[f"up{layer}"].T
        out[f"down{layer}"] = x.T @ d_low
        d = d + d_low @ theta[f"down{layer}"].T
    d_in = (d + d_first) * (1 - first**2)
    out |= {"wave": waves.T @ d_in, "lost": gone.T @ d_in, "texts": texts.T @ d_in, "in_bias": d_in.sum(0)}
    d_waves = d_in @ by_wave.T
    d_phase = d_waves[:, : n * k]
    d_phase *= waves[:, n * k :]
    d_phase -= d_waves[:, n * k :] * waves[:, : n * k]
    out["frequency"] = 2 * math.pi * (values.T[:, None, :] @ d_phase.reshape(-1, n, k).transpose(1, 0, 2))[:, 0, :]
    d_texts = (d_in @ by_text.T).reshape(codes.size, theta["embed"].shape[1])
    out["embed"] = np.stack([np.bincount(codes.ravel(), v, len(theta["embed"])) for v in d_texts.T], 1)
    return out


def hidden(design: Design, rng: np.random.Generator, codes: np.ndarray, missing: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Raw fields hidden at a rate drawn for the batch, up to ``most``; what is made of one goes with it."""
    texts = codes.shape[1]
    gone = rng.random((len(codes), design.needs.shape[1])) < most * rng.random()
    lost = (gone.astype(np.float64) @ design.needs.T.astype(np.float64)) > 0
    return np.where(gone[:, gone.shape[1] - texts :], design.offsets[None, :], codes) if texts else codes, missing | lost


NET = Net(fresh, forward, backward, hidden)


def cross_net_out_of_fold(train: DataFrame, test: DataFrame | None, id_col: str, numbers: list[str], texts: list[str], label: str, cells: dict[str, list[str]] | None = None, fold: str = "fold", params: dict | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame | None, list[float]]:
    """(id, score) of ``train`` by the model that left its fold out, of ``test`` the mean over the folds' models, both log-odds, and the mean loss of each
    step. ``cells``: columns made of raw ones, and of which; a cell with a column ``<cell>_valid`` counts only where that is true."""
    p, cells = settled(PARAMS, params), cells or {}
    raw = [*numbers, *texts]
    if unknown := sorted({s for own in cells.values() for s in own} - set(raw)):
        raise ValueError(f"cells are made of columns that aren't inputs: {unknown}")
    ready = [df.withColumns({c: F.when(F.col(f"{c}_valid"), F.col(c)) for c in cells if f"{c}_valid" in df.columns}) if df is not None else None for df in (train, test)]
    design, rows = designed(*ready, id_col, label, fold, [*numbers, *cells], texts, p, coded=False)
    needs = np.zeros((len(design.numbers), len(raw)), bool)
    for k, c in enumerate(design.numbers):
        needs[k, [raw.index(s) for s in cells.get(c, [c])]] = True
    design.needs = needs
    return trained_out_of_fold(NET, design, rows, id_col, p, seed, test is not None)
