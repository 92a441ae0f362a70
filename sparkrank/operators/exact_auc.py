"""Exact ROC-AUC of very many scores: tasks count theirs by value in numpy, ranges of values are ordered each for itself.

A task sends what it counted of a (group, step) in a packet for each range; a range's packets are one small group, and a row of
whole numbers for each range comes to the driver. Marks between ranges only share out the work; any marks give the same figures.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Scores in a range, about.
RANGE_ROWS = 200_000
PACKETS = "group int, step int, range int, score binary, p binary, n binary"
_SUMS = "group int, step int, range int, pairs long, p long, n long"


def packets(found: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], marks: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    """Scores and 0/1 labels of each (group, step), counted by value and cut at its marks."""
    rows: list[list] = [[] for _ in range(6)]
    for (group, step), (score, y) in found.items():
        value, back = np.unique(score, return_inverse=True)
        p = np.bincount(back, y, len(value)).astype(np.int64)
        n = np.bincount(back, minlength=len(value)) - p
        ends = [0, *np.searchsorted(value, marks.get((group, step), np.empty(0)), "left"), len(value)]
        for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
            if hi > lo:
                for column, v in zip(rows, (group, step, k, value[lo:hi].tobytes(), p[lo:hi].tobytes(), n[lo:hi].tobytes()), strict=True):
                    column.append(v)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in PACKETS.split(", ")])


def _ordered(key, table):
    """A range's pairs of a positive and a smaller negative, twice (ties once), and its positives and negatives."""
    read = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    score, p, n = read("score", np.float64), read("p", np.int64), read("n", np.int64)
    order = np.argsort(score, kind="stable")
    score, p, n = score[order], p[order], n[order]
    starts = np.append(0, np.flatnonzero(score[1:] != score[:-1]) + 1)
    p, n = np.add.reduceat(p, starts), np.add.reduceat(n, starts)
    pairs = (p * (2 * (np.cumsum(n) - n) + n)).sum()
    values = [*(k.as_py() for k in key), int(pairs), int(p.sum()), int(n.sum())]
    return pa.table([pa.array([v], k) for v, k in zip(values, [pa.int32()] * 3 + [pa.int64()] * 3, strict=True)], names=[c.split()[0] for c in _SUMS.split(", ")])


def aucs(sent: DataFrame) -> dict[tuple[int, int], float | None]:
    """The AUC of each (group, step) of ``sent``, rows of :func:`packets`; None where a class is absent."""
    ranges = defaultdict(list)
    for r in sent.groupBy("group", "step", "range").applyInArrow(_ordered, _SUMS).collect():  # a row per range
        ranges[r["group"], r["step"]].append((r["range"], r["pairs"], r["p"], r["n"]))
    out = {}
    for at, parts in ranges.items():
        pairs = below = positives = 0
        for _, own, p, n in sorted(parts):
            pairs, below, positives = pairs + own + 2 * p * below, below + n, positives + p
        out[at] = pairs / (2 * positives * below) if positives and below else None
    return out


def quantiles(score: np.ndarray, ranges: int) -> np.ndarray:
    """What a task says of its scores, so that :func:`marks_of` can share them out."""
    return np.quantile(score, (np.arange(2 * ranges) + 0.5) / (2 * ranges))


def marks_of(said: list[np.ndarray], ranges: int) -> np.ndarray:
    return np.unique(np.quantile(np.concatenate(said), np.arange(1, ranges) / ranges)) if ranges > 1 else np.empty(0)
