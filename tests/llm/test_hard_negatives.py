"""Mined negatives against all pairs, whatever lists, blocks and rounds are."""

import math
import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import hard_negatives as hard

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def all_pairs(rows, anchors, positives=5, negatives=10):
    own = {(i, la, tuple(max(-hard.LIMIT, min(hard.LIMIT, math.floor(float(np.float32(x)) * 256))) for x in v)) for i, la, v in rows if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    late = lambda i: math.inf if i is None else i
    for i, la, v in own:
        if i is None or not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), late(j), j, lb == la) for j, lb, w in own if j != i)
        for s, _, j, _ in [x for x in scored if x[3]][:positives]:
            fit = [x for x in scored if not x[3] and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, j, k + 1, x[2], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "row", "list", "block", "part", "goals", "rank", "score", "far", "n")})


@pytest.mark.parametrize(("lists", "block", "rounds", "parts"), [(1, 1 << 20, (4, 32), 2048), (12, 64 * 8, (1, 3), 3), (40, 8, (), 1)])
def test_equal_to_all_pairs(spark, monkeypatch, lists, block, rounds, parts):
    monkeypatch.setattr(hard, "ANCHORS", parts)
    rng = np.random.default_rng(lists)
    centers = rng.normal(size=(9, 8))
    rows = [(k, int(rng.integers(4)), [float(x) for x in centers[rng.integers(9)] + 0.2 * rng.normal(size=8)]) for k in range(260)]
    rows += [(300 + k, k % 3, rows[20][2]) for k in range(40)]  # one vector, many times
    rows += [rows[10], rows[20], (20, 3, rows[21][2])]  # equal rows; one id, two rows
    rows += [(400, None, rows[1][2]), (401, 1, None), (402, 1, [1.0, None] + [0.0] * 6), (403, 1, [math.nan] * 8), (404, 1, [math.inf] + [0.0] * 7), (410, 2, [0.5, 0.25]), (420, 1, []), (None, 2, rows[40][2]), (None, 1, rows[40][2]), (430, 1, [0.0] * 8)]
    anchors = lambda i: i % 10 == 0
    df = hard.hard_negatives(table(spark, rows), F.col("id") % 10 == 0, lists=lists, block=block, rounds=rounds)
    assert got(df) == all_pairs(rows, anchors)


def test_components_beyond_floats(spark):
    rng = random.Random(3)
    rows = [(k, k % 2, [rng.choice([1e30, -1e30, 3.4e38, 200_000.7, 131_071.3, -0.001, 1.5]) for _ in range(6)]) for k in range(60)]
    assert got(hard.hard_negatives(table(spark, rows), F.col("id") % 10 == 0, lists=4, rounds=(1,))) == all_pairs(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_skip(spark):
    rng = np.random.default_rng(2)
    centers = 4 * rng.normal(size=(16, 8))
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(50, 8)) for c in centers]))
    own = spark.createDataFrame([(k, k % 2, [int(e) for e in v], k) for k, v in enumerate(x)], "id long, label long, v array<int>, row long")
    index = hard.Lists(own, lists=16)
    where = {r["id"]: r["list"] for r in index.rows.collect()}
    low, high = index.bounds(x[:40])
    scores = hard.products(x[:40], x)
    for k, li in where.items():
        assert (low[:, li] <= scores[:, k]).all() and (scores[:, k] <= high[:, li]).all()
    anchors = index.rows.where("id % 100 = 0").select("row", "id", "label", "v").withColumn("goals", F.array(F.lit(0).cast("long")))
    visits = []
    keep = hard.written
    try:
        hard.written = lambda df, name: visits.append(out := keep(df, name)) or out if name == "visits" else keep(df, name)
        assert hard.search(index, anchors, 5, False, (2,)).count() == 8 * 5
    finally:
        hard.written = keep
    assert len(visits) == 2 and visits[0].count() == 16 and visits[1].count() < 8 * len(index.c) / 2  # most lists are never visited


def test_query(spark, sf, tmp_path):
    assert oracle.difference(hard.op12_hard_negatives(spark, sf), oracle.connection(sf), hard.OP12_SQL) == ""
    spark.read.parquet(f"{sf}/embeddings.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert hard.op12_hard_negatives(spark, str(tmp_path)).count() == 0
