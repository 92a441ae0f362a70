"""The mix against its definition: targets, passes, positions by numeric integration, awkward rows."""

import random

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import curriculum as mix


def test_word_count(spark):
    rows = [(None, 0), ("", 0), (" \t\n\x0b\f\r ", 0), ("a", 1), ("  a  b\n", 2), ("a b   c", 3), ("x\x0by", 2), ("wörd " * 5000, 5000)]
    got = spark.createDataFrame(rows, "t string, n int").select("n", mix.word_count(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == [r["n"] for r in got]


def levels(sizes, weights, share, passes):
    """By halving the level that all sources that aren't full share."""
    low, high = 0.0, 4 * sum(sizes) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, passes * s) for s, w in zip(sizes, weights, strict=True)) < share * sum(sizes) else (low, mid)
    return [min(w * low, passes * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = sorted(["b", "é", "a", "Z", "zz", "~", "c", "0"], key=lambda s: s.encode()) + [None]
    sizes = [rng.choice([0, 1, 5, 100, 3000]) * rng.randint(1, 9) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {r["source"]: (r["_rank"], r["target"]) for r in mix.source_targets(df).collect()}
    want = levels(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2.0)
    for k, (name, t) in enumerate(zip(names, want, strict=True)):
        assert got[name][0] == k and got[name][1] == pytest.approx(t, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("knots", [((0, 1), (1, 1)), ((0, 0), (1, 2)), ((0, 3), (0.25, 0), (0.5, 0), (1, 4)), ((0, 0), (0.5, 1), (1, 0))])
def test_inverse_demand(spark, knots):
    parts = [0.0, 0.01, 0.2, 0.375, 0.5, 0.77, 0.999]
    at = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "p double").select(mix.inverse_demand(F.col("p"), knots)).collect()]
    grid = np.linspace(0, 1, 200_001)
    rate = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2) * (grid[1] - grid[0])])
    for p, t in zip(parts, at, strict=True):
        assert np.interp(t, grid, area) / area[-1] == pytest.approx(p, abs=1e-6)
    with pytest.raises(ValueError):
        mix.inverse_demand(F.lit(0.5), ((0.0, 1.0), (0.5, 1.0)))


def test_awkward_rows(spark):
    rows = [(k, "w " * (k % 7), "abc"[k % 3]) for k in range(90)] + [(None, "null id", "a")] * 40 + [(5, "same row", "b")] * 30 + [(200, None, "a"), (201, "no source", None), (202, "", "empty"), (203, "long " * 20_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("size", "k", "n", "key", "_before", "_rank", "target", "position", "weight")})
    out = mix.mixed(df).persist()
    assert out.count() == len(rows)
    for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.sum("size").alias("s"), F.first("source_size").alias("all")).collect():
        assert abs(r["t"] - r["n"]) <= 0.5 and r["s"] == r["all"] and r["n"] <= 2 * r["s"]
    assert out.where("taken > 2 * size or taken <> aggregate(pieces, 0L, (a, p) -> a + p.words) or (taken > 0) <> (position is not null)").count() == 0
    order = mix.training_order(out).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order) and sum(r["words"] for r in order) == out.agg(F.sum("taken")).first()[0]
    again = mix.mixed(df.repartition(7)).select("doc_id", "size", "taken", "position")
    assert out.select("doc_id", "size", "taken", "position").exceptAll(again).count() == 0
    assert mix.mixed(df.where(F.lit(False))).count() == 0 and mix.mixed(df.where("text is null")).select("taken").collect() == [(0,)]


def test_query(spark, sf):
    assert oracle.difference(mix.op13_curriculum_mix(spark, sf), oracle.connection(sf), mix.OP13_SQL) == ""
