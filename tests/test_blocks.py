"""Random trees on blocks of rows: the same whatever a block holds, and least and largest values are those of each node."""

import numpy as np
from pyspark.sql import functions as F

from sparkrank.operators import random_trees


def test_blocks_of_any_size_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.random() < 0.3), i % 2, float(rng.random()), None if i % 13 == 0 else float(rng.integers(0, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, y int, model int, a double, b double")
    one = random_trees.fit_many(df, ["a", "b"], "y", params={"trees": 5, "depth": 4}, seed=3)
    monkeypatch.setattr(random_trees, "BLOCK_ROWS", 16)
    many = random_trees.fit_many(df.repartition(6, F.col("id")), ["a", "b"], "y", params={"trees": 5, "depth": 4, "every": 1}, seed=3)
    for m in (0, 1):
        assert (one.feature[m] == many.feature[m]).all() and (one.threshold[m] == many.threshold[m]).all() and (one.value[m] == many.value[m]).all()


def test_rows_are_ordered_by_node_and_only_open_ones():
    rng = np.random.default_rng(2)
    x, y = rng.random((3, 400)), rng.integers(0, 2, 400)
    nodes = rng.integers(4, 8, (1, 400)).astype(np.uint16)
    picked = {0: np.full((1, 16), -1)}
    picked[0][0, [4, 6, 7]] = [2, 0, 1]
    args = (3, 1, 3, 0, {0: np.full((1, 16), -1)}, {0: np.zeros((1, 16))}, picked)
    drawn = {0: np.array([[0, 1], [1, 2], [2, 0]])}
    got = {(r["place"], r["draw"]): (r["least"], r["largest"]) for b in random_trees._ranges(args, drawn, [random_trees._state(0, y, x, nodes)]) for r in b.to_pylist()}
    want = {(p, j): (x[drawn[0][p, j], nodes[0] == n].min(), x[drawn[0][p, j], nodes[0] == n].max()) for n, p in ((4, 2), (6, 0), (7, 1)) for j in (0, 1)}
    assert got == want
