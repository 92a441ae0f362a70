"""Nearest rows by leaves and boxes: the same as by all pairs, also with ties and copies, at little of the comparisons."""

import numpy as np

from sparkrank.operators import knn


def test_neighbours_equal_all_pairs_with_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 12, (400, 3)).astype(float), np.tile([[3.0, 3.0, 3.0]], (60, 1))])
    y = np.where(x[:, 0] > 9, 1, rng.random(460) < 0.02).astype(int)  # one class lies at an end and is rare elsewhere
    ids = rng.permutation(460)
    parent = spark.createDataFrame([(int(i), *map(float, v), int(c)) for i, v, c in zip(ids, x, y, strict=True)], "id long, a double, b double, c double, y int")
    parent = parent.unionByName(spark.createDataFrame([(900, None, 1.0, 1.0, 0)], parent.schema))
    q = np.concatenate([rng.integers(0, 12, (40, 3)).astype(float), [[3.0, 3.0, 3.0], [90.0, -5.0, 0.5]]])
    query = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(q)], "id long, a double, b double, c double")
    for rows in (5, 64, 1000):
        got: dict[int, list] = {}
        for r in knn.neighbours(query, parent, "id", "id", ["a", "b", "c"], "y", 4, rows, 16).collect():
            got.setdefault(r["id"], []).append(r)
        for k, v in enumerate(q):
            far = np.sqrt(((x - v) ** 2).sum(1))
            first = np.lexsort((ids, far))[:4]
            own = sorted(got[k], key=lambda r: r["place"])
            assert [r["parent_id"] for r in own[:4]] == ids[first].tolist() and np.allclose([r["distance"] for r in own[:4]], far[first])
            assert [min(r["distance"] for r in own if r["label"] == c) for c in (0, 1)] == [far[y == c].min() for c in (0, 1)]


def test_few_leaves_are_within_a_query_s_bound():
    x = np.random.default_rng(5).random((20_000, 2))
    tree = knn.grown(x, 100)
    own = tree.leaves_of(x)
    ends = [[f(x[own == n], 0) for n in range(own.max() + 1)] for f in (np.min, np.max)]
    tree.fill(np.array(ends[0]), np.array(ends[1]), np.bincount(own))
    assert len(ends[0]) >= 200 and tree.rows[0] == 20_000
    q = np.random.default_rng(6).random((500, 2))
    row, at, far = knn.Cells(x, np.arange(20_000), 5).nearest(q, 5, np.full(500, np.inf))
    assert (row == np.repeat(np.arange(500), 5)).all() and np.allclose(far.reshape(500, 5), np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), 1)[:, :5])
    assert len(tree.near(q, far[4::5])[0]) < 3 * 500  # of over 200 leaves each
