"""Tables of blocks are written so that a task never decodes many of them at once."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkrank.operators import boosting, random_trees, stack


@pytest.fixture
def groups(monkeypatch):
    """Rows of each row group of the tables that a module writes, by the table's name."""
    found = {}

    def watch(module):
        write = module.written

        def watched(df, name, *by, **how):
            out = write(df, name, *by, **how)
            for f in glob.glob(out._sparkrank_path.removeprefix("file://") + "/**/*.parquet", recursive=True):
                meta = pq.ParquetFile(f).metadata
                found.setdefault(name, []).extend(meta.row_group(k).num_rows for k in range(meta.num_row_groups))
            return out

        monkeypatch.setattr(module, "written", watched)
        return found

    return watch


def forty_models(spark):
    """In one partition, so that a task has a block of each."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.random() < 0.4), i % 40, int(i % 160 >= 120), float(rng.random()), float(rng.random())) for i in range(800)]
    return spark.createDataFrame(rows, "id long, y int, model int, part int, a double, b double").repartition(1)


def test_random_trees_write_few_blocks_together_and_nodes_of_a_byte(spark, groups):
    found, state = groups(random_trees), random_trees._state
    random_trees.fit_many(forty_models(spark), ["a", "b"], "y", params={"trees": 3, "depth": 5, "every": 2})
    assert sum(found["trees"]) == 120 and max(found["trees"]) <= 8  # at the start and twice after two levels, forty blocks each
    args = (2, 3, 6, 1, {0: np.full((3, 512), -1)}, {0: np.zeros((3, 512))})
    y, x = np.zeros(16, int), np.zeros((2, 16))
    (root,) = random_trees._start(["a", "b"], [pa_rows(16)])
    assert len(root.column("nodes")[0].as_py()) == 0
    (moved,) = random_trees._advanced(*args, [root])
    assert len(moved.column("nodes")[0].as_py()) == 3 * 16
    assert [n.tolist() for *_, n in random_trees._blocks(2, 3, [state(0, y, x, np.full((3, 16), 300, np.uint16))])] == [[[300] * 16] * 3]


def pa_rows(n):
    return pa.RecordBatch.from_pydict({"model": pa.array([0] * n, pa.int32()), "y": pa.array([0] * n, pa.int32()), "a": [0.0] * n, "b": [0.0] * n})


def test_boosting_writes_few_blocks_together(spark, groups):
    found = groups(boosting)
    boosting.fit_many(forty_models(spark), ["a", "b"], "y", "id", params={"rounds": 2, "depth": 2, "every": 2})
    assert len(found["boosting"]) > 3 * 40 // 8 and max(found["boosting"]) <= 8


def test_a_task_counts_bounded_rows_at_once(monkeypatch):
    monkeypatch.setattr(boosting, "PACKET_ROWS", 100)
    rng = np.random.default_rng(3)
    y, steps = rng.integers(0, 2, 400).astype(float), np.round(rng.random((2, 400)), 1)
    blocks = pa.RecordBatch.from_pydict({"model": pa.array([5] * 10, pa.int32()), "rows": pa.array([40] * 10, pa.int32()), "y": [y[k : k + 40].tobytes() for k in range(0, 400, 40)], "steps": [steps[:, k : k + 40].tobytes() for k in range(0, 400, 40)]})
    sent = [r for b in boosting._packets({}, 2, [blocks]) for r in b.to_pylist()]
    sizes = [np.frombuffer(r["p"], np.int64).sum() + np.frombuffer(r["n"], np.int64).sum() for r in sent]
    assert sorted(sizes) == [40] * 2 + [120] * 6
    for k in (0, 1):
        own = [(np.frombuffer(r["score"]), np.frombuffer(r["p"], np.int64)) for r in sent if r["step"] == k]
        assert sum((s * p).sum() for s, p in own) == pytest.approx((steps[k] * y).sum())


def test_the_meta_model_writes_its_rows_once(spark, groups):
    found = groups(boosting)
    df = spark.createDataFrame([(i, i * 7 % 3 % 2, i % 4, (i * 31 % 97) / 97, (i * 7919 % 101) / 101) for i in range(200)], "id long, y int, fold int, a double, b double")
    scores, _ = stack.nonlinear_meta(df, "id", ["a", "b"], [], "y", params={"rounds": 2, "depth": 2, "every": 2, "patience": None})
    assert scores.count() == 200 and "boosted" not in found  # the design is written, and no copy for each model
