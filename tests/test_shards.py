"""Training takes a job an epoch, however many batches there are; several shards learn what one learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.operators import rank_fm
from sparkrank.operators.ranking import roc_auc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x, t = rng.random(900), rng.integers(0, 3, 900)
    y = (((x * 4).astype(int) + t) % 2 == 0) ^ (rng.random(900) < 0.1)
    return spark.createDataFrame([(i, int(y[i]), i % 3, float(x[i]), "abc"[t[i]]) for i in range(900)], "id long, y int, fold int, x double, t string")


def trained(spark, table, group, params):
    spark.sparkContext.setJobGroup(group, group)
    oof, _, losses = rank_fm.rank_fm_out_of_fold(table, None, "id", ["x"], ["t"], "y", params=params)
    spark.sparkContext.setJobGroup("other", "other")
    return oof, losses, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_batches(spark, table):
    few, many = (trained(spark, table, f"batch{b}", {"epochs": 2, "batch": b}) for b in (450, 30))
    assert len(few[1]) == 4 and len(many[1]) == 60 and many[2] <= few[2] + 4  # a job or more a batch before


def test_shards_learn_as_well_and_reruns_agree(spark, table, monkeypatch):
    p = {"epochs": 25, "batch": 100, "rate": 0.05, "hidden": 0.02}
    auc = lambda oof: roc_auc(oof.join(table.select("id", "y"), "id"), "y", "score").first()["auc"]
    one, losses, _ = trained(spark, table, "one", p)
    monkeypatch.setattr(rank_fm, "SHARD_BATCHES", 3)
    three, shared, _ = trained(spark, table, "three", p)
    again, _, _ = trained(spark, table.repartition(7), "again", p)
    assert len(losses) == len(shared) == 225 and auc(one) > 0.8 and auc(three) > 0.8 and three.count() == 900
    both = three.join(again.withColumnRenamed("score", "other"), "id")
    assert both.count() == 900 and both.where(F.abs(F.col("score") - F.col("other")) > 1e-6).count() == 0
