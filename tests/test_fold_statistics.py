"""Statistics of all folds' models by one set of orders equal those of each model's own rows, and rows aren't copied by model and column."""

import pytest
from pyspark.sql import functions as F

from sparkrank.operators import boosting, ordered


def table(spark):
    rows = [(i, i * 7 % 3 % 2, [None, "a", "a", "b", "=", ""][i % 6] if i % 11 else f"rare{i}", i * 13 % 4, i % 5) for i in range(240)]
    return spark.createDataFrame(rows, "id long, y int, c string, d int, fold int")


def test_folds_share_their_orders(spark, monkeypatch):
    df, folds = table(spark), [0, 2, 3]
    test = df.where("id % 9 = 0").select((F.col("id") + 1000).alias("id"), F.when(F.col("id") == 9, "new").otherwise(F.col("c")).alias("c"), "d")
    copies = df.unionByName(test.select("*", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("fold"))).withColumn("model", F.explode(F.array(*map(F.lit, folds))))
    copies = copies.withColumn("learn", F.coalesce(F.col("fold") != F.col("model"), F.lit(False)))
    want = {(r["model"], r["id"]): (r["c__ts"], r["d__ts"]) for r in ordered.ordered_statistics(copies, "id", "y", ["c", "d"], "learn", ["model"], orders=3, weight=2.0).collect()}
    for lot in (1 << 14, 16):
        monkeypatch.setattr(ordered, "LOT_ROWS", lot)
        ours, theirs = ordered.fold_statistics(df, test, "id", "y", ["c", "d"], "fold", folds, orders=3, weight=2.0)
        got = {(m, r["id"]): (r[f"_t0_{k}"], r[f"_t1_{k}"]) for part in (ours, theirs) for r in part.collect() for k, m in enumerate(folds)}
        assert got.keys() == want.keys()
        for at, both in want.items():
            assert got[at] == pytest.approx(both, abs=1e-12)


def test_rows_are_written_once_for_all_models(spark, monkeypatch):
    rows, write = {}, boosting.written

    def watched(df, name, *by, **how):
        out = write(df, name, *by, **how)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(boosting, "written", watched)
    oof, scores, _ = boosting.boosted_out_of_fold(table(spark), table(spark).where("id < 20").drop("y", "fold"), "id", ["d"], "y", categories=["c"], params={"rounds": 2, "depth": 2, "every": 2})
    assert oof.count() == 240 and scores.count() == 20 and rows["boosted"] <= 240
