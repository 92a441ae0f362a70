"""Banks of predictions: what loads, and what refuses the whole."""

import os

import pytest
from pyspark.sql import functions as F

from sparkrank.operators.ranking import roc_auc
from sparkrank.plans import lineage
from sparkrank.sources import banks, sinks, tables

INF = float("inf")


@pytest.fixture(scope="module")
def ours(spark):
    rows = [(100 + 3 * k, k % 3 // 2, k % 4, k) for k in range(60)]
    train = spark.createDataFrame(rows, "id long, y int, fold int, row_pos long")
    test = spark.createDataFrame([(900 + k, k) for k in range(20)], "id long, row_pos long")
    return train, test


def score(k):
    return ((F.col("id") * (7 + 4 * k)) % 101 + 1).cast("double") / 103


def library(where, train, test, models=("a", "b")):
    cols = {m: score(k) for k, m in enumerate(models)}
    banks.write_library(where, train, test, train.withColumns(cols), test.withColumns(cols), list(models), "id", "y")
    return banks.Source("library", where)


def native(where, train, test, models=("a", "c"), folds=None):
    sinks.write_folds(train if folds is None else folds, f"{where}/folds", "id", "y")
    for k, m in enumerate(models):
        for split, df in (("train", train), ("test", test)):
            sinks.write_predictions(df.select("id", score(k + 2).alias("score")), f"{where}/predictions", split, m, "id")
    return banks.Source("native", where, "local")


def logits(where, train, test, name="member"):
    train.select("id", F.col("row_pos").alias(name)).write.mode("overwrite").parquet(f"{where}/oof_members.parquet")
    test.select("id", F.col("row_pos").alias(name)).write.mode("overwrite").parquet(f"{where}/test_members.parquet")
    return banks.Source("logits", where, "fm")


def test_loads_all_kinds_side_by_side(spark, ours, tmp_path):
    train, test = ours
    sources = [library(f"{tmp_path}/lib", train, test), native(f"{tmp_path}/own", train, test), logits(f"{tmp_path}/fm", train, test)]
    found = banks.load(train, test, sources, "id", "y")
    assert found.names == ["a", "b", "local__a", "local__c", "fm__member"] and found.logits == ["fm__member"]
    want = train.select("id", "y", "fold", "row_pos", score(0), score(1), score(2), score(3), F.col("row_pos").cast("double"))
    assert sorted(map(tuple, found.train.collect())) == sorted(map(tuple, want.collect()))
    assert found.test.count() == 20 and sorted(r[0] for r in found.test.select("fm__member").collect()) == list(map(float, range(20)))
    table = {r["model"]: r for r in found.table.collect()}
    assert [r["model"] for r in found.table.collect()] == sorted(found.names, key=lambda n: (-table[n]["auc"], n))
    ends = train.agg(F.min(score(1)), F.max(score(1)), roc_auc(train.withColumn("s", score(1)), "y", "s").select("auc").first()[0] * F.first(F.lit(1.0))).first()
    assert (table["b"]["least"], table["b"]["largest"], table["b"]["auc"]) == pytest.approx(tuple(ends))
    sources[0].exclude, sources[1].include = ["a"], ["c"]
    assert banks.load(train, test, sources, "id", "y").names == ["b", "local__c", "fm__member"]


def refused(spark, train, test, *sources):
    before = lineage.tables(spark)
    with pytest.raises(banks.Refused) as e:
        banks.load(train, test, list(sources), "id", "y")
    assert lineage.tables(spark) == before  # nothing is left behind
    return {(os.path.basename(s), split, check): n for s, split, check, n in e.value.problems}


def test_refuses_the_whole_and_names_every_problem(spark, ours, tmp_path):
    train, test = ours
    good = logits(f"{tmp_path}/fm", train, test)
    wrong = train.withColumns({"fold": F.lit(0), "y": F.when(F.col("id") < 130, 1 - F.col("y")).otherwise(F.col("y"))})
    assert refused(spark, train, test, good, native(f"{tmp_path}/a", train, test, folds=wrong)) == {("a", "train", "has other folds"): 45, ("a", "train", "has other labels"): 10}
    shifted = train.withColumn("id", F.col("id") + F.when(F.col("row_pos") >= 50, 1).otherwise(0))
    problems = refused(spark, train, test, library(f"{tmp_path}/b", shifted, test), logits(f"{tmp_path}/c", shifted, test.where("id < 910")))
    assert problems[("b", "train", "has other ids at our rows")] == 10 and problems[("c", "train", "lacks ids of ours")] == 10
    assert problems[("c", "train", "has ids that aren't ours")] == 10 and problems[("c", "test", "lacks ids of ours")] == 10
    swapped = train.withColumn("y", 1 - F.col("y"))
    assert refused(spark, train, test, library(f"{tmp_path}/d", swapped, test)) == {("d", "train", "has other labels"): 60}


def test_refuses_values_rows_and_names(spark, ours, tmp_path):
    train, test = ours
    odd = F.when(F.col("id") == 103, F.lit(None)).when(F.col("id") == 106, float("nan")).when(F.col("id") == 109, INF).otherwise(F.col("row_pos"))
    train.select("id", odd.alias("m")).union(train.select("id", F.lit(1.0)).limit(3)).write.parquet(f"{tmp_path}/e/oof_members.parquet")
    test.select("id", F.col("row_pos").alias("m")).write.parquet(f"{tmp_path}/e/test_members.parquet")
    found = refused(spark, train, test, banks.Source("logits", f"{tmp_path}/e"))
    assert found[("e", "train", "repeats ids")] == 3 and 1 <= found[("e", "train", "not finite: m")] <= 3
    lib = library(f"{tmp_path}/f", train, test)
    spark.createDataFrame([("a",)], "model string").coalesce(1).write.mode("overwrite").csv(f"{tmp_path}/f/manifest.csv", header=True)
    lib.include = ["a", "b", "z"]
    assert {k[1:] for k in refused(spark, train, test, lib, banks.Source("native", f"{tmp_path}/nowhere"))} == {("train", "not in the manifest: ['b', 'z']"), ("train", "no predictions of ['z']"), ("test", "no predictions of ['z']"), ("train", "no predictions")}
    test.select("id", F.col("row_pos").alias("other")).write.mode("overwrite").parquet(f"{tmp_path}/g/test_members.parquet")
    train.select("id", F.col("row_pos").alias("member")).write.mode("overwrite").parquet(f"{tmp_path}/g/oof_members.parquet")
    assert refused(spark, train, test, banks.Source("logits", f"{tmp_path}/g")) == {("g", "test", "no members ['member']"): 1}
    one = logits(f"{tmp_path}/h", train, test)
    assert ("", "train", "the name fm__member comes twice") in refused(spark, train, test, one, one)
    assert refused(spark, train, test) == {("", "train", "no sources"): 0}
    with pytest.raises(ValueError, match="row_pos"):
        banks.load(train.drop("row_pos"), test, [lib], "id", "y")


def test_bands(spark, ours, tmp_path):
    train, test = ours
    both = train.where("id < 160").select("id", F.lit("train").alias("split"), score(5).alias("prediction")).union(test.where("id > 910").select("id", F.lit("test"), score(5)))
    both.write.parquet(f"{tmp_path}/low")
    found = banks.load_bands(train, test, [f"{tmp_path}/low"], "id")
    assert found["train"].count() == 60 and found["train"].where("band0 is not null").count() == 20 and found["test"].where("band0 is not null").count() == 9
    both.union(both.where("id in (100, 911)")).union(spark.createDataFrame([(1, "train", 0.5), (103, "test", INF)], both.schema)).write.parquet(f"{tmp_path}/odd")
    before = lineage.tables(spark)
    with pytest.raises(banks.Refused) as e:
        banks.load_bands(train, test, [f"{tmp_path}/low", f"{tmp_path}/odd"], "id")
    assert lineage.tables(spark) == before
    assert {(p[1], p[2]): p[3] for p in e.value.problems} == {("train", "has ids that aren't ours"): 1, ("train", "repeats ids"): 1, ("test", "has ids that aren't ours"): 1, ("test", "repeats ids"): 1}
    with pytest.raises(banks.Refused, match="prediction"):
        both.drop("prediction").write.parquet(f"{tmp_path}/short")
        banks.load_bands(train, test, [f"{tmp_path}/short"], "id")


def test_settings():
    got = banks.settings_sources({"library": "lib", "prediction_sources": [{"path": "a", "prefix": "mine", "include": ["x"]}, "b"], "logit_sources": [{"path": "c"}]})
    assert [(s.kind, s.path, s.prefix) for s in got] == [("library", "lib", ""), ("native", "a", "mine"), ("native", "b", "local"), ("logits", "c", "external")]
    with pytest.raises(ValueError, match="path"):
        banks.settings_sources({"logit_sources": [{"directory": "c"}]})


def test_stack_of_banks_and_bands(spark, tmp_path):
    from sparkrank.workflow import Run

    train, test, sample = tables.demo(spark, 240, 80)
    for name, df in (("train", train), ("test", test), ("sample", sample)):
        df.orderBy("id").coalesce(1).write.csv(f"{tmp_path}/{name}", header=True)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.schema)
    tree = {
        "project": {"target": "addicted_label", "id_column": "id"}, "output": {"directory": f"{tmp_path}/out"}, "cv": {"n_splits": 3, "seed": 17},
        "data": {"train_path": f"{tmp_path}/train", "test_path": f"{tmp_path}/test", "sample_path": f"{tmp_path}/sample", "schema": schema}, "features": {"drop_columns": ["addiction_level"]},
        "stack": {"library": f"{tmp_path}/lib", "prediction_sources": [{"path": f"{tmp_path}/own", "prefix": "mine"}], "logit_sources": [{"path": f"{tmp_path}/fm", "prefix": "fm"}], "c_values": [0.1], "bands": [{"path": f"{tmp_path}/band", "weight": 1.0}]},
    }
    run = Run(spark, tree)
    own = run.folded().withColumn("hint", F.col("addicted_label") * 0.3 + F.pmod(F.col("id") * 37, F.lit(101)) / 150).select("id", "addicted_label", "fold", "row_pos", "hint")
    there = run.test.select("id", "row_pos", (F.pmod(F.col("id") * 37, F.lit(101)) / 110).alias("hint"))
    banks.write_library(f"{tmp_path}/lib", own, there, own.withColumns({"a": F.col("hint"), "b": score(1)}), there.withColumns({"a": F.col("hint"), "b": score(1)}), ["a", "b"], "id", "addicted_label")
    sinks.write_folds(own, f"{tmp_path}/own/folds", "id", "addicted_label")
    for split, df in (("train", own), ("test", there)):
        sinks.write_predictions(df.select("id", score(2).alias("score")), f"{tmp_path}/own/predictions", split, "m", "id")
        df.select("id", (F.col("hint") * 4 - 2).alias("member")).write.parquet(f"{tmp_path}/fm/{'oof' if split == 'train' else 'test'}_members.parquet")
    own.where("row_pos < 90").select("id", F.lit("train").alias("split"), (F.col("addicted_label") + F.col("hint")).alias("prediction")).union(there.where("row_pos < 30").select("id", F.lit("test"), "hint")).write.parquet(f"{tmp_path}/band")
    report = run.stack()
    assert report["models"] == ["a", "b", "mine__m", "fm__member"] and report["chosen"] == "mix" and set(report["weights"]) == set(report["models"])
    (band,) = report["bands"]
    assert band["rows"] == 90 and band["local"] == 1.0 and band["before"] < 1.0 and report["auc"]["mix"] > max(report["auc"]["global"], report["auc"]["regime"])
    assert spark.read.csv(f"{tmp_path}/out/submission_stack", header=True).count() == 80
    sinks.write_folds(own.withColumn("fold", F.lit(0)), f"{tmp_path}/own/folds", "id", "addicted_label")
    with pytest.raises(banks.Refused, match="other folds"):
        run.stack()
