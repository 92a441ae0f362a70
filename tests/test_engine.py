"""Exact cases, invariants and refusals of the engine's operators."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkrank.operators import align, audit, blend, encode, folds, knn, ranking, stack
from sparkrank.plans import config, geometry, views
from sparkrank.sources import sinks, tables

NUMBERS = "age double, daily_screen_time_hours double, social_media_hours double, gaming_hours double, work_study_hours double, sleep_hours double, notifications_per_day double, app_opens_per_day double, weekend_screen_time double"


@pytest.fixture(scope="module")
def hours(spark):
    rows = [(0, 26.0, 11.2, 1.87, 2.81, 1.95, 5.25, 100.0, 20.0, 13.39), (1, 21.0, 8.42, 2.57, 3.41, 1.9, 6.64, 80.0, 15.0, 8.35), (2, 30.0, None, 1.0, 1.0, 1.0, 7.0, 60.0, 10.0, 8.0)]
    return spark.createDataFrame(rows, f"id long, {NUMBERS}")


def test_artifacts(hours):
    cols = [c for c in hours.columns if c != "id"]
    out = views.view(hours, "engineered_artifact_cat", ["id"], cols).orderBy("id").collect()
    s = "daily_screen_time_hours"
    assert [r[f"{s}__first_decimal_digit"] for r in out] == ["2", "4", None]
    assert [r[f"{s}__decimal_length"] for r in out] == ["1", "2", None]
    assert out[0]["screen_component_residual"] == pytest.approx(4.57) and out[2]["screen_component_residual"] is None
    assert out[0][f"{s}__exact_level"] == "11.2" and out[2]["missing_count"] == 1.0
    assert out[0]["social_ratio"] == pytest.approx(1.87 / 11.2) and out[2]["social_ratio"] is None
    assert "impact_yes_x_screen" not in out[0].asDict()  # its inputs aren't there


def test_views_refuse(hours):
    with pytest.raises(ValueError, match="unknown view"):
        views.view(hours, "odd", ["id"], ["age"])
    with pytest.raises(ValueError, match="needs a parent"):
        views.view(hours, "raw_parent", ["id"], ["age"])
    with pytest.raises(ValueError, match="no such columns"):
        views.feature_columns(hours, "id", "y", ["nothing"])


def test_geometry(spark):
    rows = [(0, 24.0, 8.0, 2.0, 1.0, 3.0, 7.0, 100.0, 20.0, 9.0), (1, 30.0, None, 2.0, None, 1.0, 8.0, None, 15.0, None)]
    out = geometry.budget_geometry(spark.createDataFrame(rows, f"id long, {NUMBERS}"), ["id"], 15.0)
    assert len(out.columns) == 1 + 31 + 31
    a, b = (r.asDict() for r in out.orderBy("id").collect())
    assert all(v is not None for r in (a, b) for v in r.values())
    assert sum(v for k, v in a.items() if k.endswith("_valid")) > sum(v for k, v in b.items() if k.endswith("_valid"))
    assert a["capacity"] == 2.0 and a["screen_std"] == pytest.approx(3.2619013) and b["daily_width"] == 12.0 and b["width_1_valid"] is False


def test_regime_design(spark):
    rows = [(i, *[(4 * i + j) / 10 for j in range(4)], i) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, missing int")
    mean, deviation = stack.disagreement(df, list("abcd"))
    one, two = (stack.regime_design(df, ["id"], list("abcd"), "missing", *m).orderBy("id").collect() for m in ((), (mean, deviation)))
    assert len(one[0]) == 1 + 21 and one == two
    assert one[0]["complete"] == 1.0 and one[4]["severe"] == 1.0 and one[4]["a_severe"] == pytest.approx(1.6)


def test_reorder(spark):
    df = spark.createDataFrame([(i, (i + 1) / 10, {1: 3.0, 3: 2.0, 4: 1.0}.get(i)) for i in range(5)], "row long, base double, local double")
    out = {r["row"]: r["base"] for r in blend.reorder(df, "base", "local", 1.0, "row").collect()}
    assert [out[k] for k in range(5)] == pytest.approx([0.1, 0.5, 0.3, 0.4, 0.2])


def test_auc_and_ranks(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 3 == 0, ((i * 31) % 40) / 8) for i in range(500)], "id long, y boolean, s double").withColumn("y", F.col("y").cast("int"))
    auc = ranking.roc_auc(df, "y", "s").first()["auc"]
    assert ranking.roc_auc(df.withColumn("s", -F.col("s")), "y", "s").first()["auc"] == pytest.approx(1 - auc)
    assert ranking.roc_auc(df, "y", "s", bins=1).first()["auc"] == pytest.approx(auc)
    r = ranking.average_ranks(df, "s", percentile=False).agg(F.avg("rank"), F.min("rank")).first()
    assert r[0] == pytest.approx(250.5) and r[1] > 0
    assert ranking.roc_auc(df.where("y = 1"), "y", "s").first()["auc"] is None
    assert ranking.roc_auc(df.where("y = 7"), "y", "s").count() in (0, 1)


def test_nullable_ranks(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0), (4, 2.0)], "id long, s double")
    assert {r["id"]: r["rank"] for r in ranking.nullable_percentiles(df, "s").collect()} == pytest.approx({1: 2.5 / 3, 2: 0.5, 3: 1 / 3, 4: 2.5 / 3})


def test_folds_are_even(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    out = folds.stratified_folds(df, "id", "y").groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    assert len(out) == 5 and max(r["n"] for r in out) - min(r["n"] for r in out) <= 1 and max(r["p"] for r in out) - min(r["p"] for r in out) <= 1


def test_encoding(spark):
    df = spark.createDataFrame([("train", 1.0, "a"), ("train", 3.0, None), ("test", None, "b"), ("train", float("inf"), "a")], "split string, x double, c string").withColumn("id", F.monotonically_increasing_id())
    out = encode.encoded(df, ["split"], ["x", "c"])
    assert out.columns == ["split", "x", "x__missing", "c__a", "c__b", "c__nan"]
    assert out.where("split = 'test'").first() == Row(split="test", x=2.0, x__missing=1.0, c__a=0.0, c__b=1.0, c__nan=0.0)
    with pytest.raises(ValueError, match="clash"):
        encode.encoded(df.withColumn("x__missing", F.lit(1.0)), ["split"], ["x", "x__missing"])
    with pytest.raises(ValueError, match="levels"):
        encode.levels(df, ["c"], 1)


def test_refusals(spark, sf):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, y int")
    with pytest.raises(ValueError, match="present in test"):
        align.validate_schema(a, a, None, "id", "y")
    with pytest.raises(ValueError, match="binary"):
        align.validate_schema(a.withColumn("y", F.col("y") + 1), a.select("id"), None, "id", "y")
    with pytest.raises(ValueError, match="differing"):
        align.require(align.value_alignment(a, a.withColumn("y", F.lit(0)), "id", "y"), "folds")
    with pytest.raises(ValueError, match="only_a"):
        align.require(align.key_alignment(a, a.where("id = 1"), "id"), "ids")
    with pytest.raises(ValueError, match="without_fold"):
        align.require(align.uncovered(a.withColumn("fold", F.lit(-1))), "folds")
    with pytest.raises(ValueError, match="out_of_range"):
        sinks.submission(a.withColumn("score", F.lit(1.5)), a.select("id"), "id", "y")
    with pytest.raises(ValueError, match="aren't binary|isn't binary"):
        knn.parent_features(a.select("id", F.lit(1.0).alias("x")), a.select("id", F.lit(2).alias("y"), F.lit(1.0).alias("x")), "id", "id", ["x"], "y", [1])


def test_neighbours_in_blocks(spark):
    parent = spark.createDataFrame([(i, float(i * 37 % 101), i % 2) for i in range(60)], "id long, x double, y int")
    near = lambda n, m=100: sorted(map(tuple, knn.neighbours(parent.where("id < 9"), parent, "id", "id", ["x"], "y", 4, n, m).where("place < 4").collect()))
    assert near(1000) == near(7) == near(7, 2) == near(1, 1) and len(near(7, 2)) == 36
    with pytest.raises(ValueError, match="empty"):
        knn.neighbours(parent, parent.where("id < 0"), "id", "id", ["x"], "y", 1)


def test_blend_weights(spark):
    rows = [(i, int(i % 3 == 0), (i % 3 == 0) * 0.4 + (i * 7919 % 101) / 101, (i * 31 % 97) / 97) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, good double, noise double")
    weights, history = blend.greedy_weights(df, "id", "y", ["good", "noise"], 4)
    assert sum(weights.values()) == pytest.approx(1) and history[0][1] == "good"
    stable = blend.stable_weights(df, "id", "y", ["good", "noise"], 2, steps=2).collect()
    assert sum(r["weight"] for r in stable) == pytest.approx(1)


def test_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 0), (1, None, 1), (2, "a", 0), (2, "a", 0), (3, "b", 1)], "k int, t string, y int")
    assert audit.duplicate_report(df, ["k", "t"], "y").first().asDict() == {"duplicate_rows": 4, "duplicate_groups": 2, "conflicting_groups": 1}
    assert audit.overlap(df, df.where("k = 1"), ["k", "t"]).first().asDict() == {"overlap_groups": 1, "overlap_rows": 2}


def test_csv_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,t\n1,NaN,None\n2,abc,b\n3,1.5,\n")
    out = tables.read_csv(spark, str(tmp_path / "a.csv"), "id long, x double, t string").orderBy("row_pos").collect()
    assert [(r["id"], r["x"], r["t"], r["row_pos"]) for r in out] == [(1, None, None, 0), (2, None, "b", 1), (3, 1.5, None, 2)]
    df = spark.createDataFrame([(1, 0.25), (2, 0.5)], "id long, score double")
    sinks.write_predictions(df, str(tmp_path / "p"), "train", "a", "id")
    sinks.write_predictions(df, str(tmp_path / "p"), "test", "b", "id")
    assert tables.predictions(spark, str(tmp_path / "p"), "train").count() == 2
    sinks.write_submission(df, df.select("id", F.lit(0.5).alias("y")), str(tmp_path / "s"), "id", "y")
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 2
    df.select("id", F.col("score").alias("m")).write.parquet(str(tmp_path / "w"))
    assert tables.members(spark, str(tmp_path / "w"), "id", prefix="fm").select("model").first()[0] == "fm__m"
    assert tables.cached(spark, str(tmp_path), "c", lambda: df, 2).count() == tables.cached(spark, str(tmp_path), "c", lambda: 1 / 0, 2).count()


def test_config(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"features": {"default_view": "engineered", "drop": [1, 2]}, "training": {"models": ["gbt"]}, "data": {"train_path": "t.csv"}}))
    (tmp_path / "b.json").write_text(json.dumps({"extends": "a.json", "features": {"drop": [3], "engineered": False}}))
    tree = config.load(str(tmp_path / "b.json"))
    assert tree["features"] == {"default_view": "engineered", "drop": [3], "engineered": False} and tree["data"]["train_path"] == str(tmp_path / "t.csv")
    assert [(e.name, e.view) for e in config.experiments(tree)] == [("gbt", "raw")]
    (tmp_path / "a.json").write_text(json.dumps({"extends": "b.json"}))
    with pytest.raises(ValueError, match="extend each other"):
        config.load(str(tmp_path / "b.json"))
    with pytest.raises(ValueError, match="twice"):
        config.experiments(tree, ["x", "x"])


def test_workflow(spark, tmp_path):
    from sparkrank.workflow import Run

    train, test, sample = tables.demo(spark, 240, 80)
    for name, df in (("train", train), ("test", test), ("sample", sample)):
        df.orderBy("id").coalesce(1).write.csv(str(tmp_path / name), header=True)
    schema = f"id long, {NUMBERS}, gender string, stress_level string, academic_work_impact string, addiction_level string, addicted_label int"
    tree = {
        "project": {"target": "addicted_label", "id_column": "id"}, "output": {"directory": str(tmp_path / "out")}, "cv": {"n_splits": 2, "seed": 17},
        "data": {"train_path": str(tmp_path / "train"), "test_path": str(tmp_path / "test"), "sample_path": str(tmp_path / "sample"), "schema": schema},
        "features": {"default_view": "engineered", "drop_columns": ["addiction_level"]}, "training": {"models": ["logistic", "unheard_of"]}, "models": {"logistic": {"maxIter": 10}}, "ensemble": {"max_steps": 2}, "stack": {"c_values": [0.1]},
    }
    run = Run(spark, tree)
    report = run.audit()
    assert report["rows"] == {"train": 240, "test": 80} and report["strongest"]
    done = run.fit()
    assert [d["name"] for d in done] == ["logistic"] and all(d["auc"] > 0.6 for d in done)
    assert run.blend()["auc"] > 0.6
    assert run.stack()["chosen"] in ("global", "regime", "mix")
    assert spark.read.csv(str(tmp_path / "out/submission_stack"), header=True).count() == 80


def test_greedy_search_equals_candidates_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(blend, "PACKET_ROWS", 50)
    df = spark.range(300).selectExpr("id", "cast(id % 3 = 0 as int) as y", "cast(id % 7 + if(id % 3 = 0, 2, 0) as double) as a", "cast(id % 11 - if(id % 5 = 0, 1, 0) as double) as b")
    ranked = ranking.ranked_models(df, ["id", "y"], ["a", "b"]).withColumn("round", F.lit(0))
    weights, history = blend.greedy_rounds(ranked, "y", ["a", "b"], [0], 5)[0]
    chosen = {}
    for _, best, auc in history:
        scores = {r["model"]: r["auc"] for r in blend.candidate_scores(ranked, "y", ["a", "b"], {0: chosen}).collect()}
        assert auc == pytest.approx(scores[best], abs=1e-12) and auc == pytest.approx(max(scores.values()))
        chosen = chosen | {best: chosen.get(best, 0) + 1}
    assert weights == {m: chosen.get(m, 0) / len(history) for m in ("a", "b") if m in chosen}


def test_subsample_numbers_only_rows_near_it(spark, monkeypatch):
    numbered, seen = folds.numbered, []
    monkeypatch.setattr(folds, "numbered", lambda df, *a: seen.append(df.count()) or numbered(df, *a))
    df = spark.range(20_000).selectExpr("id", "cast(id % 4 = 0 as int) as y")
    few = {(r["round"], r["id"]) for r in folds.stratified_subsample(df, "id", "y", 0.8, 400, 3).collect()}
    assert seen[0] < 60_000 / 10
    monkeypatch.setattr(folds, "_most_digest", lambda wanted, rows: "g")
    assert few == {(r["round"], r["id"]) for r in folds.stratified_subsample(df, "id", "y", 0.8, 400, 3).collect()} and len(few) == 1200
    monkeypatch.setattr(folds, "_most_digest", lambda wanted, rows: "0")
    assert few == {(r["round"], r["id"]) for r in folds.stratified_subsample(df, "id", "y", 0.8, 400, 3).collect()}
