"""The pipeline's stages, each on what its predecessor kept."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    where = str(tmp_path_factory.mktemp("pipeline"))
    item, passage = prose(rng, 30).replace("\n", " "), prose(rng, 70).replace("\n", " ").strip(". ") + "."
    rows = [(i, prose(rng, 80), "xx" if i % 2 else "yy", "s", 0) for i in range(30)]
    rows += [(30, rows[3][1], "xx", "s", 0), (31, "123 456", "xx", "s", 0), (32, None, None, None, None), (None, prose(rng, 40), None, "s", 1)]
    rows += [(33, prose(rng, 40) + " " + item + " " + prose(rng, 40), "xx", "s", 0), (34, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "xx", "s", 0), (35, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "xx", "s", 0)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows


def test_stages(spark, tables):
    where, rows = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    names, columns, kept = [n for n, _ in corpus_pipeline.STAGES], docs.columns, {}
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, where).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        assert docs.columns == columns
        kept[name] = docs.collect()
    ids = {n: [r["doc_id"] for r in k] for n, k in kept.items()}
    assert len(ids["language_id"]) == len(rows) - 2 and not {31, 32} & set(ids["language_id"])
    assert len(ids["near_dedup"]) == len(ids["language_id"]) - 2 and ids["near_dedup"].count(5) == 1 and 30 not in ids["near_dedup"] and None in ids["near_dedup"]
    assert sorted(map(str, ids["substring_dedup"])) == sorted(map(str, ids["near_dedup"]))
    texts = {r["doc_id"]: r["text"] for r in kept["substring_dedup"]}
    before = {r["doc_id"]: r["text"] for r in kept["near_dedup"]}
    assert [i for i in texts if texts[i] != before[i]] == [35] and all(r["n_chars"] == len(r["text"]) for r in kept["substring_dedup"])
    assert set(ids["substring_dedup"]) - set(ids["decontamination"]) == {33}
    out = corpus_pipeline.run(spark, where)
    assert out.select("doc_id").distinct().count() == len(set(ids["decontamination"])) and out.where("length < 1 or length > 2048").count() == 0


def test_stages_on_clashing_names_long_texts_and_ties(spark, tmp_path):
    rng = random.Random(9)
    item, passage = prose(rng, 30).replace("\n", " "), prose(rng, 70).replace("\n", " ").strip(". ") + "."
    long = prose(rng, 60_000)
    rows = [(i, prose(rng, 60), "xx", "s", 0) for i in range(8)]
    rows += [(20, long, None, None, 1), (21, long, None, None, 1), (21, long, None, None, 1), (None, rows[2][1], None, None, None), (5, rows[6][1], "xx", "s", 0)]
    rows += [(30, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "xx", "s", 0), (30, prose(rng, 30) + " " + passage + " " + prose(rng, 30), "xx", "s", 0), (31, prose(rng, 40) + " " + item + " " + prose(rng, 40), "xx", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_key", "_id", "_hash", "_n", "_spans", "_own0", "_own1", "_own2", "_winner", "_kept", "key", "fp", "node", "unit", "start", "score", "cluster_id", "text_hash", "sequence_id", "piece", "row", "n"]
    docs = docs.withColumns({c: F.lit("clash") for c in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names] and docs.where(" or ".join(f"{c} <> 'clash'" for c in names)).count() == 0
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert len(kept["language_id"]) == len(rows) and kept["near_dedup"].count(20) == 1 and 21 not in kept["near_dedup"] and None not in kept["near_dedup"]
    assert kept["near_dedup"].count(5) == 2 and 6 not in kept["near_dedup"]  # the tie with the smaller id stays
    assert len(kept["substring_dedup"]) == len(kept["near_dedup"]) and set(kept["substring_dedup"]) - set(kept["decontamination"]) == {31}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(set(kept["decontamination"])) and packed.where("doc_id = 20").count() > 30


def test_without_documents(spark, tables, tmp_path):
    where, _ = tables
    spark.read.parquet(f"{where}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
