"""Repeats are judged by their whole length, words by all their characters; very long texts go through every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import decontamination, language_id, packing, paragraph_dedup, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts, toxicity


def test_paragraph_dedup_judges_the_length_of_the_repeat(spark):
    middle = "Seven plain words stand in the middle."
    passage = "the long first sentence of the passage tells of many things that happened far away on that day. " + middle + " And the last sentence of it tells of what came after all of this was over"
    line = "Read more about this on our page."
    texts = {
        1: f"Once somebody said that {passage} in the old days of the town by the sea.",
        2: f"Quite another host with its own and rather different opening words where {passage} as everybody who lived up in the hills has always known.",
        3: f"A story about birds and trees. {line} Nothing else here is like anything.",
        4: f"Numbers and tables fill this one. {line} Goodbye for now until next week comes.",
        5: f"{line} {line} My own words after it are these few.",
    }
    gone = paragraph_dedup.removals(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["kept_doc_id"], texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()) for r in gone] == [(2, 1, middle)]


def test_words_around_a_paragraph_stay_in_its_text():
    data = np.frombuffer(b"other text\xffOne " + b"x" * 500 + b" three HERE IT IS four five\xffmore", np.uint8)
    lo, hi, start = 11, 11 + 4 + 500 + 7 + 10 + 10, 11 + 4 + 500 + 7
    before, after = paragraph_dedup._around(data, lo, start, start + 10, hi, 9)
    assert (len(before), len(after)) == (3, 2)
    assert paragraph_dedup._around(data, lo, start, start + 10, hi, 1) == (before[:1], after[:1])
    assert paragraph_dedup._around(data, lo, start, start + 10, hi, 0) == ([], [])


def test_shape_reads_the_whole_word():
    assert quality_classifier.shape("ab1" * 100 + "-X9") != quality_classifier.shape("ab1" * 100 + "+x")


@pytest.fixture(scope="module")
def long_texts(spark):
    made = ["ab " * 50_000, "x" * 200_000, " " * 1_000_000, "\n" * 30_000, "Ein Wort. " * 20_000, None, "short one"]
    return spark.createDataFrame([(k, t, "xx") for k, t in enumerate(made)], "doc_id long, text string, lang string"), made


def test_very_long_texts(spark, long_texts):
    docs, made = long_texts
    n = len(made)
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(n)], "doc_id long, quality int, toxic int")
    counts = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    book = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert all(counts[k]["n_words"] == book[k]["n_words"] == len((t or "").split()) for k, t in enumerate(made))
    assert toxicity.toxicity(docs, marks).count() == quality_classifier.quality_classifier(docs, marks).count() == n
    assert {r["doc_id"] for r in language_id.language_id(docs).where("lang_pred = 'und'").collect()} == {2, 3, 5}
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert groups[2] == groups[3] == groups[5] == 2 and len(groups) == n
    items = spark.createDataFrame([(1, "ab ab ab ab ab ab ab ab"), (2, "x" * 200_000)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(docs, items).collect()} == {(0, 1), (1, 2)}
    packed = packing.best_fit_packing(docs)
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*"), F.sum("n")).first()
    assert sizes[0] <= packing.SIZE and sizes[1] == -(-sizes[2] // packing.SIZE)
    assert suffix_dedup.suffix_dedup(docs).where("n_removed > 0").count() == 0
    assert paragraph_dedup.removals(docs).count() == 0


def test_empty_tables_of_learned_operators(spark, long_texts):
    none = long_texts[0].where("false")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none, marks).count() == quality_classifier.quality_classifier(none, marks).count() == 0
    assert language_id.determined(none).count() == 0 == decontamination.decontamination(none, spark.createDataFrame([], "item_id long, text string")).count()
