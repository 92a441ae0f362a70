"""The corpus pipeline: five of the training-data operators, one after another, over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``, other columns with them, whatever their names. A null or empty text is no language's and
goes at the first stage. Rows that repeat an id are told apart by their texts; rows that repeat both are near copies of
one group, of which one stays. Ties between copies go to the smallest id, a null id being the largest. Texts of any
length are worked on whole. Empty tables give empty results at every stage; an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import finished, hinted, tables, written
from sparkrank.llm.decontamination import decontamination
from sparkrank.llm.language_id import determined
from sparkrank.llm.packing import best_fit_packing
from sparkrank.llm.paragraph_dedup import cleaned, removals
from sparkrank.llm.simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letters at all) go; the others get the language told."""
    return determined(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs that a document with a smaller id also has are cut out; n_chars follows the text."""
    out = cleaned(docs, removals(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. They are told by id and text, so ids may be null or repeat."""
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    found = decontamination(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    keys = written(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return docs.join(hinted(keys), F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit(""))) == keys["_key"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    return best_fit_packing(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("packing", packing)]

#: SQL can't express fingerprints, MinHash or the tokenizer; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = [p for p in tables(spark) if p != getattr(docs, "_sparkrank_path", None)]
        docs = written(stage(spark, docs, sf_dir), name)
        finished(spark, before, docs)  # the stage's own tables and the rows it was given
    return STAGES[-1][1](spark, docs, sf_dir)
