"""Profiles of a labelled table: missing values, counts, duplicates, overlap, single-column AUC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.operators.ranking import counted_auc, sums_before
from sparkrank.plans.lineage import written

FEW = 30


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = dict(zip(df.columns, df.schema, strict=True))
    return [c for c in columns if isinstance(kinds[c].dataType, T.NumericType)]


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_missing, n_distinct): a missing value counts as a distinct one. One pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.sum(F.col(c).isNull().cast("long")).alias("n_missing"), (F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long").alias("n_distinct")) for c in columns]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def duplicate_groups(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Groups of equal rows (missing equals missing) with more than one member: n and whether labels disagree."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"), (F.count_distinct(label) > 1).alias("conflicting"))
    return groups.where("n > 1")


def duplicate_report(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    g = duplicate_groups(df, columns, label)
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("conflicting").cast("long")), F.lit(0)).alias("conflicting_groups"))


def overlap(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """How many distinct rows both have, and how many rows of ``test`` are in ``train``; missing equals missing."""
    shared = train.select(*columns).intersect(test.select(*columns))
    counts = test.groupBy(*columns).agg(F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, [counts[c].eqNullSafe(shared[c]) for c in columns])
    return counts.join(shared, same).agg(F.count("*").alias("overlap_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("overlap_rows"))


def repeated(df: DataFrame, columns: list[str], name: str = "n_equal") -> DataFrame:
    """Adds how many rows are equal to each row in ``columns``, missing equal to missing. Rows meet their counts in a join, which Spark splits
    where very many are equal."""
    counts = df.groupBy(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(columns)]).agg(F.count("*").alias("_equal"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(columns)])
    return df.join(counts, same).select(*df.columns, F.col("_equal").alias(name))


def counted_values(df: DataFrame, columns: list[str], label: str, fold: str) -> DataFrame:
    """(column, fold, number, text, gone, p, n): positives and negatives of each value of each column in each fold. Numbers are in
    ``number``, others in ``text``; ``gone`` says that the value is missing."""
    numbers = set(numeric_columns(df, columns))
    cell = lambda c: F.struct(F.lit(c).alias("column"), (F.col(c) if c in numbers else F.lit(None)).cast("double").alias("number"), (F.lit(None) if c in numbers else F.col(c)).cast("string").alias("text"), F.col(c).isNull().alias("gone"))
    long = df.select(F.col(fold).alias("fold"), F.col(label).cast("long").alias("y"), F.explode(F.array(*[cell(c) for c in columns])).alias("v")).select("fold", "y", "v.*")
    return long.groupBy("column", "fold", "number", "text", "gone").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))


def _rank_auc(counts: DataFrame) -> DataFrame:
    """(column, auc) of numbers, missing ones at the median of the others, which is found in the same order of values."""
    there = counts.where("not gone").groupBy("column", F.col("number").alias("_value")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")).withColumn("_all", F.col("_p") + F.col("_n"))
    placed = written(sums_before(there, ["column"], "_value", ["_all", "_n"]), "placed")
    sizes = placed.groupBy("column").agg(F.sum("_all").alias("_rows"), F.sum("_p").alias("_ps"), F.sum("_n").alias("_ns"))
    holds = lambda at: (F.col("before__all") <= F.expr(at)) & (F.expr(at) < F.col("before__all") + F.col("_all"))
    middle = placed.join(F.broadcast(sizes), "column").groupBy("column").agg((F.max(F.when(holds("(_rows - 1) div 2"), F.col("_value"))) / 2 + F.max(F.when(holds("_rows div 2"), F.col("_value"))) / 2).alias("_middle"))
    lost = counts.groupBy("column").agg(F.sum(F.when(F.col("gone"), F.col("p")).otherwise(0)).alias("_lp"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("_ln"))
    each = placed.join(F.broadcast(sizes.join(middle, "column").join(lost, "column")), "column")  # a row per column
    side = F.when(F.col("_value") > F.col("_middle"), 1.0).when(F.col("_value") == F.col("_middle"), 0.5).otherwise(0.0)
    of_values = F.sum(F.col("_p") * (F.col("before__n") + F.col("_n") / 2.0 + side * F.col("_ln")))
    of_lost = F.sum(F.col("_n") * (1.0 - side) * F.col("_lp")) + F.first(F.col("_lp") * F.col("_ln") / 2.0)
    p, n = F.first(F.col("_ps") + F.col("_lp")), F.first(F.col("_ns") + F.col("_ln"))
    return each.groupBy("column").agg(F.when((p > 0) & (n > 0), (of_values + of_lost) / (p.cast("double") * n)).alias("auc"))


def _coded_auc(counts: DataFrame, smoothing: float = 20.0) -> DataFrame:
    """(column, auc) of out-of-fold smoothed label means, for all columns at once: sums of a fold's value less totals."""
    value = F.coalesce("text", F.col("number").cast("string"), F.lit("__MISSING__"))
    own = counts.groupBy("column", "fold", value.alias("value")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = own.groupBy("column", "value").agg(F.sum("p").alias("tp"), F.sum(F.col("p") + F.col("n")).alias("ta"))
    folds = own.groupBy("column", "fold").agg(F.sum("p").alias("fp"), F.sum(F.col("p") + F.col("n")).alias("fa"))
    whole = Window.partitionBy("column")  # a row per fold
    prior = folds.select("column", "fold", ((F.sum("fp").over(whole) - F.col("fp")) / (F.sum("fa").over(whole) - F.col("fa"))).alias("prior"))
    rest = F.col("ta") - F.col("p") - F.col("n")
    score = F.when(rest > 0, (F.col("tp") - F.col("p") + F.col("prior") * smoothing) / (rest + smoothing)).otherwise(F.col("prior"))
    scored = own.join(total, ["column", "value"]).join(F.broadcast(prior), ["column", "fold"]).withColumn("_score", score)  # a row per column and fold
    return counted_auc(scored.groupBy("column", "_score").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n")), ["column"]).select("column", "auc")


def univariate_audit(df: DataFrame, columns: list[str], label: str, fold: str = "fold") -> DataFrame:
    """(column, method, auc), the best first. Text or at most 30 distinct values (missing counts): the AUC of the
    out-of-fold smoothed target mean. Other numbers: that of the rank, in the better direction, missing in the
    middle. ``<c>:missing`` where some but not all values are missing. A constant column has no AUC. Rows are read
    once; all else works on counts of values."""
    counts = written(counted_values(df, columns, label, fold), "counts")
    values = counts.groupBy("column", "number", "text", "gone").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    lost = lambda c: F.sum(F.when(F.col("gone"), F.col(c)).otherwise(0)).alias(f"lost_{c}")
    shape = {r["column"]: r for r in values.groupBy("column").agg(F.count("*").alias("n_distinct"), F.sum("p").alias("p"), F.sum("n").alias("n"), lost("p"), lost("n")).collect()}  # a row per column
    numbers = set(numeric_columns(df, columns))
    by_rank = [c for c in columns if c in numbers and c in shape and shape[c]["n_distinct"] > FEW]
    by_code = [c for c in columns if c not in by_rank]
    single = [c for c in by_code if c not in shape or shape[c]["n_distinct"] <= 1]
    several = [c for c in by_code if c not in single]
    rows = []
    for c in columns:
        if c in shape and 0 < shape[c]["lost_p"] + shape[c]["lost_n"] < shape[c]["p"] + shape[c]["n"]:
            p, n, lp, ln = (int(shape[c][k]) for k in ("p", "n", "lost_p", "lost_n"))
            auc = (lp * (n - ln) + (lp * ln + (p - lp) * (n - ln)) / 2) / (p * n) if p and n else None
            rows.append((f"{c}:missing", "missing_indicator", None if auc is None else max(auc, 1 - auc)))
    rows += [(c, "oof_smoothed_target_encoding", None) for c in single]
    out = [df.sparkSession.createDataFrame(rows, "column string, method string, auc double")]
    if by_rank:
        auc = _rank_auc(counts.where(F.col("column").isin(by_rank)))
        out.append(auc.select("column", F.lit("rank_auc_best_direction").alias("method"), F.greatest("auc", 1 - F.col("auc")).alias("auc")))
    if several:
        out.append(_coded_auc(counts.where(F.col("column").isin(several))).select("column", F.lit("oof_smoothed_target_encoding").alias("method"), "auc"))
    return reduce(DataFrame.unionByName, out).orderBy(F.col("auc").desc_nulls_last(), "column")
