"""Ranks and ROC-AUC that no single task has to order.

Ordering a whole table in one window is one task. Here rows fall into bins by approximate quantiles of the
ordering column (equal values always share a bin), bins are summed, the few sums are accumulated, and only
the inside of a bin is ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64
#: Marks for what is spread over 0 to 1, like percentile ranks and their means: no pass is needed to find them.
UNIT = [k / BINS for k in range(1, BINS)]
INF = float("inf")


def binned(df: DataFrame, order: str, bins: int | list[float] = BINS) -> DataFrame:
    """Adds ``_bin``, increasing with ``order`` (numeric, not null). ``bins`` is their number, or the marks between."""
    if bins == 1:
        return df.withColumn("_bin", F.lit(0.0))
    marks = bins if isinstance(bins, list) else df.agg(F.percentile_approx(F.col(order).cast("double"), [k / bins for k in range(1, bins)], 1000)).first()[0] or []
    splits = [-INF, *sorted(set(marks) - {-INF, INF}), INF]
    if len(splits) < 3:
        return df.withColumn("_bin", F.lit(0.0))
    keyed = df.withColumn("_bin_by", F.col(order).cast("double"))
    return Bucketizer(splits=splits, inputCol="_bin_by", outputCol="_bin", handleInvalid="keep").transform(keyed).drop("_bin_by")


def sums_before(df: DataFrame, groups: list[str], order: str, values: list[str], bins: int | list[float] = BINS) -> DataFrame:
    """Adds ``before_<v>``: the sum of v over the group's rows with a smaller ``order``. One row per group and order."""
    rows = binned(df, order, bins)
    totals = rows.groupBy(*groups, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "_bin", *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_s_{v}") for v in values])
    inside = Window.partitionBy(*groups, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = [rows[g].eqNullSafe(starts[g]) for g in [*groups, "_bin"]]
    joined = rows.join(starts, reduce(lambda a, b: a & b, same)).drop(*[starts[g] for g in [*groups, "_bin"]])
    return joined.select(*df.columns, *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_s_{v}")).alias(f"before_{v}") for v in values])


def average_ranks(df: DataFrame, score: str, groups: list[str] | None = None, percentile: bool = True, name: str = "rank", bins: int | list[float] = BINS) -> DataFrame:
    """Adds the average rank of ``score`` within the groups, divided by the number of scores if ``percentile``.
    Missing scores have no rank and don't count."""
    groups = groups or []
    own = df.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    placed = sums_before(own, groups, "_score", ["_n"], bins)
    rank = F.col("before__n") + (F.col("_n") + 1) / 2.0
    if percentile:
        sizes = own.groupBy(*groups).agg(F.sum("_n").alias("_all")) if groups else own.agg(F.sum("_n").alias("_all"))
        placed = _matched(placed, sizes, groups) if groups else placed.crossJoin(F.broadcast(sizes))  # one row
        rank = rank / F.col("_all")
    placed = placed.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_score", rank.alias(name))
    on = reduce(lambda a, b: a & b, [df[g].eqNullSafe(F.col(f"_g_{g}")) for g in groups] + [df[score] == F.col("_score")])
    return df.join(placed, on, "left").select(*df.columns, name)


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(right, reduce(lambda a, b: a & b, [left[k].eqNullSafe(F.col(f"_k_{k}")) for k in keys])).drop(*[f"_k_{k}" for k in keys])


def medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """The exact median of each expression, None where it has no value. Equal values are counted first; no task
    holds a column's values, as an exact percentile's would."""
    if not values:
        return {}
    long = df.select(*[v.cast("double").alias(n) for n, v in values.items()]).unpivot([], list(values), "_column", "_value")
    counts = long.where("_value is not null").groupBy("_column", "_value").agg(F.count("*").alias("_n"))
    placed = sums_before(counts, ["_column"], "_value", ["_n"])
    placed = _matched(placed, F.broadcast(counts.groupBy("_column").agg(F.sum("_n").alias("_all"))), ["_column"])  # a row per column
    here = [(F.col("before__n") <= at) & (at < F.col("before__n") + F.col("_n")) for at in (F.expr("(_all - 1) div 2"), F.expr("_all div 2"))]
    ends = placed.groupBy("_column").agg(*[F.max(F.when(h, F.col("_value"))).alias(f"_{k}") for k, h in enumerate(here)])
    found = {r["_column"]: 0.5 * r["_0"] + 0.5 * r["_1"] for r in ends.collect()}  # a row per column
    return {n: found.get(n) for n in values}


def nullable_percentiles(df: DataFrame, score: str, name: str = "rank", middle: float = 0.5) -> DataFrame:
    """Percentile ranks in which a missing score stands in the middle."""
    return average_ranks(df, score, name=name).withColumn(name, F.coalesce(name, F.lit(middle)))


def roc_auc(df: DataFrame, label: str, score: str, groups: list[str] | None = None, bins: int | list[float] = BINS) -> DataFrame:
    """(groups, auc, positives, negatives): exact, ties count half; NULL where a class is absent. Rows are first
    counted by score, so what follows depends on the number of distinct scores. Scores must be finite."""
    groups = groups or []
    counts = df.groupBy(*groups, F.col(score).alias("_score")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.sum(1 - F.col(label).cast("long")).alias("_n"))
    return counted_auc(counts, groups, bins)


def counted_auc(counts: DataFrame, groups: list[str], bins: int | list[float] = BINS) -> DataFrame:
    """:func:`roc_auc` of ``counts(groups, _score, _p, _n)``: positives and negatives of each score, a row per score."""
    placed = sums_before(counts, groups, "_score", ["_n"], bins)
    pairs = F.sum(F.col("_p").cast("double") * (F.col("before__n") + F.col("_n") / 2.0))
    p, n = F.sum("_p"), F.sum("_n")
    return placed.groupBy(*groups).agg(F.when((p > 0) & (n > 0), pairs / (p.cast("double") * n)).alias("auc"), p.alias("positives"), n.alias("negatives"))


def long_scores(df: DataFrame, keys: list[str], models: list[str], variable: str = "model", value: str = "score") -> DataFrame:
    return df.unpivot(keys, models, variable, value)


def wide_scores(df: DataFrame, keys: list[str], models: list[str], variable: str = "model", value: str = "rank") -> DataFrame:
    return df.groupBy(*keys).pivot(variable, models).agg(F.first(value))


def ranked_models(df: DataFrame, keys: list[str], models: list[str], groups: list[str] | None = None, bins: int | list[float] = BINS) -> DataFrame:
    """Every model's score replaced by its percentile rank (within the groups)."""
    long = long_scores(df, keys, models)
    return wide_scores(average_ranks(long, "score", [*(groups or []), "model"], bins=bins), keys, models)


def spearman(df: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """(a, b, correlation) for every pair of models: Pearson over ranks, all pairs in one aggregate."""
    wide = ranked_models(df, keys, models)
    pairs = [(a, b) for k, a in enumerate(models) for b in models[k:]]
    row = wide.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def model_table(df: DataFrame, label: str, keys: list[str], models: list[str]) -> DataFrame:
    """(model, auc, least, largest), the best first, ties by name."""
    long = long_scores(df, [*keys, label] if label not in keys else keys, models)
    ends = long.groupBy("model").agg(F.min("score").alias("least"), F.max("score").alias("largest"))
    return roc_auc(long, label, "score", ["model"]).join(ends, "model").select("model", "auc", "least", "largest").orderBy(F.col("auc").desc_nulls_last(), "model")


def top(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    return df.orderBy(by.desc_nulls_last(), *ties).limit(n)
