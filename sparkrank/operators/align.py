"""Checks that tables belong together. Each report is one row of counts; ``require`` raises if any isn't zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.functions.scalar import INF


def require(report: DataFrame, what: str) -> None:
    row = report.first().asDict()
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise ValueError(f"{what}: {wrong}")


def schema_problems(train: DataFrame, test: DataFrame, id_col: str, target: str) -> list[str]:
    """What is wrong with the columns and the target's values, in words; nothing if all is well."""
    found = []
    if target not in train.columns:
        found.append(f"target {target} is absent from train")
    if target in test.columns:
        found.append(f"target {target} is present in test")
    found += [f"id {id_col} is absent from {name}" for name, df in (("train", train), ("test", test)) if id_col not in df.columns]
    ours, theirs = set(train.columns) - {target}, set(test.columns)
    if ours != theirs:
        found.append(f"columns differ: only train {sorted(ours - theirs)}, only test {sorted(theirs - ours)}")
    if target in train.columns:
        odd = train.where(F.col(target).isNotNull() & ~F.col(target).cast("double").isin(0.0, 1.0)).limit(1).count()
        if odd:
            found.append("the target isn't binary")
    return found


def validate_schema(train: DataFrame, test: DataFrame, sample: DataFrame | None, id_col: str, target: str, row: str | None = None) -> None:
    problems = schema_problems(train, test, id_col, target)
    if sample is not None and not {id_col, target} <= set(sample.columns):
        problems.append("the template lacks id or target")
    if problems:
        raise ValueError("; ".join(problems))
    if sample is not None:
        require(key_alignment(sample, test, id_col) if row is None else order_alignment(sample, test, id_col, row), "template against test")


def key_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has or that a side repeats."""
    left, right = (df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(f"_{n}")) for df, n in ((a, "a"), (b, "b")))
    both = left.join(right, left["_k"].eqNullSafe(right["_k"]), "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(count(F.col("_b").isNull()).alias("only_a"), count(F.col("_a").isNull()).alias("only_b"), count((F.col("_a") > 1) | (F.col("_b") > 1)).alias("repeated"))


def order_alignment(a: DataFrame, b: DataFrame, key: str, row: str) -> DataFrame:
    """Places (column ``row``) at which the keys differ or only one side has one."""
    left, right = a.select(F.col(row).alias("_ra"), F.col(key).alias("_ka")), b.select(F.col(row).alias("_rb"), F.col(key).alias("_kb"))
    both = left.join(right, F.col("_ra") == F.col("_rb"), "full_outer")
    wrong = F.col("_ra").isNull() | F.col("_rb").isNull() | ~F.col("_ka").eqNullSafe(F.col("_kb"))
    return both.agg(F.coalesce(F.sum(wrong.cast("long")), F.lit(0)).alias("misplaced"))


def value_alignment(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides whose values (labels, folds) differ; keys that one side lacks."""
    left, right = a.select(F.col(key).alias("_ka"), F.col(value).alias("_va")), b.select(F.col(key).alias("_kb"), F.col(value).alias("_vb"))
    both = left.join(right, F.col("_ka") == F.col("_kb"), "full_outer")
    one = F.col("_ka").isNull() | F.col("_kb").isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return both.agg(count(one).alias("unmatched"), count(~one & ~F.col("_va").eqNullSafe(F.col("_vb"))).alias("differing"))


def finite_report(df: DataFrame, scores: list[str], least: float | None = None, largest: float | None = None) -> DataFrame:
    """Per score column how many values are missing, not finite, or out of range."""
    out = []
    for c in scores:
        x = F.col(c).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == INF)
        outside = F.lit(False)
        if least is not None:
            outside = outside | (x < least)
        if largest is not None:
            outside = outside | (x > largest)
        out += [F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias(f"{c}_not_finite"), F.coalesce(F.sum((~bad & outside).cast("long")), F.lit(0)).alias(f"{c}_out_of_range")]
    return df.agg(*out)


def shape_report(long: DataFrame, expected: int, model: str = "model") -> DataFrame:
    """Models without exactly ``expected`` rows."""
    return long.groupBy(model).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def outside(subset: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Rows of ``subset`` whose key ``whole`` lacks."""
    return subset.join(whole.select(key).distinct(), key, "left_anti")


def name_differences(a: DataFrame, b: DataFrame, name: str = "model") -> DataFrame:
    """Names that only one of two tables has, and which."""
    x, y = a.select(name).distinct(), b.select(name).distinct()
    return x.exceptAll(y).withColumn("side", F.lit("a")).unionByName(y.exceptAll(x).withColumn("side", F.lit("b")))


def uncovered(df: DataFrame, fold: str = "fold") -> DataFrame:
    return df.agg(F.coalesce(F.sum((F.col(fold).isNull() | (F.col(fold) < 0)).cast("long")), F.lit(0)).alias("without_fold"))
