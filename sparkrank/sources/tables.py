"""Readers: delimited and Parquet tables, prediction sets and banks, manifests, cached features, demo data."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrank.operators.align import order_alignment, require, validate_schema, value_alignment

# Texts that a delimited file may use for a missing value.
MISSING_TOKENS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "#N/A", "n/a", "<NA>", "-nan", "-NaN", "1.#IND", "1.#QNAN", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN"]


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers become NULL: the engine knows no other missing value."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, tokens: list[str] | None = None) -> DataFrame:
    """A delimited file with a header under a declared schema; missing tokens become NULL, and so does a number that
    can't be read. ``row_pos`` keeps the order of the file's rows; it goes through one task per file split only."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    raw = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    missing = tokens if tokens is not None else MISSING_TOKENS

    def cell(f: T.StructField) -> Column:
        text = F.when(~F.col(f.name).isin(missing), F.col(f.name))
        return (text if isinstance(f.dataType, T.StringType) else text.try_cast(f.dataType)).alias(f.name)

    rows = raw.select(*[cell(f) for f in schema], F.monotonically_increasing_id().alias("_order"))
    return without_nan(positioned(rows, "_order").drop("_order"))


def positioned(df: DataFrame, order: str, name: str = "row_pos") -> DataFrame:
    """Numbers rows from 0 by ``order`` (unique), within parts of it: the high bits of a monotonic id are the part."""
    part = F.shiftright(F.col(order), 33)
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row per part
    inside = Window.partitionBy("_part").orderBy(order)
    return df.withColumn("_part", part).join(starts, "_part").select(*df.columns, (F.col("_start") + F.row_number().over(inside) - 1).alias(name))


def load_tables(spark: SparkSession, train_path: str, test_path: str, sample_path: str | None, schema: str | T.StructType, id_col: str, target: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(train, test, template), checked against each other; the template's ids must be test's, row by row."""
    absent = [p for p in (train_path, test_path, sample_path) if p and "://" not in p and not os.path.exists(p)]
    if absent:
        raise FileNotFoundError(f"missing files: {absent}")
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    features = [n for n in kinds if n != target]
    ddl = lambda names: ", ".join(f"`{n}` {kinds[n]}" for n in names)
    train, test = read_csv(spark, train_path, ddl(kinds)), read_csv(spark, test_path, ddl(features))
    sample = read_csv(spark, sample_path, f"`{id_col}` {kinds[id_col]}, `{target}` double") if sample_path else None
    validate_schema(train, test, sample, id_col, target, "row_pos")
    return train, test, sample


def members(spark: SparkSession, path: str, id_col: str, include: list[str] | None = None, prefix: str = "") -> DataFrame:
    """A wide table of member scores as (id, model, score); members are all other columns or those asked for."""
    wide = spark.read.parquet(path)
    names = include or [c for c in wide.columns if c != id_col]
    absent = [n for n in names if n not in wide.columns]
    if absent:
        raise ValueError(f"no such members: {absent}")
    return wide.select(id_col, *[F.col(n).cast("double").alias(f"{prefix}__{n}" if prefix else n) for n in names]).unpivot([id_col], [f"{prefix}__{n}" if prefix else n for n in names], "model", "score")


def band(spark: SparkSession, path: str, id_col: str, split: str) -> DataFrame:
    """(id, prediction) of one split of a band table."""
    df = spark.read.parquet(path)
    absent = {id_col, "split", "prediction"} - set(df.columns)
    if absent:
        raise ValueError(f"a band table needs {sorted(absent)}")
    return df.where(F.col("split") == split).select(id_col, F.col("prediction").cast("double").alias("prediction"))


def predictions(spark: SparkSession, path: str, split: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Stored predictions (split, model, id, score); directories are pruned by split and model. Ensembles are left out
    unless asked for by name."""
    df = spark.read.parquet(path)
    if split:
        df = df.where(F.col("split") == split)
    return df.where(F.col("model").isin(models)) if models else df.where(~F.col("model").contains("ensemble"))


def manifest_problems(spark: SparkSession, path: str, found: DataFrame, name: str = "model") -> DataFrame:
    """Models that are stored but not listed in the manifest (a delimited file)."""
    return found.select(name).distinct().join(spark.read.csv(path, header=True).select(name), name, "left_anti")


def selected_models(path: str, include: list[str] | None = None) -> list[str]:
    """Models to blend: those asked for, else those that the last training listed."""
    if include:
        return include
    with open(path) as f:
        return [m["name"] if isinstance(m, dict) else m for m in json.load(f)["models"]]


def bank(spark: SparkSession, path: str, keys: DataFrame, id_col: str, label: str | None = None, bank_keys: DataFrame | None = None, row: str | None = None) -> DataFrame:
    """A bank's predictions after its keys (and labels, and order if ``row`` is given) have been held against ours."""
    if bank_keys is not None:
        if row:
            require(order_alignment(bank_keys, keys, id_col, row), "order of the bank's keys")
        if label:
            require(value_alignment(bank_keys, keys, id_col, label), "labels of the bank")
    return spark.read.parquet(path)


def signature(parts: list[str], options: dict) -> str:
    """What a cache of features depends on: files by path, size and time, and the options."""
    stats = [(p, os.stat(p).st_size, os.stat(p).st_mtime_ns) if os.path.exists(p) else (p,) for p in parts]
    return hashlib.sha256(json.dumps([stats, options], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make, rows: int | None = None) -> DataFrame:
    """The Parquet cache ``folder/key``, made if it isn't there or holds another number of rows."""
    path = f"{folder.rstrip('/')}/{key}"
    try:
        df = spark.read.parquet(path)
        if rows is None or df.count() == rows:
            return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_digest(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


#: The invented table's inputs: rate of missing values, then least and largest value (numbers, and digits kept) or levels (texts).
DEMO_NUMBERS = {
    "age": (0.03, 16, 45, 0), "daily_screen_time_hours": (0.10, 1, 13, 1), "social_media_hours": (0.10, 0, 5, 1), "gaming_hours": (0.10, 0, 5, 1), "work_study_hours": (0.05, 0, 9, 1),
    "sleep_hours": (0.05, 4, 9, 1), "notifications_per_day": (0.15, 0, 150, 0), "app_opens_per_day": (0.15, 0, 80, 0), "weekend_screen_time": (0.20, 1, 16, 1),
}
DEMO_TEXTS = {"gender": (0.02, ["Female", "Male", "Other"]), "stress_level": (0.08, ["Low", "Medium", "High"]), "academic_work_impact": (0.08, ["Yes", "No"])}


def demo(spark: SparkSession, train_rows: int = 2000, test_rows: int = 800, seed: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, template) of invented habits: twelve inputs, each spread evenly over its range and missing at its own rate, a
    severity in words, and a label that grows likelier with time at the screen. All draws are hashes of id, column and seed."""

    def draw(column: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(column), F.col("id"), F.lit(seed)), F.lit(1 << 20)).cast("double") / float(1 << 20)

    def present(x: Column, column: str, rate: float) -> Column:
        return F.when(draw(f"{column} is there") > rate, x).alias(column)

    def number(column: str) -> Column:
        rate, low, high, digits = DEMO_NUMBERS[column]
        x = F.round(low + (high - low) * draw(column), digits)
        return present(x if digits else x.cast("int"), column, rate)

    def text(column: str) -> Column:
        rate, names = DEMO_TEXTS[column]
        return present(F.get(F.array(*map(F.lit, names)), F.floor(draw(column) * len(names)).cast("int")), column, rate)

    strain = 0.7 * draw("daily_screen_time_hours") + 0.3 * draw("strain")
    severity = F.when(strain < 0.25, "None").when(strain < 0.5, "Mild").when(strain < 0.75, "Moderate").otherwise("Severe")
    rows = spark.range(train_rows + test_rows).select("id", *map(number, DEMO_NUMBERS), *map(text, DEMO_TEXTS), severity.alias("addiction_level"), (0.8 * strain + 0.2 * draw("luck") > 0.4).cast("int").alias("addicted_label"))
    train, test = rows.where(F.col("id") < train_rows), rows.where(F.col("id") >= train_rows).drop("addicted_label")
    return train, test, test.select("id", F.lit(0.5).alias("addicted_label"))
