"""Fold assignment, exact samples and out-of-fold target encoding. Randomness is md5 of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.operators.ranking import roc_auc
from sparkrank.plans.lineage import written


def shuffled(id_col: str, salt: object) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{salt}")))


def numbered(df: DataFrame, groups: list[str], order: str, name: str = "number") -> DataFrame:
    """Numbers rows from 0 within the groups by ``order``, a hexadecimal digest (then by all else that ties). The
    digest's first digits bin the rows evenly, so no task orders a whole group."""
    rows = df.withColumn("_bin", F.substring(order, 1, 3))
    counts = rows.groupBy(*groups, "_bin").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*groups, "_bin", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*groups, "_bin").orderBy(order)
    return rows.join(starts, [*groups, "_bin"]).select(*df.columns, (F.col("_start") + F.row_number().over(inside) - 1).alias(name))


def stratified_folds(df: DataFrame, id_col: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: classes are shuffled each for itself and dealt in turn, the next class going on where the one
    before ended. Sizes differ by at most one, overall and within a class."""
    rows = numbered(df.withColumn("_digest", shuffled(id_col, seed)), [label], "_digest", "_number")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    offset = sizes.select(label, F.coalesce(F.sum("_n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))  # a row per class
    return rows.join(F.broadcast(offset), label).select(*df.columns, F.pmod(F.col("_number") + F.col("_offset"), F.lit(folds)).cast("int").alias("fold"))


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (or all): those with the smallest digests."""
    return df.orderBy(shuffled(id_col, seed), id_col).limit(n)


def stratified_subsample(df: DataFrame, id_col: str, label: str, share: float = 0.8, cap: int | None = 120_000, rounds: int = 1, seed: int = 20260803) -> DataFrame:
    """Rows of each round's sample without replacement, with ``round``. A class of n rows gives
    min(max(2, round(n * share)), max(2, round(cap * class share)), n)."""
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row per class
    total = sum(sizes.values())
    wanted = {}
    for c, n in sizes.items():
        k = max(2, round(n * share))
        if cap:
            k = min(k, max(2, round(cap * n / total)))
        wanted[c] = min(k, n)
    parts = df.withColumn("round", F.explode(F.array(*[F.lit(k) for k in range(rounds)])))
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), F.col("round").cast("string"), F.lit(f":{seed}")))
    dealt = parts.withColumn("_digest", digest)
    per = lambda found: F.coalesce(*[F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(k)) for c, k in found.items()]) if found else F.lit(0)
    near = {c: _most_digest(k, sizes[c]) for c, k in wanted.items()}
    taken = dealt
    if 2 * sum(wanted.values()) < total:  # else nearly all rows would be kept
        taken = written(dealt.where(F.col("_digest") <= per(near)), "sample")
        full = taken.groupBy("round", label).count().collect()  # a row per round and class
        if any(sum(r[label] == c and r["count"] >= k for r in full) < rounds for c, k in wanted.items()):
            taken = dealt  # digests weren't spread evenly
    rows = numbered(taken, ["round", label], "_digest", "_number")
    return rows.where(F.col("_number") < per(wanted)).select(*parts.columns)


def _most_digest(wanted: int, rows: int) -> str:
    """A digest that the ``wanted`` smallest of ``rows`` stay below but by an accident."""
    share = (wanted + 8 * wanted**0.5 + 64) / max(1, rows)
    return "g" if share >= 1 else f"{int(share * 16**8):08x}" + "f" * 24


def out_of_fold_encoding(df: DataFrame, column: str, label: str, fold: str = "fold", smoothing: float = 20.0, missing: str = "__MISSING__") -> DataFrame:
    """(fold, value, encoded, prior) for each value of each fold, learned from the other folds: their sums are the
    totals less the fold's own. A value that the other folds lack has their prior."""
    rows = df.select(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value"), F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"))
    own = rows.groupBy("fold", "value").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    total = own.groupBy("value").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    folds = own.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    everything = folds.agg(F.sum("fs").alias("es"), F.sum("fn").alias("en"))  # one row
    prior = folds.crossJoin(F.broadcast(everything)).select("fold", ((F.col("es") - F.col("fs")) / (F.col("en") - F.col("fn"))).alias("prior"))
    n = F.col("tn") - F.col("n")
    encoded = F.when(n > 0, (F.col("ts") - F.col("s") + F.col("prior") * smoothing) / (n + smoothing)).otherwise(F.col("prior"))
    return own.join(total, "value").join(F.broadcast(prior), "fold").select("fold", "value", encoded.alias("encoded"), "prior")  # a row per fold


def encoded_rows(df: DataFrame, column: str, label: str, fold: str = "fold", smoothing: float = 20.0, name: str = "encoded") -> DataFrame:
    codes = out_of_fold_encoding(df, column, label, fold, smoothing).select(F.col("fold").alias("_f"), F.col("value").alias("_v"), F.col("encoded").alias(name))
    value = F.coalesce(F.col(column).cast("string"), F.lit("__MISSING__"))
    return df.join(codes, (df[fold] == F.col("_f")) & (value == F.col("_v")), "left").drop("_f", "_v")


def encoded_auc(df: DataFrame, column: str, label: str, fold: str = "fold") -> DataFrame:
    return roc_auc(encoded_rows(df, column, label, fold), label, "encoded")
