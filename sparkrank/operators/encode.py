"""Numeric matrices: missing indicators, one-hot columns, median fill, lattice codes, rank-Gauss."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.functions.scalar import finite, round_even
from sparkrank.operators.audit import numeric_columns
from sparkrank.operators.ranking import average_ranks, medians, sums_before
from sparkrank.plans.lineage import written

MAX_LEVELS = 1000


def levels(df: DataFrame, columns: list[str], most: int = MAX_LEVELS) -> dict[str, list[str]]:
    """Distinct texts of each column, sorted; a column with more than ``most`` can't be spread out and is refused."""
    found = {}
    for c in columns:
        rows = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"column {c} has more than {most} levels")
        found[c] = sorted(r["v"] for r in rows)
    return found


def encoded(df: DataFrame, keys: list[str], columns: list[str], split: str = "split", fill: bool = True, indicators: bool = True, indicator_columns: list[str] | None = None) -> DataFrame:
    """``keys`` and a number per feature, in one projection over ``df`` (train and test rows, told by ``split``).

    Numbers: not-finite ones become missing; ``<c>__missing`` for those with a missing value in either split. Texts:
    ``<c>__<level>`` for each level of either split and ``<c>__nan``. If ``fill``, medians of the train rows go
    into the gaps, 0 where there is no median."""
    numbers = numeric_columns(df, columns)
    texts = [c for c in columns if c not in numbers]
    clean = {c: finite(F.col(c).cast("double")) for c in numbers}
    stats = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"m_{c}") for c in numbers], F.count("*").alias("n")).first()
    middles = medians(df.where(F.col(split) == "train"), clean) if fill else {}
    allowed = set(numbers if indicator_columns is None else indicator_columns)
    flagged = [c for c in numbers if indicators and c in allowed and (stats[f"m_{c}"] or 0) > 0]
    clash = {f"{c}__missing" for c in flagged} & set(columns)
    if clash:
        raise ValueError(f"missing indicators clash with columns: {sorted(clash)}")
    out = [F.coalesce(clean[c], F.lit(middles[c]), F.lit(0.0)).alias(c) if fill else clean[c].alias(c) for c in numbers]
    out += [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in flagged]
    for c, own in levels(df, texts).items():
        out += [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)).alias(f"{c}__{v}") for v in own]
        out.append(F.col(c).isNull().cast("double").alias(f"{c}__nan"))
    return df.select(*keys, *out)


def lattice_vocabulary(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(field, value, n, code): values with at least ``least`` rows, the most frequent first, ties by value, from 2 on."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.withColumn("code", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")) + 1)


def lattice_codes(df: DataFrame, keys: list[str], columns: list[str], least: int = 2) -> DataFrame:
    """(keys, field, code): 0 missing, 1 rare, 2.. by frequency."""
    long = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "field", "value")
    words = lattice_vocabulary(df, columns, least).select(F.col("field").alias("_f"), F.col("value").alias("_v"), F.col("code").alias("_c"))
    joined = long.join(words, (F.col("field") == F.col("_f")) & (F.col("value") == F.col("_v")), "left")
    return joined.select(*keys, "field", F.when(F.col("value").isNull(), 0).otherwise(F.coalesce("_c", F.lit(1))).alias("code"))


def coarse(df: DataFrame, columns: list[str], digits: int = 1) -> DataFrame:
    """Adds ``<c>_r1``: the number rounded half to even."""
    return df.select("*", *[round_even(F.col(c).cast("double"), digits).alias(f"{c}_r{digits}") for c in columns])


def vocabulary_offsets(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(field, size, offset): codes of each field, with missing and rare, and where they begin in a common table."""
    sizes = lattice_vocabulary(df, columns, least).groupBy("field").agg((F.count("*") + 2).alias("size"))
    listed = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(columns)], "field string, place int")
    sizes = listed.join(sizes, "field", "left").select("field", "place", F.coalesce("size", F.lit(2)).alias("size"))  # a row per field
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("field", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))


#: Coefficients of a published rational approximation of the normal quantile (relative error 1.2e-9), the
#: middle's numerator and denominator, then the tails', highest power first.
MIDDLE_P = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
MIDDLE_Q = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_P = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_Q = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1, by arithmetic in the JVM."""

    def polynomial(x: Column, coefficients: list[float]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    def tail(side: Column) -> Column:
        x = F.sqrt(-2.0 * F.log(side))
        return polynomial(x, TAIL_P) / polynomial(x, TAIL_Q)

    gap = p - 0.5
    middle = gap * polynomial(gap * gap, MIDDLE_P) / polynomial(gap * gap, MIDDLE_Q)
    return F.when(p < TAIL, tail(p)).when(p > 1 - TAIL, -tail(1.0 - p)).otherwise(middle)


def rank_gauss(df: DataFrame, column: str, name: str, least: int = 10) -> DataFrame:
    """Adds normal quantiles of the average ranks; 0 where missing or if at most ``least`` values are there. The
    exact ranks take the place of an interpolated table of quantiles, so values differ slightly from such a one."""
    n = df.where(F.col(column).isNotNull()).count()
    if n <= least:
        return df.withColumn(name, F.lit(0.0))

    ranked = average_ranks(df, column, percentile=False, name="_rank")
    p = F.least(F.greatest((F.col("_rank") - 0.5) / n, F.lit(1e-7)), F.lit(1 - 1e-7))
    return ranked.withColumn(name, F.when(F.col("_rank").isNull(), 0.0).otherwise(normal_quantile(p))).drop("_rank")


#: Marks of the quantile transform at most; how far from 0 and 1 its uniform values are kept before the normal quantile.
MARKS, EDGE = 1000, 1e-7


def quantile_tables(df: DataFrame, columns: list[str], most: int = MARKS) -> dict[str, np.ndarray]:
    """For each column min(``most``, values) quantiles at even steps from 0 to 1, interpolated between exact order statistics. Values are
    counted once for all columns; a value knows which quantiles fall on the ranks that it holds, so nothing is sorted again.
    What comes to the driver is ``most`` numbers a column."""
    long = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], columns, "_column", "_value")
    counts = written(long.where("_value is not null").groupBy("_column", "_value").agg(F.count("*").alias("_n")), "counts")
    sizes = {r["_column"]: int(r["n"]) for r in counts.groupBy("_column").agg(F.sum("_n").alias("n")).collect()}  # a row per column
    marks = {c: min(most, n) for c, n in sizes.items()}
    own = [c for c in columns if marks.get(c, 0) > 1]
    found = {c: np.zeros((2, marks[c])) for c in own}
    if own:
        placed = sums_before(counts.where(F.col("_column").isin(own)), ["_column"], "_value", ["_n"])
        of = lambda of_column: F.coalesce(*[F.when(F.col("_column") == c, F.lit(of_column(c)).cast("long")) for c in own])
        # Quantile i stands at rank h = i * (n - 1) / (m - 1), from 0: the value that holds floor(h) and that which holds ceil(h).
        placed = placed.withColumns({"_i": of(lambda c: marks[c] - 1), "_all": of(lambda c: sizes[c] - 1), "_b": F.col("before__n"), "_e": F.col("before__n") + F.col("_n")})
        up = lambda x: F.expr(f"({x} * _i + _all - 1) div _all")
        low = _from_to(up("_b"), up("_e") - 1)
        high = _from_to(F.when(F.col("_b") == 0, F.lit(0)).otherwise(F.expr("((_b - 1) * _i) div _all") + 1), F.expr("((_e - 1) * _i) div _all"))
        parts = [placed.select("_column", "_value", F.lit(k).alias("_side"), F.explode(s).alias("_q")) for k, s in enumerate((low, high))]
        for r in parts[0].unionByName(parts[1]).collect():  # two rows a quantile and column
            found[r["_column"]][r["_side"], r["_q"]] = r["_value"]
    out = {}
    for c in columns:
        if c not in own:
            out[c] = np.zeros(0)
            continue
        h = np.arange(marks[c]) * (sizes[c] - 1) / (marks[c] - 1)
        low, high = found[c]
        out[c] = np.maximum.accumulate(low + (high - low) * (h - np.floor(h)))
    return out


def _from_to(a: Column, b: Column) -> Column:
    """a, a + 1, .. b; nothing if b is less."""
    return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<bigint>"))


def _placed_between(names, tables, batches):
    for b in batches:
        out = []
        for c, k in zip(names, b.schema.names, strict=False):
            x, q = b.column(k).to_numpy(zero_copy_only=False).astype(np.float64), tables[c]
            part = np.linspace(0, 1, len(q))
            there = np.isfinite(x)
            y = np.full(len(x), np.nan)
            if len(q):
                v = x[there]
                p = 0.5 * (np.interp(v, q, part) - np.interp(-v, -q[::-1], -part[::-1]))  # the middle of a value's marks
                p[v + EDGE > q[-1]] = 1.0
                p[v - EDGE < q[0]] = 0.0
                y[there] = p
            out.append(pa.array(y, from_pandas=True))
        yield pa.RecordBatch.from_arrays([*out, *(b.column(k) for k in b.schema.names[len(names) :])], names=b.schema.names)


def quantile_gauss(df: DataFrame, columns: list[str], suffix: str = "__gauss", least: int = 10, most: int = MARKS, fit: DataFrame | None = None) -> DataFrame:
    """Adds normal quantiles of each column by interpolation in its table of quantiles (of ``fit``, or of ``df`` itself); 0 where the value is
    missing, or everywhere if at most ``least`` values are there."""
    tables = quantile_tables(df if fit is None else fit, columns, most)
    n = {r["_c"]: r["n"] for r in (df if fit is None else fit).select(*[finite(F.col(c).cast("double")).alias(c) for c in columns]).unpivot([], columns, "_c", "_v").groupBy("_c").agg(F.count("_v").alias("n")).collect()}  # a row per column
    own = [c for c in columns if n.get(c, 0) > least and len(tables[c]) > 1]
    if not own:
        return df.withColumns({f"{c}{suffix}": F.lit(0.0) for c in columns})
    kinds = dict(df.dtypes)
    ready = df.select(*[F.col(c).cast("double").alias(f"_u{k}") for k, c in enumerate(own)], *df.columns)
    schema = ", ".join([*(f"_u{k} double" for k in range(len(own))), *(f"`{c}` {kinds[c]}" for c in df.columns)])
    placed = ready.mapInArrow(partial(_placed_between, own, {c: tables[c] for c in own}), schema)
    p = lambda k: F.least(F.greatest(F.col(f"_u{k}"), F.lit(EDGE)), F.lit(1 - EDGE))
    made = {f"{c}{suffix}": F.when(F.col(f"_u{own.index(c)}").isNotNull(), normal_quantile(p(own.index(c)))).otherwise(0.0) if c in own else F.lit(0.0) for c in columns}
    return placed.withColumns(made).drop(*[f"_u{k}" for k in range(len(own))])
