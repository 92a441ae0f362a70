"""Ordered target statistics: what the labels of a category's earlier rows say, along random orders of the rows.

A row's own label never enters its statistic, nor do those of rows after it in the order at hand. Several orders are
averaged. Rows that aren't trained on get the statistic of all training rows. An order is one of digests, and no task
accumulates a category: labels are summed by digits of the digest first, so that a category of any size is many groups.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest by which sums are taken: 256 groups of a category, and 4096 in each.
COARSE, FINE = 2, 3


def prefix_sums(df: DataFrame, groups: list[str], key: str, ties: list[str], values: list[str]) -> DataFrame:
    """Adds ``before_<v>``: the sum of v over the group's rows earlier by ``key``, a text of hexadecimal digits that are spread evenly, and
    then by ``ties``. Groups must not be null."""
    rows = df.withColumns({"_a": F.substring(key, 1, COARSE), "_b": F.substring(key, COARSE + 1, FINE)})
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda v, *by: F.coalesce(F.sum(v).over(earlier.partitionBy(*by[0]).orderBy(*by[1])), F.lit(0))
    fine = rows.groupBy(*groups, "_a", "_b").agg(*[F.sum(v).alias(f"_f_{v}") for v in values])
    coarse = fine.groupBy(*groups, "_a").agg(*[F.sum(f"_f_{v}").alias(f"_c_{v}") for v in values])
    coarse = coarse.select(*groups, "_a", *[before(f"_c_{v}", groups, ["_a"]).alias(f"_c_{v}") for v in values])
    fine = fine.select(*groups, "_a", "_b", *[before(f"_f_{v}", [*groups, "_a"], ["_b"]).alias(f"_f_{v}") for v in values])
    starts = fine.join(coarse, [*groups, "_a"])
    out = rows.join(starts, [*groups, "_a", "_b"])
    return out.select(*df.columns, *[(F.col(f"_c_{v}") + F.col(f"_f_{v}") + before(v, [*groups, "_a", "_b"], [key, *ties])).alias(f"before_{v}") for v in values])


def _category(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def ordered_statistics(rows: DataFrame, id_col: str, label: str, columns: list[str], trained: str | None = None, groups: list[str] | None = None, orders: int = 4, weight: float = 1.0, prior: float | None = None, seed: int = 42) -> DataFrame:
    """``rows`` with ``<c>__ts`` for each of ``columns``: (sum of labels + weight * prior) / (rows + weight) of the category's earlier training
    rows, the mean of ``orders`` orders; of all of them where the boolean ``trained`` is false. A missing value is a category. ``groups`` are
    trained apart (ids are unique in each); the prior is the training rows' mean label unless given."""
    groups = groups or []
    own = rows.withColumn("_trained", F.coalesce(F.col(trained), F.lit(False)) if trained else F.lit(True))
    long = own.select(*groups, id_col, "_trained", F.col(label).cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(k).alias("_column"), _category(c).alias("_category")) for k, c in enumerate(columns)])).alias("_p"))
    long = long.select(*groups, id_col, "_trained", "_y", "_p._column", "_p._category")
    learned = long.where("_trained").withColumns({"_y": F.coalesce("_y", F.lit(0.0)), "_n": F.lit(1)})
    means = learned.groupBy(*groups).agg(F.avg("_y").alias("_prior")) if prior is None else None

    def smoothed(df: DataFrame, total: str, n: str) -> DataFrame:
        at = F.lit(prior) if prior is not None else F.col("_prior")
        if means is not None:  # a row per group
            df = df.join(F.broadcast(means), groups) if groups else df.crossJoin(F.broadcast(means))
        return df.select(*groups, id_col, "_column", ((F.coalesce(F.col(total), F.lit(0.0)) + weight * at) / (F.coalesce(F.col(n), F.lit(0)) + weight)).alias("_ts"))

    dealt = learned.withColumn("_order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    dealt = dealt.withColumn("_key", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("_order").cast("string"), F.lit(str(seed)))))
    ours = smoothed(prefix_sums(dealt, [*groups, "_column", "_category", "_order"], "_key", [id_col], ["_y", "_n"]), "before__y", "before__n")
    totals = learned.groupBy(*groups, "_column", "_category").agg(F.sum("_y").alias("_all_y"), F.sum("_n").alias("_all_n"))
    theirs = smoothed(long.where("not _trained").join(totals, [*groups, "_column", "_category"], "left"), "_all_y", "_all_n")
    wide = ours.unionByName(theirs).groupBy(*groups, id_col).agg(*[F.avg(F.when(F.col("_column") == k, F.col("_ts"))).alias(f"{c}__ts") for k, c in enumerate(columns)])
    return rows.join(wide, [*groups, id_col])


#: Rows of an order, or of ids, that a task works on at once, about; and lots of an order, at most.
LOT_ROWS, LOTS = 1 << 14, 1 << 16


def fold_statistics(train: DataFrame, test: DataFrame | None, id_col: str, label: str, columns: list[str], fold: str, models: list[int], orders: int = 4, weight: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """:func:`ordered_statistics` for many models, of which each leaves a fold of ``train`` out: ``_t<c>_<m>`` for place c in ``columns`` and m in ``models``
    (their folds), added to both tables. An order is the same for all models, so a row goes once into each order and not once a model and column: of
    what stands before it, sums are kept by fold, and a model's are the totals less its fold's. An order is dealt into lots by its digests; a lot
    gets what the lots before it hold."""
    each = {int(r[fold]): r for r in train.groupBy(fold).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("s")).collect()}  # a row per fold
    folds, n, total = sorted(each), sum(r["n"] for r in each.values()), sum(r["s"] for r in each.values())
    priors = [(total - each[m]["s"]) / (n - each[m]["n"]) if n > each[m]["n"] else float("nan") for m in models]
    places, size = [folds.index(m) for m in models], len(folds)
    names = [f"_t{c}_{k}" for c in range(len(columns)) for k in range(len(models))]
    lots = min(LOTS, max(1, -(-n // LOT_ROWS)))
    at = F.coalesce(*[F.when(F.col(fold) == m, F.lit(k)) for k, m in enumerate(folds)])
    own = train.select(F.col(id_col).alias("_id"), at.alias("_fold"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_y"), *[_category(c).alias(f"_c{k}") for k, c in enumerate(columns)])
    dealt = own.withColumn("_order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    dealt = dealt.withColumn("_key", F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col("_order").cast("string"), F.lit(str(seed)))))
    dealt = dealt.withColumn("_lot", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * lots, 32).cast("int")).withColumn("_key", F.unhex("_key"))
    long = lambda df, *keep: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(k).alias("_column"), F.col(f"_c{k}").alias("_category")) for k in range(len(columns))])).alias("_p")).select(*keep, "_p.*")
    sums = [f"_s{k}" for k in range(2 * size)]  # rows by fold, then labels by fold
    adding = [F.sum(F.when(F.col("_fold") == k % size, F.lit(1.0) if k < size else F.col("_y")).otherwise(0.0)).alias(s) for k, s in enumerate(sums)]
    counts = long(dealt, "_order", "_lot", "_fold", "_y").groupBy("_order", "_lot", "_column", "_category").agg(*adding)
    group = Window.partitionBy("_order", "_column", "_category")  # a row per lot
    before = group.orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_order", "_lot", "_column", "_category", *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(s) for s in sums], *[F.sum(s).over(group).alias(f"{s}_all") for s in sums])
    kind = dict(train.dtypes)[id_col]
    schema = ", ".join([f"_id {kind}", "_order int", *(f"{t} double" for t in names)])
    found = dealt.groupBy("_order", "_lot").cogroup(starts.groupBy("_order", "_lot")).applyInArrow(partial(_in_lot, len(columns), places, priors, size, weight), schema)
    mean = found.groupBy(F.pmod(F.xxhash64("_id"), F.lit(max(1, -(-n // LOT_ROWS)))).alias("_part")).applyInArrow(partial(_mean, orders, names), schema.replace("_order int, ", ""))
    ours = train.join(mean.withColumnRenamed("_id", id_col), id_col)
    if test is None:
        return ours, None
    totals = long(own, "_fold", "_y").groupBy("_column", "_category").agg(*adding)
    known = long(test.select(F.col(id_col).alias("_id"), *[_category(c).alias(f"_c{k}") for k, c in enumerate(columns)]), "_id").join(totals, ["_column", "_category"], "left")
    less = lambda m, from_: sum((F.coalesce(f"_s{from_ + k}", F.lit(0.0)) for k in range(size) if k != places[m]), F.lit(0.0))
    value = lambda c, m: F.max(F.when(F.col("_column") == c, (less(m, size) + weight * priors[m]) / (less(m, 0) + weight)))
    wide = known.groupBy("_id").agg(*[value(c, m).alias(f"_t{c}_{m}") for c in range(len(columns)) for m in range(len(models))])
    return ours, test.join(wide.withColumnRenamed("_id", id_col), id_col)


def _in_lot(columns, places, priors, size, weight, key, rows, starts):
    """Statistics of a lot's rows by column and model: of the rows before each, or of all where the model leaves it out."""
    n = rows.num_rows
    digest = np.frombuffer(b"".join(rows.column("_key").to_pylist()), ">u8").reshape(n, 2)
    rows = rows.take(pa.array(np.lexsort((digest[:, 1], digest[:, 0]))))
    fold, y = rows.column("_fold").to_numpy(), rows.column("_y").to_numpy()
    own = np.zeros((n, 2 * size))
    own[np.arange(n), fold], own[np.arange(n), size + fold] = 1, y
    said, column, out = np.column_stack([starts.column(k).to_numpy() for k in starts.column_names if k.startswith("_s")]), starts.column("_column").to_numpy(), []
    for c in range(columns):
        here = np.flatnonzero(column == c)
        code = pc.index_in(rows.column(f"_c{c}"), value_set=starts.column("_category").take(pa.array(here)).combine_chunks()).to_numpy()
        by = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.append(True, code[by][1:] != code[by][:-1]))
        run = np.cumsum(own[by], 0) - own[by]
        before = np.empty_like(run)
        before[by] = run - np.repeat(run[first], np.diff(np.append(first, n)), 0)
        of = said[here][code]
        before += of[:, : 2 * size]
        for place, prior in zip(places, priors, strict=True):
            s = np.where((fold == place)[:, None], of[:, 2 * size :], before)
            out.append((s[:, size:].sum(1) - s[:, size + place] + weight * prior) / (s[:, :size].sum(1) - s[:, place] + weight))
    names = [f"_t{c}_{k}" for c in range(columns) for k in range(len(places))]
    return pa.Table.from_arrays([rows.column("_id"), pa.array(np.full(n, key[0].as_py(), np.int32)), *(pa.array(v) for v in out)], names=["_id", "_order", *names])


def _mean(orders, names, key, rows):
    """A row's statistics, the mean of its orders."""
    rows = rows.sort_by([("_id", "ascending"), ("_order", "ascending")])
    mean = lambda t: sum(rows.column(t).to_numpy().reshape(-1, orders).T) / orders
    return pa.Table.from_arrays([rows.column("_id").take(pa.array(np.arange(0, rows.num_rows, orders))), *(pa.array(mean(t)) for t in names)], names=["_id", *names])
