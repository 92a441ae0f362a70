"""Rank blends: fixed and searched weights, mixes, and re-ordering inside a subset."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrank.operators import exact_auc
from sparkrank.operators.folds import stratified_subsample
from sparkrank.operators.ranking import BINS, UNIT, average_ranks, ranked_models, roc_auc, sums_before
from sparkrank.plans.lineage import deleted, written


def weighted(models: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(m) * float(w) for m, w in models.items()])


def rank_blend(df: DataFrame, keys: list[str], weights: dict[str, float], groups: list[str] | None = None, name: str = "blend") -> DataFrame:
    """The weighted sum of the models' percentile ranks (within the groups)."""
    return ranked_models(df, keys, list(weights), groups).select(*keys, weighted(weights).alias(name))


def fold_gains(df: DataFrame, id_col: str, label: str, fold: str, base: str, other: str, weight: float) -> DataFrame:
    """(fold, base_auc, blend_auc, gain) of (1 - weight) * rank(base) + weight * rank(other)."""
    keys = [id_col, label, fold]
    ranked = ranked_models(df, keys, [base, other]).select(*keys, F.col(base).alias("base"), weighted({base: 1 - weight, other: weight}).alias("blend"))
    auc = roc_auc(ranked.unpivot(keys, ["base", "blend"], "kind", "score"), label, "score", [fold, "kind"], UNIT)
    wide = auc.groupBy(fold).agg(F.max(F.when(F.col("kind") == "base", F.col("auc"))).alias("base_auc"), F.max(F.when(F.col("kind") == "blend", F.col("auc"))).alias("blend_auc"))
    return wide.select(fold, "base_auc", "blend_auc", (F.col("blend_auc") - F.col("base_auc")).alias("gain"))


def candidate_scores(ranked: DataFrame, label: str, models: list[str], chosen: dict[int, dict[str, int]], round_col: str = "round") -> DataFrame:
    """(round, model, auc): of each round's running mean of ranks with one model more, for all models in one job."""
    done = {r: sum(c.values()) for r, c in chosen.items()}
    total = F.coalesce(*[F.when(F.col(round_col) == r, F.lit(float(n))) for r, n in done.items()])
    kept = F.coalesce(*[F.when(F.col(round_col) == r, weighted(c) if c else F.lit(0.0)) for r, c in chosen.items()])
    rows = ranked.where(F.col(round_col).isin(list(chosen)))
    rows = rows.select(round_col, label, *[((kept + F.col(m)) / (total + 1)).alias(m) for m in models])
    return roc_auc(rows.unpivot([round_col, label], models, "model", "score"), label, "score", [round_col, "model"], UNIT).select(round_col, "model", "auc")


def _candidates(models, chosen, ranges, batches):
    """A task's packets of every round's running mean with one model more."""
    held: dict[int, list] = {}
    for b in batches:
        if b.num_rows:
            rounds, y = b.column("round").to_numpy(), b.column("y").to_numpy()
            x = {m: b.column(k + 2).to_numpy() for k, m in enumerate(models)}
            for r, c in chosen.items():
                at = slice(None) if (rounds == r).all() else rounds == r
                kept = reduce(lambda a, d: a + d, [x[m] * float(n) for m, n in c.items()]) if c else 0.0
                held.setdefault(r, []).append((y[at], [((kept + x[m]) / (sum(c.values()) + 1.0))[at] for m in models]))
                if sum(len(p[0]) for p in held[r]) >= PACKET_ROWS:
                    yield _sent(r, held.pop(r), ranges)
    for r, parts in held.items():
        yield _sent(r, parts, ranges)


#: Rows that a task counts by score at once.
PACKET_ROWS = 1 << 19


def _sent(r: int, parts: list, ranges: int) -> pa.RecordBatch:
    y = np.concatenate([p[0] for p in parts])
    found = {(r, k): (np.concatenate([p[1][k] for p in parts]), y) for k in range(len(parts[0][1]))}
    return exact_auc.packets(found, dict.fromkeys(found, np.arange(1, ranges) / ranges))


def greedy_rounds(ranked: DataFrame, label: str, models: list[str], rounds: list[int], steps: int = 40, gain: float = 1e-6) -> dict[int, tuple[dict[str, float], list[tuple[int, str, float]]]]:
    """Greedy selection with replacement in every round at once: one job scores all candidates of all rounds that
    still go on. Per round: weights, and (step, model, auc) for each step. The first model wins ties. Ranks are not null."""
    chosen, history, _ = _all_steps(ranked, label, models, rounds, steps, gain)
    return {r: (_shares(c), history[r]) for r, c in chosen.items()}


def _shares(chosen: dict[str, int]) -> dict[str, float]:
    return {m: n / sum(chosen.values()) for m, n in chosen.items()}


def _all_steps(ranked: DataFrame, label: str, models: list[str], rounds: list[int], steps: int, gain: float) -> tuple[dict[int, dict[str, int]], dict[int, list[tuple[int, str, float]]], dict[int, dict[str, float]]]:
    """How often each round of :func:`greedy_rounds` took a model, its steps, and the AUC of each model alone."""
    chosen: dict[int, dict[str, int]] = {r: {} for r in rounds}
    history: dict[int, list[tuple[int, str, float]]] = {r: [] for r in rounds}
    alone: dict[int, dict[str, float]] = {r: {} for r in rounds}
    going = set(rounds)
    own = _numbers(ranked, label, models)
    ranges = max(BINS, -(-own.count() // exact_auc.RANGE_ROWS))
    for step in range(1, steps + 1):
        if not going:
            break
        asked = {r: chosen[r] for r in sorted(going)}
        found = exact_auc.aucs(own.where(F.col("round").isin(list(asked))).mapInArrow(partial(_candidates, models, asked, ranges), exact_auc.PACKETS))
        for r in sorted(going):
            scores = {m: found[r, k] for k, m in enumerate(models) if found.get((r, k)) is not None}
            if step == 1:
                alone[r] = scores
            best = max((m for m in models if m in scores), key=lambda m: scores[m], default=None)
            if best is None or step > 1 and scores[best] < history[r][-1][2] + gain:
                going.discard(r)
                continue
            chosen[r][best] = chosen[r].get(best, 0) + 1
            history[r].append((step, best, scores[best]))
    return chosen, history, alone


def _numbers(ranked: DataFrame, label: str, models: list[str]) -> DataFrame:
    return ranked.select(F.col("round").cast("int").alias("round"), F.col(label).cast("double").alias("y"), *[F.col(m).cast("double") for m in models])


def _mixed(weights: dict[str, float], ranges: int, batches):
    """A task's packets of the ranks' weighted sum."""
    held: list = []
    for b in batches:
        if b.num_rows:
            held.append((b.column("y").to_numpy(), [reduce(lambda a, d: a + d, [b.column(m).to_numpy() * w for m, w in weights.items()])]))
            if sum(len(p[0]) for p in held) >= PACKET_ROWS:
                yield _sent(0, held, ranges)
                held = []
    if held:
        yield _sent(0, held, ranges)


def greedy_weights(df: DataFrame, id_col: str, label: str, models: list[str], steps: int = 40, gain: float = 1e-6) -> tuple[dict[str, float], list[tuple[int, str, float]]]:
    ranked = written(ranked_models(df, [id_col, label], models).select(F.lit(0).alias("round"), label, *models), "ranks")
    try:
        return greedy_rounds(ranked, label, models, [0], steps, gain)[0]
    finally:
        deleted(ranked)


def _auc_of(score: np.ndarray, y: np.ndarray, positives: int) -> float:
    """Exact AUC of whole-number scores, ties half."""
    order = np.argsort(score, kind="stable")
    s, ones = score[order], y[order]
    ends = np.append(np.flatnonzero(np.diff(s)), len(s) - 1)
    upto, pos = ends + 1, np.cumsum(ones)[ends]
    neg = upto - pos
    p, n = np.diff(pos, prepend=0), np.diff(neg, prepend=0)
    return float((p * (2 * (neg - n) + n)).sum()) / (2.0 * positives * (len(y) - positives))


def _search(models: list[str], steps: int, gain: float, key, table):
    """One round's greedy search over its sample, and the AUC that it reached: twice the average ranks, whole numbers, are summed up."""
    y = table.column("_y").to_numpy()
    n, positives = len(y), int(y.sum())
    chosen, last = dict.fromkeys(models, 0), None
    if 0 < positives < n:
        ranks = {}
        for m in models:
            _, back, counts = np.unique(table.column(m).to_numpy(), return_inverse=True, return_counts=True)
            ranks[m] = (2 * np.cumsum(counts) - counts + 1)[back]
        total = np.zeros(n, np.int64)
        for _ in range(steps):
            found = {m: _auc_of(total + ranks[m], y, positives) for m in models}
            best = max(models, key=lambda m: found[m])
            if last is not None and found[best] < last + gain:
                break
            chosen[best], total, last = chosen[best] + 1, total + ranks[best], found[best]
    taken = max(1, sum(chosen.values()))
    return pa.table([pa.array([key[0].as_py()] * len(models), pa.int32()), pa.array(models), pa.array([chosen[m] / taken for m in models]), pa.array([last] * len(models), pa.float64())], names=["round", "model", "weight", "auc"])


def stable_weights(df: DataFrame, id_col: str, label: str, models: list[str], rounds: int = 25, share: float = 0.8, cap: int = 120_000, least: float = 0.15, steps: int = 40, gain: float = 1e-6, seed: int = 20260803) -> DataFrame:
    """(model, weight, frequency, mean, deviation) of greedy blends over stratified subsamples: mean weights, nothing for
    a model that fewer than ``least`` of the rounds chose, then scaled to 1. A round is at most ``cap`` rows, which one
    task searches; rounds go side by side. Then all rows judge: ``auc`` of each model alone, ``blend_auc`` of the weights, and a greedy search
    over all rows to compare with (``greedy``, its weights, and ``greedy_auc``); ``round_auc_mean`` and ``round_auc_deviation`` are of the rounds."""
    parts = stratified_subsample(df.select(id_col, label, *models), id_col, label, share, cap, rounds, seed)
    own = parts.select(F.col("round").cast("int").alias("round"), F.col(label).cast("long").alias("_y"), *models)
    found = written(own.groupBy("round").applyInArrow(partial(_search, models, steps, gain), "round int, model string, weight double, auc double"), "rounds")
    summary = weight_summary(found, least)
    weights = {r["model"]: r["weight"] for r in summary.select("model", "weight").collect()}  # a row per model
    each = found.agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("deviation")).first()  # a round's AUC stands in as many rows as there are models
    ranked = written(ranked_models(df, [id_col, label], models).select(F.lit(0).alias("round"), label, *models), "ranks")
    try:
        chosen, history, alone = _all_steps(ranked, label, models, [0], steps, gain)
        rows = _numbers(ranked, label, models)
        ranges = max(BINS, -(-rows.count() // exact_auc.RANGE_ROWS))
        whole = exact_auc.aucs(rows.mapInArrow(partial(_mixed, {m: w for m, w in weights.items() if w}, ranges), exact_auc.PACKETS)).get((0, 0)) if any(weights.values()) else None
    finally:
        deleted(ranked)
    of = lambda found, other: F.coalesce(*[F.when(F.col("model") == m, F.lit(v)) for m, v in found.items()], F.lit(other).cast("double"))
    said = {"blend_auc": whole, "greedy_auc": history[0][-1][2] if history[0] else None, "round_auc_mean": each["mean"], "round_auc_deviation": each["deviation"]}
    return summary.select("*", of(alone[0], None).alias("auc"), of(_shares(chosen[0]), 0.0).alias("greedy"), *[F.lit(v).cast("double").alias(n) for n, v in said.items()])


def weight_summary(rounds: DataFrame, least: float = 0.15) -> DataFrame:
    own = rounds.groupBy("model").agg(F.avg((F.col("weight") > 0).cast("double")).alias("frequency"), F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("deviation"))
    whole = Window.partitionBy(F.lit(0))  # a row per model
    used = F.when(F.col("frequency") >= least, F.col("mean")).otherwise(0.0)
    first = F.row_number().over(whole.orderBy(F.desc("frequency"), "model")) == 1
    own = own.withColumn("_used", used).withColumn("_sum", F.sum("_used").over(whole)).withColumn("_first", first)
    weight = F.when(F.col("_sum") > 0, F.col("_used") / F.when(F.col("_sum") > 0, F.col("_sum"))).otherwise(F.col("_first").cast("double"))
    return own.select("model", weight.alias("weight"), "frequency", "mean", "deviation")


def reorder(df: DataFrame, base: str, local: str, weight: float, row: str, inside: Column | None = None, bins: int = BINS, groups: list[str] | None = None) -> DataFrame:
    """Re-orders ``base`` inside a subset (where ``inside``, or where ``local`` isn't missing): the subset keeps the
    same base values, dealt out by (1 - weight) * rank(base) + weight * rank(local), ties by ``row``. Other rows stay.
    ``groups`` (no nulls) are re-ordered apart."""
    chosen = F.col(local).isNotNull() if inside is None else inside
    by = [f"_g{k}" for k in range(len(groups or []))]
    own = written(df.where(chosen).select(*[F.col(g).alias(b) for g, b in zip(groups or [], by, strict=True)], F.col(row).alias("_row"), F.col(base).alias("_base"), F.col(local).alias("_local")), "subset")
    mixed = average_ranks(average_ranks(own, "_base", by, name="_rb", bins=bins), "_local", by, name="_rl", bins=bins)
    mixed = written(mixed.select(*by, "_row", "_base", ((1.0 - weight) * F.col("_rb") + weight * F.col("_rl")).alias("_order")), "order")
    places = _positions(mixed, "_order", "_row", bins, by).select(*by, "_row", F.col("_place").alias("_p"))
    values = _positions(mixed, "_base", "_row", bins, by).select(*[F.col(b).alias(f"{b}v") for b in by], F.col("_base").alias("_value"), F.col("_place").alias("_q"))
    same = [F.col(b) == F.col(f"{b}v") for b in by]
    moved = places.join(values, reduce(lambda a, b: a & b, [F.col("_p") == F.col("_q"), *same])).select(*by, "_row", "_value")
    ours = [df[g] == F.col(b) for g, b in zip(groups or [], by, strict=True)]
    return df.join(moved, reduce(lambda a, b: a & b, [df[row] == F.col("_row"), *ours]), "left").withColumn(base, F.coalesce("_value", base)).select(*df.columns)


def _positions(df: DataFrame, order: str, tie: str, bins: int, by: list[str]) -> DataFrame:
    """Adds ``_place``, 0.. by ``order`` and then ``tie``, in each group."""
    counts = df.groupBy(*by, order).agg(F.count("*").alias("_n"))
    starts = sums_before(counts, by, order, ["_n"], bins).select(*[F.col(b).alias(f"{b}s") for b in by], F.col(order).alias("_o"), F.col("before__n").alias("_start"))
    inside = Window.partitionBy(*by, order).orderBy(tie)
    same = reduce(lambda a, b: a & b, [F.col(order) == F.col("_o"), *[F.col(b) == F.col(f"{b}s") for b in by]])
    return df.join(starts, same).withColumn("_place", F.col("_start") + F.row_number().over(inside) - 1).drop("_o", "_start", *[f"{b}s" for b in by])


def reorder_bands(df: DataFrame, base: str, bands: list[tuple[str, float]], row: str, groups: list[str] | None = None) -> DataFrame:
    """One band (column of local scores, missing outside, and its weight) after another."""
    for local, weight in bands:
        df = written(reorder(df, base, local, weight, row, groups=groups), "band")
    return df


def band_report(df: DataFrame, label: str, base: str, bands: list[tuple[str, float]], row: str, groups: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """:func:`reorder_bands`, and for each band its labelled rows, the AUC inside it of what came before and of the local scores."""
    found = []
    for local, weight in bands:
        inside = df.where(F.col(local).isNotNull() & F.col(label).isNotNull())
        both = inside.unpivot([row, label], [base, local], "kind", "score")
        auc = {r["kind"]: r for r in roc_auc(both, label, "score", ["kind"]).collect()}  # two rows
        rows = auc[base]["positives"] + auc[base]["negatives"] if auc else 0
        found.append({"band": local, "weight": weight, "rows": rows, "before": auc[base]["auc"] if auc else None, "local": auc[local]["auc"] if auc else None})
        df = written(reorder(df, base, local, weight, row, groups=groups), "band")
    return df, found


def average_predictions(long: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean over folds and seeds."""
    return long.groupBy(*keys).agg(F.avg(score).alias(score))


def adopt(gain: float, least: float) -> bool:
    return gain >= least
