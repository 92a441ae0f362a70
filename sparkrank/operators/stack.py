"""Meta models over base-model logits: global and by missingness regime, both exact optima of ridge logistic loss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.functions.scalar import logit
from sparkrank.operators import newton
from sparkrank.operators.boosting import boosted_out_of_fold
from sparkrank.operators.ranking import roc_auc
from sparkrank.plans.lineage import written


def as_logits(df: DataFrame, models: list[str]) -> DataFrame:
    return df.withColumns({m: logit(F.col(m)) for m in models})


def _mean(models: list[str]) -> Column:
    return sum((F.col(m) for m in models[1:]), F.col(models[0])) / len(models)


def spread(models: list[str]) -> Column:
    """Population deviation of a row's logits."""
    mean = _mean(models)
    return F.sqrt(sum(((F.col(m) - mean) * (F.col(m) - mean) for m in models), F.lit(0.0)) / len(models))


def disagreement(df: DataFrame, models: list[str]) -> tuple[float, float]:
    """Mean and population deviation of the rows' spreads."""
    row = df.agg(F.avg(spread(models)).alias("m"), F.stddev_pop(spread(models)).alias("s")).first()
    return float(row["m"] or 0.0), float(row["s"] or 0.0)


def regime_design(df: DataFrame, keys: list[str], models: list[str], missing: str, mean: float | None = None, deviation: float | None = None) -> DataFrame:
    """``keys`` and 4 * m + 5 columns: the logits alone, times complete (nothing missing), times severe (four or more
    missing) and times the normed disagreement; their mean, deviation and range; complete and severe."""
    if mean is None or deviation is None:
        own = disagreement(df, models)
        mean, deviation = own[0] if mean is None else mean, own[1] if deviation is None else deviation
    complete, severe = (F.col(missing) == 0).cast("double"), (F.col(missing) >= 4).cast("double")
    normed = (spread(models) - mean) / (deviation + 1e-6)
    columns = [F.col(m) for m in models]
    for tag, by in (("complete", complete), ("severe", severe), ("disagreement", normed)):
        columns += [(F.col(m) * by).alias(f"{m}_{tag}") for m in models]
    largest, least = (F.greatest(*models), F.least(*models)) if len(models) > 1 else (F.col(models[0]), F.col(models[0]))
    columns += [_mean(models).alias("logit_mean"), spread(models).alias("logit_std"), (largest - least).alias("logit_range"), complete.alias("complete"), severe.alias("severe")]
    return df.select(*keys, *columns)


def quantile_design(df: DataFrame, keys: list[str], models: list[str], raw: list[str]) -> DataFrame:
    """The logits, their mean, deviation, range and quartiles, how many raw columns are missing and which."""
    ordered = F.array_sort(F.array(*models))

    def quantile(q: float) -> Column:
        at = q * (len(models) - 1)
        low, part = int(at), at - int(at)
        high = min(low + 1, len(models) - 1)
        return F.get(ordered, low) * (1 - part) + F.get(ordered, high) * part

    missing = [F.col(c).isNull().cast("double") for c in raw]
    return df.select(*keys, *models, _mean(models).alias("logit_mean"), spread(models).alias("logit_std"), (F.get(ordered, len(models) - 1) - F.get(ordered, 0)).alias("logit_range"), *[quantile(q).alias(f"logit_q{int(100 * q)}") for q in (0.25, 0.5, 0.75)], sum(missing, F.lit(0.0)).alias("missing_count"), *[m.alias(f"{c}__missing") for m, c in zip(missing, raw, strict=True)])


def scaled(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """All tables in units of the first one's mean and population deviation (1 where that is 0)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    by = {c: (F.col(c) - (row[f"m_{c}"] or 0.0)) / (row[f"s_{c}"] or 1.0) for c in columns}
    return [df.withColumns(by) for df in (train, *others)]


def _folds(df: DataFrame, fold: str) -> list[int]:
    return sorted(int(r[fold]) for r in df.select(fold).distinct().collect())  # a row per fold


def cross_fitted(df: DataFrame, keys: list[str], columns: list[str], label: str, fold: str = "fold", c: float = 1.0, scale: bool = True) -> DataFrame:
    """Out-of-fold scores: one fit per fold on the rows of the others (scaled by them if asked for), all at once."""
    df = written(df.select(*dict.fromkeys([*keys, *columns, label, fold])), "stack")
    fits = newton.fit_many(df, columns, label, [(k, c) for k in _folds(df, fold)], fold, scale)
    return newton.scored(df, keys, columns, fits, fold)


def final_logistic(train: DataFrame, test: DataFrame, keys: list[str], columns: list[str], label: str, c: float = 1.0, scale: bool = True):
    """Scores of ``test`` from a fit on all of ``train``, and (column, coefficient in the columns' own units)."""
    fits = newton.fit_many(train, columns, label, [(None, c)], None, scale)
    weights = sorted(((x, float(w)) for x, w in zip(columns, fits[0].plain()[:-1], strict=True)), key=lambda r: (-abs(r[1]), r[0]))
    return newton.scored(test, keys, columns, fits), weights


def best_of_grid(df: DataFrame, keys: list[str], columns: list[str], label: str, grid: list[float], fold: str = "fold", scale: bool = True) -> tuple[float, float, DataFrame]:
    """(c, auc, out-of-fold scores) of the best c; the first one wins ties. All folds and all c are fitted together."""
    df = written(df.select(*dict.fromkeys([*keys, *columns, label, fold])), "grid")
    folds = _folds(df, fold)
    fits = newton.fit_many(df, columns, label, [(k, c) for c in grid for k in folds], fold, scale)
    own = list(dict.fromkeys([*keys, label]))
    scores = written(newton.scored(df, own, columns, fits, fold, "_fit").withColumn("_c", F.expr(f"_fit div {max(1, len(folds))}")).drop("_fit"), "grid")
    found = {r["_c"]: r["auc"] for r in roc_auc(scores, label, "score", ["_c"]).collect()}  # a row per c
    best = max(range(len(grid)), key=lambda k: (-1.0 if found.get(k) is None else found[k], -k))
    return grid[best], found.get(best), scores.where(F.col("_c") == best).drop("_c")


def logistic_out_of_fold(train: DataFrame, test: DataFrame | None, id_col: str, columns: list[str], label: str, fold: str = "fold", c: float = 1.0) -> tuple[DataFrame, DataFrame | None, list[tuple[str, float]]]:
    """Out-of-fold scores of ``train``, mean scores of ``test`` over the folds' fits, and mean absolute weights of scaled columns."""
    fits = newton.fit_many(train, columns, label, [(k, c) for k in _folds(train, fold)], fold, True)
    weights = [(x, float(np.mean([abs(f.weights[k]) for f in fits]))) for k, x in enumerate(columns)]
    scores = newton.scored(test, [id_col], columns, fits, tag="_fit").groupBy(id_col).agg(F.avg("score").alias("score")) if test is not None else None
    return newton.scored(train, [id_col], columns, fits, fold), scores, weights


def nonlinear_meta(df: DataFrame, id_col: str, models: list[str], raw: list[str], label: str, fold: str = "fold", only: list[int] | None = None, params: dict | None = None, seed: int = 42) -> tuple[DataFrame, dict]:
    """Boosted trees over :func:`quantile_design` of the logits, fitted out of fold: (id, label, fold, score) of all folds or of ``only`` some, and
    a report: rows, pooled AUC, each fold's AUC and rounds, the design's width. With no ``patience`` the rounds are fixed; else each
    fold chooses its own, which suits a screening only."""
    design = quantile_design(df, [id_col, label, fold], models, raw)
    names = {c: f"d{k}" for k, c in enumerate(c for c in design.columns if c not in (id_col, label, fold))}
    design = written(design.select(id_col, label, fold, *[F.col(f"`{c}`").alias(x) for c, x in names.items()]), "design")
    oof, _, fitted = boosted_out_of_fold(design, None, id_col, list(names.values()), label, fold, params=params, seed=seed, only=only)
    scores = written(oof.join(design.select(id_col, label, fold), id_col).select(id_col, label, fold, "score"), "meta")
    each = {r[fold]: r for r in roc_auc(scores, label, "score", [fold]).collect()}  # a row per fold
    pooled = roc_auc(scores, label, "score").first()
    folds = [{"fold": k, "rows": r["positives"] + r["negatives"], "auc": r["auc"], "rounds": fitted.best[k]} for k, r in sorted(each.items())]
    back = {x: c for c, x in names.items()}
    return scores, {"rows": sum(f["rows"] for f in folds), "width": len(names), "auc": pooled["auc"] if pooled else None, "folds": folds, "importance": [(back[c], w) for c, w in fitted.importance()]}


def choose(global_auc: float, regime_auc: float, margin: float = 2e-5) -> str:
    return "regime" if regime_auc >= global_auc + margin else "global"
