"""Model adapters of one shape: fit on train rows, score others. Boosted and fully random trees are this library's own;
the plain forest, the factorization machine and the network are MLlib's. None claims the numbers of another library."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.operators.blend import average_predictions
from sparkrank.operators.boosting import boosted_out_of_fold
from sparkrank.operators.random_trees import trees_out_of_fold
from sparkrank.operators.stack import logistic_out_of_fold, scaled
from sparkrank.plans.lineage import written

FOLD_STEP = 1009

#: Boosted trees: gaps stay gaps. Of these, the ones that read texts as ordered target statistics.
BOOSTED = ("gbt", "lightgbm", "xgboost", "catboost")
CATEGORICAL = ("catboost",)
#: Settings by the names that users of boosters know.
NAMES = {"n_estimators": "rounds", "iterations": "rounds", "max_depth": "depth", "learning_rate": "rate", "early_stopping_rounds": "patience", "subsample": "row_share", "colsample_bytree": "column_share", "reg_lambda": "ridge", "l2_leaf_reg": "ridge", "max_bin": "bins", "min_child_samples": "least", "min_samples_leaf": "least"}


@dataclass
class Experiment:
    """One line of work: a model over a view, repeated over seeds."""

    name: str
    model: str
    view: str = "engineered"
    seeds: tuple[int, ...] = (42,)
    params: dict = field(default_factory=dict)


def _estimator(model: str, params: dict, seed: int, width: int):
    common = {"featuresCol": "_x", "labelCol": "_y"}
    if model == "forest":
        return RandomForestClassifier(**common, seed=seed, **({"numTrees": 50, "maxDepth": 8} | params))
    if model == "factorization":
        return FMClassifier(**common, seed=seed, **({"factorSize": 4, "maxIter": 30, "stepSize": 0.05} | params))
    if model == "network":
        return MultilayerPerceptronClassifier(**common, seed=seed, **({"layers": [width, 32, 2], "maxIter": 50} | params))
    raise ValueError(f"unknown model {model}")


def available(model: str) -> bool:
    if model in BOOSTED or model in ("extra_trees", "logistic"):
        return True
    try:
        _estimator(model, {}, 0, 1)
    except ValueError:
        return False
    return True


def fit_predict(model: str, train: DataFrame, others: list[DataFrame], keys: list[str], columns: list[str], label: str, params: dict | None = None, seed: int = 42):
    """Scores of each table in ``others``, and (column, importance), the largest first. Columns must have no gaps."""
    if model in ("factorization", "network"):
        train, *others = scaled(train, others, columns)
    spread = VectorAssembler(inputCols=columns, outputCol="_x")
    ready = spread.transform(train.select(*columns, F.col(label).cast("double").alias("_y"))).select("_x", "_y")
    fitted = _estimator(model, params or {}, seed, len(columns)).fit(ready)
    scores = [fitted.transform(spread.transform(df.select(*keys, *columns))).select(*keys, F.get(vector_to_array("probability"), 1).alias("score")) for df in others]
    if hasattr(fitted, "featureImportances"):
        weights = fitted.featureImportances.toArray()
    else:
        weights = [0.0] * len(columns)
    return scores, sorted(zip(columns, map(float, weights), strict=True), key=lambda r: (-r[1], r[0]))


def _own_trees(experiment: Experiment, train: DataFrame, test: DataFrame | None, id_col: str, columns: list[str], label: str, fold: str) -> tuple[DataFrame, DataFrame | None, list[tuple[str, float]]]:
    """All folds of a seed in one fit; texts among the columns are categories."""
    kinds, params = dict(train.dtypes), {NAMES.get(k, k): v for k, v in experiment.params.items()}
    texts = [c for c in columns if kinds[c] == "string"]
    numbers = [c for c in columns if c not in texts]
    parts, test_parts, weights = [], [], {}
    for seed in experiment.seeds:
        if experiment.model == "extra_trees":
            if texts:
                raise ValueError(f"random trees need numbers, not {texts}")
            oof, scores, fitted = trees_out_of_fold(train, test, id_col, numbers, label, fold, params, seed)
        else:
            oof, scores, fitted = boosted_out_of_fold(train, test, id_col, numbers, label, fold, texts, params, seed)
        parts.append(oof)
        test_parts += [scores] if scores is not None else []
        for c, w in fitted.importance():
            c = c.removesuffix("__ts") if c not in columns else c
            weights[c] = weights.get(c, 0.0) + w / len(experiment.seeds)
    union = lambda dfs: average_predictions(reduce(DataFrame.unionByName, dfs), [id_col])
    return union(parts), union(test_parts) if test_parts else None, sorted(weights.items(), key=lambda r: (-r[1], r[0]))


def out_of_fold(experiment: Experiment, train: DataFrame, test: DataFrame | None, id_col: str, columns: list[str], label: str, fold: str = "fold") -> tuple[DataFrame, DataFrame | None, list[tuple[str, float]]]:
    """Out-of-fold scores of ``train`` (mean over seeds), scores of ``test`` (mean over seeds and folds) and mean
    importances. One fit per seed and fold, or for this library's own trees one per seed. Only those take gaps (boosted ones)."""
    train = written(train.select(id_col, label, fold, *columns), "train")
    if experiment.model in BOOSTED or experiment.model == "extra_trees":
        return _own_trees(experiment, train, test, id_col, columns, label, fold)
    if experiment.model == "logistic":  # no draws: seeds change nothing
        oof, scores, weights = logistic_out_of_fold(train, test, id_col, columns, label, fold, float(experiment.params.get("C", 1.0)))
        return oof, scores, sorted(weights, key=lambda r: (-r[1], r[0]))
    folds = sorted(r[fold] for r in train.select(fold).distinct().collect())  # a row per fold
    valid_parts, test_parts, weights = [], [], {}
    for seed in experiment.seeds:
        for k in folds:
            others = [train.where(F.col(fold) == k), *([test] if test is not None else [])]
            scores, found = fit_predict(experiment.model, train.where(F.col(fold) != k), others, [id_col], columns, label, experiment.params, seed + FOLD_STEP * k)
            valid_parts.append(scores[0])
            test_parts += scores[1:]
            for c, w in found:
                weights[c] = weights.get(c, 0.0) + w / (len(folds) * len(experiment.seeds))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return average_predictions(out, [id_col])

    return union(valid_parts), union(test_parts) if test_parts else None, sorted(weights.items(), key=lambda r: (-r[1], r[0]))


def adversarial_scores(train: DataFrame, test: DataFrame, id_col: str, columns: list[str], rows: int | None = 100_000, folds: int = 3, seed: int = 42) -> DataFrame:
    """(id, came_from_test, score): out-of-fold scores of a forest that tells test rows from train rows, over at most
    ``rows`` of each (None: all). An AUC near one half says that they are alike."""
    from sparkrank.operators.folds import exact_sample, stratified_folds

    own = [df.select(id_col, *columns) for df in (train, test)]
    parts = [(df if rows is None else exact_sample(df, id_col, rows, seed)).withColumn("came_from_test", F.lit(k)) for k, df in enumerate(own)]
    both = stratified_folds(parts[0].unionByName(parts[1]), id_col, "came_from_test", folds, seed)
    scores, _, _ = out_of_fold(Experiment("adversarial", "forest", seeds=(seed,)), both, None, id_col, columns, "came_from_test")
    return both.select(id_col, "came_from_test").join(scores, id_col)
