"""Writers. What goes out is checked first."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.operators.align import finite_report, key_alignment, require, uncovered


def write_predictions(df: DataFrame, path: str, split: str, model: str, id_col: str, score: str = "score") -> None:
    """(id, score) of one model and split, in directories by split and model; writing again replaces that one only."""
    require(finite_report(df, [score]), f"scores of {model}")
    out = df.select(F.col(id_col), F.col(score).cast("double").alias("score"), F.lit(split).alias("split"), F.lit(model).alias("model"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "model").parquet(path)


def write_folds(df: DataFrame, path: str, id_col: str, label: str, fold: str = "fold") -> None:
    require(uncovered(df, fold), "folds")
    df.select(id_col, label, F.col(fold).cast("int").alias("fold")).write.mode("overwrite").parquet(path)


def submission(scores: DataFrame, template: DataFrame, id_col: str, target: str, score: str = "score") -> DataFrame:
    """The template's ids with their scores; refused unless ids are the same and scores are finite in [0, 1]."""
    require(key_alignment(scores, template, id_col), "ids of the submission")
    out = template.select(*[c for c in template.columns if c != target]).join(scores.select(id_col, F.col(score).alias(target)), id_col)
    require(finite_report(out, [target], 0.0, 1.0), "scores of the submission")
    return out


def write_submission(scores: DataFrame, template: DataFrame, path: str, id_col: str, target: str, score: str = "score", row: str = "row_pos") -> None:
    """One delimited file in the template's order; a submission is as small as its test table's two columns."""
    out = submission(scores, template, id_col, target, score)
    ordered = out.orderBy(row) if row in out.columns else out.orderBy(id_col)
    ordered.select(id_col, target).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def plain(x):
    """Numbers of array libraries as Python's own, through lists and maps."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.item() if hasattr(x, "item") else x


def write_json(path: str, payload) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(payload), indent=2, sort_keys=True) + "\n")
