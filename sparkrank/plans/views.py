"""Feature views: named sets of columns derived from a table in one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.functions import scalar as S
from sparkrank.operators.audit import numeric_columns

# Names of the inputs that the derived columns use.
AGE, SCREEN, SOCIAL, GAMING, WORK, SLEEP = "age", "daily_screen_time_hours", "social_media_hours", "gaming_hours", "work_study_hours", "sleep_hours"
NOTIFICATIONS, OPENS, WEEKEND = "notifications_per_day", "app_opens_per_day", "weekend_screen_time"
STRESS, IMPACT = "stress_level", "academic_work_impact"
COMPONENTS = [SOCIAL, GAMING, WORK]
VIEWS = {
    "raw": (),
    "engineered": ("engineered",),
    "artifact": ("artifact",),
    "engineered_artifact": ("engineered", "artifact"),
    "artifact_cat": ("artifact", "levels"),
    "engineered_artifact_cat": ("engineered", "artifact", "levels"),
    "raw_parent": ("parent",),
    "engineered_parent": ("engineered", "parent"),
}


def feature_columns(df: DataFrame, id_col: str, target: str, drop: list[str] | None = None, use_id: bool = False) -> list[str]:
    unknown = sorted(set(drop or []) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns to drop: {unknown}")
    out = [c for c in df.columns if c != target and c not in (drop or []) and (use_id or c != id_col)]
    if not out:
        raise ValueError("no feature columns are left")
    return out


def _derived() -> list[tuple[str, tuple[str, ...], Column]]:
    """(name, the inputs it needs, the expression); a column is derived only from inputs that are there."""
    c = {n: F.col(n) for n in (SCREEN, SOCIAL, GAMING, WORK, SLEEP, NOTIFICATIONS, OPENS, WEEKEND, STRESS, IMPACT)}
    ratio = lambda name, a, b: (name, (a, b), S.safe_divide(c[a], c[b]))
    square = lambda name, a: (name, (a,), c[a] * c[a])
    logs = lambda name, a: (name, (a,), S.log1p_clipped(c[a]))
    yes, stress = S.yes_flag(c[IMPACT]), S.ordinal(c[STRESS], ("low", "medium", "high"))
    known = c[SOCIAL] + c[GAMING] + c[WORK]
    return [
        ratio("social_ratio", SOCIAL, SCREEN),
        ratio("gaming_ratio", GAMING, SCREEN),
        ratio("work_ratio", WORK, SCREEN),
        ratio("weekend_ratio", WEEKEND, SCREEN),
        ratio("screen_per_sleep_hour", SCREEN, SLEEP),
        ratio("notifications_per_hour", NOTIFICATIONS, SCREEN),
        ratio("app_opens_per_hour", OPENS, SCREEN),
        ratio("notifications_per_open", NOTIFICATIONS, OPENS),
        ("screen_per_awake_hour", (SCREEN, SLEEP), S.safe_divide(c[SCREEN], 24.0 - c[SLEEP])),
        ("leisure_hours", (SOCIAL, GAMING), c[SOCIAL] + c[GAMING]),
        ("social_minus_gaming", (SOCIAL, GAMING), c[SOCIAL] - c[GAMING]),
        ("known_usage_hours", tuple(COMPONENTS), known),
        ("other_screen_time", (*COMPONENTS, SCREEN), c[SCREEN] - known),
        ("weekend_delta", (WEEKEND, SCREEN), c[WEEKEND] - c[SCREEN]),
        ("sleep_deficit", (SLEEP,), 8.0 - c[SLEEP]),
        ("screen_sleep_sum", (SCREEN, SLEEP), c[SCREEN] + c[SLEEP]),
        ("screen_sleep_product", (SCREEN, SLEEP), c[SCREEN] * c[SLEEP]),
        ("digital_interruptions", (NOTIFICATIONS, OPENS), c[NOTIFICATIONS] + c[OPENS]),
        ("non_work_screen_hours", (WORK, SCREEN), c[SCREEN] - c[WORK]),
        ("screen_minus_work", (WORK, SCREEN), c[SCREEN] - c[WORK]),
        square("screen_time_squared", SCREEN),
        square("weekend_time_squared", WEEKEND),
        square("social_time_squared", SOCIAL),
        square("gaming_time_squared", GAMING),
        logs("log1p_screen_time", SCREEN),
        logs("log1p_notifications", NOTIFICATIONS),
        logs("log1p_app_opens", OPENS),
        ("impact_yes_x_screen", (IMPACT, SCREEN), yes * c[SCREEN]),
        ("impact_yes_x_work", (IMPACT, WORK), yes * c[WORK]),
        ("stress_x_sleep_deficit", (STRESS, SLEEP), stress * (8.0 - c[SLEEP])),
        ("stress_x_screen", (STRESS, SLEEP, SCREEN), stress * c[SCREEN]),
    ]


def engineered(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    numbers = numeric_columns(df, columns)
    texts = [c for c in columns if c not in numbers]
    missing = S.count_missing([F.col(c) for c in columns])
    out = {
        "missing_count": missing.cast("double"),
        "missing_fraction": missing / float(max(1, len(columns))),
        "numeric_missing_count": S.count_missing([F.col(c) for c in numbers]).cast("double"),
        "categorical_missing_count": S.count_missing([F.col(c) for c in texts]).cast("double"),
    }
    return out | {name: x for name, needs, x in _derived() if set(needs) <= set(columns)}


def artifacts(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Digits and fractions of the hour columns, and what the components leave of the screen time."""
    out: dict[str, Column] = {}
    for c in (c for c in (SCREEN, *COMPONENTS, SLEEP, WEEKEND) if c in columns):
        x = F.col(c)
        out |= {f"{c}__first_decimal_digit": S.first_decimal(x), f"{c}__decimal_length": S.decimal_length(x), f"{c}__fractional_part": S.fraction(x)}
    if {SCREEN, *COMPONENTS} <= set(columns):
        parts = reduce(lambda a, b: a + b, [F.col(c) for c in COMPONENTS])
        residual = F.col(SCREEN) - parts
        out |= {
            "screen_component_residual": residual,
            "abs_screen_component_residual": F.abs(residual),
            "screen_components_exceed_daily": (residual < 0).cast("double"),
            "screen_component_share": S.safe_divide(parts, F.col(SCREEN)),
        }
    return out


def exact_levels(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {f"{c}__exact_level": S.exact_level(F.col(c)) for c in numeric_columns(df, columns)}


def view(df: DataFrame, name: str, keys: list[str], columns: list[str], parent: DataFrame | None = None, **parent_options) -> DataFrame:
    """``keys``, the columns and what the view adds. Parent views take ``parent`` and the options of
    :func:`sparkrank.operators.knn.parent_features`."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name}; there are {sorted(VIEWS)}")
    steps = VIEWS[name]
    added: dict[str, Column] = {}
    for step, make in (("engineered", engineered), ("artifact", artifacts), ("levels", exact_levels)):
        if step in steps:
            added |= make(df, columns)
    out = df.select(*keys, *columns, *[x.alias(n) for n, x in added.items()])
    if "parent" in steps:
        from sparkrank.operators.knn import parent_features

        if parent is None:
            raise ValueError(f"view {name} needs a parent table")
        near = parent_features(df.select(*keys, *columns), parent, keys[0], columns=columns, **parent_options)
        out = out.join(near.drop(*keys[1:], *columns), keys[0])
    return out


def matrix_inputs(df: DataFrame) -> DataFrame:
    """Sums, fractions (denominators of at least 0.1) and differences for factorisation models."""
    x = {n: F.col(n).cast("double") for n in (SCREEN, *COMPONENTS, WEEKEND, NOTIFICATIONS, OPENS)}
    total = reduce(lambda a, b: a + b, [x[c] for c in COMPONENTS])
    other, floor = x[SCREEN] - total, F.when(x[SCREEN].isNotNull(), F.greatest(x[SCREEN], F.lit(0.1)))
    return df.select("*", other.alias("fm_other_screen"), total.alias("fm_component_sum"), (other / floor).alias("fm_other_fraction"), (total / floor).alias("fm_component_fraction"), (x[WEEKEND] - total).alias("fm_weekend_minus_components"), (x[WEEKEND] - other).alias("fm_weekend_minus_other"), (x[WEEKEND] - x[SCREEN]).alias("fm_weekend_minus_daily"), S.safe_divide(x[NOTIFICATIONS], x[OPENS] + 1.0).alias("fm_notifications_per_open"))
