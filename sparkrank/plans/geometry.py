"""Budget geometry: what the hours of a day allow, as 31 values with a validity flag each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrank.plans.views import COMPONENTS, NOTIFICATIONS, OPENS, SCREEN, SLEEP, WEEKEND

LEAST = 1e-4


def _quotient(a: Column, b: Column, valid: Column) -> Column:
    return F.when(valid, a / F.when(F.abs(b) > LEAST, b).otherwise(1.0)).otherwise(0.0)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def geometry(max_daily: float) -> dict[str, tuple[Column, Column]]:
    """name -> (value, valid): values are 0 where they aren't valid."""
    raw = {c: F.col(c).cast("double") for c in (SCREEN, *COMPONENTS, SLEEP, NOTIFICATIONS, OPENS, WEEKEND)}
    seen = {c: x.isNotNull() for c, x in raw.items()}
    x = {c: F.coalesce(v, F.lit(0.0)) for c, v in raw.items()}
    always = F.lit(True)
    day, day_seen = x[SCREEN], seen[SCREEN]
    parts, parts_seen = [x[c] for c in COMPONENTS], [seen[c] for c in COMPONENTS]
    total, many = _sum(parts), _sum([s.cast("double") for s in parts_seen])
    whole = many == 3
    upper = F.when(day_seen, day).otherwise(F.lit(float(max_daily)))
    both_days = seen[WEEKEND] & day_seen
    out: dict[str, tuple[Column, Column]] = {
        "component_sum": (total, always),
        "component_count": (many, always),
        "known_lower": (total, always),
        "daily_upper": (upper, always),
        "daily_width": (F.greatest(upper - total, F.lit(0.0)), always),
        "capacity": (F.when(day_seen, F.greatest(day - total, F.lit(0.0))).otherwise(0.0), day_seen),
        "component_ratio": (_quotient(total, day, day_seen & (F.abs(day) > LEAST)), day_seen),
        "components_complete": (whole.cast("double"), always),
        "strict_sum": (F.when(whole, total).otherwise(0.0), whole),
        "other_screen": (F.when(day_seen & whole, day - total).otherwise(0.0), day_seen & whole),
        "weekend_less_daily": (F.when(both_days, x[WEEKEND] - day).otherwise(0.0), both_days),
        "weekend_less_components": (F.when(seen[WEEKEND], x[WEEKEND] - total).otherwise(0.0), seen[WEEKEND]),
        "notifications_per_open": (_quotient(x[NOTIFICATIONS], x[OPENS] + 1.0, seen[NOTIFICATIONS] & seen[OPENS]), seen[NOTIFICATIONS] & seen[OPENS]),
    }
    bounds = [F.when(day_seen, F.greatest(day - (total - p), F.lit(0.0))).otherwise(0.0) for p in parts]
    for k, b in enumerate(bounds):
        out[f"upper_{k}"] = b, day_seen
    for k, (b, s) in enumerate(zip(bounds, parts_seen, strict=True)):
        out[f"width_{k}"] = F.when(day_seen & ~s, b).otherwise(0.0), day_seen & ~s
    names = [SCREEN, *COMPONENTS, WEEKEND]
    n = _sum([seen[c].cast("double") for c in names])
    some, at_least_one = n > 0, F.greatest(n, F.lit(1.0))
    mean = _sum([x[c] for c in names]) / at_least_one
    spread = F.sqrt(_sum([F.when(seen[c], (x[c] - mean) * (x[c] - mean)).otherwise(0.0) for c in names]) / at_least_one)
    least, most = (F.coalesce(f(*[raw[c] for c in names]), F.lit(0.0)) for f in (F.least, F.greatest))  # both skip NULL
    out |= {"screen_count": (n, always), "screen_sum": (_sum([x[c] for c in names]), some), "screen_mean": (mean, some), "screen_std": (spread, some), "screen_min": (least, some), "screen_max": (most, some), "screen_range": (most - least, some)}
    for k, (p, s) in enumerate(zip(parts, parts_seen, strict=True)):
        out[f"share_{k}"] = _quotient(p, day, day_seen & s), day_seen & s
    out["weekend_share"] = _quotient(x[WEEKEND], day, both_days), both_days
    out["daily_and_sleep"] = F.when(day_seen & seen[SLEEP], day + x[SLEEP]).otherwise(0.0), day_seen & seen[SLEEP]
    return out


def budget_geometry(df: DataFrame, keys: list[str], max_daily: float) -> DataFrame:
    cells = geometry(max_daily)
    return df.select(*keys, *[v.alias(n) for n, (v, _) in cells.items()], *[ok.alias(f"{n}_valid") for n, (_, ok) in cells.items()])


def masked_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, scale) over valid cells; the scale is their population deviation, 1 if that is next to 0."""
    rows = [F.struct(F.lit(c).alias("column"), F.coalesce(F.avg(F.when(F.col(f"{c}_valid"), F.col(c))), F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.stddev_pop(F.when(F.col(f"{c}_valid"), F.col(c))) > 1e-6, F.stddev_pop(F.when(F.col(f"{c}_valid"), F.col(c)))), F.lit(1.0)).alias("scale")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def cell_sources(names: list[str]) -> dict[str, list[str]]:
    """Which raw columns each value of :func:`geometry` is made of."""
    screens, day = [SCREEN, *COMPONENTS, WEEKEND], [SCREEN, *COMPONENTS]
    known = {n: list(COMPONENTS) for n in ("component_sum", "component_count", "known_lower", "components_complete", "strict_sum")}
    known |= {"weekend_less_daily": [SCREEN, WEEKEND], "weekend_share": [SCREEN, WEEKEND], "weekend_less_components": [*COMPONENTS, WEEKEND], "daily_and_sleep": [SCREEN, SLEEP], "notifications_per_open": [NOTIFICATIONS, OPENS]}
    known |= {f"share_{k}": [SCREEN, c] for k, c in enumerate(COMPONENTS)}
    return {n: known.get(n, screens if n.startswith("screen_") else day) for n in names}
