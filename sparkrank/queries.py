"""The query catalogue: each operator of the engine over the supplied tables, with SQL of the same meaning.

SQL is written independently of the engine: plain windows where the engine bins, loops over nothing, one
statement each. Floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.fixtures import HABIT_NUMBERS, HABITS, MODELS, OBS_SQL, habits, obs, table, train
from sparkrank.functions import scalar as S
from sparkrank.operators import align, audit, blend, cross_net, encode, folds, knn, models, ordered, rank_fm, ranking, stack
from sparkrank.plans import geometry, lineage, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = f"with {OBS_SQL} {sql}" if not sql.lstrip().startswith("with ") else f"with {OBS_SQL}, {sql.lstrip()[5:]}"
        return fn

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def counted(df: DataFrame) -> DataFrame:
    return df.select([F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


# --- scalar expressions and feature views -------------------------------------------------------------------------


@query("select id, round(case when abs(x4) > 1e-6 then x1 / x4 end, 6) as a, round(case when abs(x3) > 1e-6 then x2 / x3 end, 6) as b from obs")
def safe_divide_ratios(spark, sf):
    d = obs(spark, sf, lines=True)
    return rounded(d.select("id", S.safe_divide(F.col("x1"), F.col("x4")).alias("a"), S.safe_divide(F.col("x2"), F.col("x3")).alias("b")), "a", "b")


@query("select id, round(x1 + x4, 4) as total, round(x1 - x4, 4) as gap, round(x2 * x2, 4) as square, round(x1 * x2, 4) as product from obs")
def interaction_features(spark, sf):
    d = obs(spark, sf, lines=True)
    x1, x2, x4 = map(F.col, ("x1", "x2", "x4"))
    return rounded(d.select("id", (x1 + x4).alias("total"), (x1 - x4).alias("gap"), (x2 * x2).alias("square"), (x1 * x2).alias("product")), "total", "gap", "square", "product", digits=4)


@query("select id, round(ln(1 + greatest(x1 - 150000, 0)), 6) as v from obs where x1 is not null union all select id, null from obs where x1 is null")
def log1p_clip(spark, sf):
    return rounded(obs(spark, sf).select("id", S.log1p_clipped(F.col("x1") - 150000).alias("v")), "v")


@query("select id, round((case when lower(academic_work_impact) in ('yes', '1', 'true') then 1.0 else 0.0 end) * daily_screen_time_hours, 6)::double as v from habits")
def yes_flag_product(spark, sf):
    return rounded(habits(spark, sf).select("id", (S.yes_flag(F.col("academic_work_impact")) * F.col("daily_screen_time_hours")).alias("v")), "v")


@query("select id, case lower(stress_level) when 'low' then 0.0 when 'medium' then 1.0 when 'high' then 2.0 end::double as v from habits")
def ordinal_map(spark, sf):
    return habits(spark, sf).select("id", S.ordinal(F.col("stress_level"), ("low", "medium", "high")).alias("v"))


_MISS = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in HABITS)
_MISS_N = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in HABIT_NUMBERS)


@query(f"select id, ({_MISS})::bigint as n, ({_MISS_N})::bigint as n_numeric, round(({_MISS}) / 12.0, 6)::double as share from habits")
def missing_counts(spark, sf):
    n = S.count_missing([F.col(c) for c in HABITS])
    return habits(spark, sf).select("id", n.cast("long").alias("n"), S.count_missing([F.col(c) for c in HABIT_NUMBERS]).cast("long").alias("n_numeric"), F.round(n / 12.0, 6).alias("share"))


@query("select id, (" + " + ".join(f"(case when {c} is null then {1 << k} else 0 end)" for k, c in enumerate(HABITS)) + ")::bigint as pattern from habits")
def missing_pattern_bitmask(spark, sf):
    return habits(spark, sf).select("id", S.missing_pattern([F.col(c) for c in HABITS]).alias("pattern"))


@query(f"""with b as (select h.id, h.y, case when ({_MISS}) = 0 then '0' when ({_MISS}) <= 3 then '1-3' else '4+' end as bucket, o.m1 as s from habits h join obs o on h.id = o.id),
g as (select bucket, s, sum(y) as p, sum(1 - y) as n from b group by bucket, s),
w as (select *, coalesce(sum(n) over (partition by bucket order by s rows between unbounded preceding and 1 preceding), 0) as nb from g)
select bucket, round(cast(sum(p * (nb + n / 2.0)) as double) / cast(sum(p) * sum(n) as double), 6) as auc, sum(p)::bigint as positives, sum(n)::bigint as negatives from w group by bucket""")
def missing_bucket_auc(spark, sf):
    b = habits(spark, sf).select("id", S.missing_bucket(S.count_missing([F.col(c) for c in HABITS])).alias("bucket"))
    return rounded(ranking.roc_auc(obs(spark, sf).select("id", "y", "m1").join(b, "id"), "y", "m1", ["bucket"]), "auc")


@query("""select event_id, cast(cast(floor(round_even(abs(value) * 100, 0) / 10) as bigint) % 10 as varchar) as digit,
case when round_even(abs(value) * 100, 0) % 10 = 0 then '1' else '2' end as length, round(abs(value) - floor(abs(value)), 6) as fraction from events""")
def decimal_artifacts(spark, sf):
    v = F.col("value")
    return rounded(table(spark, sf, "events").select("event_id", S.first_decimal(v).alias("digit"), S.decimal_length(v).alias("length"), S.fraction(v).alias("fraction")), "fraction")


@query("""select id, round(r, 6) as residual, round(abs(r), 6) as size, case when r is null then null when round(r, 9) < 0 then 1.0 else 0.0 end::double as exceeds, round(case when abs(d) > 1e-6 then p / d end, 6) as share
from (select id, daily_screen_time_hours as d, social_media_hours + gaming_hours + work_study_hours as p, daily_screen_time_hours - (social_media_hours + gaming_hours + work_study_hours) as r from habits)""")
def component_residual(spark, sf):
    h = habits(spark, sf)
    a = views.artifacts(h, HABITS)
    r = a["screen_component_residual"]
    return h.select("id", F.round(r, 6).alias("residual"), F.round(a["abs_screen_component_residual"], 6).alias("size"), (F.round(r, 9) < 0).cast("double").alias("exceeds"), F.round(a["screen_component_share"], 6).alias("share"))


@query("select event_id, cast(value as double) as level from events")
def exact_level(spark, sf):
    # Engines write exponents differently, so levels are compared as the numbers they spell.
    return table(spark, sf, "events").select("event_id", S.exact_level(F.col("value")).cast("double").alias("level"))


def _ratio(a: str, b: str) -> str:
    return f"case when abs({b}) > 1e-6 then {a} / ({b}) end"


_H = {"d": "daily_screen_time_hours", "s": "social_media_hours", "g": "gaming_hours", "w": "work_study_hours", "sl": "sleep_hours", "n": "notifications_per_day", "o": "app_opens_per_day", "we": "weekend_screen_time"}
_YES = "(case when lower(academic_work_impact) in ('yes', '1', 'true') then 1 else 0 end)"
_STRESS = "(case lower(stress_level) when 'low' then 0 when 'medium' then 1 when 'high' then 2 end)"
_ENGINEERED_SQL = {
    "missing_count": f"({_MISS})", "missing_fraction": f"({_MISS}) / cast(12 as double)", "numeric_missing_count": f"({_MISS_N})", "categorical_missing_count": f"({_MISS}) - ({_MISS_N})",
    "social_ratio": _ratio("s", "d"), "gaming_ratio": _ratio("g", "d"), "work_ratio": _ratio("w", "d"), "weekend_ratio": _ratio("we", "d"), "screen_per_sleep_hour": _ratio("d", "sl"),
    "notifications_per_hour": _ratio("n", "d"), "app_opens_per_hour": _ratio("o", "d"), "notifications_per_open": _ratio("n", "o"), "screen_per_awake_hour": _ratio("d", "24 - sl"),
    "leisure_hours": "s + g", "social_minus_gaming": "s - g", "known_usage_hours": "s + g + w", "other_screen_time": "d - (s + g + w)", "weekend_delta": "we - d", "sleep_deficit": "8 - sl",
    "screen_sleep_sum": "d + sl", "screen_sleep_product": "d * sl", "digital_interruptions": "n + o", "non_work_screen_hours": "d - w", "screen_minus_work": "d - w",
    "screen_time_squared": "d * d", "weekend_time_squared": "we * we", "social_time_squared": "s * s", "gaming_time_squared": "g * g",
    "log1p_screen_time": "ln(1 + d)", "log1p_notifications": "ln(1 + n)", "log1p_app_opens": "ln(1 + o)",
    "impact_yes_x_screen": f"{_YES} * d", "impact_yes_x_work": f"{_YES} * w", "stress_x_sleep_deficit": f"{_STRESS} * (8 - sl)", "stress_x_screen": f"case when sl is null then {_STRESS} * d else {_STRESS} * d end",
}
_RENAMED = "(select *, " + ", ".join(f"{v} as {k}" for k, v in _H.items()) + " from habits)"


@query("select id, " + ", ".join(f"round(cast({x} as double), 6) as {n}" for n, x in _ENGINEERED_SQL.items()) + f" from {_RENAMED}")
def feature_view_engineered(spark, sf):
    v = views.view(habits(spark, sf), "engineered", ["id"], HABITS)
    return rounded(v.select("id", *_ENGINEERED_SQL), *_ENGINEERED_SQL)


_ARTIFACT_SQL = {f"{v}__first_decimal_digit": f"cast(cast(floor(round_even(abs({v}) * 100, 0) / 10) as bigint) % 10 as varchar)" for v in (_H["d"], _H["sl"])} | {f"{_H['g']}__decimal_length": f"case when {_H['g']} is null then null when round_even(abs({_H['g']}) * 100, 0) % 10 = 0 then '1' else '2' end", "age__exact_level": "cast(age as varchar)"}


@query("select id, " + ", ".join(f"{x} as {n}" for n, x in _ARTIFACT_SQL.items()) + ", round(d / sl, 6) as screen_per_sleep_hour, round(d - (s + g + w), 6) as screen_component_residual" + f" from {_RENAMED}")
def feature_view_engineered_artifact(spark, sf):
    v = views.view(habits(spark, sf), "engineered_artifact_cat", ["id"], HABITS)
    return rounded(v.select("id", *_ARTIFACT_SQL, "screen_per_sleep_hour", "screen_component_residual"), "screen_per_sleep_hour", "screen_component_residual")


_PARTS = ["social_media_hours", "gaming_hours", "work_study_hours"]


@query("""with g as (select id, d, we, n, o, sl, s, g, w, coalesce(s, 0) as es, coalesce(g, 0) as eg, coalesce(w, 0) as ew,
  coalesce(s, 0) + coalesce(g, 0) + coalesce(w, 0) as total, (s is not null)::int + (g is not null)::int + (w is not null)::int as many, list_filter([d, s, g, w, we], lambda v: v is not null) as seen from """ + _RENAMED + """)
select id, round(total, 6) as component_sum, many::double as component_count, round(coalesce(d, 15), 6) as daily_upper, round(greatest(coalesce(d, 15) - total, 0), 6) as daily_width,
  round(case when d is null then 0 else greatest(d - total, 0) end, 6) as capacity, round(case when d is null then 0 when abs(d) <= 1e-4 then 0 else total / d end, 6) as component_ratio,
  round(case when many = 3 and d is not null then d - total else 0 end, 6) as other_screen, round(case when d is not null and we is not null then we - d else 0 end, 6) as weekend_less_daily,
  round(case when n is not null and o is not null then n / (o + 1) else 0 end, 6) as notifications_per_open,
  round(case when d is null then 0 else greatest(d - (total - es), 0) end, 6) as upper_0, round(case when d is not null and g is null then greatest(d - (total - eg), 0) else 0 end, 6) as width_1,
  len(seen)::double as screen_count, round(coalesce(list_avg(seen), 0), 6) as screen_mean, round(coalesce(list_stddev_pop(seen), 0), 6) as screen_std, round(coalesce(list_min(seen), 0), 6) as screen_min, round(coalesce(list_max(seen), 0), 6) as screen_max,
  (d is not null and w is null) as width_2_valid, (len(seen) > 0) as screen_std_valid from g""")
def budget_geometry(spark, sf):
    out = geometry.budget_geometry(habits(spark, sf), ["id"], 15.0)
    values = ["component_sum", "component_count", "daily_upper", "daily_width", "capacity", "component_ratio", "other_screen", "weekend_less_daily", "notifications_per_open", "upper_0", "width_1", "screen_count", "screen_mean", "screen_std", "screen_min", "screen_max"]
    return rounded(out.select("id", *values, "width_2_valid", "screen_std_valid"), *values)


@query("""with v as (select d as capacity from """ + _RENAMED + """ where d is not null), c as (select greatest(d - (coalesce(s, 0) + coalesce(g, 0) + coalesce(w, 0)), 0) as x from """ + _RENAMED + """ where d is not null),
q as (select s / (case when abs(d) > 1e-4 then d else 1 end) as x from """ + _RENAMED + """ where d is not null and s is not null)
select 'capacity' as "column", round(avg(x), 6) as mean, round(stddev_pop(x), 6) as scale from c union all select 'share_0', round(avg(x), 6), round(stddev_pop(x), 6) from q""")
def masked_scaler(spark, sf):
    return rounded(geometry.masked_scaler(geometry.budget_geometry(habits(spark, sf), ["id"], 15.0), ["capacity", "share_0"]), "mean", "scale")


@query("""select id, round(d - p, 6) as fm_other_screen, round(p, 6) as fm_component_sum, round((d - p) / f, 6) as fm_other_fraction, round(p / f, 6) as fm_component_fraction, round(we - p, 6) as fm_weekend_minus_components,
round(we - (d - p), 6) as fm_weekend_minus_other, round(we - d, 6) as fm_weekend_minus_daily, round(n / (o + 1), 6) as fm_notifications_per_open from (select *, s + g + w as p, case when d is not null then greatest(d, 0.1) end as f from """ + _RENAMED + """)""")
def fm_derived(spark, sf):
    names = ["fm_other_screen", "fm_component_sum", "fm_other_fraction", "fm_component_fraction", "fm_weekend_minus_components", "fm_weekend_minus_other", "fm_weekend_minus_daily", "fm_notifications_per_open"]
    return rounded(views.matrix_inputs(habits(spark, sf)).select("id", *names), *names)


@query("select event_id, round_even(value * 10, 0) / 10 as value_r1 from events")
def coarse_round(spark, sf):
    return encode.coarse(table(spark, sf, "events").select("event_id", "value"), ["value"]).select("event_id", "value_r1")


@query("select id, round(ln(p) - ln(1 - p), 6) as z from (select id, least(greatest(m1 - 0.2, 1e-6), 1 - 1e-6) as p from obs)")
def logit_clip(spark, sf):
    return rounded(obs(spark, sf).select("id", S.logit(F.col("m1") - 0.2).alias("z")), "z")


@query("select id, round(1 / (1 + exp(-(40 * m1 - 20))), 6) as p from obs")
def stable_sigmoid(spark, sf):
    return rounded(obs(spark, sf).select("id", S.sigmoid(40 * F.col("m1") - 20).alias("p")), "p")


@query("select id, (age is null or daily_screen_time_hours is null) as a, (sleep_hours is null) as b from habits")
def hidden_dependencies(spark, sf):
    found = S.any_hidden({c: F.col(c).isNull() for c in HABITS}, {"a": ["age", "daily_screen_time_hours"], "b": ["sleep_hours"]})
    return habits(spark, sf).select("id", *[x.alias(n) for n, x in found.items()])


@query("select id, sleep_hours, stress_level from habits")
def feature_selection(spark, sf):
    h = habits(spark, sf)
    keep = views.feature_columns(h, "id", "y", [c for c in h.columns if c not in ("id", "y", "sleep_hours", "stress_level")])
    return h.select("id", *keep)


# --- encoding -----------------------------------------------------------------------------------------------------


@query("select id, " + ", ".join(f"(case when c1 = '{v}' then 1.0 else 0.0 end)::double as c1__{n}" for v, n in (("1-URGENT", "1"), ("2-HIGH", "2"), ("3-MEDIUM", "3"), ("4-NOT SPECIFIED", "4"), ("5-LOW", "5"))) + ", (case when c1 is null then 1.0 else 0.0 end)::double as c1__nan from obs")
def one_hot_with_null(spark, sf):
    out = encode.encoded(obs(spark, sf).select("id", "split", "c1"), ["id"], ["c1"])
    return out.select("id", *[F.col(f"`{c}`").alias("c1__nan" if c.endswith("nan") else c[:5]) for c in out.columns[1:]])


@query("select id, (case when x1 is null then 1.0 else 0.0 end)::double as x1__missing, (case when x2 is null then 1.0 else 0.0 end)::double as x2__missing from obs")
def missing_indicators(spark, sf):
    return encode.encoded(obs(spark, sf, lines=True).select("id", "split", "x1", "x2"), ["id"], ["x1", "x2"]).select("id", "x1__missing", "x2__missing")


@query("select id, round(coalesce(x1, (select quantile_cont(x1, 0.5) from obs where split = 'train'), 0), 4) as x1, round(coalesce(x2, (select quantile_cont(x2, 0.5) from obs where split = 'train'), 0), 4) as x2 from obs")
def median_impute(spark, sf):
    return rounded(encode.encoded(obs(spark, sf, lines=True).select("id", "split", "x1", "x2"), ["id"], ["x1", "x2"]).select("id", "x1", "x2"), "x1", "x2", digits=4)


_LATTICE = "v as (select id, 'c1' as field, c1 as value from obs union all select id, 'brand', (select min(p_brand) from part where p_partkey = id % 200 + 1) from obs), n as (select field, value, count(*) as n from v where value is not null group by field, value having count(*) >= 30), k as (select *, row_number() over (partition by field order by n desc, value) + 1 as code from n)"


def _lattice_input(spark, sf):
    part = table(spark, sf, "part").groupBy("p_partkey").agg(F.min("p_brand").alias("brand"))
    d = obs(spark, sf).select("id", "c1").withColumn("_k", F.col("id") % 200 + 1)
    return d.join(part, F.col("_k") == F.col("p_partkey"), "left").select("id", "c1", "brand")


@query(f"with {_LATTICE} select v.id, v.field, (case when v.value is null then 0 else coalesce(k.code, 1) end)::bigint as code from v left join k on v.field = k.field and v.value = k.value")
def lattice_codes(spark, sf):
    return counted(encode.lattice_codes(_lattice_input(spark, sf), ["id"], ["c1", "brand"], 30))


@query(f"with {_LATTICE} select field, size, coalesce(sum(size) over (order by place rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from (select f.field, f.place, (count(k.value) + 2)::bigint as size from (select 'c1' as field, 0 as place union all select 'brand', 1) f left join k on f.field = k.field group by f.field, f.place)")
def vocab_offsets(spark, sf):
    return counted(encode.vocabulary_offsets(_lattice_input(spark, sf), ["c1", "brand"], 30))


def _polynomial(x: str, coefficients: list[float]) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::double))"
    return out


def _tail_sql(side: str) -> str:
    x = f"sqrt(-2 * ln({side}))"
    return f"{_polynomial(x, encode.TAIL_P)} / {_polynomial(x, encode.TAIL_Q)}"


_GAP = "(p - 0.5::double)"
_QUANTILE = f"case when p < {encode.TAIL} then {_tail_sql('p')} when p > {1 - encode.TAIL} then -({_tail_sql('(1 - p)')}) else {_GAP} * {_polynomial(f'({_GAP} * {_GAP})', encode.MIDDLE_P)} / {_polynomial(f'({_GAP} * {_GAP})', encode.MIDDLE_Q)} end"


@query(f"""with r as (select id, x1, rank() over (order by x1) + (count(*) over (partition by x1) - 1) / 2 as k, count(*) over () as n from obs where x1 is not null),
q as (select id, least(greatest((k - 0.5) / n, 1e-7::double), 1 - 1e-7::double)::double as p from r)
select id, round({_QUANTILE}, 6) as z from q union all select id, 0.0::double from obs where x1 is null""")
def rank_gauss(spark, sf):
    return rounded(encode.rank_gauss(obs(spark, sf).select("id", "x1"), "x1", "z").select("id", "z"), "z")


def _interpolated_sql(column: str) -> str:
    """id and the part of a column's values below each value, between a thousand quantiles of it."""
    t = f"_{column}"
    return f"""n{t} as (select least(1000, count({column})) as m, count({column}) as n from obs), r{t} as (select {column} as v, row_number() over (order by {column}) - 1 as k from obs where {column} is not null),
h{t} as (select i, (i * (n - 1)) // (m - 1) as k, (i * (n - 1)) % (m - 1) as f, m - 1 as w from range(1000) r(i), n{t} where i < m),
e{t} as (select i, a.v + (b.v - a.v) * (f / w) as q from h{t} h join r{t} a on a.k = h.k join r{t} b on b.k = h.k + case when f > 0 then 1 else 0 end), d{t} as (select q, min(i) as a, max(i) as b from e{t} group by q),
u{t} as (select o.id, o.{column} as v, d.q, d.a, d.b from obs o asof join d{t} d on o.{column} >= d.q),
p{t} as (select u.id, least(greatest(case when u.v + 1e-7 > (select max(q) from e{t}) then 1.0 when u.v - 1e-7 < (select min(q) from e{t}) then 0.0 when u.v = u.q then (u.a + u.b) / 2.0 / ((select m from n{t}) - 1) else (u.b + (u.v - u.q) / (x.q - u.q)) / ((select m from n{t}) - 1) end, 1e-7::double), 1 - 1e-7::double)::double as p
  from u{t} u left join d{t} x on x.a = u.b + 1)"""


@query(f"""with {_interpolated_sql('x1')}, {_interpolated_sql('m2')}, z1 as (select id, {_QUANTILE} as z from p_x1), z2 as (select id, {_QUANTILE} as z from p_m2)
select obs.id, round(coalesce(z1.z, 0), 5) as x1__gauss, round(coalesce(z2.z, 0), 5) as m2__gauss from obs left join z1 on z1.id = obs.id left join z2 on z2.id = obs.id""")
def quantile_gauss(spark, sf):
    d = encode.quantile_gauss(obs(spark, sf).select("id", "x1", "m2"), ["x1", "m2"])
    return rounded(d.select("id", "x1__gauss", "m2__gauss"), "x1__gauss", "m2__gauss", digits=5)


# --- ranks and AUC ------------------------------------------------------------------------------------------------


def _auc_sql(source: str, group: str, score: str, label: str = "y") -> str:
    g = f"{group}, " if group else ""
    p = f"partition by {group}" if group else ""
    return f"""gg as (select {g}{score} as s, sum({label}) as p, sum(1 - {label}) as n from {source} group by {g}{score}),
ww as (select *, coalesce(sum(n) over ({p} order by s rows between unbounded preceding and 1 preceding), 0) as nb from gg),
aa as (select {g}cast(sum(p * (nb + n / 2.0)) as double) / cast(sum(p) * sum(n) as double) as auc, sum(p)::bigint as positives, sum(n)::bigint as negatives from ww {f'group by {group}' if group else ''})"""


@query(f"with {_auc_sql('obs', '', 'm2')} select round(auc, 6) as auc, positives, negatives from aa")
def roc_auc_exact(spark, sf):
    return rounded(ranking.roc_auc(obs(spark, sf).select("y", "m2"), "y", "m2"), "auc")


@query(f"with {_auc_sql('train', 'fold', 'm1')} select fold, round(auc, 6) as auc, positives, negatives from aa")
def roc_auc_by_fold(spark, sf):
    return rounded(ranking.roc_auc(train(spark, sf).select("fold", "y", "m1"), "y", "m1", ["fold"]), "auc")


_LONG = "l as (" + " union all ".join(f"select id, y, split, '{m}' as model, {m} as score from obs" for m in MODELS) + ")"


@query(f"with {_LONG}, {_auc_sql('l', 'model', 'score')}, e as (select model, min(score) as least, max(score) as largest from l group by model) select model, round(auc, 6) as auc, round(least, 6) as least, round(largest, 6) as largest from aa join e using (model)")
def model_score_table(spark, sf):
    return rounded(ranking.model_table(obs(spark, sf).select("id", "y", *MODELS), "y", ["id"], MODELS), "auc", "least", "largest")


def _rank(s: str, part: str = "", n: str | None = None) -> str:
    p = f"partition by {part} " if part else ""
    q = f"partition by {part}, {s}" if part else f"partition by {s}"
    n = n or (f"count(*) over (partition by {part})" if part else "count(*) over ()")
    return f"((rank() over ({p}order by {s}) + (count(*) over ({q}) - 1) / 2.0) / {n})::double"


@query(f"select id, round({_rank('m2')}, 9) as r from obs")
def rank_percentile_avg(spark, sf):
    return rounded(ranking.average_ranks(obs(spark, sf).select("id", "m2"), "m2", name="r").select("id", "r"), "r", digits=9)


@query(f"select id, round({_rank('x1')}, 9) as r from obs where x1 is not null union all select id, 0.5 from obs where x1 is null")
def rank_percentile_nullable(spark, sf):
    return rounded(ranking.nullable_percentiles(obs(spark, sf).select("id", "x1"), "x1", "r").select("id", "r"), "r", digits=9)


_RANKS = "r as (select id, y, split, " + ", ".join(f"{_rank(m)} as {m}" for m in MODELS) + " from obs)"


@query(f"with {_RANKS} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as correlation from r" for k, a in enumerate(MODELS) for b in MODELS[k:]))
def spearman_matrix(spark, sf):
    return rounded(ranking.spearman(obs(spark, sf).select("id", *MODELS), ["id"], MODELS), "correlation")


@query("select model, score from (select 'm1' as model, m1 as score, id from obs) order by score desc, id limit 10")
def top_scores(spark, sf):
    return ranking.top(obs(spark, sf).select("id", F.lit("m1").alias("model"), F.col("m1").alias("score")), F.col("score"), 10, "id").select("model", "score")


# --- folds, samples, target encoding, audit -----------------------------------------------------------------------


@query("select id, y, fold from train")
def stratified_folds(spark, sf):
    return train(spark, sf).select("id", "y", "fold")


@query("select fold, count(*)::bigint as n, sum(y)::bigint as positives from train group by fold")
def fold_balance(spark, sf):
    return train(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query("select id, y from obs order by md5(cast(id as varchar) || ':42'), id limit 500")
def exact_sample(spark, sf):
    return folds.exact_sample(obs(spark, sf).select("id", "y"), "id", 500)


_SUB = "select r as round, id, y from (select r, id, y, row_number() over (partition by r, y order by md5(cast(id as varchar) || ':' || cast(r as varchar) || ':20260803')) as k, count(*) over (partition by r, y) as n, count(*) over (partition by r) as t from obs, (select unnest([0, 1]) as r)) where k <= least(greatest(2, round_even(n * 0.8, 0)), greatest(2, round_even(2000 * n / t, 0)), n)"


@query(_SUB)
def stratified_subsample(spark, sf):
    return folds.stratified_subsample(obs(spark, sf).select("id", "y"), "id", "y", 0.8, 2000, 2).select("round", "id", "y")


_ENC = """o as (select coalesce(c1, '__MISSING__') as value, fold, sum(y)::double as s, count(*) as n from train group by 1, 2),
t as (select value, sum(s) as ts, sum(n) as tn from o group by value), f as (select fold, sum(s) as fs, sum(n) as fn from o group by fold), e as (select sum(s) as es, sum(n) as en from o),
p as (select fold, (es - fs) / (en - fn) as prior from f, e),
c as (select o.fold, o.value, case when tn - n > 0 then (ts - s + prior * 20) / (tn - n + 20) else prior end as encoded, prior from o join t on o.value = t.value join p on o.fold = p.fold)"""


@query(f"with {_ENC} select fold, value, round(encoded, 9) as encoded, round(prior, 9) as prior from c")
def oof_target_encoding(spark, sf):
    return rounded(folds.out_of_fold_encoding(train(spark, sf), "c1", "y"), "encoded", "prior", digits=9)


@query(f"with {_ENC}, j as (select train.y, c.encoded from train join c on train.fold = c.fold and coalesce(train.c1, '__MISSING__') = c.value), {_auc_sql('j', '', 'encoded')} select round(auc, 6) as auc, positives, negatives from aa")
def oof_category_auc(spark, sf):
    return rounded(folds.encoded_auc(train(spark, sf), "c1", "y"), "auc")


@query(f"""with {_ENC}, j as (select 'c1' as col, train.y, c.encoded as s from train join c on train.fold = c.fold and coalesce(train.c1, '__MISSING__') = c.value
  union all select 'x1', y, coalesce(x1, (select quantile_cont(x1, 0.5) from train)) from train union all select 'm1', y, m1 from train
  union all select 'x1:missing', y, case when x1 is null then 1.0 else 0.0 end from train union all select 'c1:missing', y, case when c1 is null then 1.0 else 0.0 end from train),
{_auc_sql('j', 'col', 's')}
select col as "column", case when col = 'c1' then 'oof_smoothed_target_encoding' when col like '%:missing' then 'missing_indicator' else 'rank_auc_best_direction' end as method, round(case when col = 'c1' then auc else greatest(auc, 1 - auc) end, 6) as auc from aa""")
def univariate_audit(spark, sf):
    return rounded(audit.univariate_audit(train(spark, sf), ["c1", "x1", "m1"], "y"), "auc")


_EVENTS = ["user_id", "event_type", "value"]


def _events(spark, sf):
    return table(spark, sf, "events").select(*_EVENTS, (F.col("event_id") % 2).alias("y"))


@query("select coalesce(sum(n), 0)::bigint as duplicate_rows, count(*)::bigint as duplicate_groups, coalesce(sum(case when d > 1 then 1 else 0 end), 0)::bigint as conflicting_groups from (select count(*) as n, count(distinct event_id % 2) as d from events group by user_id, event_type, value having count(*) > 1)")
def duplicate_report(spark, sf):
    return audit.duplicate_report(_events(spark, sf), _EVENTS, "y")


@query("select user_id, event_type, value, count(*)::bigint as n from events group by user_id, event_type, value having count(distinct event_id % 2) > 1")
def conflicting_groups(spark, sf):
    return audit.duplicate_groups(_events(spark, sf), _EVENTS, "y").where("conflicting").select(*_EVENTS, "n")


@query("with a as (select distinct user_id, event_type from events where event_id % 10 < 7 and user_id % 3 > 0), b as (select user_id, event_type, count(*) as n from events where event_id % 10 >= 7 group by user_id, event_type) select count(*)::bigint as overlap_groups, coalesce(sum(n), 0)::bigint as overlap_rows from b where exists (select 1 from a where a.user_id is not distinct from b.user_id and a.event_type is not distinct from b.event_type)")
def train_test_overlap(spark, sf):
    e = table(spark, sf, "events")
    return audit.overlap(e.where("event_id % 10 < 7 and user_id % 3 > 0"), e.where("event_id % 10 >= 7"), ["user_id", "event_type"])


@query("select event_id, count(*) over (partition by user_id, event_type)::bigint as n_equal from events")
def repeated_rows(spark, sf):
    return audit.repeated(table(spark, sf, "events"), ["user_id", "event_type"]).select("event_id", "n_equal")


_PROFILE = " union all ".join(f"select '{c}' as \"column\", count(*)::bigint as n_rows, sum(case when {c} is null then 1 else 0 end)::bigint as n_missing, (count(distinct {c}) + max(case when {c} is null then 1 else 0 end))::bigint as n_distinct from obs" for c in ("x1", "c1", "split"))


@query(_PROFILE)
def schema_profile(spark, sf):
    return audit.profile(obs(spark, sf), ["x1", "c1", "split"])


@query("select c1 as value, count(*)::bigint as n from obs group by c1")
def value_counts(spark, sf):
    return audit.value_counts(obs(spark, sf), "c1")


@query("select round(avg(y), 9) as rate from obs")
def positive_rate(spark, sf):
    return obs(spark, sf).agg(F.round(F.avg("y"), 9).alias("rate"))


# --- neighbours ---------------------------------------------------------------------------------------------------

_DIM = 64


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    flat = e.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") < 5).cast("int").alias("y"), *[F.get("embedding", k).cast("double").alias(f"e{k}") for k in range(_DIM)])
    return flat.where("vec_id < 400"), flat.where("vec_id >= 400")


_KNN = """e as (select vec_id, case when label < 5 then 1 else 0 end as y, list_transform(embedding, lambda v: v::double) as v from embeddings), p as (select * from e where vec_id < 400), q as (select vec_id, v from e where vec_id >= 400),
d as (select q.vec_id, p.vec_id as parent_id, p.y, sqrt(list_sum(list_transform(range(1, 65), lambda k: (q.v[k] - p.v[k]) * (q.v[k] - p.v[k])))) as dist from q, p),
r as (select *, row_number() over (partition by vec_id order by dist, parent_id) as k from d)"""


@query(f"""with {_KNN} select vec_id, round((sum(case when k <= 5 then y else 0 end) + (select avg(y) from p)) / 6, 6) as label_mean_5,
round(sum(case when k <= 5 then y / greatest(dist, 1e-4) else 0 end) / sum(case when k <= 5 then 1 / greatest(dist, 1e-4) else 0 end), 6) as label_weighted_5, round(avg(case when k <= 5 then dist end), 6) as distance_mean_5, round(min(dist), 6) as distance_min from r group by vec_id""")
def knn_label_features(spark, sf):
    parent, query_rows = _vectors(spark, sf)
    prior = parent.agg(F.avg("y")).first()[0]
    found = knn.neighbours(query_rows, parent, "vec_id", "vec_id", [f"e{k}" for k in range(_DIM)], "y", 5)
    names = ["label_mean_5", "label_weighted_5", "distance_mean_5", "distance_min"]
    return rounded(knn.label_features(found, "vec_id", [5], prior).select("vec_id", *names), *names)


@query(f"with {_KNN} select vec_id, round(min(case when y = 0 then dist end), 6) as distance_class_0, round(min(case when y = 1 then dist end), 6) as distance_class_1, round(min(case when y = 0 then dist end) - min(case when y = 1 then dist end), 6) as distance_margin from r group by vec_id")
def knn_class_margin(spark, sf):
    parent, query_rows = _vectors(spark, sf)
    found = knn.neighbours(query_rows, parent, "vec_id", "vec_id", [f"e{k}" for k in range(_DIM)], "y", 1)
    names = ["distance_class_0", "distance_class_1", "distance_margin"]
    return rounded(knn.label_features(found, "vec_id", [1], 0.5).select("vec_id", *names), *names)


@query("""with u as (select quantile_cont(x1, 0.5) as mx, stddev_samp(x1) as sx, quantile_cont(m2, 0.5) as mm, stddev_samp(m2) as sm, avg(y) as prior from obs where split = 'train'),
v as (select id, y, split, (coalesce(x1, mx) - mx) / sx as a, (m2 - mm) / sm as b, coalesce(c1, '__MISSING__') as c, prior from obs, u),
d as (select q.id, p.id as pid, p.y, q.prior, sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + case when q.c = p.c then 0 else 3.125 end) as dist from v q, v p where q.split = 'test' and p.split = 'train'),
k as (select *, row_number() over (partition by id order by dist, pid) as k from d)
select id, """ + ", ".join(f"round((sum(case when k <= {n} then y else 0 end) + prior) / {n + 1}, 6) as label_mean_{n}, round(sum(case when k <= {n} then y / greatest(dist, 1e-4) else 0 end) / sum(case when k <= {n} then 1 / greatest(dist, 1e-4) else 0 end), 6) as label_weighted_{n}, round(avg(case when k <= {n} then dist end), 6) as distance_mean_{n}" for n in (1, 5)) + """,
round(min(dist), 6) as distance_min, round(min(case when y = 0 then dist end), 6) as distance_class_0, round(min(case when y = 1 then dist end), 6) as distance_class_1, round(min(case when y = 0 then dist end) - min(case when y = 1 then dist end), 6) as distance_margin from k group by id, prior""")
def parent_view(spark, sf):
    """What the nearest train rows say about each test row: medians, deviations and levels of the train rows make the space."""
    d = lineage.written(obs(spark, sf).select("id", "y", "split", "x1", "m2", "c1"), "obs")
    out = knn.parent_features(d.where("split = 'test'").drop("y", "split"), d.where("split = 'train'"), "id", "id", ["x1", "m2", "c1"], "y", [1, 5])
    names = [c for c in out.columns if c.startswith(("label_", "distance_"))]
    return rounded(out.select("id", *names), *names)


@query("""select id, round((coalesce(x1, m1) - m1) / s1, 6) as x_x1, c1_0 as x_c1_0 from (select id, x1, case when coalesce(c1, '__MISSING__') = '1-URGENT' then 1.25 else 0.0 end::double as c1_0 from obs where split = 'test') q,
(select quantile_cont(x1, 0.5) as m1, stddev_samp(x1) as s1 from obs where split = 'train') t""")
def parent_standardize(spark, sf):
    d = obs(spark, sf).select("id", "split", "x1", "c1")
    (_, out), _ = knn.metric_space(d.where("split = 'train'"), [d.where("split = 'test'")], ["x1", "c1"])
    return rounded(out.select("id", "x_x1", "x_c1_0"), "x_x1")


# --- blends, stacks -----------------------------------------------------------------------------------------------


@query(f"with {_RANKS} select id, round(0.96 * m1 + 0.04 * m3, 9) as blend from r")
def rank_blend_fixed(spark, sf):
    return rounded(blend.rank_blend(obs(spark, sf).select("id", "m1", "m3"), ["id"], {"m1": 0.96, "m3": 0.04}), "blend", digits=9)


@query(f"with {_RANKS} select id, round(0.5 * m1 + 0.3 * m2 + 0.2 * m4, 9) as blend from r")
def rank_blend_weighted(spark, sf):
    return rounded(blend.rank_blend(obs(spark, sf).select("id", "m1", "m2", "m4"), ["id"], {"m1": 0.5, "m2": 0.3, "m4": 0.2}), "blend", digits=9)


@query(f"""with r as (select fold, y, {_rank('m1')} as base, 0.7 * {_rank('m1')} + 0.3 * {_rank('m3')} as blend from train), k as (select fold || ':base' as g, y, base as s from r union all select fold || ':blend', y, blend from r),
{_auc_sql('k', 'g', 's')} select f::int as fold, round(b, 6) as base_auc, round(c, 6) as blend_auc, round(c - b, 6) as gain from (select split_part(g, ':', 1) as f, max(case when g like '%base' then auc end) as b, max(case when g like '%blend' then auc end) as c from aa group by 1)""")
def blend_fold_delta(spark, sf):
    return rounded(blend.fold_gains(train(spark, sf).select("id", "y", "fold", "m1", "m3"), "id", "y", "fold", "m1", "m3", 0.3), "base_auc", "blend_auc", "gain")


@query(f"with {_RANKS}, k as (" + " union all ".join(f"select '{m}' as model, y, (m1 + {m}) / 2 as s from r" for m in MODELS) + f"), {_auc_sql('k', 'model', 's')} select model, round(auc, 6) as auc from aa")
def greedy_step_candidates(spark, sf):
    ranked = ranking.ranked_models(obs(spark, sf).select("id", "y", *MODELS), ["id", "y"], MODELS).withColumn("round", F.lit(0))
    return rounded(blend.candidate_scores(ranked, "y", MODELS, {0: {"m1": 1}}).select("model", "auc"), "auc")


@query()
def greedy_rank_weights(spark, sf):
    weights, _ = blend.greedy_weights(obs(spark, sf).select("id", "y", *MODELS), "id", "y", MODELS)
    return spark.createDataFrame([(m, float(weights.get(m, 0.0))) for m in MODELS], "model string, weight double")


@query()
def stable_rank_weights(spark, sf):
    return blend.stable_weights(obs(spark, sf).select("id", "y", *MODELS), "id", "y", MODELS)


@query("""with n as (select l_suppkey % 20 as round, l_returnflag || l_linestatus as model, sum(l_quantity) as q from lineitem where l_orderkey % 7 < 2 group by 1, 2), a as (select round, sum(q) as whole from n group by round),
w as (select r.round, m.model, coalesce(case when n.q >= 0.165 * a.whole then n.q / a.whole end, 0) as weight from (select distinct round from n) r cross join (select distinct model from n) m left join n on n.round = r.round and n.model = m.model join a on a.round = r.round),
s as (select model, avg(case when weight > 0 then 1.0 else 0.0 end) as frequency, avg(weight) as mean, stddev_pop(weight) as deviation from w group by model)
select model, round(case when frequency >= 0.15 then mean else 0 end / (select sum(case when frequency >= 0.15 then mean else 0 end) from s), 6) as weight, round(frequency, 6)::double as frequency, round(mean, 6) as mean, round(deviation, 6) as deviation from s""")
def selection_frequency(spark, sf):
    """The summary of rounds: of twenty groups of suppliers, the share that each kind of line has, if it has about a sixth at least."""
    lines = table(spark, sf, "lineitem").where("l_orderkey % 7 < 2")
    n = lines.groupBy((F.col("l_suppkey") % 20).alias("round"), F.concat("l_returnflag", "l_linestatus").alias("model")).agg(F.sum("l_quantity").alias("q"))
    wide = n.groupBy("round").pivot("model").agg(F.first("q"))
    kinds = [c for c in wide.columns if c != "round"]
    long = wide.unpivot(["round"], kinds, "model", "q").withColumn("whole", F.sum("q").over(Window.partitionBy("round")))
    weights = long.select("round", "model", F.coalesce(F.when(F.col("q") >= 0.165 * F.col("whole"), F.col("q") / F.col("whole")), F.lit(0.0)).alias("weight"))
    return rounded(blend.weight_summary(weights), "weight", "frequency", "mean", "deviation")


@query(f"select id, split, round({_rank('m1', 'split')} / 3 + {_rank('m3', 'split')} * 2 / 3, 9) as blend from obs")
def meta_rank_mix(spark, sf):
    return rounded(blend.rank_blend(obs(spark, sf).select("id", "split", "m1", "m3"), ["id", "split"], {"m1": 1 / 3, "m3": 2 / 3}, ["split"]), "blend", digits=9)


def _reorder_sql(source: str, inside: str, local: str, weight: float, name: str) -> str:
    return f"""{name}i as (select id, base, {local} as local, {_rank('base')} as rb, {_rank(local)} as rl from {source} where {inside}),
{name}p as (select id, row_number() over (order by (1 - {weight}) * rb + {weight} * rl, id) as k from {name}i), {name}v as (select base, row_number() over (order by base, id) as k from {name}i),
{name} as (select s.* exclude (base), coalesce(v.base, s.base) as base from {source} s left join {name}p p on s.id = p.id left join {name}v v on p.k = v.k)"""


@query(f"with b0 as (select id, m1 as base, m3, m4, x1 from obs), {_reorder_sql('b0', 'x1 > 200000', 'm3', 1.0, 'b1')} select id, round(base, 9) as base from b1")
def subset_reorder(spark, sf):
    d = obs(spark, sf).select("id", F.col("m1").alias("base"), F.when(F.col("x1") > 200000, F.col("m3")).alias("local"))
    return rounded(blend.reorder(d, "base", "local", 1.0, "id").select("id", "base"), "base", digits=9)


@query(f"with b0 as (select id, m1 as base, m2, m3, x1 from obs), {_reorder_sql('b0', 'x1 > 200000', 'm3', 1.0, 'b1')}, {_reorder_sql('b1', 'x1 < 250000', 'm2', 1.0, 'b2')} select id, round(base, 9) as base from b2")
def band_reorder_sequential(spark, sf):
    d = obs(spark, sf).select("id", F.col("m1").alias("base"), F.when(F.col("x1") > 200000, F.col("m3")).alias("high"), F.when(F.col("x1") < 250000, F.col("m2")).alias("low"))
    return rounded(blend.reorder_bands(d, "base", [("high", 1.0), ("low", 1.0)], "id").select("id", "base"), "base", digits=9)


_Z = "z as (select o.id, o.y, " + ", ".join(f"ln(o.{m}) - ln(1 - o.{m}) as {m}" for m in MODELS) + f", ({_MISS})::int as missing from obs o join habits h on o.id = h.id)".replace("case when ", "case when h.")


def _logits(spark, sf, rows=obs):
    own = habits(spark, sf).select("id", S.count_missing([F.col(c) for c in HABITS]).alias("missing"))
    return stack.as_logits(rows(spark, sf), MODELS).join(own, "id")


@query(f"""with {_Z}, s as (select *, list_avg([m1, m2, m3, m4]) as mean, list_stddev_pop([m1, m2, m3, m4]) as dev, greatest(m1, m2, m3, m4) - least(m1, m2, m3, m4) as rng from z), t as (select avg(dev) as a, stddev_pop(dev) as b from s)
select id, """ + ", ".join(f"round({m}, 6) as {m}, round(case when missing = 0 then {m} else 0 end, 6) as {m}_complete, round(case when missing >= 4 then {m} else 0 end, 6) as {m}_severe, round({m} * (dev - a) / (b + 1e-6), 5) as {m}_disagreement" for m in MODELS) + """, round(mean, 6) as logit_mean, round(dev, 6) as logit_std, round(rng, 6) as logit_range,
case when missing = 0 then 1.0 else 0.0 end::double as complete, case when missing >= 4 then 1.0 else 0.0 end::double as severe from s, t""")
def regime_design(spark, sf):
    d = stack.regime_design(_logits(spark, sf), ["id"], MODELS, "missing")
    assert len(d.columns) == 1 + 4 * len(MODELS) + 5
    fine = [*MODELS, *(f"{m}_{t}" for m in MODELS for t in ("complete", "severe")), "logit_mean", "logit_std", "logit_range"]
    return rounded(rounded(d, *fine), *(f"{m}_disagreement" for m in MODELS), digits=5)


@query(f"with {_Z} select id, round(list_sort([m1, m2, m3, m4])[1] * 0.25 + list_sort([m1, m2, m3, m4])[2] * 0.75, 6) as logit_q25, round((list_sort([m1, m2, m3, m4])[2] + list_sort([m1, m2, m3, m4])[3]) / 2, 6) as logit_q50, round(list_sort([m1, m2, m3, m4])[3] * 0.75 + list_sort([m1, m2, m3, m4])[4] * 0.25, 6) as logit_q75, (case when x1 is null then 1.0 else 0.0 end)::double as missing_count from (select z.*, obs.x1 from z join obs on z.id = obs.id)")
def meta_design_quantiles(spark, sf):
    d = stack.quantile_design(stack.as_logits(obs(spark, sf), MODELS), ["id"], MODELS, ["x1"])
    return rounded(d.select("id", "logit_q25", "logit_q50", "logit_q75", "missing_count"), "logit_q25", "logit_q50", "logit_q75")


def _newton_sql(source: str, columns: list[str], groups: str, within: str, c: float = 1.0, steps: int = 9) -> str:
    """Newton's steps for ridge logistic regression, one after another, each solved by eliminating its columns in turn. ``groups``: a select of
    the fits (k); ``within``: which rows of ``source`` a fit k has. The last table, ``wl``, has a row of weights w1.. a fit, the intercept last."""
    d = len(columns) + 1
    x = [*(f"r.{n}" for n in columns), "1.0::double"]
    ids = range(1, d + 1)
    out = ["w0 as (select k, " + ", ".join(f"0.0::double as w{i}" for i in ids) + f" from ({groups}))"]
    for t in range(steps):
        z = " + ".join(f"w.w{i} * {x[i - 1]}" for i in ids)
        own = f"select w.*, r.y, {', '.join(f'{v} as v{i}' for i, v in zip(ids, x, strict=True))}, 1 / (1 + exp(-({z}))) as p from w{t} w join {source} r on {within}"
        ridge = lambda i, j: 1 if i == j < d else 0
        h = [f"{c} * sum(p * (1 - p) * v{i} * v{j}) + {ridge(i, j)} as a{i}_{j}" for i in ids for j in ids]
        g = [f"{c} * sum((p - y) * v{i}) + {0 if i == d else f'any_value(w{i})'} as b{i}" for i in ids]
        out.append(f"e{t}_0 as (select k, {', '.join([*(f'any_value(w{i}) as w{i}' for i in ids), *h, *g])} from ({own}) group by k)")
        for q in ids:
            less = lambda i, v: f"a{i}_{q} / a{q}_{q} * {v}"  # noqa: B023, E731
            rows = [f"a{i}_{j} - {less(i, f'a{q}_{j}')} as a{i}_{j}" if i != q else f"a{i}_{j}" for i in ids for j in ids]
            rows += [f"b{i} - {less(i, f'b{q}')} as b{i}" if i != q else f"b{i}" for i in ids]
            out.append(f"e{t}_{q} as materialized (select k, {', '.join([*(f'w{i}' for i in ids), *rows])} from e{t}_{q - 1})")
        name = "wl" if t == steps - 1 else f"w{t + 1}"
        out.append(f"{name} as materialized (select k, {', '.join(f'w{i} - b{i} / a{i}_{i} as w{i}' for i in ids)} from e{t}_{d})")
    return ", ".join(out)


_ZS = ", ".join(f"ln({m}) - ln(1 - {m}) as {m}" for m in MODELS)
_P = "1 / (1 + exp(-(" + " + ".join(f"w{i} * r.{m}" for i, m in enumerate(MODELS, 1)) + " + w5)))"


@query()
def nonlinear_meta_oof(spark, sf):
    """Boosted trees over the logits, their spread and quartiles, and what is missing; fixed rounds."""
    d = stack.as_logits(train(spark, sf, lines=True).select("id", "y", "fold", *MODELS, "x1", "x2"), MODELS)
    scores, _ = stack.nonlinear_meta(d, "id", MODELS, ["x1", "x2"], "y", params={"rounds": 20, "patience": None})
    return rounded(scores, "score")


@query(f"with zt as materialized (select id, y, fold, {_ZS} from train), {_newton_sql('zt', MODELS, 'select distinct fold as k from train', 'r.fold <> w.k')} select r.id, r.y, round({_P}, 6) as score from zt r join wl on wl.k = r.fold")
def logistic_stack(spark, sf):
    d = stack.as_logits(train(spark, sf).select("id", "y", "fold", *MODELS), MODELS)
    return rounded(stack.cross_fitted(d, ["id", "y"], MODELS, "y", scale=False), "score")


@query()
def regime_stack(spark, sf):
    d = stack.regime_design(_logits(spark, sf, train), ["id", "y", "fold"], MODELS, "missing")
    _, _, scores = stack.best_of_grid(d, ["id"], [c for c in d.columns if c not in ("id", "y", "fold")], "y", [0.1, 1.0])
    return rounded(scores, "score")


_ENDS = ", ".join(f"avg({m}) as a_{m}, stddev_pop({m}) as d_{m}" for m in MODELS)


@query(f"""with zo as (select id, y, split, {_ZS} from obs), zm as (select {_ENDS} from zo where split = 'train'), zt as materialized (select id, y, split, {', '.join(f'({m} - a_{m}) / d_{m} as {m}' for m in MODELS)} from zo, zm),
{_newton_sql('zt', MODELS, 'select 0 as k', "r.split = 'train'")} select r.id, round({_P}, 6) as score from zt r, wl where r.split = 'test'""")
def final_stack(spark, sf):
    d = stack.as_logits(obs(spark, sf).select("id", "y", "split", *MODELS), MODELS)
    scores, _ = stack.final_logistic(d.where("split = 'train'"), d.where("split = 'test'"), ["id"], MODELS, "y")
    return rounded(scores, "score")


def _prior_sql(column: str, order: int) -> str:
    """The smoothed mean label of a category's rows before each of those with fold > 0, and of all of these for the others."""
    key = f"md5(id::varchar || ':{order}:42')"
    return f"""case when fold > 0 then (coalesce(sum(case when fold > 0 then y end) over (partition by {column}, fold > 0 order by {key} rows between unbounded preceding and 1 preceding), 0) + pr) / (count(*) over (partition by {column}, fold > 0 order by {key} rows between unbounded preceding and current row))
else (coalesce(sum(case when fold > 0 then y end) over (partition by {column}), 0) + pr) / (sum(case when fold > 0 then 1 else 0 end) over (partition by {column}) + 1) end"""


@query("select id, " + ", ".join(f"round(({_prior_sql(c, 0)} + {_prior_sql(c, 1)}) / 2, 9) as {c}__ts" for c in ("c1", "c2")) + " from train, (select avg(y) as pr from train where fold > 0)")
def ordered_target_stats(spark, sf):
    d = train(spark, sf, customers=True).select("id", "y", "c1", "c2", (F.col("fold") > 0).alias("learned"))
    return rounded(ordered.ordered_statistics(d, "id", "y", ["c1", "c2"], "learned", orders=2).select("id", "c1__ts", "c2__ts"), "c1__ts", "c2__ts", digits=9)


def _gaps(spark, sf):
    return train(spark, sf, lines=True, customers=True).select("id", "y", "fold", "x1", "x2", "x3", "m1", "c1", "c2")


@query()
def gbt_oof(spark, sf):
    """Boosted trees over numbers whose gaps stay gaps; each fold stops its model."""
    scores, _, _ = models.out_of_fold(models.Experiment("gbt", "gbt"), _gaps(spark, sf), None, "id", ["x1", "x2", "x3", "m1"], "y")
    return rounded(scores, "score")


@query()
def categorical_gbt_oof(spark, sf):
    """Boosted trees over numbers with gaps and two text columns as ordered target statistics."""
    scores, _, _ = models.out_of_fold(models.Experiment("cat", "catboost"), _gaps(spark, sf), None, "id", ["x1", "m1", "c1", "c2"], "y")
    return rounded(scores, "score")


@query()
def extra_trees_oof(spark, sf):
    """Fully random trees over the filled matrix of three numbers and their gaps."""
    d = train(spark, sf, lines=True).select("id", "y", "fold", "split", "x1", "x2", "x3", "m1")
    d = encode.encoded(d, ["id", "y", "fold"], ["x1", "x2", "x3", "m1"])
    scores, _, _ = models.out_of_fold(models.Experiment("trees", "extra_trees"), d, None, "id", [c for c in d.columns if c not in ("id", "y", "fold")], "y")
    return rounded(scores, "score")


@query()
def rank_fm_oof(spark, sf):
    """Log-odds of the factorization machine over numbers with gaps and texts."""
    scores, _, _ = rank_fm.rank_fm_out_of_fold(_gaps(spark, sf), None, "id", ["x1", "x2", "x3", "m1"], ["c1", "c2"], "y")
    return rounded(scores, "score")


@query()
def cross_net_oof(spark, sf):
    """Log-odds of the cross network over nine numbers, the 31 values of the budget that they allow, and three texts."""
    d = folds.stratified_folds(habits(spark, sf).where("split = 'train'"), "id", "y").drop("split")
    cells = geometry.geometry(15.0)
    d = d.select("*", *[v.alias(n) for n, (v, _) in cells.items()], *[ok.alias(f"{n}_valid") for n, (_, ok) in cells.items()])
    scores, _, _ = cross_net.cross_net_out_of_fold(d, None, "id", HABIT_NUMBERS, [c for c in HABITS if c not in HABIT_NUMBERS], "y", geometry.cell_sources(list(cells)))
    return rounded(scores, "score")


@query()
def adversarial_auc(spark, sf):
    d = encode.encoded(obs(spark, sf).select("id", "split", "x1", "m1"), ["id", "split"], ["x1"])
    both = models.adversarial_scores(d.where("split = 'train'"), d.where("split = 'test'"), "id", ["x1", "x1__missing"], rows=None)
    return rounded(ranking.roc_auc(both, "came_from_test", "score"), "auc")


@query("select id, y, round(avg(score), 9) as score from (" + " union all ".join(f"select id, y, {m} as score from obs" for m in MODELS) + ") group by id, y")
def prediction_average(spark, sf):
    return rounded(blend.average_predictions(ranking.long_scores(obs(spark, sf).select("id", "y", *MODELS), ["id", "y"], MODELS), ["id", "y"]), "score", digits=9)


@query("select id, round(m1, 9) as y from obs where split = 'test'")
def submission_table(spark, sf):
    from sparkrank.sources.sinks import submission

    d = obs(spark, sf).where("split = 'test'")
    return rounded(submission(d.select("id", F.col("m1").alias("score")), d.select("id", F.lit(0.5).alias("y")), "id", "y"), "y", digits=9)


# --- alignment ----------------------------------------------------------------------------------------------------


@query("with b as (select id from obs where id >= (select id from obs order by id limit 1 offset 10)) select (select count(*) from obs where id not in (select id from b))::bigint as only_a, (select count(*) from b where id not in (select id from obs))::bigint as only_b, (select count(*) from (select id from obs group by id having count(*) > 1))::bigint as repeated")
def alignment_check(spark, sf):
    d = obs(spark, sf).select("id")
    return align.key_alignment(d, d.where(F.col("id") >= F.lit(d.orderBy("id").offset(10).limit(1).first()[0])), "id")


@query("with a as (select row_number() over (order by id) as p, id from obs), b as (select row_number() over (order by case when id % 100 = 1 then -id else id end) as p, id from obs) select count(*)::bigint as misplaced from a join b on a.p = b.p where a.id <> b.id")
def order_check(spark, sf):
    d = obs(spark, sf).select("id")
    a = ranking.average_ranks(d, "id", percentile=False, name="p")
    b = ranking.average_ranks(d.withColumn("k", F.when(F.col("id") % 100 == 1, -F.col("id")).otherwise(F.col("id"))), "k", percentile=False, name="p")
    return align.order_alignment(a, b, "id", "p")


@query("select 0::bigint as unmatched, count(*)::bigint as differing from train where fold <> 0")
def fold_alignment_check(spark, sf):
    d = train(spark, sf)
    return align.value_alignment(d.select("id", "fold"), d.select("id", F.lit(0).alias("fold")), "id", "fold")


@query("select sum(case when x1 is null then 1 else 0 end)::bigint as x1_not_finite, sum(case when x1 > 400000 then 1 else 0 end)::bigint as x1_out_of_range from obs")
def finite_check(spark, sf):
    return align.finite_report(obs(spark, sf), ["x1"], 0.0, 400000.0)


@query("select id from obs where x1 > 300000 and id not in (select id from train)")
def anti_join_subset(spark, sf):
    d = obs(spark, sf)
    return align.outside(d.where("x1 > 300000").select("id"), d.where("split = 'train'").select("id"), "id")


@query(f"with {_LONG} select model, count(*)::bigint as n from l where score > 0.5 or model <> 'm4' group by model having count(*) <> (select count(*) from obs)")
def shape_check(spark, sf):
    d = obs(spark, sf).select("id", *MODELS)
    return align.shape_report(ranking.long_scores(d, ["id"], MODELS).where("score > 0.5 or model <> 'm4'"), d.count())


@query("""with a as (select distinct p_brand as model from part where p_size <= 2), b as (select distinct p_brand as model from part where p_size >= 49)
select model, 'a' as side from a where model not in (select model from b) union all select model, 'b' from b where model not in (select model from a)""")
def name_check(spark, sf):
    """Brands that only the smallest or only the largest parts have."""
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "model")
    return align.name_differences(p.where("p_size <= 2"), p.where("p_size >= 49"))


@query("select id, band, round(prediction, 9) as prediction from (select id, 'high' as band, m3 as prediction from obs where x1 > 400000 union all select id, 'low', m2 from obs where x1 < 50000)")
def band_union(spark, sf):
    d = obs(spark, sf)
    high, low = (d.where(w).select("id", F.lit(n).alias("band"), F.col(m).alias("prediction")) for n, m, w in (("high", "m3", "x1 > 400000"), ("low", "m2", "x1 < 50000")))
    return rounded(high.unionByName(low), "prediction", digits=9)


# --- banks of predictions -----------------------------------------------------------------------------------------


def _bank(spark, sf):
    """Our train and test rows, and a library (m1, m2), stored predictions (m3) and logits (m4) made of the same rows."""
    from sparkrank.sources import banks, sinks

    at = lineage.fresh_folder(spark, "bank")
    ours = lineage.written(train(spark, sf).select("id", "y", "fold", F.col("id").alias("row_pos"), *MODELS), "ours")
    there = obs(spark, sf).where("split = 'test'").select("id", F.col("id").alias("row_pos"), *MODELS)
    banks.write_library(f"{at}/library", ours, there, ours, there, ["m1", "m2"], "id", "y")
    sinks.write_folds(ours, f"{at}/stored/folds", "id", "y")
    for split, df, name in (("train", ours, "oof_members"), ("test", there, "test_members")):
        sinks.write_predictions(df, f"{at}/stored/predictions", split, "m3", "id", "m3")
        df.select("id", S.logit(F.col("m4")).alias("m4")).write.parquet(f"{at}/logits/{name}.parquet")
    return ours, there, [banks.Source("library", f"{at}/library"), banks.Source("native", f"{at}/stored", "local"), banks.Source("logits", f"{at}/logits", "fm")]


_BANKED = ["m1", "m2", "local__m3", "fm__m4"]


@query("""select id, 'train' as split, y, fold, round(m1, 9) as m1, round(m2, 9) as m2, round(m3, 9) as local__m3, round(ln(m4) - ln(1 - m4), 6) as fm__m4 from train
union all select id, 'test', null, null, round(m1, 9), round(m2, 9), round(m3, 9), round(ln(m4) - ln(1 - m4), 6) from obs where split = 'test'""")
def bank_members(spark, sf):
    from sparkrank.sources import banks

    ours, there, sources = _bank(spark, sf)
    found = banks.load(ours, there, sources, "id", "y")
    test = found.test.withColumns({"split": F.lit("test"), "y": F.lit(None).cast("int"), "fold": F.lit(None).cast("int")})
    both = found.train.withColumn("split", F.lit("train")).select("id", "split", "y", "fold", *_BANKED).unionByName(test.select("id", "split", "y", "fold", *_BANKED))
    return rounded(rounded(both, *_BANKED[:3], digits=9), "fm__m4")


_MEMBERS = "b as (" + " union all ".join(f"select '{n}' as model, split, y, {x} as s from obs" for n, x in zip(_BANKED, ["m1", "m2", "m3", "ln(m4) - ln(1 - m4)"], strict=True)) + "), k as (select * from b where split = 'train')"


@query(f"""with {_MEMBERS}, {_auc_sql('k', 'model', 's')}, e as (select model, min(case when split = 'train' then s end) as a, max(case when split = 'train' then s end) as b, min(case when split = 'test' then s end) as c, max(case when split = 'test' then s end) as d from b group by model)
select model, round(auc, 9) as auc, round(a, 6) as least, round(e.b, 6) as largest, round(c, 6) as test_least, round(d, 6) as test_largest from aa join e using (model)""")
def bank_scores(spark, sf):
    from sparkrank.sources import banks

    ours, there, sources = _bank(spark, sf)
    return rounded(rounded(banks.load(ours, there, sources, "id", "y").table, "auc", digits=9), "least", "largest", "test_least", "test_largest")


@query("""select 'library' as source, 'train' as split, 'has other labels' as "check", count(*)::bigint as n from train where id % 50 = 0 having count(*) > 0
union all select 'stored', 'train', 'has other folds', count(*) from train where id % 9 = 0 having count(*) > 0
union all select 'logits', 'train', 'lacks ids of ours', count(*) from train where id % 20 = 1 having count(*) > 0
union all select 'logits', 'train', 'has ids that aren''t ours', count(*) from train where id % 20 = 1 having count(*) > 0
union all select 'logits', 'test', 'not finite: m4', count(*) from obs where split = 'test' and id % 30 = 7 having count(*) > 0""")
def bank_refusals(spark, sf):
    """What a bank is refused for whose labels, folds, ids and values were changed here and there."""
    from sparkrank.sources import banks, sinks

    ours, there, sources = _bank(spark, sf)
    lib, stored, logits = (s.path for s in sources)
    ours.select("row_pos", "id", F.when(F.col("id") % 50 == 0, 1 - F.col("y")).otherwise(F.col("y")).alias("y")).write.mode("overwrite").parquet(f"{lib}/train_keys.parquet")
    sinks.write_folds(ours.withColumn("fold", F.when(F.col("id") % 9 == 0, (F.col("fold") + 1) % 5).otherwise(F.col("fold"))), f"{stored}/folds", "id", "y")
    ours.select(F.when(F.col("id") % 20 == 1, -F.col("id")).otherwise(F.col("id")).alias("id"), "m4").write.mode("overwrite").parquet(f"{logits}/oof_members.parquet")
    there.select("id", F.when(F.col("id") % 30 == 7, F.lit(float("nan"))).otherwise(F.col("m4")).alias("m4")).write.mode("overwrite").parquet(f"{logits}/test_members.parquet")
    try:
        banks.load(ours, there, sources, "id", "y")
    except banks.Refused as e:
        rows = [(s.rpartition("/")[2], split, check, n) for s, split, check, n in e.problems]
        return spark.createDataFrame(rows, "source string, split string, check string, n long")
    return spark.createDataFrame([], "source string, split string, check string, n long")


def _banded_sql(split: str) -> str:
    t = split[:2]
    return f"""{t}0 as (select id, 0.25 * {_rank('m1')} + 0.75 * {_rank('m3')} as base, m2, m4, x1 from obs where split = '{split}'), {_reorder_sql(f'{t}0', 'x1 > 300000', 'm4', 0.5, f'{t}1')}, {_reorder_sql(f'{t}1', 'x1 < 250000', 'm2', 1.0, f'{t}2')}"""


@query(f"with {_banded_sql('train')}, {_banded_sql('test')} select id, 'train' as split, round(base, 9) as score from tr2 union all select id, 'test', round(base, 9) from te2")
def bank_bands(spark, sf):
    """Mixed ranks of both splits, re-ordered in two bands that are read from tables of their own."""
    from sparkrank.sources import banks

    at = lineage.fresh_folder(spark, "bands")
    d = lineage.written(obs(spark, sf), "obs")
    for name, inside, local in (("high", "x1 > 300000", "m4"), ("low", "x1 < 250000", "m2")):  # as other tools would leave them
        d.where(inside).select("id", "split", F.col(local).alias("prediction")).write.parquet(f"{at}/{name}")
    mixed = lineage.written(blend.rank_blend(d.select("id", "split", "m1", "m3"), ["id", "split"], {"m1": 0.25, "m3": 0.75}, ["split"]), "mixed")
    found = banks.load_bands(*(mixed.where(F.col("split") == s) for s in ("train", "test")), [f"{at}/high", f"{at}/low"], "id")
    out = blend.reorder_bands(found["train"].unionByName(found["test"]), "blend", [("band0", 0.5), ("band1", 1.0)], "id", ["split"])
    return rounded(out.select("id", "split", F.col("blend").alias("score")), "score", digits=9)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well does each base score rank the label, fold by fold?"""
    d = ranking.long_scores(train(spark, sf_dir).select("id", "y", "fold", *MODELS), ["id", "y", "fold"], MODELS)
    return ranking.roc_auc(d, "y", "score", ["model", "fold"]).withColumn("best", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("auc"), "model")) == 1)
