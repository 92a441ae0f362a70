"""Labelled tables over the supplied star schema, as Spark DataFrames and as SQL text of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkrank.operators.folds import stratified_folds

MODELS = ["m1", "m2", "m3", "m4"]
HABIT_NUMBERS = ["age", "daily_screen_time_hours", "social_media_hours", "gaming_hours", "work_study_hours", "sleep_hours", "notifications_per_day", "app_opens_per_day", "weekend_screen_time"]
HABIT_TEXTS = ["gender", "stress_level", "academic_work_impact"]
HABITS = HABIT_NUMBERS + HABIT_TEXTS

_KEYS = {"id": "o_orderkey", "y": "case when o_orderstatus = 'F' then 1 else 0 end", "split": "case when o_orderkey % 10 < 7 then 'train' else 'test' end"}
_X1 = {"x1": "case when o_orderkey % 11 = 0 then null else o_totalprice end", "c1": "case when o_orderkey % 13 = 0 then null else o_orderpriority end"}
_LINES = {"x2": "case when o_orderkey % 7 = 0 then null else s_quantity end", "x3": "s_discount", "x4": "s_price"}
_SCORES = {
    "m1": "cast(((id * 7919) % 10007) + 2500 * y + 1 as double) / cast(12510 as double)",
    "m2": "cast(((id * 104729) % 89) + 15 * y + 1 as double) / cast(106 as double)",
    "m3": "cast(((id * 1299709) % 10009) + 900 * y + 1 as double) / cast(10912 as double)",
    "m4": "cast(((id * 15485863) % 997) + 60 * (1 - y) + 1 as double) / cast(1060 as double)",
}


def _hours(factor: int, span: int, least: int, every: int) -> str:
    return f"case when id % {every} = 0 then null else cast({least} + ((id * {factor}) % {span}) as double) / cast(100 as double) end"


_HABITS = {
    "age": "case when id % 23 = 0 then null else cast(18 + id % 18 as double) end",
    "daily_screen_time_hours": _hours(37, 901, 300, 8),
    "social_media_hours": _hours(53, 401, 0, 6),
    "gaming_hours": _hours(71, 301, 0, 9),
    "work_study_hours": _hours(97, 551, 50, 12),
    "sleep_hours": _hours(13, 651, 350, 14),
    "notifications_per_day": "case when id % 10 = 3 then null else cast((id * 17) % 240 as double) end",
    "app_opens_per_day": "case when id % 11 = 4 then null else cast((id * 19) % 90 as double) end",
    "weekend_screen_time": _hours(29, 1301, 200, 7),
    "gender": "case when id % 25 = 0 then null when id % 3 = 0 then 'Female' when id % 3 = 1 then 'Male' else 'Other' end",
    "stress_level": "case when id % 15 = 0 then null when id % 4 = 0 then 'Low' when id % 4 = 1 then 'Medium' else 'High' end",
    "academic_work_impact": "case when id % 17 = 0 then null when id % 2 = 0 then 'Yes' else 'No' end",
}


def _list(columns: dict[str, str]) -> list[str]:
    return [f"{x} as {n}" for n, x in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str, lines: bool = False, customers: bool = False) -> DataFrame:
    """id, y, split, x1, c1, m1..m4; ``lines`` adds x2, x3, x4 and ``customers`` c2, each at the price of a join."""
    orders = table(spark, sf_dir, "orders")
    columns = _KEYS | _X1
    if lines:
        sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg({"l_quantity": "sum", "l_discount": "avg", "l_extendedprice": "sum"})
        sums = sums.selectExpr("l_orderkey", "`sum(l_quantity)` as s_quantity", "round(`avg(l_discount)`, 6) as s_discount", "round(`sum(l_extendedprice)`, 2) as s_price")
        orders = orders.join(sums, orders["o_orderkey"] == sums["l_orderkey"], "left")
        columns = columns | _LINES
    if customers:
        own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        orders = orders.join(own, orders["o_custkey"] == own["c_custkey"], "left")
        columns = columns | {"c2": "c_mktsegment"}
    return orders.selectExpr(*_list(columns)).selectExpr("*", *_list(_SCORES))


def train(spark: SparkSession, sf_dir: str, **joins: bool) -> DataFrame:
    """The train rows of :func:`obs` with their folds."""
    return stratified_folds(obs(spark, sf_dir, **joins).where("split = 'train'"), "id", "y")


def habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, split and twelve inputs with gaps, named like those the feature views know."""
    return table(spark, sf_dir, "orders").selectExpr(*_list(_KEYS)).selectExpr("*", *_list(_HABITS))


OBS_SQL = f"""
ln as (select l_orderkey, sum(l_quantity) as s_quantity, round(avg(l_discount), 6) as s_discount, round(sum(l_extendedprice), 2) as s_price from lineitem group by l_orderkey),
obs0 as (select {', '.join(_list(_KEYS | _X1 | _LINES | {'c2': 'c_mktsegment'}))}
  from orders left join ln on o_orderkey = l_orderkey left join customer on o_custkey = c_custkey),
obs as (select *, {', '.join(_list(_SCORES))} from obs0),
train as (select *, cast((row_number() over (order by y, md5(cast(id as varchar) || ':42')) - 1) % 5 as int) as fold from obs where split = 'train'),
habits as (select *, {', '.join(_list(_HABITS))} from (select {', '.join(_list(_KEYS))} from orders))
"""
