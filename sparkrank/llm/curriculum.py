"""Mixing sources to target weights by a curriculum that changes over training time.

Each source has a share of the words to be trained on and a schedule, its rate of words over training time from 0 to 1
(piecewise linear). The schedule's integral up to a time, scaled to the source's target, is its demand so far. The
documents of a source stand in an order of their own (a digest of id, size and seed), pass after pass; where a document
starts on that line of words, the inverse of the demand gives the time at which training gets there: its position.
Documents sorted by position, range by range, are the mix. The one at which the target is reached gives its first words.

No task sums up a source: words are summed by digits of the digest, the sums accumulated in two steps (256 and 4096 at
most at a time), and only what shares five digits is ordered. Rows that are equal are one row with a count until the end.

Defined cases: a null text or one without words has size 0, is never taken and has no position; a null source is one
of its own, after all others; null and repeated ids are rows like others, ties go by id and size and can't change the
rows as a whole; an empty table gives none. Other columns are ignored, whatever their names. Whole texts are counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import documents, hinted, written

#: Of the sources in order of code points, repeating; all targets together, and each source's at most, in passes.
WEIGHTS, SHARE, PASSES = (3.0, 1.0, 2.0), 1.5, 2.0
#: (time, rate) from time 0 to 1, repeating like the weights: less and less, as much all the time, more and more.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SEED = "mix-1"
#: Sources whose row is broadcast at most.
FEW_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Words of a text: its white space shrunk to single blanks, which are counted by length."""
    own = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(own == "", F.lit(0)).otherwise(F.octet_length(own) - F.octet_length(F.replace(own, F.lit(" "))) + 1).cast("long")


def numbered(df: DataFrame, col: str) -> DataFrame:
    """Adds ``_rank``, 0.. by ``col`` with nulls last, over ranges of it."""
    order = F.col(col).asc_nulls_last()
    dealt = written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()), "ranges")
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("_rank", (F.col("_start") + inside - 1).cast("long")).drop("_part", "_start")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """(source, _rank, source_size, weight, target) of ``sizes(source, size)``: ``share`` of all words dealt by weight, no target
    above ``passes`` times its source, the excess dealt again among the others. Only sums come to the driver."""
    own = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    own = written(own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))), "sources")
    most = passes * F.col("source_size")
    whole = own.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (whole[0] or 0), 0.0
    full, rest = 0.0, whole[1] or 0.0
    while rest > 0:  # full sources leave more to the others, which may fill up in turn
        before, level = level, (budget - full) / rest
        if level <= before:
            break
        above = F.col("weight") * level >= most
        full, rest = (x or 0.0 for x in own.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first())
    return own.withColumn("target", F.least(F.col("weight") * F.lit(level if rest > 0 else math.inf), most))


def inverse_demand(part: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a piecewise linear rate has reached ``part`` of its whole."""
    areas = [0.0]
    for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (t1 - t0) * (r0 + r1) / 2)
    if min(r for _, r in knots) < 0 or areas[-1] <= 0 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError(f"a schedule runs from time 0 to 1 with rates of at least 0, not all of them 0: {knots}")
    want, out = part * areas[-1], F.lit(1.0)
    for k in reversed(range(len(knots) - 1)):
        (t0, r0), (t1, r1) = knots[k], knots[k + 1]
        if areas[k + 1] > areas[k]:
            here = F.greatest(want - areas[k], F.lit(0.0))
            root = r0 + F.sqrt(F.greatest(F.lit(r0 * r0) + here * (2 * (r1 - r0) / (t1 - t0)), F.lit(0.0)))
            out = F.when(want < areas[k + 1], t0 + F.when(root > 0, 2 * here / root).otherwise(0.0)).otherwise(out)
    return out


def _before(rows: DataFrame) -> DataFrame:
    """Adds ``_before``: the words of a source's rows (k, key, doc_id, size, n) earlier in its order."""
    rows = rows.withColumns({"_a": F.substring("key", 1, 2), "_b": F.substring("key", 3, 3)})
    fine = rows.groupBy("k", "_a", "_b").agg(F.sum(F.col("size") * F.col("n")).alias("_s"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("k", "_a").agg(F.sum("_s").alias("_c")).select("k", "_a", F.coalesce(F.sum("_c").over(earlier.partitionBy("k").orderBy("_a")), F.lit(0)).alias("_c"))
    fine = fine.withColumn("_s", F.coalesce(F.sum("_s").over(earlier.partitionBy("k", "_a").orderBy("_b")), F.lit(0)))
    starts = fine.join(coarse, ["k", "_a"]).select("k", "_a", "_b", (F.col("_s") + F.col("_c")).alias("_s"))
    inside = earlier.partitionBy("k", "_a", "_b").orderBy("key", "doc_id", "size")
    return rows.join(starts, ["k", "_a", "_b"]).withColumn("_before", F.col("_s") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))).drop("_a", "_b", "_s")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = SHARE, passes: float = PASSES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, weight, target, taken, position (of its first words; null
    if none are taken) and pieces (epoch from 0, words, position), in ranges of position."""
    sizes = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = source_targets(sizes, weights, share, passes).select(F.col("source").alias("_source"), F.col("_rank").alias("k"), "source_size", "weight", "target")
    equal = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    rows = equal.join(hinted(sources, FEW_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.lit(seed))))
    rows = _before(rows).withColumn("_copy", F.explode(F.expr("sequence(0L, n - 1)")))
    start, goal = F.col("_before") + F.col("_copy") * F.col("size"), F.floor(F.col("target") + 0.5)

    def piece(epoch: int) -> Column:
        at = start + epoch * F.col("source_size")
        part = at / F.greatest(F.col("target"), F.lit(1.0))
        time = F.coalesce(*[F.when(F.col("k") % len(schedules) == j, inverse_demand(part, s)) for j, s in enumerate(schedules)])
        return F.struct(F.lit(epoch).alias("epoch"), F.greatest(F.least(F.col("size"), goal - at), F.lit(0)).cast("long").alias("words"), time.alias("position"))

    pieces = F.filter(F.array(*[piece(e) for e in range(math.ceil(passes))]), lambda p: p["words"] > 0)
    placed = rows.select("doc_id", "source", "size", "source_size", "weight", "target", pieces.alias("pieces"))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    placed = written(placed.select("doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"), F.get("pieces", F.lit(0))["position"].alias("position"), "pieces"), "placed")
    order = [F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("size")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mix: DataFrame) -> DataFrame:
    """What is trained on, in order: (position, doc_id, source, epoch, words); a document twice if two passes take it."""
    each = mix.select("doc_id", "source", F.explode("pieces").alias("p")).select("p.position", "doc_id", "source", "p.epoch", "p.words")
    return each.repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")


def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("position", 6).alias("position"))


#: Targets by sources sorted by size against weight, the order in which they fill up; positions by each schedule's own formula.
OP13_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size) as ss, (row_number() over (order by source nulls last) - 1) % 3 as k from d group by source),
w as (select *, case k when 0 then 3 when 1 then 1 else 2 end::double as w from s),
f as (select *, row_number() over (order by ss / w, source nulls last) as j, coalesce(sum(2 * ss) over (order by ss / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_, sum(w) over (order by ss / w, source nulls last rows between current row and unbounded following) as rest from w),
l as (select min_by((1.5 * (select sum(ss) from s)::double - full_::double) / rest, j) as level from f where (1.5 * (select sum(ss) from s)::double - full_::double) / rest * w <= 2 * ss),
t as (select source, ss, k, least(w * level, 2 * ss::double) as target from w, l),
p as (select doc_id, size, ss, k, target, coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, 'null') || ':' || size || ':mix-1'), doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as c from d join t on d.source is not distinct from t.source),
q as (select *, greatest(least(size, floor(target + 0.5) - c), 0)::bigint as one, greatest(least(size, floor(target + 0.5) - c - ss), 0)::bigint as two, c / greatest(target, 1.0) as x from p)
select doc_id, size, ss::bigint as source_size, round(target, 3) as target, (one + two)::bigint as taken,
round(case when one = 0 then null when k = 0 then 1.5 - sqrt(2.25 - 2 * x) when k = 1 then x else sqrt(0.25 + 2 * x) - 0.5 end, 6) as position from q
"""
