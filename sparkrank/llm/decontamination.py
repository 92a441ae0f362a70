"""Benchmark decontamination: spaced-seed hashing, on DataFrame functions alone.

Words are lower-cased runs without white space. A spaced seed is a mask over consecutive words that ignores
some places, so a hash of the others still matches if an ignored word was substituted. Every window of a
document and of a benchmark item is hashed under each mask; windows with equal hashes put the item beside the
document on one diagonal. Items of up to ``SHORT`` words have masks of their own length besides, so many that every
pattern of substitutions that the rule allows leaves the places of one untouched (under five words: the whole item).

Around such hits the item's words are compared with the document's. On a diagonal, words that are the same at
their places form overlaps: at most two other words in a row may stand between them, and an overlap has at
least ``OVERLAP`` of them and ``SIMILARITY`` of its length. The item contaminates the document if

* ``SIMILARITY`` of its words are the same on one diagonal,
* or stand in overlaps on any of its diagonals (a word put in or left out moves what follows to another one),
* or one overlap has ``PASSAGE`` words, whatever the item's length.

Seeds are (hash, item, place) alone; hits are told apart by diagonal before any text is compared, and only
documents with hits are read again. The benchmark's seeds are broadcast up to ``BROADCAST_LIMIT`` rows of 24
bytes, its words and the keys of documents with hits up to as many rows and ``BROADCAST_BYTES``; beyond, the
joins shuffle. All ways give the same rows.

So no substitution that is allowed hides an item of up to ``SHORT`` words; of longer ones only rare patterns could
(none of those tried: all up to 15 words, 20,000 a length up to 60).

Null and empty texts, null items and empty tables give no rows. Texts and items of any length are compared
whole. Repeated rows and ties (several diagonals) give one row per (doc_id, item_id) with the best match. Rows
without doc_id give rows without one; items without item_id likewise. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import documents, hinted, texts, written

#: Places of each mask that count.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 1, 2, 3, 4))
#: Words of an item that has masks of its own at most.
SHORT = 12
SIMILARITY = 0.8
#: Equal words that an overlap has at least, and that make one a passage of its own.
OVERLAP, PASSAGE = 5, 50
#: Places from one equal word of an overlap to the next at most.
STEP = 3
#: Neighbouring diagonals that are compared together.
TOGETHER = 4096
#: Rows and bytes of text that are broadcast at most.
BROADCAST_LIMIT, BROADCAST_BYTES = 1_000_000, 64 << 20


def met(mask: tuple[int, ...], n: int, gone: tuple[int, ...], whole: bool) -> bool:
    """Whether a mask finds an item of ``n`` words with other words at the places ``gone``: at its start, or (not ``whole``) anywhere."""
    return any(not any(at + m in gone for m in mask) for at in range(1 if whole else n - mask[-1]))


@lru_cache
def own_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for items of just ``n`` words beside ``MASKS``: each one the five places (or fewer) that find the most of the patterns not found yet."""
    allowed = n - math.ceil(SIMILARITY * n - 1e-9)
    left = [g for g in itertools.combinations(range(n), allowed) if not any(met(m, n, g, False) for m in MASKS if m[-1] < n)]
    out = []
    while left:
        free = [p for p in range(n) if p not in left[0]]
        out.append(max(itertools.combinations(free, min(5, len(free))), key=lambda mask: sum(met(mask, n, g, True) for g in left)))
        left = [g for g in left if not met(out[-1], n, g, True)]
    return tuple(out)


def words(text: Column) -> Column:
    return F.split(F.trim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def _seeds(df: DataFrame, at: str, masks: list[tuple[tuple[int, ...], int | None]], whole: bool, *keep: str) -> DataFrame:
    """A row per place and mask. ``whole``: masks with a length are hashed at their own place in texts of that length only.
    Places are unfolded before they are hashed, so that hashing and the join that follows are compiled with the
    scan; the arrays are never copied per row."""
    hashed = df.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("_hashes"))
    # The outer form infers no filter on the array's size, which would split and hash every text once more.
    places = hashed.select(*keep, "_hashes", F.posexplode_outer("_hashes").alias(at, "_h"))
    n = F.size("_hashes")
    seeds = []
    for name, length in masks:
        # Only the mask's own places have to be there: an item may begin before a document's first word.
        mask = tuple(place - name[0] for place in name)
        fits = (n == length) & (F.col(at) == name[0]) if whole and length else F.col(at) + mask[-1] < n
        seeds.append(F.when((n > 0) & fits, F.xxhash64(F.lit(repr((name, length))), *[F.get("_hashes", F.col(at) + place) for place in mask])))
    return places.select(*keep, at, F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def decontamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT, id_col: str = "doc_id") -> DataFrame:
    """A row per contaminated document and item: doc_id, item_id, n_words (of the item), n_matched (its words found,
    on one diagonal or in overlaps, whichever are more), n_longest (equal words of the longest overlap) and
    first_word (place in the document of the item's first word on the best diagonal; negative if the item begins
    before the document)."""
    return _found(texts(docs, id_col), benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("_text")), broadcast_limit)


def _found(own: DataFrame, benchmark: DataFrame, limit: int) -> DataFrame:
    items = benchmark.select("item_id", words(F.col("_text")).alias("words")).where("size(words) > 1 or words[0] <> ''").distinct().withColumn("_item", F.xxhash64("item_id", "words"))
    short = sorted(r[0] for r in items.where(F.size("words") <= SHORT).select(F.size("words")).distinct().collect())  # twelve lengths at most
    masks = [*((m, None) for m in MASKS), *((m, n) for n in short for m in own_masks(n))]
    seeds = _seeds(items, "_item_at", masks, True, "_item").select("seed", "_item", "_item_at").distinct()
    keyed = own.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    placed = _seeds(keyed.select("doc_id", "_hash", words(F.col("text")).alias("words")), "_at", masks, False, "doc_id", "_hash")
    met = placed.join(hinted(seeds, limit), "seed")
    hits = written(met.select("doc_id", "_hash", "_item", (F.col("_at") - F.col("_item_at")).alias("_first")).distinct(), "hits")

    # Documents with hits are few; their keys pick them before any text is shuffled. Null ids are keys as well.
    keys = hits.select(F.struct("doc_id", "_hash").alias("_key")).distinct()
    picked = keyed.withColumn("_key", F.struct("doc_id", "_hash")).join(hinted(keys, limit), "_key", "left_semi")
    split = picked.select("_key", words(F.col("text")).alias("_words")).distinct()
    item_bytes = benchmark.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    # A text stands beside thousands of its diagonals at a time, not beside each.
    grouped = hits.groupBy(F.struct("doc_id", "_hash").alias("_key"), "_item", F.floor(F.col("_first") / TOGETHER)).agg(F.collect_list("_first").alias("_firsts")).select("_key", "_item", "_firsts")
    lined = grouped.join(hinted(items, limit) if item_bytes <= BROADCAST_BYTES else items, "_item").join(split, "_key")
    n = F.size("words")
    equal = lambda first: F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.get("words", j) == F.get("_words", j + first))
    compared = F.transform("_firsts", lambda first: F.struct(first.alias("_first"), equal(first).alias("_equal")))
    same = lined.select("_key", "_item", "item_id", n.alias("_n"), F.explode(compared).alias("_c")).select("_key", "_item", "item_id", "_n", "_c._first", "_c._equal")

    whole = same.groupBy("_key", "_item").agg(F.max(F.struct(F.size("_equal").alias("m"), (-F.col("_first")).alias("back"))).alias("_best"), F.max("_n").alias("_n"), F.max("item_id").alias("item_id"))
    # Overlaps: equal words with few others between them, numbered along their diagonal.
    along = Window.partitionBy("_key", "_item", "_first").orderBy("_j")
    rows = same.select("_key", "_item", "_first", F.explode("_equal").alias("_j"))
    rows = rows.withColumn("_new", F.when(F.col("_j") - F.lag("_j").over(along) <= STEP, 0).otherwise(1)).withColumn("_overlap", F.sum("_new").over(along))
    overlap = Window.partitionBy("_key", "_item", "_first", "_overlap")
    rows = rows.withColumns({"_m": F.count("*").over(overlap), "_length": F.max("_j").over(overlap) - F.min("_j").over(overlap) + 1})
    rows = rows.where((F.col("_m") >= OVERLAP) & (F.col("_m") >= SIMILARITY * F.col("_length")))
    joined = rows.groupBy("_key", "_item").agg(F.count_distinct("_j").alias("_covered"), F.max("_m").alias("_longest"))
    both = whole.join(joined, ["_key", "_item"], "left")
    matched, longest = F.greatest(F.col("_best.m").cast("long"), F.coalesce("_covered", F.lit(0))), F.coalesce("_longest", F.lit(0))
    kept = both.select(F.col("_key.doc_id").alias("doc_id"), "item_id", F.col("_n").cast("long").alias("n_words"), matched.alias("n_matched"), longest.alias("n_longest"), (-F.col("_best.back")).cast("long").alias("first_word"))
    kept = kept.where((F.col("n_matched") >= SIMILARITY * F.col("n_words")) | (F.col("n_longest") >= PASSAGE))
    best = kept.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_longest", (-F.col("first_word")).alias("back"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_words", "b.n_matched", "b.n_longest", (-F.col("b.back")).alias("first_word"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All words of all items on all diagonals, without any seed.
OP3_SQL = r"""
with i0 as (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as iw from benchmark),
i as (select row_number() over () as r, item_id, iw, len(iw) as n from i0 where len(iw) > 0),
d0 as (select distinct doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as dw from documents),
d as (select row_number() over () as t, doc_id, dw from d0 where len(dw) > 0),
ia as (select r, n, unnest(range(1, n + 1)) as p, iw as w from i),
da as (select t, len(dw) as n, unnest(range(1, len(dw) + 1)) as p, dw as w from d),
m as (select t, r, da.p - ia.p as f, ia.p as j from da join ia on da.w[da.p] = ia.w[ia.p]),
wh as (select t, r, f, count(*) as s from m group by t, r, f),
wb as (select t, r, s, f from (select *, row_number() over (partition by t, r order by s desc, f) as k from wh) where k = 1),
g as (select *, sum(fresh) over (partition by t, r, f order by j) as o from (select *, case when j - lag(j) over (partition by t, r, f order by j) <= 3 then 0 else 1 end as fresh from m)),
o as (select *, count(*) over (partition by t, r, f, o) as q, max(j) over (partition by t, r, f, o) - min(j) over (partition by t, r, f, o) + 1 as z from g),
u as (select t, r, count(distinct j) as covered, max(q) as longest from o where q >= 5 and q >= 0.8 * z group by t, r),
x as (select d.doc_id, i.item_id, i.n, greatest(wb.s, coalesce(u.covered, 0)) as s, coalesce(u.longest, 0) as longest, wb.f from wb join d on wb.t = d.t join i on wb.r = i.r left join u on u.t = wb.t and u.r = wb.r),
y as (select *, row_number() over (partition by doc_id, item_id order by s desc, longest desc, f, n desc) as k from x where s >= 0.8 * n or longest >= 50)
select doc_id, item_id, n::bigint as n_words, s::bigint as n_matched, longest::bigint as n_longest, f::bigint as first_word from y where k = 1
"""
