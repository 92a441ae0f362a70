"""Hard-negative mining: exact searches by inner product over the inverted lists of a k-means, cut short by bounds.

Vectors are quantised, and clustered by centroids learned on a bounded sample; every row is in the list of its nearest
centroid, and lists are dealt into blocks of a bounded size. A list keeps its centroid and its radius, the largest
distance from the centroid in it. By Cauchy and Schwarz no row of it scores outside a.c - |a| r to a.c + |a| r with an
anchor a. An anchor visits lists by falling upper bound, skips those whose bounds miss its window of scores, and stops
when the upper bound falls strictly below its k-th score so far. Visits go in rounds, a few lists, then more, then the
rest; after each round every anchor's k-th score is known. What a list's block and the anchors that visit it are, one
task multiplies: about ``BLOCK`` components by ``ANCHORS`` anchors. So the result is that of comparing all.

Centroids and radii, at most ``LISTS`` rows, are the only things broadcast; the sample of ``SAMPLE`` rows is what the
driver gets. The bounds hold whatever the centroids are; the sample only decides how tight they are.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part. Quantised
components are cut off at 2**26, so that scores of up to 1,024 dimensions are longs. A shorter vector counts as filled
up with zeros. Equal rows count once; rows that share an id but nothing else are rows of their own, and no partners of
each other. A null id is no anchor and comes last among ties. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, tidy, written

POSITIVES, NEGATIVES = 5, 10
#: Of the positive's score: a negative's is from LOW to HIGH hundredths of it.
LOW, HIGH = 30, 90
LISTS, SAMPLE, STEPS = 512, 16_384, 8
BLOCK, ANCHORS = 1 << 20, 2_048
#: Lists that an anchor has visited at most after each round but the last.
ROUNDS = (4, 32)
LIMIT = 1 << 26

#: Within float64 sums of products below this are exact.
EXACT = 1 << 53


def quantised(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """(id, label, v array<int>, row) of the rows that take part; ``row`` tells rows apart that share an id."""
    x = F.transform(F.col("embedding"), lambda e: F.floor(F.greatest(F.least(e.cast("double") * 256, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    own = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    label = F.col("label") if relabel is None else relabel
    own = own.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v")).distinct()
    return own.withColumn("row", F.xxhash64("id", "label", "v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    n = np.diff(offsets)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], n)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two integral matrices: by floats where these are exact."""
    most = (np.abs(a).max(initial=0.0)) * (np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    return (a @ b.T).astype(np.int64) if most < EXACT else a.astype(np.int64) @ b.astype(np.int64).T


def centroids(sample: np.ndarray, count: int, steps: int = STEPS, seed: int = 1) -> np.ndarray:
    """Plain k-means on the sample."""
    rng = np.random.default_rng(seed)
    own = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)].copy()
    for _ in range(steps):
        near = _nearest(sample, own)[0]
        sums = np.zeros_like(own)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(own))
        own[n > 0] = sums[n > 0] / n[n > 0, None]
    return own


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for k in range(0, len(x), 4096):
        near[k : k + 4096] = (x[k : k + 4096] @ c.T - half).argmax(1)
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


INDEX = {"id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int32()), "row": pa.int64(), "list": pa.int64(), "far": pa.float64()}


def _assign(c: np.ndarray, batches):
    for b in batches:
        if b.num_rows:
            near, far = _nearest(matrix(b.column("v"), c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([*(b.column(x).cast(INDEX[x]) for x in ("id", "label", "v", "row")), pa.array(near), pa.array(far)], schema=pa.schema(list(INDEX.items())))


class Lists:
    """The inverted lists: ``rows(id, label, v, row, list, block)`` written, and centroids, radii and blocks of each list."""

    def __init__(self, own: DataFrame, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK):
        spark = own.sparkSession
        own = written(own, "vectors")
        size, width = own.agg(F.count("*"), F.max(F.size("v"))).first()
        self.size, self.width = size, max(1, width or 0)
        picked = own.orderBy(F.xxhash64("row")).limit(sample).select("v").toArrow().column("v")  # bounded
        learned = matrix(picked, self.width) if len(picked) else np.zeros((1, self.width))
        self.c = centroids(learned, max(1, min(lists, round(size**0.5))))
        rows = written(own.mapInArrow(tidy(partial(_assign, self.c)), ddl(INDEX)), "index")
        found = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()  # a row per list, at most ``lists``
        self.n, self.radius = np.zeros(len(self.c), np.int64), np.zeros(len(self.c))
        for x in found:
            self.n[x["list"]], self.radius[x["list"]] = x["n"], x["r"]
        self.blocks = -(-self.n // max(1, block // self.width))
        parts = spark.createDataFrame([(k, int(b)) for k, b in enumerate(self.blocks)], "list long, blocks long")
        self.rows = rows.join(F.broadcast(parts), "list").withColumn("block", F.pmod("row", F.greatest("blocks", F.lit(1)))).drop("blocks", "far")

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No score of a list's row with an anchor is outside; a little wider than in theory, as floats round."""
        middle, reach = a @ self.c.T, np.sqrt((a * a).sum(1))[:, None] * self.radius * (1 + 1e-9) + 1e-3
        slack = 1e-9 * np.abs(middle)
        return middle - reach - slack, middle + reach + slack


#: An anchor on its way to one block of one list. ``goals``: the positives' scores whose windows are open to the list;
#: ``least``: the k-th score of each so far. Rows that score less are not sent out.
VISIT = {"list": pa.int64(), "block": pa.int64(), "part": pa.int64(), "anchor": pa.int64(), "id": pa.int64(), "label": pa.int64(), "v": pa.list_(pa.int32()), "goals": pa.list_(pa.int64()), "least": pa.list_(pa.int64())}
FLOOR = -(1 << 63)


def _windows(goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest integer score in the window of a positive's score."""
    return -(-LOW * goal // 100), HIGH * goal // 100


def _visits(c, radius, n, blocks, width, parts, since, until, windowed, batches):
    lists = Lists.__new__(Lists)
    lists.c, lists.radius = c, radius
    for b in batches:
        for k in range(0, b.num_rows, 1024):
            own = b.slice(k, 1024)
            a = matrix(own.column("v"), width)
            low, high = lists.bounds(a)
            goals, least = own.column("goals").to_pylist(), own.column("kth").to_pylist()
            rows: dict[str, list] = {x: [] for x in ("list", "block", "at", "goals", "least")}
            for i in range(own.num_rows):
                open_to, reached = np.zeros((len(goals[i]), len(c)), bool), np.zeros(len(c), bool)
                for j, (goal, kth) in enumerate(zip(goals[i], least[i], strict=True)):
                    lo, hi = _windows(np.int64(goal)) if windowed else (-np.inf, np.inf)
                    inside = (low[i] <= hi) & (high[i] >= lo) & (lo <= hi) & (n > 0)
                    reached |= inside
                    open_to[j] = inside & (np.minimum(high[i], hi) >= (-np.inf if kth is None else kth))
                order = np.argsort(-high[i], kind="stable")
                may = order[reached[order]]  # lists outside all windows take no place among those to visit
                for x in may[since:until]:
                    wanted = np.flatnonzero(open_to[:, x])
                    if len(wanted):
                        for block in range(blocks[x]):
                            rows["list"].append(x)
                            rows["block"].append(block)
                            rows["at"].append(i)
                            rows["goals"].append([goals[i][j] for j in wanted])
                            rows["least"].append([FLOOR if least[i][j] is None else least[i][j] for j in wanted])
            at = pa.array(rows["at"], pa.int64())
            anchor = own.column("row").take(at)
            part = np.abs(anchor.to_numpy()) % parts
            for s in range(0, len(at), 4096):
                sl = slice(s, s + 4096)
                take = at[sl]
                yield pa.RecordBatch.from_arrays([pa.array(rows["list"][sl], pa.int64()), pa.array(rows["block"][sl], pa.int64()), pa.array(part[sl], pa.int64()), anchor[sl], *(own.column(x).take(take).cast(VISIT[x]) for x in ("id", "label", "v")), *(pa.array(rows[x][sl], VISIT[x]) for x in ("goals", "least"))], schema=pa.schema(list(VISIT.items())))


FOUND = {"anchor": pa.int64(), "anchor_id": pa.int64(), "goal": pa.int64(), "id": pa.int64(), "row": pa.int64(), "score": pa.int64()}


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by falling score, then by id (rows come in order of id)."""
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > cut)
        return np.r_[above, np.flatnonzero(score == cut)[: k - len(above)]]
    return np.arange(len(score))


def _compare(width, k, windowed, _key, visits: pa.Table, rows: pa.Table) -> pa.Table:
    """A block's rows against the anchors that visit it: the first k of each anchor and window."""
    out: dict[str, list] = {x: [] for x in FOUND}
    if visits.num_rows and rows.num_rows:
        ids = rows.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        row, label = rows.column("row").to_numpy(), rows.column("label").to_numpy()
        order = np.lexsort((row, ids))
        b = matrix(rows.column("v"), width)[order]
        ids, row, label = ids[order], row[order], label[order]
        v_id, v_label, v_anchor = (visits.column(x).to_numpy() for x in ("id", "label", "anchor"))
        goals, least = (visits.column(x).to_pylist() for x in ("goals", "least"))
        for s in range(0, visits.num_rows, 256):
            score = products(matrix(visits.column("v").slice(s, 256), width), b)
            for i in range(len(score)):
                at = s + i
                mine = np.flatnonzero(label != v_label[at] if windowed else (label == v_label[at]) & (ids != v_id[at]))
                values = score[i, mine]
                for goal, kth in zip(goals[at], least[at], strict=True):
                    lo, hi = _windows(np.int64(goal)) if windowed else (FLOOR, -FLOOR - 1)
                    inside = np.flatnonzero((values >= max(lo, kth)) & (values <= hi))
                    best = mine[inside[_best(values[inside], k)]]
                    for name, x in (("anchor", np.full(len(best), v_anchor[at])), ("anchor_id", np.full(len(best), v_id[at])), ("goal", np.full(len(best), goal)), ("id", ids[best]), ("row", row[best]), ("score", score[i, best])):
                        out[name].append(x)
    return pa.table([pa.array(np.concatenate(out[x]) if out[x] else np.empty(0, np.int64), t) for x, t in FOUND.items()], schema=pa.schema(list(FOUND.items())))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and goal: a few from each block come together."""
    order = Window.partitionBy("anchor", "anchor_id", "goal").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(lists: Lists, anchors: DataFrame, k: int, windowed: bool, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(anchor, anchor_id, goal, id, row, score, rank) of the first k partners of each of ``anchors(row, id, label, v, goals)``: with ``windowed``
    rows of other labels in the window of each goal, else other rows of the label (goals: one that means nothing)."""
    parts = max(1, -(-anchors.count() // ANCHORS))
    spark, found, since = anchors.sparkSession, None, 0
    for until in (*rounds, len(lists.c)):
        if until <= since:
            continue
        if found is None:
            state = anchors.withColumn("kth", F.transform("goals", lambda g: F.lit(None).cast("long")))
        else:  # the k-th score of each goal, null where fewer are known
            kth = found.where(F.col("rank") == k).groupBy("anchor", "anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("goal", "score"))).alias("_kth"))  # as many as goals
            state = anchors.join(kth, (anchors["row"] == kth["anchor"]) & (anchors["id"] == kth["anchor_id"]), "left").withColumn("kth", F.transform("goals", lambda g: F.try_element_at("_kth", g)))
        fn = partial(_visits, lists.c, lists.radius, lists.n, lists.blocks, lists.width, parts, since, until, windowed)
        visits = written(state.select("row", "id", "label", "v", "goals", "kth").mapInArrow(tidy(fn), ddl(VISIT)), "visits")
        asked = visits.select(F.col("list").alias("_list"), F.col("block").alias("_block"), F.col("part").alias("_part")).distinct()
        rows = lists.rows.join(asked, (F.col("list") == F.col("_list")) & (F.col("block") == F.col("_block"))).drop("list", "block")
        more = visits.groupBy("list", "block", "part").cogroup(rows.groupBy("_list", "_block", "_part")).applyInArrow(partial(_compare, lists.width, k, windowed), ddl(FOUND))
        more = more if found is None else more.unionByName(found.drop("rank"))
        found, since = written(_first(more, k), "found"), until
    return found if found is not None else spark.createDataFrame([], ddl(FOUND) + ", rank int")


def hard_negatives(rows: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, lists: int = LISTS, sample: int = SAMPLE, block: int = BLOCK, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``rows(vec_id, label, embedding)``;
    ``is_anchor`` is asked of the column ``id``, ``relabel`` of the rows as they are."""
    index = Lists(quantised(rows, relabel), lists, sample, block)
    anchors = written(index.rows.where(is_anchor).select("row", "id", "label", "v"), "anchors")
    near = search(index, anchors.withColumn("goals", F.array(F.lit(0).cast("long"))), positives, False, rounds)
    pairs = near.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    goals = pairs.groupBy("anchor", "anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("goals"))  # as many as positives
    asking = written(anchors.join(goals, (anchors["row"] == goals["anchor"]) & (anchors["id"] == goals["anchor_id"])).select("row", "id", "label", "v", "goals"), "asking")
    hard = search(index, asking, negatives, True, rounds)
    hard = hard.select("anchor", "anchor_id", F.col("goal").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.join(hard, ["anchor", "anchor_id", "positive_score"])
    known = lambda c: F.when(F.col(c) < F.lit((1 << 63) - 1), F.col(c)).alias(c)  # noqa: E731  null ids come last as the largest
    return out.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0, relabel)


OP12_SQL = """
with e as (select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
