"""Late session merging: versions of sessions as batches of late events come in, over a segment tree of the time axis.

The axis of each user is cut into blocks, ``fan`` blocks into the next larger one, and so on up to one that holds
all: a tree whose nodes are (user, block). A task works on whole nodes. Inside one, a segment tree has a leaf for each
second with an event; a node of it summarises its active leaves by their extents, by the islands at its two edges (runs
of neighbours at most ``gap`` apart) and by the islands' counts, and two summaries merge into one. Batch after batch the
new leaves are activated, and from each of them the search goes outward over the adjoining nodes, as far as islands
reach, which gives the session's bounds and counts.

A session further than ``gap`` from both edges of its block can't meet another block: its versions are final there.
Of the others, the edge islands, only their versions go up to the block above, where each is one leaf. So no task holds
a user's axis, however long: it gets a block of seconds, or a few islands a block below.

Defined cases: a row without user, time or batch takes no part. Events of one second, user and batch are counted before
they are shuffled; repeated rows are events of their own. Ties in time share a session. An empty table gives no rows.
Other columns are ignored, whatever their names. Texts are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, tidy, written

GAP = 240
#: Seconds in a block of the lowest level; so many blocks make one of the next.
BLOCK, FAN = 16_384, 32
#: Rows that a task takes up at a time, in whole nodes.
CHUNK = 50_000

#: kind 0: the version of an edge island, for the level above. kind 1: a version of a session; ``final`` unless the
#: session that retracts it is still open, then (r_batch, r_start) say which that is.
COLUMNS = {"user": pa.int64(), "final": pa.bool_(), "kind": pa.int64(), "batch": pa.int64(), "start": pa.int64(), "end": pa.int64(), "n": pa.int64(), "h": pa.int64(), "n_new": pa.int64(), "retracted": pa.int64(), "r_batch": pa.int64(), "r_start": pa.int64()}


class Islands:
    """A segment tree over leaves in order of group and start. A leaf is a span of time with counts, active or not.
    ``first`` and ``last`` are a node's outermost active leaves (-1: none), ``left`` the last leaf of its left-edge
    island and ``right`` the first leaf of its right-edge island, with the counts of both."""

    def __init__(self, group: np.ndarray, start: np.ndarray, gap: int):
        self.group, self.start, self.end, self.gap = group, start, start.copy(), gap
        self.size = 1 << max(1, int(len(start) - 1).bit_length())
        self.first, self.last, self.left, self.right = (np.full(2 * self.size, -1) for _ in range(4))
        self.left_n, self.left_h, self.right_n, self.right_h = (np.zeros(2 * self.size, np.int64) for _ in range(4))

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether leaf ``a`` and the next active leaf ``b`` share an island."""
        return (self.group[a] == self.group[b]) & (self.start[b] - self.end[a] <= self.gap)

    def put(self, leaves: np.ndarray, end: np.ndarray, n: np.ndarray, h: np.ndarray) -> None:
        at = leaves + self.size
        self.end[leaves] = end
        for x in (self.first, self.last, self.left, self.right):
            x[at] = leaves
        for x, v in ((self.left_n, n), (self.right_n, n), (self.left_h, h), (self.right_h, h)):
            x[at] = v

    def clear(self, leaves: np.ndarray) -> None:
        at = leaves + self.size
        for x in (self.first, self.last, self.left, self.right):
            x[at] = -1
        for x in (self.left_n, self.right_n, self.left_h, self.right_h):
            x[at] = 0

    def merge_above(self, leaves: np.ndarray) -> None:
        at = np.unique((leaves + self.size) >> 1)
        while at[0]:
            a, b = 2 * at, 2 * at + 1
            no_a, no_b = self.first[a] < 0, self.first[b] < 0
            both = ~no_a & ~no_b
            meet = both & self.joined(self.last[a], self.first[b])
            self.first[at] = np.where(no_a, self.first[b], self.first[a])
            self.last[at] = np.where(no_b, self.last[a], self.last[b])
            through = meet & (self.left[a] == self.last[a])  # the left child is one island, which goes on
            self.left[at] = np.where(no_a | through, self.left[b], self.left[a])
            for x in (self.left_n, self.left_h):
                x[at] = np.where(no_a, x[b], x[a] + np.where(through, x[b], 0))
            through = meet & (self.right[b] == self.first[b])
            self.right[at] = np.where(no_b | through, self.right[a], self.right[b])
            for x in (self.right_n, self.right_h):
                x[at] = np.where(no_b, x[a], x[b] + np.where(through, x[a], 0))
            at = np.unique(at >> 1)

    def around(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first leaf, last leaf, n, h) of the islands of active leaves: outward over the adjoining nodes, each larger
        than the one before, until one has a gap."""
        at, low, high = leaves + self.size, leaves.copy(), leaves.copy()
        n, h = self.left_n[at].copy(), self.left_h[at].copy()
        goes = [np.ones(len(leaves), bool), np.ones(len(leaves), bool)]
        while at.size and at[0] > 1:
            beside = at ^ 1
            full = self.first[beside] >= 0
            for side in (0, 1):  # to the left of a right child, to the right of a left child
                look = np.flatnonzero(goes[side] & full & ((at & 1) == 1 - side))
                x = beside[look]
                meet = self.joined(self.last[x], low[look]) if side == 0 else self.joined(high[look], self.first[x])
                goes[side][look[~meet]] = False
                look, x = look[meet], x[meet]
                if side == 0:
                    low[look], whole = self.right[x], self.right[x] == self.first[x]
                    n[look] += self.right_n[x]
                    h[look] += self.right_h[x]
                else:
                    high[look], whole = self.left[x], self.left[x] == self.last[x]
                    n[look] += self.left_n[x]
                    h[look] += self.left_h[x]
                goes[side][look[~whole]] = False
            at = at >> 1
        return low, high, n, h


def _grouped_sum(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, index, values)
    return out


def versions(cols: dict[str, np.ndarray], gap: int, width: int, origin: int, lowest: bool) -> dict[str, np.ndarray]:
    """The rows of whole nodes (user, block), sorted by them, to versions: see ``COLUMNS``."""
    new_group = np.r_[True, (np.diff(cols["user"]) != 0) | (np.diff(cols["block"]) != 0)]
    group = np.cumsum(new_group) - 1
    floor = (origin + cols["block"] * width)[new_group]
    own = np.flatnonzero(cols["kind"] == 0)
    own = own[np.lexsort((cols["start"][own], cols["batch"][own], group[own]))]
    g, batch, start, end = group[own], cols["batch"][own], cols["start"][own], cols["end"][own]
    if not len(own):
        raise ValueError("a version waits for an island that isn't there")
    by = np.lexsort((start, g))
    fresh = np.r_[True, (np.diff(g[by]) != 0) | (np.diff(start[by]) != 0)]
    leaf = np.empty(len(own), np.int64)
    leaf[by] = np.cumsum(fresh) - 1
    tree = Islands(g[by][fresh], start[by][fresh], gap)
    turn = np.cumsum(np.r_[True, (np.diff(g) != 0) | (np.diff(batch) != 0)]) - 1
    step = turn - turn[np.searchsorted(g, g)]  # batches of a node from 0
    order = np.argsort(step, kind="stable")
    cuts = np.searchsorted(step[order], np.arange(step.max() + 2))
    times = np.unique(tree.start)
    spot = lambda gs, at, side: gs * (len(times) + 1) + np.searchsorted(times, at, side)
    places = spot(tree.group, tree.start, "left")
    beyond = lambda gs, at: np.searchsorted(places, spot(gs, at, "right"), "left")  # noqa: E731  the first leaf of a group after a time
    inner = beyond(g, end)  # leaves up to there that an island's span holds are in its place from now on
    of_item = np.empty(len(own), np.int64)
    standing, ids, made, found = np.empty(0, np.int64), np.empty(0, np.int64), 0, []
    by_version = np.empty(0, np.int64)  # who retracts a version
    for k in range(len(cuts) - 1):
        now = order[cuts[k] : cuts[k + 1]]
        touched = leaf[now]
        if lowest:
            n, h = (x[touched + tree.size] for x in (tree.left_n, tree.left_h))
            tree.put(touched, tree.end[touched], n + cols["n"][own[now]], h + cols["h"][own[now]])
        else:
            inside = np.zeros(len(tree.start) + 1, np.int64)
            np.add.at(inside, touched + 1, 1)
            np.add.at(inside, np.maximum(inner[now], touched + 1), -1)
            gone = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & (tree.first[tree.size : tree.size + len(tree.start)] >= 0))
            tree.clear(gone)
            tree.put(touched, end[now], cols["n"][own[now]], cols["h"][own[now]])
            touched = np.r_[touched, gone]
        tree.merge_above(touched)
        low, high, n, h = tree.around(leaf[now])
        session, at, back = np.unique(low, return_index=True, return_inverse=True)
        last, new = high[at], made + np.arange(len(session))
        of_item[now] = new[back]
        lo, hi = np.searchsorted(standing, session, "left"), np.searchsorted(standing, beyond(tree.group[last], tree.end[last]), "left")
        taken = np.repeat(np.arange(len(session)), hi - lo)
        out = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(len(taken))
        by_version = np.r_[by_version, np.full(len(session), -1)]
        by_version[ids[out]] = new[taken]
        keep = np.ones(len(standing), bool)
        keep[out] = False
        standing, ids = np.r_[standing[keep], session], np.r_[ids[keep], new]
        sort = np.argsort(standing, kind="stable")
        standing, ids = standing[sort], ids[sort]
        item = own[now]
        found.append((tree.group[session], batch[now][at], tree.start[session], tree.end[last], n[at], h[at], _grouped_sum(back, cols["n_new"][item], len(session)), _grouped_sum(back, cols["retracted"][item], len(session))))
        made += len(session)
    vg, vb, vs, ve, vn, vh, v_new, swallowed = (np.concatenate(x) for x in zip(*found, strict=True))
    opened = (vs - floor[vg] + 1 <= gap) | (floor[vg] + width - ve <= gap)
    gone = by_version >= 0
    shut = np.flatnonzero(gone & ~opened)
    np.add.at(swallowed, by_version[shut], 1)  # an open one that goes is counted above, where it stands for a session
    user = cols["user"][new_group]
    none = np.int64(0)
    rows = {
        "user": user[vg], "kind": np.where(opened, 0, 1), "batch": vb, "start": vs, "end": ve, "n": vn, "h": vh, "n_new": v_new, "retracted": swallowed,
        "final": ~opened & (~gone | ~opened[by_version]), "gone": ~opened & gone, "r_batch": np.where(gone, vb[by_version], none), "r_start": np.where(gone, vs[by_version], none),
    }
    waits = np.flatnonzero(cols["kind"] == 1)
    if len(waits):
        place = lambda gs, b, s: (gs * len(batches) + np.searchsorted(batches, b)) * len(starts) + np.searchsorted(starts, s)
        batches, starts = np.unique(batch), np.unique(start)
        keys = place(g, batch, start)
        v = of_item[np.searchsorted(keys, place(group[waits], cols["r_batch"][waits], cols["r_start"][waits]))]
        more = {c: cols[c][waits] for c in ("user", "kind", "batch", "start", "end", "n", "h", "n_new", "retracted", "r_batch")} | {"final": ~opened[v], "gone": np.ones(len(waits), bool), "r_start": vs[v]}
        rows = {c: np.r_[x, more[c]] for c, x in rows.items()}
    return rows


def _level(gap: int, width: int, origin: int, lowest: bool):
    kinds = pa.schema(list(COLUMNS.items()))

    def made(rows: pa.Table):
        cols = {c: rows.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in rows.column_names}
        out = versions(cols, gap, width, origin, lowest)
        arrays = [pa.array(out[c], t, mask=~out["gone"]) if c in ("r_batch", "r_start") else pa.array(out[c], t) for c, t in COLUMNS.items()]
        yield from pa.table(arrays, schema=kinds).to_batches(max_chunksize=CHUNK)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            rows = pa.Table.from_batches(held)
            user, block = (rows.column(c).to_numpy() for c in ("user", "block"))
            # whole nodes only; the last one may go on
            cut = int(np.flatnonzero((user != user[-1]) | (block != block[-1]))[-1]) + 1 if user[0] != user[-1] or block[0] != block[-1] else 0
            if cut:
                yield from made(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield from made(rows)

    return tidy(run)


def late_sessions(events: DataFrame, gap: int = GAP, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Every version of every session of ``events(user, t, batch, h)``, all long: user, batch, start_s, end_s, n_events,
    n_new, n_retracted, h_sum, retracted_batch, retracted_start_s. Versions that were never retracted have null in the last two."""
    spark = events.sparkSession
    own = events.where("user is not null and t is not null and batch is not null")
    own = own.groupBy("user", "t", "batch").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    work = written(own.select("user", F.lit(0).cast("long").alias("kind"), "batch", F.col("t").alias("start"), F.col("t").alias("end"), "n", "h", F.col("n").alias("n_new"), F.lit(0).cast("long").alias("retracted"), F.lit(None).cast("long").alias("r_batch"), F.lit(None).cast("long").alias("r_start")), "events")
    ends = work.agg(F.min("start"), F.max("end")).first()
    origin, most = (ends[0] - gap - 1, ends[1]) if ends[0] is not None else (0, 0)
    width, done = block, []
    while True:
        at = F.when(F.col("kind") == 0, F.col("start")).otherwise(F.col("r_start"))
        placed = work.drop("final").withColumn("block", _block(at, origin, width))
        dealt = placed.repartition("user", "block").sortWithinPartitions("user", "block")
        out = written(dealt.mapInArrow(_level(gap, width, origin, not done), ddl(COLUMNS)), "sessions")
        done.append(out.where("final"))
        if origin + width > most + gap:  # one block holds all
            break
        work = out.where("not final")
        if work.isEmpty():
            break
        width *= fan
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select("user", "batch", F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.col("n").alias("n_events"), "n_new", F.col("retracted").alias("n_retracted"), F.col("h").alias("h_sum"), F.col("r_batch").alias("retracted_batch"), F.col("r_start").alias("retracted_start_s"))


def _block(at: Column, origin: int, width: int) -> Column:
    """Which block of ``width`` seconds after ``origin``, which lies before all."""
    return F.call_function("div", at - F.lit(origin), F.lit(width)) if width < 1 << 62 else F.lit(0).cast("long")


def conversation_events(talks: DataFrame) -> DataFrame:
    """(user, t, batch, h) of the turns of ``talks(conv_id, turn)``, as the contract derives them. Rows without a turn or
    a conversation, and turns beyond 2**52, which no time axis of seconds in a long has room for, take no part."""
    own = talks.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn")).where(F.col("conv").isNotNull() & F.col("turn").between(-(1 << 52), 1 << 52))
    own = own.withColumn("c", F.crc32(F.col("conv").cast("string"))).withColumn("h", F.crc32(F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string"))))
    g = F.expr("h div 600")
    t = F.expr("(c div 2) % 7200 + 300 * turn + h % 600")
    batch = F.expr("(t - pmod(t, 1800L)) div 1800") + F.when(F.col("g") % 5 == 0, F.col("g") % 4).otherwise(0)
    return own.withColumns({"g": g, "t": t}).select((2 * F.shiftright("conv", 3) + F.col("c") % 2).alias("user"), "t", batch.alias("batch"), "h")


def op11_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions(conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: crc32 by its table of 256 values, worked out here too; then, batch by batch, a user's sessions by gaps.
OP11_SQL = """
with recursive crc_steps as (select i as byte, i::bigint as c, 0 as k from range(256) r(i) union all select byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8),
tab as (select list(c order by byte) as m from crc_steps where k = 8),
e0 as (select conv_id, turn, conv_id::varchar as a, conv_id::varchar || ':' || turn::varchar as b from conversations where turn is not null and conv_id is not null),
e1 as (select conv_id, turn,
  xor(list_reduce(list_transform(string_split(a, ''), lambda x: ord(x)::bigint), lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1]), 4294967295::bigint), 4294967295) as c,
  xor(list_reduce(list_transform(string_split(b, ''), lambda x: ord(x)::bigint), lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1]), 4294967295::bigint), 4294967295) as h from e0, tab),
e2 as (select 2 * floor(conv_id / 8)::bigint + c % 2 as u, (c // 2) % 7200 + 300 * turn + h % 600 as t, h, h // 600 as g from e1),
e as (select u, t, h, floor(t / 1800)::bigint + case when g % 5 = 0 then g % 4 else 0 end as b from e2),
bs as (select distinct u, b from e),
j as (select bs.u, bs.b, e.t, e.h, e.b as own, e.t - lag(e.t) over (partition by bs.u, bs.b order by e.t) as d from bs join e on e.u = bs.u and e.b <= bs.b),
s as (select *, sum(case when d is null or d > 240 then 1 else 0 end) over (partition by u, b order by t) as k from j),
v as (select u, b, min(t) as s, max(t) as e, count(*) as n, sum(case when own = b then 1 else 0 end) as n_new, sum(h) as h from s group by u, b, k having max(case when own = b then 1 else 0 end) = 1),
r as (select v.*, (select min_by({'b': w.b, 's': w.s}, w.b) from v w where w.u = v.u and w.b > v.b and w.s <= v.s and w.e >= v.e) as w from v),
q as (select r.*, (select count(*) from r x where x.u = r.u and x.w.b = r.b and x.w.s = r.s) as gone from r)
select u::bigint as "user", b::bigint as batch, s::bigint as start_s, e::bigint as end_s, n::bigint as n_events, n_new::bigint as n_new, gone::bigint as n_retracted, h::bigint as h_sum, w.b::bigint as retracted_batch, w.s::bigint as retracted_start_s from q
"""
