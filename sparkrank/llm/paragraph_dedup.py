"""Substring dedup: paragraph MinHash banding.

Paragraphs: a line's sentences (they end at ``.``, ``!`` or ``?`` before white space); a sentence of fewer than
five words joins the next one of its line. Repeated passages thus fall into the same paragraphs wherever they
stand, but for the first and last one. Paragraphs of fewer than ``shortest`` words are no candidates.

1. MinHash over five-word shingles (A-Z lowered; a shorter paragraph is one shingle); ``ROWS`` and ``BANDS`` are
   tuned so that a pair at similarity 0.8 collides in some band with probability ``RECALL``. Bands that only one
   document has are dropped by their hashes alone (:func:`sparkrank.llm.units.with_shared`).
2. Equal paragraphs are one class. Classes that collide in a band are verified by the exact Jaccard similarity
   of their shingle sets; a band's group yields a spanning forest of its links, never its pairs. Within a group
   only sets that share one of their least shingles are compared: of two sets at similarity 0.8 the least fifth
   (and one more) of both must meet. A band with over ``CROWD`` classes is dealt out by those shingles as well.
3. Components of classes are clusters. A cluster's paragraphs stay in the document with the smallest id and go
   from all others, if the repeat has at least ``min_run`` words: removed neighbours, and the words around them that
   match those around the kept paragraph one by one (a passage's first and last words stand in the host's sentences).
   With 0 every verified paragraph goes.

Classes are told apart by 64 bits; one that a second hash of 64 bits contradicts is left alone.

Null and empty texts have no paragraphs; an empty table gives no rows. Equal ids (repeated rows, ties) are one
document to each other: nothing goes because of them. A null id counts as larger than all others. Very long texts
are read whole, some lines at a time. Other columns are ignored by the search and kept by :func:`cleaned`. Offsets
are UTF-8 bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import documents, free_name, hinted, tidy, written
from sparkrank.llm.components import components
from sparkrank.llm.suffix_array import prefix_hashes
from sparkrank.llm.suffix_dedup import _mixed, _slices
from sparkrank.llm.units import Unit, units, with_shared

SHINGLE, SIMILARITY = 5, 0.8
RECALL = 0.996
#: A lone short line that many documents share is no passage; the repeat must have so many words in a row.
MIN_RUN = 20
#: Classes of a band from which on they are dealt out by their least shingles too.
CROWD = 2000
#: Words beyond ``MIN_RUN`` that a paragraph and its surroundings on one side have: a similar paragraph may be longer.
SLACK = 4
CHUNK = 1 << 20
LAST = np.iinfo(np.int64).max
FOUND = {"doc_id": pa.int64(), "text_hash": pa.int64(), "para": pa.int64(), "start": pa.int64(), "end": pa.int64(), "n_words": pa.int64(), "cls": pa.int64(), "check": pa.int64(), "before": pa.list_(pa.int16()), "after": pa.list_(pa.int16()), "bands": pa.list_(pa.int64()), "shingles": pa.binary()}


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = 3) -> tuple[int, int]:
    """(rows, bands): the fewest bands of ``rows`` rows that find a pair at ``similarity`` with probability ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return rows, bands


ROWS, BANDS = tuned()
_SEEDS = np.random.default_rng(10).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_PLACES = np.random.default_rng(11).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 255]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 255]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _chunk(data: np.ndarray, shortest: int) -> tuple[np.ndarray, ...] | None:
    """(start, end, words, shingles of all, how many shingles, class, check) of the candidates in whole lines."""
    space = _SPACE[data]
    turn = np.diff(space.astype(np.int8), prepend=1, append=1)
    ws, we = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
    if not len(ws):
        return None
    sums, inverse = prefix_hashes(_LOWER[data], 0x9E3779B97F4A7C15)
    word = _mixed((sums[we] - sums[ws]) * inverse[ws] + (we - ws).astype(np.uint64))
    breaks = np.append(0, np.cumsum(_BREAK[data]))
    hard = np.append(breaks[ws[1:]] > breaks[we[:-1]], True)
    sentence_ends = np.flatnonzero(hard | _STOP[data[we - 1]])
    size = np.diff(sentence_ends, prepend=-1)
    ends = sentence_ends[(size >= SHINGLE) | hard[sentence_ends]] + 1
    begins = np.append(0, ends[:-1])
    keep = ends - begins >= shortest
    begins, ends = begins[keep], ends[keep]
    if not len(begins):
        return None
    count = np.maximum(1, ends - begins - SHINGLE + 1)
    at = _slices(begins, count)
    shingles = np.zeros(len(at), np.uint64)
    last = np.repeat(ends, count)
    for k in range(SHINGLE):
        shingles += np.where(at + k < last, word[np.minimum(at + k, len(word) - 1)], np.uint64(k)) * _PLACES[k]
    shingles = _mixed(shingles)
    # The class hashes the shingles with their places, that is the whole sequence of words.
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    firsts = np.cumsum(count) - count
    place = place.astype(np.uint64)
    cls = _mixed(np.add.reduceat(_mixed(shingles + (place << np.uint64(1))), firsts) + count.astype(np.uint64))
    check = _mixed(np.add.reduceat((shingles ^ (shingles >> np.uint64(23))) * (place * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)), firsts))
    return ws[begins], we[ends - 1], ends - begins, shingles, count, cls, check


def paragraphs(unit: Unit, shortest: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(band keys, row of each) and, per paragraph, (row, start, end, words, number of shingles, class, check), shingles."""
    breaks = np.flatnonzero(_BREAK[unit.data]) + 1
    lo, parts = 0, []
    while lo < len(unit.data):
        k = np.searchsorted(breaks, lo + CHUNK, "right") - 1
        hi = int(breaks[k]) if k >= 0 and breaks[k] > lo else int(breaks[np.searchsorted(breaks, lo + CHUNK, "left")])
        if (part := _chunk(unit.data[lo:hi], shortest)) is not None:
            parts.append((part[0] + lo, part[1] + lo, *part[2:]))
        lo = hi
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, none, none, none, *(np.zeros(0, np.uint64),) * 3
    start, end, words, shingles, count, cls, check = (np.concatenate(x) for x in zip(*parts, strict=True))
    firsts = np.cumsum(count) - count
    keys = np.empty((len(start), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(start), np.uint64(b + 1))
        for r in range(ROWS):
            seed = _SEEDS[b * ROWS + r]
            v = (shingles ^ seed) * (seed | np.uint64(1))
            v ^= v >> np.uint64(32)
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(v, firsts)
        keys[:, b] = _mixed(key)
    row = unit.doc_at(start)
    return keys.ravel(), np.repeat(row, BANDS), row, start, end, words, count, cls, check, shingles


def _around(data: np.ndarray, lo: int, start: int, end: int, hi: int, n: int) -> tuple[list[int], list[int]]:
    """Hashes (16 bits, A-Z lowered) of up to ``n`` words before and after a paragraph of the text at ``lo`` to ``hi``,
    the nearest first."""
    import xxhash

    def words(size: int) -> tuple[list[bytes], list[bytes]]:
        left, right = max(lo, start - size), min(hi, end + size)
        before, after = data[left:start].tobytes().split(), data[end:right].tobytes().split()
        # A word that the window cuts isn't known.
        return before[::-1][: len(before) - (left > lo and len(before) > 0)], after[: len(after) - (right < hi and len(after) > 0)]

    size = 16 * n
    before, after = words(size) if n > 0 else ([], [])
    while n > 0 and (len(before) < n and start - size > lo or len(after) < n and end + size < hi):
        size *= 4
        before, after = words(size)
    return tuple([(xxhash.xxh32_intdigest(w.lower()) & 0xFFFF) - 0x8000 for w in side[:n]] for side in (before, after))


def _candidates(unit, shared, found, min_run):
    import xxhash

    _, _, row, start, end, words, count, cls, check, shingles = found
    cls, check = cls.view(np.int64), check.view(np.int64)
    shared = shared.reshape(-1, BANDS)
    keys = found[0].reshape(-1, BANDS)
    firsts = np.cumsum(count) - count
    doc_first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    para = np.arange(len(row)) - np.maximum.accumulate(np.where(doc_first, np.arange(len(row)), 0)) if len(row) else row
    hashes: dict[int, int] = {}
    sent: set[int] = set()
    rows = []
    for k in np.flatnonzero(shared.any(axis=1)).tolist():
        r = int(row[k])
        if r not in hashes:
            hashes[r] = int(np.uint64(xxhash.xxh64_intdigest(unit.data[unit.starts[r] : unit.starts[r] + unit.lengths[r]].tobytes(), seed=42)).astype(np.int64))
        c = int(cls[k])
        first = c not in sent
        sent.add(c)
        rows.append((unit.doc_ids[r], hashes[r], int(para[k]), int(start[k] - unit.starts[r]), int(end[k] - unit.starts[r]), int(words[k]), c, int(check[k]), *_around(unit.data, int(unit.starts[r]), int(start[k]), int(end[k]), int(unit.starts[r] + unit.lengths[r]), min_run + SLACK - int(words[k]) if min_run else 0), keys[k][shared[k]].view(np.int64).tolist() if first else None, np.unique(shingles[firsts[k] : firsts[k] + count[k]]).tobytes() if first else None))
    for lo in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows[lo : lo + 20_000], strict=True), FOUND.values(), strict=True)], schema=pa.schema(list(FOUND.items())))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact Jaccard similarity of two sorted sets against the threshold."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILARITY * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def least(n: int) -> int:
    """How many of the least of ``n`` shingles meet those of any similar set: n less its least overlap, and one."""
    return n - math.ceil(SIMILARITY * n - 1e-9) + 1


def forest(ids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect a group as all its links would. A member is compared with those that share one of its
    least shingles, and with no more of a cluster once it has met it. Under each shingle a cluster has one list of members,
    however many it has; when clusters meet, the lists of the one with fewer shingles go to the other."""
    holders: dict[int, dict[int, list[int]]] = {}  # by shingle, then by cluster
    shingles_of: dict[int, set[int]] = {}
    links = []
    for k, own in enumerate(sets):
        tokens = own[: least(len(own))].tolist()
        met, tried = set(), set()
        for token in tokens:
            for cluster, members in holders.get(token, {}).items():
                if cluster in met:
                    continue
                for m in members:
                    if m not in tried:
                        tried.add(m)
                        if similar(sets[m], own):
                            links.append((ids[m], ids[k]))
                            met.add(cluster)
                            break
        whole, shingles_of[k] = k, set(tokens)
        for token in tokens:
            holders.setdefault(token, {})[k] = [k]
        for cluster in met:
            small, whole = sorted((whole, cluster), key=lambda c: len(shingles_of[c]))
            for token in shingles_of[small]:
                at = holders[token]
                fewer, more = sorted((at.pop(small), at.get(whole, [])), key=len)
                at[whole] = more
                more += fewer
            shingles_of[whole] |= shingles_of.pop(small)
    return links


def _linked(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest: tuple[int, list, list] | None = None

    def flush(group, out):
        if group is not None and len(group[1]) > 1:
            out += forest(group[1], group[2])

    for batch in batches:
        out: list[tuple[int, int]] = []
        for key, cls, raw in zip(batch.column("key").to_pylist(), batch.column("cls").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
            if rest is None or rest[0] != key:
                flush(rest, out)
                rest = key, [], []
            rest[1].append(cls)
            rest[2].append(np.frombuffer(raw, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
    out = []
    flush(rest, out)
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)


def removals(docs: DataFrame, min_run: int = MIN_RUN, shortest: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """A row per removed paragraph: doc_id, text_hash (of the whole text, to tell repeated ids apart), para,
    start, end, n_words, cluster_id and kept_doc_id, the document that keeps the cluster's paragraphs."""
    pieces = with_shared(units(docs), lambda unit: paragraphs(unit, shortest), lambda _, unit, shared, __, found: _candidates(unit, shared, found, min_run), FOUND)
    found = written(pieces, "paragraphs")
    classes = found.where("shingles is not null").select("cls", "bands", "shingles")
    keys = classes.select("cls", F.explode("bands").alias("key")).distinct()
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(several, "key")
    sets = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "shingles").dropDuplicates(["cls"])
    n = F.expr("length(shingles) div 8")
    tokens = F.transform(F.sequence(F.lit(0), n - F.ceil(n * SIMILARITY - 1e-9)), lambda k: F.xxhash64("key", F.substring("shingles", (8 * k + 1).cast("int"), F.lit(8))))
    dealt = met.join(sets, "cls").select(F.explode(F.when(F.col("n") > crowd, tokens).otherwise(F.array("key"))).alias("key"), "cls", "shingles")
    links = dealt.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(tidy(_linked), "a long, b long")
    clusters = components(links)
    # Who keeps what is settled by class, of which copies are one; only the last join meets every paragraph, and its
    # large side comes straight from a shuffle, so a class that very many documents share can be split there.
    order = F.coalesce("doc_id", F.lit(LAST))
    least = found.groupBy("cls").agg(F.min(order).alias("least"), (F.min("check") == F.max("check")).alias("_sound")).where("_sound").drop("_sound")
    named = least.join(clusters.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("cluster_id"))
    keeper = named.groupBy("cluster_id").agg(F.min("least").alias("kept_doc_id"))
    by_class = named.join(keeper, "cluster_id").select("cls", "cluster_id", "kept_doc_id")
    gone = found.drop("bands", "shingles", "check").join(by_class, "cls").where(order > F.col("kept_doc_id")).drop("cls").repartition("doc_id", "text_hash")
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("para")
    runs = gone.distinct().withColumn("_run", F.col("para") - F.row_number().over(by_doc))
    names = ["doc_id", "text_hash", "para", "start", "end", "n_words", "cluster_id", "kept_doc_id"]
    if not min_run:
        return runs.select(*names)
    whole = Window.partitionBy("doc_id", "text_hash", "_run")
    ends = {"_words": F.sum("n_words").over(whole), "_first": F.col("para") == F.min("para").over(whole), "_last": F.col("para") == F.max("para").over(whole)}
    runs = written(runs.withColumns(ends), "runs")
    # Where a run is short, the words around its first and last paragraph are held against each kept occurrence.
    short = runs.where((F.col("_words") < min_run) & (F.col("_first") | F.col("_last")))
    asked = by_class.join(short.select("cluster_id").distinct(), "cluster_id", "left_semi")
    kept = found.where((F.size("before") > 0) | (F.size("after") > 0)).select("cls", order.alias("_order"), "before", "after").join(asked, "cls")
    kept = kept.where(F.col("_order") == F.col("kept_doc_id")).select("cluster_id", F.col("before").alias("_before"), F.col("after").alias("_after")).distinct()
    more = F.when(F.col("_first"), _matching("before", "_before")).otherwise(0) + F.when(F.col("_last"), _matching("after", "_after")).otherwise(0)
    # A null id or hash can't be a key of these joins as it stands.
    key = F.struct(order.alias("d"), F.col("text_hash").alias("h"), F.col("_run").alias("r"))
    best = short.join(kept, "cluster_id").groupBy(key.alias("_key"), "para", "_words").agg(F.max(more).alias("_more"))
    longer = best.groupBy("_key").agg((F.max("_words") + F.sum("_more")).alias("_n")).where(F.col("_n") >= min_run)
    extended = runs.where(F.col("_words") < min_run).withColumn("_key", key).join(longer, "_key", "left_semi")
    return runs.where(F.col("_words") >= min_run).select(*names).unionByName(extended.select(*names))


def _matching(a: str, b: str) -> Column:
    """How many of the first words of two lists are the same."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same))


def cleaned(docs: DataFrame, gone: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs cut out of the text; same rows and columns."""
    spans = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))

    names = docs.columns

    def cut(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if spans:
                    raw, at, parts = text.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    text = b"".join([*parts, raw[at:]]).decode()
                out.append(text)
            columns = [pa.array(out, pa.string()) if name == text_col else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = docs.join(hinted(spans), docs["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans["_hash"]), "left")
    return joined.select(*[docs[c] for c in docs.columns], spans["_spans"].alias(free_name(docs.columns))).mapInArrow(tidy(cut), docs.schema)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(documents(spark, sf_dir)).drop("text_hash")
