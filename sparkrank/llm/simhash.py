"""SimHash near-dedup with pigeonring filtering.

Fingerprints: words of the text with A-Z lowered, 4-word shingles (repeats count; fewer words make one
shingle, none make fingerprint zero), XXH64 with seed 42 of each, and a bit for what more than half of the
hashes set. Texts link if their fingerprints differ in at most four bits.

Search: a fingerprint is a ring of five segments, so each has 4/5 of a bit to spend. If two fingerprints
differ in at most four bits, then from some segment on every chain of l consecutive segments differs in at
most l*4/5 bits: 0, 1, 2, 3, 4 bits for l = 1..5. The first two links of that chain become an exact key: each
fingerprint is indexed by the bits of those segments and probes with the few variants that the budgets allow.
A key with over ``CROWD`` indexed fingerprints is split by the chain's next link (and again, if need be), in the
same way. Fingerprints that meet go through the rest of the chain before their full distance is taken.

Only distinct fingerprints are searched, and a key's group yields a spanning forest of its links, never its
pairs; components are then joined across keys. Links are complete: nothing is capped.

Null texts count as empty. Repeated rows, ties and equal texts share a fingerprint. A null id gets a fingerprint,
but never names a component. Very long texts are hashed whole, a block at a time. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, documents, free_name, hinted, per_batch, texts, tidy, written
from sparkrank.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
WIDTHS = (13, 13, 13, 13, 12)
#: Indexed fingerprints of a key from which on it is split by the next segment.
CROWD = 8192
#: Bytes of a text whose shingles are hashed at a time.
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
FINGERPRINTS = {"doc_id": pa.int64(), "fp": pa.int64(), "text_hash": pa.int64()}
_ALL = (1 << 64) - 1


def _blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a block of bytes at a time."""
    at = 0
    while at < len(raw):
        end = at + BLOCK_BYTES
        cut = _SPACE.search(raw, end) if end < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()  # bytes split at the six ASCII white space characters alone
        at = end


def fingerprint(text: str) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest
    ones, total, carried, words = np.zeros(64, np.int64), 0, [], []

    def count(hashes: list[int]) -> None:
        nonlocal total
        total += len(hashes)
        ones[:] += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for more in _blocks(text.encode().lower()):  # bytes: only A-Z are lowered
        words = carried + more
        line = b" ".join(words)
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist() if words else []
        starts = [0, *(e + 1 for e in ends[:-1])]
        if len(words) >= SHINGLE:
            count([h(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])])
        carried = words[-(SHINGLE - 1) :]
    if not words:
        return 0
    if not total:
        count([h(b" ".join(words), SEED)])
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint's bits as a signed long, and the hash that tells texts of one id apart."""
    import xxhash

    def run(ids, whole):
        fps = np.array([fingerprint(t) for t in whole], dtype=np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(t.encode(), SEED) for t in whole], dtype=np.uint64)
        return ids, fps.view(np.int64), hashes.view(np.int64)

    return texts(docs).mapInArrow(per_batch(run, FINGERPRINTS), ddl(FINGERPRINTS))


def ring(start: int) -> list[np.uint64]:
    """Masks of the chains of 1..5 segments from ``start`` on; segment 0 has the highest bits."""
    offsets = np.cumsum((0, *WIDTHS))
    masks, mask = [], 0
    for k in range(len(WIDTHS)):
        s = (start + k) % len(WIDTHS)
        mask |= ((1 << WIDTHS[s]) - 1) << int(64 - offsets[s + 1])
        masks.append(np.uint64(mask))
    return masks


def budgets() -> list[int]:
    return [DISTANCE * (k + 1) // len(WIDTHS) for k in range(len(WIDTHS))]


def further(start: int, k: int, spent: int) -> list[int]:
    """Differences within the chain's segment number ``k`` that ``spent`` differing bits before it leave room for."""
    masks = ring(start)
    own = int(masks[k]) & ~(int(masks[k - 1]) if k else 0)
    bits = [1 << b for b in range(64) if own >> b & 1]
    return [sum(more) for n in range(budgets()[k] - spent + 1) for more in combinations(bits, n)]


def variants(start: int, chain: int) -> np.ndarray:
    """Differences within the first ``chain`` segments whose every prefix keeps to its budget."""
    found = {0}
    for k in range(1, chain):
        found = {d | more for d in found for more in further(start, k, d.bit_count())}
    return np.array(sorted(found), dtype=np.uint64)


def forest(probes: np.ndarray, indexed: np.ndarray, masks: list[np.uint64], chain: int) -> list[tuple[int, int]]:
    """Links within a key's group, one for each merging of two of its classes."""
    limit, links = budgets(), []
    label = np.arange(len(indexed))
    for p in probes:
        x = indexed ^ p
        own = np.flatnonzero(x)
        for k in range(chain, len(masks)):  # the chain's later links prune before the last, the full distance
            own = own[np.bitwise_count(x[own] & masks[k]) <= limit[k]]
        if not len(own):
            continue
        met, first = np.unique(label[own], return_index=True)
        mine = np.flatnonzero(indexed == p)
        if len(mine):
            home = label[mine[0]]
            keep = met != home
            met, first = met[keep], first[keep]
        links += [(int(p), int(indexed[own[f]])) for f in first]
        if len(mine) and len(met):
            label[np.isin(label, met)] = home
        elif len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    return links


DEALT = "start int, key long, fp long, indexed boolean"


def _rows(start: np.ndarray, key: np.ndarray, fp: np.ndarray, indexed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(start.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(indexed)], names=["start", "key", "fp", "indexed"])


def _first(fps: DataFrame, probes: bool) -> DataFrame:
    """Keys of two segments; ``probes``: those that are probed with as well."""

    def keys(batches):
        ways = [(ring(s)[1], variants(s, 2)) for s in range(len(WIDTHS))]
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(all_fps), 2000):
                fp = all_fps[lo : lo + 2000]
                parts = []
                for s, (mask, diffs) in enumerate(ways):
                    parts.append((np.full(len(fp), s), fp & mask, fp, np.ones(len(fp), bool)))
                    if probes:
                        probe = ((fp[:, None] ^ diffs[None, :]) & mask).ravel()
                        parts.append((np.full(len(probe), s), probe, np.repeat(fp, len(diffs)), np.zeros(len(probe), bool)))
                yield _rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return fps.select("fp").distinct().mapInArrow(tidy(keys), DEALT)


def _next(dealt: DataFrame, chain: int) -> DataFrame:
    """Keys of ``chain`` segments from those of one less: indexed ones go on as they are, probes with every
    difference in the next segment that their differences so far leave room for."""

    def keys(batches):
        for batch in batches:
            start, key, fp, indexed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "key", "fp", "indexed"))
            key, fp = key.view(np.uint64), fp.view(np.uint64)
            for s in np.unique(start).tolist():
                masks = ring(s)
                own, old = masks[chain - 1] & ~masks[chain - 2], masks[chain - 2]
                at = np.flatnonzero((start == s) & indexed)
                yield _rows(start[at], key[at] | (fp[at] & own), fp[at], indexed[at])
                spent = np.bitwise_count((fp ^ key) & old)
                for n in range(budgets()[chain - 2] + 1):
                    diffs = np.array(further(s, chain - 1, n), dtype=np.uint64)
                    at = np.flatnonzero((start == s) & ~indexed & (spent == n))
                    for lo in range(0, len(at), 2000):
                        some = at[lo : lo + 2000]
                        probe = (key[some, None] | ((fp[some, None] ^ diffs[None, :]) & own)).ravel()
                        yield _rows(np.full(len(probe), s), probe, np.repeat(fp[some], len(diffs)), np.zeros(len(probe), bool))

    return dealt.mapInArrow(tidy(keys), DEALT)


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column ``fp`` as all links would."""
    dealt, indexed, found = _first(fps, True), _first(fps, False), []
    for chain in range(2, len(WIDTHS)):
        many = indexed.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("start", "key")
        many = written(many, "crowds") if chain < len(WIDTHS) - 1 else None
        if many is None or many.isEmpty():
            return reduce(DataFrame.unionByName, [*found, _met(dealt, chain)]).distinct()
        found.append(_met(dealt.join(many, ["start", "key"], "left_anti"), chain))
        dealt = _next(dealt.join(many, ["start", "key"], "left_semi"), chain + 1)
        indexed = dealt.where("indexed")
    raise AssertionError


def _met(dealt: DataFrame, chain: int) -> DataFrame:
    """Links of the fingerprints that meet at keys of ``chain`` segments."""
    dealt = dealt.repartition("start", "key").sortWithinPartitions("start", "key")

    def meet(batches):
        rest = None
        rings = [ring(s) for s in range(len(WIDTHS))]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def solve(start, key, fp, kind):
            out: list[tuple[int, int]] = []
            edges = np.flatnonzero(np.append(True, (start[1:] != start[:-1]) | (key[1:] != key[:-1])))
            sizes = np.diff(np.append(edges, len(key)))
            some = np.add.reduceat(kind.astype(np.int64), edges)
            for e, n in zip(edges[(some > 0) & (sizes > 2)], sizes[(some > 0) & (sizes > 2)], strict=True):  # an indexed one always meets itself
                group, marks = fp[e : e + n], kind[e : e + n]
                out += forest(group[~marks], group[marks], rings[start[e]], chain)
            return pa.RecordBatch.from_arrays([pa.array(np.array([x[k] for x in out], dtype=np.uint64).view(np.int64)) for k in (0, 1)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "key", "fp", "indexed")]
            own[2] = own[2].view(np.uint64)
            if rest is not None:
                own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
            cut = int(np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))[-1]) + 1 if ((own[0] != own[0][-1]) | (own[1] != own[1][-1])).any() else 0
            rest = [x[cut:] for x in own]
            if cut:
                yield solve(*(x[:cut] for x in own))
        if rest is not None:
            yield solve(*rest)

    return dealt.mapInArrow(tidy(meet), "a long, b long")


def grouped(fps: DataFrame) -> DataFrame:
    """(fp, node) for each distinct fingerprint: the smallest fingerprint (as a signed long) in its reach."""
    distinct = fps.select("fp").distinct()
    found = components(links(distinct))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("node"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id in reach)."""
    fps = written(fingerprints(docs), "fingerprints")
    of_fp = grouped(fps).join(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    least = of_fp.groupBy("node").agg(F.min("least").alias("component_id"))
    named = of_fp.join(least, "node").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, of each group of near copies: that with the smallest id, nulls last."""
    fps = written(fingerprints(docs.select("doc_id", F.col(text_col).alias("text"))), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    of_fp = grouped(fps).join(fps.groupBy("fp").agg(first.alias("first")), "fp")
    winners = of_fp.groupBy("node").agg(F.min("first").alias("w")).select(F.col("w.doc_id").alias("_id"), F.col("w.text_hash").alias("_hash")).distinct()
    # Rows that go, and rows that repeat a winner; texts are shuffled only if these are many.
    keys = fps.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    key = F.struct("_id", "_hash").alias("_key")
    ahead = winners.select(F.struct("_id", "_hash").alias("_winner"))
    marked = keys.select(key, "_n").join(ahead, F.col("_key") == F.col("_winner"), "left")
    odd = written(marked.where("_winner is null or _n > 1").select("_key", F.col("_winner").isNotNull().alias("_kept")), "losers")
    name = free_name(docs.columns)
    again = free_name([*docs.columns, name])
    key = free_name([*docs.columns, name, again])
    own = F.struct(docs["doc_id"].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_hash"))
    beside = docs.withColumn(name, own)
    clean = beside.join(hinted(odd.select(F.col("_key").alias(key))), F.col(name) == F.col(key), "left_anti").drop(name)
    twice = beside.join(hinted(odd.where("_kept").select(F.col("_key").alias(key))), F.col(name) == F.col(key), "left_semi")
    once = twice.withColumn(again, F.row_number().over(Window.partitionBy(name).orderBy(name))).where(F.col(again) == 1).drop(name, again)
    return clean.unionByName(once)


def op7_simhash_neardedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
