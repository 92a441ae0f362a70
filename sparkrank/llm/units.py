"""Units of text and the keys they share.

Whole documents are packed into units of some megabytes, which are written once (compressed) and read by
every later pass, so a pass may number what it finds in a unit and another one finds it again. Which keys
(hashes of pieces of text) occur in two or more documents is settled by hashes alone:

1. every unit sends its distinct keys, sorted and packed, to the buckets of a hash range;
2. every bucket marks the keys that two units have, or one unit in two documents, and answers each unit
   with one bit per key, in the order in which the unit sent them;
3. every unit is read again and goes through an exchange, compressed, to meet its answers.

A key that very many documents share is sent once per unit, so buckets stay even however hot a key is. Units and
buckets grow with the memory that a task has, so that there are fewer of them on larger executors; results don't
depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, give_back, task_memory, texts, tidy, written

#: Bytes of a unit at least and at most; between them a task's memory divided by ``UNIT_SHARE``.
UNIT_BYTES, LARGEST_UNIT, UNIT_SHARE = 4 << 20, 64 << 20, 256
#: Units' worth of text whose keys meet in one bucket.
BUCKET_UNITS = 3
KEY_BITS = 56
UNIT = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blob", pa.binary()), ("n_bytes", pa.int64())])
SEPARATOR = 0xFF  # in no UTF-8 text


class Unit:
    """``doc_ids``, and ``data``: their texts as UTF-8, each followed by a separator; ``starts``, ``lengths`` in bytes."""

    def __init__(self, doc_ids: list, lengths: list[int], blob: bytes):
        self.doc_ids, self.lengths = doc_ids, np.asarray(lengths, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(self.lengths.sum()) + len(lengths)), np.uint8)
        self.starts = np.cumsum(self.lengths + 1) - (self.lengths + 1)

    def doc_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def unit_size(spark) -> int:
    return min(LARGEST_UNIT, max(UNIT_BYTES, task_memory(spark) // UNIT_SHARE))


def units(docs: DataFrame) -> DataFrame:
    """unit, doc_ids, lengths, blob, n_bytes; written to the shared folder. A null text is an empty one. A text
    longer than a unit is a unit of its own."""
    unit_bytes = unit_size(docs.sparkSession)

    def pack(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        ids, raws, size = [], [], 0

        def unit():
            blob = zip_.compress(b"".join(x for r in raws for x in (r, b"\xff")))
            return pa.RecordBatch.from_arrays([pa.array([ids], UNIT.field(0).type), pa.array([[len(r) for r in raws]], UNIT.field(1).type), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], schema=UNIT)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                ids.append(doc_id)
                raws.append(raw)
                size += len(raw) + 1
                if size >= unit_bytes:
                    yield unit()
                    ids, raws, size = [], [], 0
        if ids:
            yield unit()

    packed = texts(docs).mapInArrow(tidy(pack), "doc_ids array<long>, lengths array<long>, blob binary, n_bytes long")
    return written(packed.withColumn("unit", F.monotonically_increasing_id()), "units")


def _opened(batches) -> Iterator[tuple[int, Unit]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in ("unit", "doc_ids", "lengths", "blob")}
            yield row["unit"].as_py(), Unit(row["doc_ids"].as_py(), row["lengths"].as_py(), row["blob"].as_py())


def per_unit(table: DataFrame, fn: Callable[[int, Unit], Iterator[pa.RecordBatch]], names: dict) -> DataFrame:
    def run(batches):
        for number, unit in _opened(batches):
            yield from fn(number, unit)

    return table.select("unit", "doc_ids", "lengths", "blob").mapInArrow(tidy(run), ddl(names))


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, which of them two or more documents have, and how often each occurs (255 at most).
    Ids of documents, not rows, count."""
    if not len(keys):
        return keys, np.zeros(0, bool), np.zeros(0, np.uint8)
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(at[1:], len(keys))
    return keys[at], docs[at] != docs[ends - 1], np.minimum(ends - at, 255).astype(np.uint8)


def _packed(keys: np.ndarray, many: np.ndarray, often: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + np.packbits(many).tobytes() + often.tobytes())


def _unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = (n + 7) // 8
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=9 * n + bits)
    steps = np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.unpackbits(np.frombuffer(raw[8 * n : 8 * n + bits], np.uint8), count=n).astype(bool), np.frombuffer(raw[8 * n + bits :], np.uint8)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def doc_numbers(unit: Unit) -> np.ndarray:
    """A number per row of the unit that is equal for equal ids. Rows without an id are told apart."""
    return np.array([i if i is not None else -1 - k for k, i in enumerate(unit.doc_ids)], dtype=np.int64)


def with_shared(table: DataFrame, keys: Callable[[Unit], tuple], fn: Callable[[int, Unit, np.ndarray, np.ndarray, tuple], Iterator[pa.RecordBatch]], names: dict, hot: int = 1 << 62) -> DataFrame:
    """Runs ``fn(number, unit, shared, crowded, found)`` for each unit. ``found = keys(unit)`` begins with uint64
    keys and the row of each key's document, the same whenever it is called; ``shared`` says of each key if two
    documents have it (it may say so of a few more: keys are compared by 56 bits), ``crowded`` if it occurs over
    ``hot`` times (255 at most counting for a unit)."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // (BUCKET_UNITS * unit_size(table.sparkSession))))
    cut = np.uint64(64 - KEY_BITS)

    def own(unit: Unit):
        found = keys(unit)
        k, row = found[0] >> cut, found[1]
        distinct, many, often = _distinct(k, doc_numbers(unit)[row])
        # Buckets are ranges of the keys, so that a unit's keys of a bucket follow each other.
        bucket = ((distinct >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        return found, k, distinct, many, often, bucket[first].astype(np.int64), np.append(first, len(distinct))

    packets = {"bucket": pa.int64(), "unit": pa.int64(), "n": pa.int64(), "keys": pa.binary()}
    sent_schema = pa.schema(list(packets.items()))

    def send(number, unit):
        _, _, distinct, many, often, bucket, edges = own(unit)
        for b, lo, hi in zip(bucket.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([number]), pa.array([hi - lo]), pa.array([_packed(distinct[lo:hi], many[lo:hi], often[lo:hi])], pa.binary())], schema=sent_schema)

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        sizes = group.column("n").to_pylist()
        found = [_unpacked(k, n) for k, n in zip(group.column("keys").to_pylist(), sizes, strict=True)]
        k, marks, often = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        order = np.argsort(k, kind="stable")
        ordered = k[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        first = np.flatnonzero(fresh)
        shared = np.logical_or.reduceat(marks[order], first) | (np.diff(np.append(first, len(k))) > 1)
        crowded = np.add.reduceat(often[order].astype(np.int64), first) > hot
        run = np.cumsum(fresh) - 1  # number of the distinct key
        flags = np.empty((2, len(k)), bool)
        flags[0, order], flags[1, order] = shared[run], crowded[run]
        ends = np.cumsum(sizes).tolist()
        out = pa.table({"unit": group.column("unit"), "bucket": group.column("bucket"), **{name: pa.array([_bits(f[e - n : e]) if f[e - n : e].any() else b"" for e, n in zip(ends, sizes, strict=True)], pa.binary()) for name, f in zip(("bits", "hot"), flags, strict=True)}})
        del k, marks, often, order, ordered, run, flags
        give_back()
        return out

    sent = per_unit(table, send, packets)
    answers = sent.groupBy("bucket").applyInArrow(answer, "unit long, bucket long, bits binary, hot binary")

    def resume(left: pa.Table, right: pa.Table) -> Iterator[pa.RecordBatch]:
        answered = {b: (bits, hot) for b, bits, hot in zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "hot")), strict=True)}
        for number, unit in _opened(left.to_batches()):
            found, k, distinct, _, _, bucket, edges = own(unit)
            flags = np.zeros((2, len(distinct)), bool)
            for b, lo, hi in zip(bucket.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for f, raw in zip(flags, answered[b], strict=True):
                    if raw:
                        f[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).astype(bool)
            at = np.searchsorted(distinct, k)
            yield from fn(number, unit, flags[0][at], flags[1][at], found)
        give_back()

    return beside(table, answers, resume, names)


def beside(table: DataFrame, rows: DataFrame, fn: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], names: dict) -> DataFrame:
    """``fn(unit's row, its rows)`` for each unit, also for units without rows."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(fn(left, right)) if left.num_rows else []
        return pa.Table.from_batches(out) if out else pa.schema(list(names.items())).empty_table()

    return table.select("unit", "doc_ids", "lengths", "blob").groupBy("unit").cogroup(rows.groupBy("unit")).applyInArrow(both, ddl(names))
