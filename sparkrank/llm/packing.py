"""Best-fit packing: large-item matching on the histogram of lengths.

Tokenizes every document, cuts those longer than a sequence and packs the pieces into sequences of at
most ``size`` tokens. Lengths are whole numbers from 1 to ``size``, so the packing itself needs only how
many pieces there are of each length. That histogram has at most ``size`` rows whatever the corpus
weighs; the driver packs it once, *for whole classes of equal pieces at a time*:

1. Pieces over a third of a sequence are large; no sequence holds three. They are matched greedily, the
   largest first, each with the largest other one that still fits, at most two in a sequence.
2. The other pieces go, the largest first, into the sequence with the least gap that still holds them
   (best fit); what fits nowhere opens new sequences.

The plan says "ranks lo..hi of length n go to sequences s, s+1, ... at this offset". A distributed rank
within each length (counts by salt, prefix sums over the few counts, a row number within length and
salt) then places every piece, so no task gets all pieces of a common length.

Nulls and empty texts are documents of one id, the end marker 0. Repeated rows are packed as often as
they occur; ties between equal pieces may go either way. Very long texts are tokenized whole and cut into as
many pieces as they need. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrank.llm.common import ddl, documents, texts, tidy, written

SIZE = 2048
END_ID = 0
#: Characters of white space in a row that the fast encoder isn't given.
LONG_SPACE = 10_000
#: A length with more pieces than this is salted; so many are ranked at a time on average.
RANKED_AT_ONCE = 200
#: Salts whose counts are summed at a time.
SUMMED_AT_ONCE = 1_000

PIECES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the tokenizer file. Latin text goes through the same vocabulary's faster encoder, whose ids
    are the same there; texts with other characters, a special token or a run of white space that is too long for
    that encoder's pattern go through the tokenizer itself."""

    def __init__(self, files: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(files[0])
        with open(files[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.other = re.compile("|".join([*special, "[^\n\r\t\x20-\x7e\xa1-ɏ]", rf"\s{{{LONG_SPACE},}}"]))

    def ids(self, text: str) -> np.ndarray:
        if self.other.search(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first one takes what is over, the others are full."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int = SIZE, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as little-endian binary."""
    files = files or tokenizer_files()
    names = PIECES | ({"ids": pa.binary()} if with_ids else {})
    schema = pa.schema(list(names.items()))

    def run(batches):
        encoder = Encoder(files)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encoder.ids(text), np.uint32(END_ID)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    raw = ids[start : start + n].tobytes()
                    rows.append((doc_id, k, start, n, zlib.crc32(raw), *((raw,) if with_ids else ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)] if rows else [pa.array([], type=t) for t in names.values()], schema=schema)

    return texts(docs).mapInArrow(tidy(run), ddl(names))


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Packs ``counts[n]`` pieces of each length n. Rows (length, lo, hi, sequence, offset): the piece of that
    length with rank r, lo <= r < hi, is in sequence + r - lo at offset. Work grows with the number of
    distinct lengths, not of pieces."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    open_bins: list[tuple[int, int, int]] = []  # (gap, first sequence, how many)

    def put(n: int, many: int, sequence: int, offset: int) -> None:
        plan.append((n, used[n], used[n] + many, sequence, offset))
        used[n] += many
        left[n] -= many

    large = sorted(n for n in left if 3 * n > size)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, size - a) - 1
        while at >= 0 and not left[large[at]]:
            del large[at]
            at -= 1
        if at < 0:
            many = left[a]
            put(a, many, sequences, 0)
            open_bins.append((size - a, sequences, many))
        else:
            b = large[at]
            many = min(left[a], left[b]) if a != b else left[a] // 2
            if not many:  # one of its kind is left: it fits a smaller one, or stays alone
                b = next((x for x in reversed(large[:at]) if left[x]), None)
                many = 1
            put(a, many, sequences, 0)
            if b is not None:
                put(b, many, sequences, a)
            open_bins.append((size - a - (b or 0), sequences, many))
        sequences += many
    gaps: dict[int, list[tuple[int, int]]] = {}
    for gap, first, many in open_bins:
        gaps.setdefault(gap, []).append((first, many))
    order = sorted(gaps)

    def add(gap: int, first: int, many: int) -> None:
        if gap:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((first, many))

    for n in sorted((n for n in left if 3 * n <= size), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                each = size // n
                many = max(1, left[n] // each)
                each = min(each, left[n])
                for k in range(each):
                    put(n, many, sequences, k * n)
                add(size - each * n, sequences, many)
                sequences += many
                continue
            gap = order[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            each = gap // n
            if left[n] >= each * many:
                whole, rest = many, 0
            else:
                whole, rest = divmod(left[n], each)
            for k in range(each):
                if whole:
                    put(n, whole, first, size - gap + k * n)
            if whole:
                add(gap - each * n, first, whole)
            if whole < many:
                for k in range(rest):
                    put(n, 1, first + whole, size - gap + k * n)
                if rest:
                    add(gap - rest * n, first + whole, 1)
                if many > whole + bool(rest):
                    add(gap, first + whole + bool(rest), many - whole - bool(rest))
    return plan


def pack(placed: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (see :func:`pieces`), which is read twice."""
    counts = {r["length"]: r["count"] for r in placed.groupBy("length").count().collect()}  # at most ``size`` rows
    plan = plan_packing(counts, size)
    salts = F.lit([-(-counts.get(n, 1) // RANKED_AT_ONCE) for n in range(size + 1)])
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.element_at(salts, (F.col("length") + 1).cast("int"))).cast("int"))
    # Prefix sums of the salts' counts, within blocks of salts and over the blocks, so that no task gets all salts of a length.
    sums = salted.groupBy("length", "_salt").count().withColumn("_block", F.floor(F.col("_salt") / SUMMED_AT_ONCE))
    blocks = sums.groupBy("length", "_block").agg(F.sum("count").alias("_all"))
    blocks = blocks.select("length", "_block", (F.sum("_all").over(Window.partitionBy("length").orderBy("_block")) - F.col("_all")).alias("_ahead"))
    inside = F.sum("count").over(Window.partitionBy("length", "_block").orderBy("_salt")) - F.col("count")
    before = sums.withColumn("_inside", inside).join(blocks, ["length", "_block"]).select("length", "_salt", (F.col("_ahead") + F.col("_inside")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_within", within).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, lo, _, sequence, offset in plan:
        by_length.setdefault(n, []).append((lo, sequence, offset))
    table = {n: np.asarray(sorted(r), dtype=np.int64).T for n, r in by_length.items()}  # bounded by the distinct lengths
    schema = pa.schema([*((n, t) for n, t in PIECES.items()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def look(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order])) + 1
            for own in np.split(order, edges) if len(n) else []:
                los, sequences, offsets = table[int(n[own[0]])]
                at = np.searchsorted(los, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[at] + rank[own] - los[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.select(*PIECES, "_rank").mapInArrow(look, ddl(PIECES) + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, size: int = SIZE, files: tuple[str, str] | None = None) -> DataFrame:
    """A row per piece with its place; tokenizing runs once, its small table of lengths is kept in the shared folder."""
    return pack(written(pieces(docs, size, files), "pieces"), size)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
