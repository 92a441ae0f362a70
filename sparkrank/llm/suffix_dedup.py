"""Suffix-array dedup: removes bytes of 50-byte strings that also start in a document with a smaller id.

Every text is read as UTF-8 bytes. A byte goes if some 50-byte string that covers it also starts in a document
with a smaller doc_id; strings are judged on the input and never cross documents.

1. Runs. Each 50-byte string has a minimizer (the least hash of its 20-byte strings); consecutive strings with
   the same one form a run. Equal strings have equal minimizers, so a run whose minimizer no second document
   has holds nothing to remove (:func:`sparkrank.llm.units.with_shared`).
2. Shards. The texts of the other runs go to shards by minimizer, each distinct text of a unit once, with the
   unit's smallest doc_id that has it. Thousands of copies are thus a few rows, and equal strings meet. A run
   has some 50 bytes more than strings, so there are as many shards as keep what a shard is *sent* small. A
   minimizer that occurs over ``HOT`` times, in as many contexts perhaps, is no longer a key: its strings go to
   shards one by one, each by a hash of its own 50 bytes.
3. Suffix arrays. A shard induces the suffix array of its distinct texts and computes permuted common prefixes
   (:mod:`sparkrank.llm.suffix_array`). Strings that share 50 bytes are neighbours there; the least doc_id of
   each such group is every string's answer.
4. Answers go back to the units, which remove what a smaller id also has.

Null and empty texts have 0 bytes. Equal ids (repeated rows) never remove from each other, so ties keep all; a
null id counts as larger than all others, and null ids never remove from each other. Each input row gives one
row, an empty table none. Very long texts are treated whole (a text longer than a unit is a unit of its own,
hashed in blocks). Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import documents, give_back
from sparkrank.llm.suffix_array import permuted_prefixes, prefix_hashes, suffix_array
from sparkrank.llm.units import SEPARATOR, UNIT_BYTES, Unit, beside, unit_size, units, with_shared

LENGTH, GRAM = 50, 20
CHUNK = 1 << 19
PART = 32
#: Bytes that a shard is sent on average at most, for units of UNIT_BYTES; larger units come with larger shards.
SHARD_BYTES = 8 << 20
#: Bytes sent for a byte of text if all of it is shared: a run has 16 strings on average.
SPREAD = 4
#: From so many occurrences on, a minimizer's strings are dealt one by one.
HOT = 1 << 15
LAST = np.iinfo(np.int64).max
DEDUPED = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
WHOLE = DEDUPED | {"spans": pa.list_(pa.int64()), "kept": pa.binary()}
_B = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if step < width else h


def runs(unit: Unit) -> tuple[np.ndarray, ...]:
    """(minimizer, row, start, strings, mark) of each run; the mark is a hash of the run's whole text."""
    n = len(unit.data)
    valid = np.zeros(n + 1, np.int8)
    long = unit.lengths >= LENGTH
    valid[unit.starts[long]] = 1
    valid[unit.starts[long] + unit.lengths[long] - LENGTH + 1] -= 1
    valid = np.cumsum(valid, dtype=np.int8).astype(bool)
    parts = []
    for lo in range(0, max(0, n - LENGTH + 1), CHUNK):
        data = unit.data[lo : min(n, lo + CHUNK + LENGTH - 1)]
        sums, inverse = prefix_hashes(data, _B)
        least = _least(_mixed((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1]), LENGTH - GRAM + 1)
        own = valid[lo : lo + len(least)]
        edge = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (own[1:] != own[:-1])))
        strings = np.diff(np.append(edge, len(least)))
        edge, strings = edge[own[edge]], strings[own[edge]]
        # Only repetitive text has longer runs; its parts are mostly equal, and equal ones are sent once.
        parted = -(-strings // PART)
        place = _slices(np.zeros(len(edge), np.int64), parted)
        edge, strings = np.repeat(edge, parted) + PART * place, np.minimum(np.repeat(strings, parted) - PART * place, PART)
        mark = _mixed((sums[edge + strings + LENGTH - 1] - sums[edge]) * inverse[edge] + strings.astype(np.uint64))
        parts.append((_mixed(least[edge]), edge + lo, strings, mark))  # minima crowd at the low end; mixed, they deal out evenly
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64)
    key, start, strings, mark = (np.concatenate(x) for x in zip(*parts, strict=True))
    return key, unit.doc_at(start), start, strings, mark


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unzip(blob: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=size)


def _ids(unit: Unit) -> np.ndarray:
    return np.array([LAST if i is None else i for i in unit.doc_ids], dtype=np.int64)


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start+1, ... of each slice, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def single_strings(unit: Unit, start: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, run, start) of every string of the given runs."""
    run = np.repeat(np.arange(len(start)), strings)
    first = _slices(start, strings)
    marks = np.empty(len(first), np.uint64)
    block = CHUNK // LENGTH
    for lo in range(0, len(first), block):
        data = unit.data[(first[lo : lo + block, None] + np.arange(LENGTH)).ravel()]
        sums, inverse = prefix_hashes(data, _B)
        edge = np.arange(0, len(data), LENGTH)
        marks[lo : lo + block] = _mixed((sums[edge + LENGTH] - sums[edge]) * inverse[edge] + np.uint64(1))
    return marks, run, first


def all_runs(unit: Unit, found: tuple, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs, those of crowded minimizers string by string with hashes of their own as keys."""
    if not crowded.any():
        return found
    mark, run, start = single_strings(unit, found[2][crowded], found[3][crowded])
    ones = np.ones(len(mark), np.int64)
    single = (_mixed(mark), found[1][crowded][run], start, ones, mark)
    return tuple(np.concatenate([x[~crowded], y]) for x, y in zip(found, single, strict=True))


def smallest_ids(data: np.ndarray, starts: np.ndarray, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For the 50-byte strings of each text (one text after another), the least id of a text with that string."""
    known, rank = np.unique(ids, return_inverse=True)
    sa = suffix_array(data)
    fresh = permuted_prefixes(data, sa)[0].take(sa) < LENGTH
    fresh[0] = True
    places = _slices(starts, strings)
    owner = np.full(len(data), len(known), np.int32)
    owner[places] = np.repeat(rank.astype(np.int32), strings)
    least = np.minimum.reduceat(owner.take(sa), np.flatnonzero(fresh))
    owner[sa] = least.take(np.cumsum(fresh, dtype=np.int32) - 1)
    return known.take(owner.take(places))


def suffix_dedup(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; ``with_text`` adds the removed ``spans``
    (start, end, start, end, ... in bytes) and the ``kept`` bytes."""
    table = units(docs)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-SPREAD * total // (SHARD_BYTES * unit_size(docs.sparkSession) // UNIT_BYTES)))
    packets = {"shard": pa.int64(), "unit": pa.int64(), "n": pa.int64(), "n_bytes": pa.int64(), "head": pa.binary(), "packet": pa.binary()}
    packet_schema = pa.schema(list(packets.items()))

    def sent_packet(shard, number, n, n_bytes, head, packet):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, number, n, n_bytes, head, packet), packets.values(), strict=True)], schema=packet_schema)

    def send(number, unit, shared, crowded, found):
        if not shared.any():
            return
        crowded = crowded[shared]
        found = tuple(x[shared] for x in found)
        if crowded.any():  # a note to the unit itself, so that it deals with the same strings later
            keys = np.unique(found[0][crowded])
            yield sent_packet(number % shards, number, 0, 0, _zip(keys), len(keys).to_bytes(8, "little"))
        key, row, start, strings, mark = all_runs(unit, found, crowded)
        order = np.lexsort((_ids(unit)[row], mark))
        first = np.append(True, mark[order][1:] != mark[order][:-1])
        pick = order[first]  # of each distinct text the run in the document with the smallest id
        shard = ((key[pick] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        pick, shard = pick[np.argsort(shard, kind="stable")], np.sort(shard)
        ids = _ids(unit)[row[pick]]
        for own in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(shard)) + 1):
            at = pick[own]
            lengths = strings[at] + LENGTH - 1
            text = unit.data[_slices(start[at], lengths)]
            yield sent_packet(int(shard[own[0]]), number, len(at), len(text), _zip(mark[at], ids[own], strings[at].astype(np.int32)), _zip(text))

    def answer(group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        note = np.asarray(group.column("n")) == 0
        notes = group.filter(pa.array(note))
        group = group.filter(pa.array(~note))
        out = [(u, -1, int.from_bytes(n, "little"), k) for u, k, n in zip(*(notes.column(c).to_pylist() for c in ("unit", "head", "packet")), strict=True)]
        if group.num_rows:
            out += settled(group)
        columns = zip(*out, strict=True)
        give_back()
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("unit", "n", "n_pieces", "packet"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def settled(group: pa.Table) -> list[tuple]:
        marks, ids, strings, sizes = [], [], [], group.column("n").to_pylist()
        for n, head in zip(sizes, group.column("head").to_pylist(), strict=True):
            raw = _unzip(head, 20 * n)
            marks.append(np.frombuffer(raw, "<u8", n))
            ids.append(np.frombuffer(raw, "<i8", n, 8 * n))
            strings.append(np.frombuffer(raw, "<i4", n, 16 * n))
        marks, ids, strings = (np.concatenate(x) for x in (marks, ids, strings))
        distinct, first, which = np.unique(marks, return_index=True, return_inverse=True)
        del marks
        least = np.full(len(distinct), LAST)
        np.minimum.at(least, which, ids)
        own = strings[first].astype(np.int64)
        lengths = own + LENGTH - 1
        text = np.full(int(lengths.sum()) + len(distinct), SEPARATOR, np.uint8)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        # One packet's text at a time; of equal ones the first is taken.
        from_first = np.zeros(len(which), bool)
        from_first[first] = True
        begin = 0
        for n, n_bytes, packet in zip(sizes, group.column("n_bytes").to_pylist(), group.column("packet"), strict=True):
            mine = np.flatnonzero(from_first[begin : begin + n])
            if len(mine):
                data = np.frombuffer(_unzip(packet.as_py(), n_bytes), np.uint8)
                size = strings[begin : begin + n].astype(np.int64) + LENGTH - 1
                at = (np.cumsum(size) - size)[mine]
                to = which[begin + mine]
                text[_slices(starts[to], size[mine])] = data[_slices(at, size[mine])]
            begin += n
        found = smallest_ids(text, starts, own, least)
        del text
        # Runs of equal answers within each text.
        text_starts = np.cumsum(own) - own
        edge = np.append(True, found[1:] != found[:-1])
        edge[text_starts] = True
        edges = np.flatnonzero(edge)
        length, value = np.diff(np.append(edges, len(found))), found[edges]
        pieces = np.add.reduceat(edge.astype(np.int64), text_starts)
        piece_starts = np.cumsum(pieces) - pieces
        out, begin = [], 0
        for number, n in zip(group.column("unit").to_pylist(), sizes, strict=True):
            mine = which[begin : begin + n]
            at = _slices(piece_starts[mine], pieces[mine])
            out.append((number, n, len(at), _zip(distinct[mine], pieces[mine].astype(np.int32), length[at].astype(np.int32), value[at])))
            begin += n
        return out

    sent = with_shared(table, runs, send, packets, hot)
    answers = sent.groupBy("shard").applyInArrow(answer, "unit long, n long, n_pieces long, packet binary")
    names = WHOLE if with_text else DEDUPED
    schema = pa.schema(list(names.items()))

    def remove(left: pa.Table, right: pa.Table):
        unit = Unit(*(left.column(c)[0].as_py() for c in ("doc_ids", "lengths", "blob")))
        gone = np.zeros(len(unit.data) + 1, np.int32)
        note = np.asarray(right.column("n")) < 0
        notes, right = right.filter(pa.array(note)), right.filter(pa.array(~note))
        if right.num_rows:
            found = runs(unit)
            crowded = np.zeros(len(found[0]), bool)
            for n, packet in zip(notes.column("n_pieces").to_pylist(), notes.column("packet").to_pylist(), strict=True):
                crowded |= np.isin(found[0], np.frombuffer(_unzip(packet, 8 * n), "<u8"))
            _, row, start, _, mark = all_runs(unit, found, crowded)
            del found
            parts = []
            for n, p, packet in zip(right.column("n").to_pylist(), right.column("n_pieces").to_pylist(), right.column("packet").to_pylist(), strict=True):
                raw = _unzip(packet, 12 * (n + p))
                parts.append((np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i4", n, 8 * n), np.frombuffer(raw, "<i4", p, 12 * n), np.frombuffer(raw, "<i8", p, 12 * n + 4 * p)))
            known, pieces, length, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.argsort(known)
            piece_starts = (np.cumsum(pieces, dtype=np.int64) - pieces)[order]
            known, pieces = known[order], pieces[order].astype(np.int64)
            at = np.minimum(np.searchsorted(known, mark), len(known) - 1)
            hit = known[at] == mark
            at, row, start = at[hit], row[hit], start[hit]
            own = _slices(piece_starts[at], pieces[at])
            run = np.repeat(np.arange(len(at)), pieces[at])
            length, value = length[own].astype(np.int64), value[own]
            offset = np.cumsum(length) - length
            offset -= np.repeat(offset[np.cumsum(pieces[at]) - pieces[at]], pieces[at]) if len(at) else 0
            begin = start[run] + offset
            smaller = value < _ids(unit)[row[run]]
            np.add.at(gone, begin[smaller], 1)
            np.subtract.at(gone, (begin + length + LENGTH - 1)[smaller], 1)
        mask = np.cumsum(gone[:-1], dtype=np.int32) > 0
        out = []
        for doc_id, a, n in zip(unit.doc_ids, unit.starts.tolist(), unit.lengths.tolist(), strict=True):
            own, data = mask[a : a + n], unit.data[a : a + n]
            removed = int(own.sum())
            kept = (data[~own] if removed else data).tobytes()
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if removed else ()
            out.append((doc_id, n, removed, len(edges) // 2, hashlib.sha256(kept).hexdigest(), *((list(edges), kept) if with_text else ())))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], schema=schema)
        give_back()

    return beside(table, answers, remove, names)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


OP1_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
n as (select doc_id, h, (length(h) // 2)::bigint as n_bytes from d),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) as s from (select doc_id, h, unnest(range(0, n_bytes - 49)) as i from n where n_bytes >= 50)),
m as (select s, min(doc_id) as m from w group by s),
r as (select w.doc_id, w.i, lag(w.i) over (partition by w.doc_id order by w.i) as p from w join m on w.s = m.s where m.m < w.doc_id),
f as (select doc_id, i, sum(case when p is null or i - p > 50 then 1 else 0 end) over (partition by doc_id order by i) as g from r),
spans as (select doc_id, g, min(i) as a, max(i) + 50 as b from f group by doc_id, g),
gaps as (select doc_id, b as a, lead(a) over (partition by doc_id order by a) as b from spans union all select doc_id, 0, min(a) from spans group by doc_id),
kept as (select x.doc_id, string_agg(substr(n.h, 2 * x.a + 1, 2 * (coalesce(x.b, n.n_bytes) - x.a)), '' order by x.a) as k from gaps x join n on x.doc_id = n.doc_id group by x.doc_id),
t as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans from spans group by doc_id)
select n.doc_id, n.n_bytes, coalesce(t.n_removed, 0)::bigint as n_removed, coalesce(t.n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.k, n.h))) as kept_sha256
from n left join t on n.doc_id = t.doc_id left join kept on n.doc_id = kept.doc_id
"""
