"""Language identification with hyperdimensional profiles.

Every letter, of any script, owns a random vector of +1 and -1 that its code point seeds. A letter n-gram's vector binds (multiplies) the letters'
vectors, each permuted (rotated) by its place. A text's vector bundles (adds) those of its n-grams, a
language's prototype those of its training texts at unit length. A text gets the language whose prototype
has the largest cosine with it; the score is that cosine, cut to 0..1.

Prototypes are learned from a bounded sample: of each language, texts with a hash of the id below a
threshold that lets about ``per_language`` through; vectors are added up on the executors. A null or letterless
text gets ``und`` and score 0, as does every text if there is nothing to learn from; ties go to the first
language by name. Very long texts are read whole. Repeated rows are judged each for itself; empty tables give no
rows. Null ids are allowed. Columns other than id, text and language are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.llm.common import crc_mod, crc_mod_py, ddl, documents, per_batch, texts, tidy

UNDETERMINED = "und"
DIMENSIONS, ORDER, SEED = 1024, 3, 6
PER_LANGUAGE = 1500
#: Code points looked up in a table; rarer ones one by one.
KNOWN = 0x3000
#: Bits of a code point within an n-gram's code.
BITS = 21
BLOCK_CHARS, BLOCK_TEXTS = 1_000_000, 256
#: Letters whose vectors a worker remembers; a full memory is emptied.
REMEMBERED = 8192
LANGUAGES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}


def letter(cp: int) -> int:
    """The code point of a letter's lower case; 0 for what is no letter."""
    return ord(chr(cp).lower()[0]) if unicodedata.category(chr(cp)).startswith("L") else 0


class Letters:
    """n-gram codes and their vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.table = np.array([letter(cp) for cp in range(KNOWN)], np.int64)
        self.dimensions, self.known = dimensions, {}

    def vector(self, symbol: int) -> np.ndarray:
        """A letter's own vector; symbol 0 stands for any other character and a text's ends."""
        found = self.known.get(symbol)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[symbol] = np.random.default_rng([SEED, symbol]).choice(np.array([-1, 1], np.int8), self.dimensions)
        return found

    def symbols(self, text: str) -> np.ndarray:
        cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.table.take(cps, mode="clip")
        rare = np.flatnonzero(cps >= KNOWN)
        if len(rare):
            distinct, back = np.unique(cps[rare], return_inverse=True)
            found[rare] = np.array([letter(c) for c in distinct.tolist()], np.int64)[back]
        return found

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Codes of the text's n-grams and their counts; None if it has no letter."""
        s = self.symbols(text)
        if not s.any():
            return None
        s = np.concatenate([[0], s, [0]])
        n = len(s) - ORDER + 1
        code = s[:n].copy()
        for k in range(1, ORDER):
            code <<= BITS
            code |= s[k : n + k]
        code = code[code > 0]
        code.sort()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return code[first], np.diff(np.append(first, len(code)))

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Letters' vectors, each turned by its place, multiplied."""
        out = None
        for k in range(ORDER):
            symbols, back = np.unique((codes >> (BITS * (ORDER - 1 - k))) & ((1 << BITS) - 1), return_inverse=True)
            own = np.roll(np.stack([self.vector(s) for s in symbols.tolist()]), ORDER - 1 - k, axis=1)[back]
            out = own if out is None else out * own
        return out.astype(np.float32)

    def bundles(self, whole: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Blocks of (places of texts with letters, their vectors at unit length)."""
        at = 0
        while at < len(whole):
            place, found, chars = [], [], 0
            while at < len(whole) and len(place) < BLOCK_TEXTS and chars < BLOCK_CHARS:
                if (g := self.grams(whole[at])) is not None:
                    place.append(at)
                    found.append(g)
                chars += len(whole[at])
                at += 1
            if not place:
                continue
            distinct, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.zeros((len(place), len(distinct)), np.float32)
            counts[np.repeat(np.arange(len(place)), [len(c) for c, _ in found]), back] = np.concatenate([n for _, n in found])
            v = np.zeros((len(place), self.dimensions), np.float32)
            for lo in range(0, len(distinct), 4096):
                v += counts[:, lo : lo + 4096] @ self.vectors(distinct[lo : lo + 4096])
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield place, v / np.where(size > 0, size, 1)


def learn(docs: DataFrame, lang_col: str = "lang", fold: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows outside the held-out fold that have a text and a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != fold))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return {}
    share = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    keep = F.coalesce(*[F.when(F.col("lang") == lang, share < min(1.0, per_language / n)) for lang, n in counts.items()])
    schema = pa.schema([("lang", pa.string()), ("vector", pa.binary())])

    def bundle(batches):
        letters, sums = Letters(), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for place, v in letters.bundles(batch.column("text").to_pylist()):
                for k, p in enumerate(place):
                    sums[langs[p]] = sums.get(langs[p], 0) + v[k].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], schema=schema)

    def total(group: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(x) for x in sorted(group.column("vector").to_pylist())]  # in a fixed order, for the rounding
        return pa.Table.from_arrays([group.column("lang").slice(0, 1), pa.array([np.sum(vectors, axis=0).tobytes()], pa.binary())], schema=schema)

    parts = rows.where(keep).select("lang", "text").mapInArrow(tidy(bundle), "lang string, vector binary")
    summed = {r["lang"]: np.frombuffer(r["vector"]) for r in parts.groupBy("lang").applyInArrow(total, "lang string, vector binary").collect()}  # a row per language
    return {k: (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32) for k, v in sorted(summed.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names], axis=1) if names else None

    def run(batches):
        letters = Letters()

        def score(ids, whole):
            best, value = [UNDETERMINED] * len(whole), [0.0] * len(whole)
            for place, v in letters.bundles(whole) if names else ():
                cosine = v @ matrix
                at = cosine.argmax(axis=1)
                for k, p in enumerate(place):
                    best[p], value[p] = names[at[k]], min(1.0, max(0.0, float(cosine[k, at[k]])))
            return ids, [crc_mod_py(i, folds) == fold for i in ids], best, value

        yield from per_batch(score, LANGUAGES)(batches)

    return texts(docs).mapInArrow(run, ddl(LANGUAGES))


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs))


def determined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, all columns; the language told is written to ``lang_col``.
    Where there is nothing to learn from no language can be told: rows with a letter stay, as they are."""
    prototypes = learn(docs, lang_col)
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values()), axis=1) if names else None

    def run(batches):
        letters = Letters()
        for batch in batches:
            lang: list[str | None] = [None] * batch.num_rows
            whole = [t or "" for t in batch.column(text_col).to_pylist()]
            if matrix is None:
                lang = [old if letters.symbols(t).any() else None for t, old in zip(whole, (x or "" for x in batch.column(lang_col).to_pylist()), strict=True)]
            else:
                for place, v in letters.bundles(whole):
                    for p, at in zip(place, (v @ matrix).argmax(axis=1).tolist(), strict=True):
                        lang[p] = names[at]
            out = batch if matrix is None else batch.set_column(batch.schema.get_field_index(lang_col), lang_col, pa.array(lang, pa.string()))
            yield out.filter(pa.array([x is not None for x in lang], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
