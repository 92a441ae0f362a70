"""Helpers shared by the training-data operators: Arrow plumbing, columns, folds; lineage is cut as elsewhere."""

from __future__ import annotations

import ctypes
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.plans.lineage import deleted, finished, shared_dir, tables, written  # noqa: F401

#: A word of the contracts: a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, a null text as an empty one; other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_name(taken: list[str]) -> str:
    """A column name that isn't taken."""
    low = {c.lower() for c in taken}
    return next(n for k in range(len(taken) + 1) if (n := f"_own{k}") not in low)


#: Keys of rows (some 50 bytes each) that are broadcast at most.
KEYS_LIMIT = 500_000


def few(df: DataFrame, limit: int = KEYS_LIMIT) -> bool:
    return df.limit(limit + 1).count() <= limit


def hinted(df: DataFrame, limit: int = KEYS_LIMIT) -> DataFrame:
    """``df`` to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if few(df, limit) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def crc_mod(col, n: int):
    """The remainder that assigns folds: crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def per_batch(fn, names: dict[str, pa.DataType]):
    """Makes of ``fn(ids, texts) -> columns`` a function for mapInArrow that returns one row per document."""
    schema = pa.schema(list(names.items()))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id")
            columns = fn(ids.to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, names.values(), strict=True)], schema=schema)

    return tidy(run)


def task_memory(spark: SparkSession) -> int:
    """Bytes of an executor's heap for each task that it runs at a time; 1 GB a task where the session doesn't say."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    given = re.fullmatch(r"(\d+)([bkmgt]?)b?", (conf.get("spark.driver.memory" if local else "spark.executor.memory", None) or "").strip().lower())
    if not given:
        return 1 << 30
    size = int(given[1]) << {"b": 0, "k": 10, "m": 20, "": 20, "g": 30, "t": 40}[given[2]]
    cores = conf.get("spark.executor.cores", None) or (re.findall(r"local-cluster\[\d+,\s*(\d+)", spark.sparkContext.master) or [None])[0]
    return size // max(1, spark.sparkContext.defaultParallelism if local else int(cores or 1))


def give_back() -> None:
    """Returns a worker's free memory to the system, where the C library can. Idle workers otherwise keep what their
    largest group took beside those that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` for mapInArrow, whose worker gives free memory back after the task's own objects are gone."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def ddl(names: dict[str, pa.DataType]) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int16()): "array<short>"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in names.items())
