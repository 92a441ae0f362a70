"""Cutting lineage in a way that outlives executors: tables in the folder that all of them share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``; a local one only if the session names none and
    has no executors beside the driver."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = getattr(spark, "_sparkrank_dir", None)
    if where is None:
        folder = tempfile.mkdtemp(prefix="sparkrank-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = spark._sparkrank_dir = "file://" + folder
    return where


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the driver."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


#: For rows that hold thousands of rows each. Parquet counts bytes after a hundred rows first, and readers decode up to 4096 rows at once:
#: of rows of a megabyte that is gigabytes a task.
PACKED = {"parquet.block.row.count.limit": 8, "parquet.page.size.row.check.min": 1, "parquet.page.row.count.limit": 1, "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false"}


def written(df: DataFrame, name: str, by: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and returns a scan of what was written, in directories of the columns
    ``by``. ``packed``: its rows are large, and few of them go together. The table goes when the driver ends, or earlier by :func:`deleted`."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    (df.write.partitionBy(*by) if by else df.write).options(**(PACKED if packed else {})).parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan._sparkrank_path = path
    spark._sparkrank_tables = [*getattr(spark, "_sparkrank_tables", ()), path]
    return scan


def deleted(scan: DataFrame) -> None:
    """Deletes a table that :func:`written` made, once nothing reads it any more."""
    spark, path = scan.sparkSession, getattr(scan, "_sparkrank_path", None)
    if path is not None:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
        fs.cancelDeleteOnExit(at)
        spark._sparkrank_tables = [p for p in getattr(spark, "_sparkrank_tables", ()) if p != path]


def finished(spark: SparkSession, before: list[str], keep: DataFrame) -> None:
    """Deletes the tables written since ``before`` (see :func:`tables`) but ``keep``, which was written from them."""
    for path in tables(spark):
        if path not in before and path != getattr(keep, "_sparkrank_path", None):
            fs, at = _file_system(spark, path)
            fs.delete(at, True)
            fs.cancelDeleteOnExit(at)
    spark._sparkrank_tables = [p for p in tables(spark) if p in before or p == getattr(keep, "_sparkrank_path", None)]


def side_session(spark: SparkSession) -> SparkSession:
    """Another session with this one's settings and shared folder. A session that has observed metrics can't be sent to
    executors, and MLlib's models send theirs along; so what observes does it in a session of its own."""
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            side.conf.set(key, value)
    side._sparkrank_dir = shared_dir(spark)
    return side


def handed_over(scan: DataFrame, spark: SparkSession) -> DataFrame:
    """A table that :func:`written` made in another session, as one of this session."""
    path, other = scan._sparkrank_path, scan.sparkSession
    other._sparkrank_tables = [p for p in tables(other) if p != path]
    out = spark.read.schema(scan.schema).parquet(path)
    out._sparkrank_path = path
    spark._sparkrank_tables = [*tables(spark), path]
    return out


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables written and not deleted yet."""
    return list(getattr(spark, "_sparkrank_tables", ()))
