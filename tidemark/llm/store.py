"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``, one folder for each application.

A returned DataFrame may read them until the application ends; clear() deletes them all."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tokens import PieceEncoder

BATCH = 500  #: rows with whole texts that Python holds at a time
MARKS = 1 << 23  #: bits of marked()
_PAGE = 1 << 15  #: bits of one bitmap of Spark's
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  #: glibc's


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, so a lost executor costs only tasks that
    read the table again, and what two later branches share is computed once. While it is written, Arrow batches are small
    (they may hold whole texts); the session's own limit holds again afterwards."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(limit)
    spark.conf.set(limit, min(int(own), BATCH) if int(own) > 0 else BATCH)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(limit, own)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH, tokenizes: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of a few texts, so that only those are Python objects at a time. A worker gives back the memory
    of its batches when it has done its task. Workers go on to other steps: ``tokenizes`` says that this one wants the
    tokenizers and pieces that the worker has, all others drop them."""
    if not tokenizes:
        PieceEncoder.drop()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def spread(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n", share: int = 1000) -> DataFrame:
    """Inner join with a table that has each key once, and in ``n`` how many of the rows have it.

    Keys that more than one row in ``share`` has are joined by broadcast (there can be no more than ``share`` of them), so
    that a hot key's rows stay where they are; all others by a shuffle. Null keys find nothing.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.broadcast(table.where(F.col(n) * share > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) * share <= total), keys)
    return rows.join(hot, keys).unionByName(rest)


def marked(rows: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """``rows`` and a boolean column ``name``: true wherever ``table`` (one column) has the row's ``key``, and by chance
    for others, so that rows with large columns can be told apart before they are shuffled. ``table``'s hashes are marked in a
    bitmap, of which at most ``MARKS`` bits (1 MB) are broadcast, however long it is; the more it has, the more are marked by chance.
    """
    page, bits = (free(n, [*rows.columns, name]) for n in ("page", "bits"))
    spot = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast("long")), F.lit(MARKS))
    pages = table.select(spot(table.columns[0]).alias("spot")).groupBy(F.expr(f"spot div {_PAGE}").alias(page)).agg(F.bitmap_construct_agg(F.col("spot") % _PAGE).alias(bits))
    at = spot(key) % _PAGE
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(pages), F.floor(spot(key) / _PAGE) == F.col(page), "left")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(name))


def free(name: str, taken: list[str]) -> str:
    """``name``, or if a column has it, with as many underscores before it as it takes."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; no DataFrame that an operator returned can be read afterwards."""
    remove(spark, _own(spark))
