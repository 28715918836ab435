"""Shards by extendible hashing.

The directory is indexed by bits of a key's hash, first bit first. It starts as one bucket; a bucket over the byte limit
is split on its next bit, and no other is. STEP bits are looked at in a round, all by grouped sums: bytes are summed for
prefixes of each depth, a row's shard is its shortest prefix that fits, and only rows whose prefixes are all too large go
on to the next round's bits. A prefix of a round has at most 2**STEP finer ones, and rows learn their shard by a join that leaves
those of hot keys where they are, so that no key passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .store import free, join_counted, materialize

KEY_BITS = 60  #: of md5 over the key; rows of one key are told apart by ROW_BITS more
ROW_BITS = 32
STEP = 4
DIRECTORY = 100_000  #: shards of a directory that is broadcast (three numbers each)
SHARD = ("local_depth", "prefix", "row_prefix")


def _key_hash(key: str) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> tuple[Column, Column]:
    """Key bits and row bits of a prefix."""
    key = F.when(depth <= KEY_BITS, F.expr(f"shiftright(key_hash, cast({KEY_BITS} - least(depth, {KEY_BITS}) as int))")).otherwise(F.col("key_hash"))
    row = F.expr(f"shiftright(row_hash, cast({ROW_BITS} - greatest(depth - {KEY_BITS}, 0) as int))")
    return key, row


def shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, local_depth, prefix, row_prefix, shard_bytes) of each row of ``docs`` (key, text).

    A shard is (local_depth, prefix, row_prefix): the rows whose hash starts with those bits; row_prefix is 0 unless one key
    alone exceeds the limit. n_bytes counts the text's UTF-8 bytes (null: 0). Every shard has at most ``limit`` bytes, but for a
    single row that is larger, which gets a shard of its own. Rows with null key share one hash and split like any other
    key; equal rows count one by one. An empty table has no shard. Other columns take no part.
    """
    return _placed(docs.select(F.col(key), "text"), limit, key).drop("row")


def _placed(docs: DataFrame, limit: int, key: str, row: str | None = None) -> DataFrame:
    """shards(), and the column ``row`` (by which the caller knows its rows)."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    rows = docs.select(
        F.col(key).alias("key"),
        _key_hash(key).alias("key_hash"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
    )
    rows = materialize(rows.withColumn("row_hash", F.expr("xxhash64(row) & 4294967295L")), "hashes")
    low, out = 0, None
    while True:
        last = KEY_BITS if low <= KEY_BITS else KEY_BITS + ROW_BITS
        high = min(low + STEP, last)
        at = F.col("depth")
        keyed = rows.withColumn("depth", F.lit(high)).select("key", "key_hash", "row_hash", "n_bytes", "row", *(c.alias(n) for c, n in zip(_prefix(at), ("fine", "fine_row"))))
        fine = keyed.groupBy("fine", "fine_row").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), (F.min("key_hash") == F.max("key_hash")).alias("alone"))
        fine = materialize(fine, "prefixes")
        # prefixes of every depth of this round, from the finest ones
        deep = max(0, high - KEY_BITS)
        key_part = F.when(F.lit(high) - at <= deep, F.col("fine")).otherwise(F.expr(f"shiftright(fine, cast({high} - depth - {deep} as int))"))
        row_part = F.expr(f"shiftright(fine_row, cast(least({high} - depth, {deep}) as int))")
        spread = fine.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).select("fine", "fine_row", "n_bytes", "n", "depth", key_part.alias("prefix"), row_part.alias("row_prefix"))
        sums = spread.groupBy("depth", "prefix", "row_prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("held"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("held") == 1) | (F.col("depth") == KEY_BITS + ROW_BITS))
        chosen = spread.join(fits, ["depth", "prefix", "row_prefix"]).groupBy("fine", "fine_row").agg(F.min(F.struct("depth", "prefix", "row_prefix", "shard_bytes")).alias("s"))
        directory = materialize(fine.join(chosen, ["fine", "fine_row"], "left").select("fine", "fine_row", "n", "alone", "s"), "directory")
        marked = materialize(join_counted(keyed, directory, ["fine", "fine_row"]).drop("fine", "fine_row", "n", "alone"), "marked")
        done = marked.where("s IS NOT NULL").select(F.col("key").alias(key), "n_bytes", F.col("s.depth").alias("local_depth"), "s.prefix", "s.row_prefix", "s.shard_bytes", "row")
        out = done if out is None else out.unionByName(done)
        more = directory.where("s IS NULL").agg(F.bool_and("alone")).first()[0]
        if more is None:
            return out
        rows = marked.where("s IS NULL").drop("s")
        low = KEY_BITS + 1 if more and high <= KEY_BITS else high + 1


def write(docs: DataFrame, limit: int, path: str, key: str = "doc_id") -> None:
    """Write the rows of each shard to a folder of its own under ``path``, each row once, whatever keys repeat. The folders are
    named by the columns of SHARD, with underscores before those that ``docs`` has.

    Where no key had to be split and the directory has at most DIRECTORY shards, it is broadcast and texts are shuffled once, to
    their shards; else rows are numbered, written and joined with their shards by number."""
    names, row = [free(n, docs.columns) for n in SHARD], free("row", docs.columns)
    shards_ = materialize(_placed(docs.select(F.col(key), "text"), limit, key).select(*SHARD).distinct(), "shards")
    n, deepest = shards_.agg(F.count("*"), F.max("local_depth")).first()
    if n and n <= DIRECTORY and deepest <= KEY_BITS:
        depths = [r[0] for r in shards_.select("local_depth").distinct().collect()]  # up to KEY_BITS numbers
        h = free("key_hash", docs.columns)
        rows = docs.withColumn(h, _key_hash(key)).withColumn(names[0], F.explode(F.array(*map(F.lit, depths)))).withColumn(names[1], F.expr(f"shiftright(`{h}`, cast({KEY_BITS} - `{names[0]}` as int))"))
        placed = rows.join(F.broadcast(shards_.toDF(*names)), names[:2]).drop(h)
    else:
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = _placed(numbered.select(F.col(key), "text", row), limit, key, row).select(F.col("row").alias(row), *(F.col(c).alias(n) for c, n in zip(SHARD, names)))
        placed = numbered.join(found, row).drop(row)
    placed.repartition(*names).write.partitionBy(*names).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows that write() wrote and their shards. schema: of the rows, without which a table that is empty cannot be read."""
    if schema is None:
        return spark.read.parquet(path)
    names = [free(n, schema.names) for n in SHARD]
    kinds = zip(names, (IntegerType(), LongType(), LongType()))
    return spark.read.schema(StructType([*schema.fields, *(StructField(n, k) for n, k in kinds)])).parquet(path)


def oracle(limit: int) -> str:
    """The same in DuckDB, for unique keys none of which is larger than the limit."""
    return f"""
    WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
    g AS (SELECT d, h >> ({KEY_BITS} - d) AS p, CAST(sum(n_bytes) AS BIGINT) AS s FROM r, range({KEY_BITS + 1}) t(d) GROUP BY ALL),
    leaf AS (SELECT r.doc_id, min(g.d) AS d FROM r JOIN g ON g.p = r.h >> ({KEY_BITS} - g.d) WHERE g.s <= {limit} GROUP BY 1)
    SELECT r.doc_id, r.n_bytes, CAST(leaf.d AS INTEGER) AS local_depth, g.p AS prefix, CAST(0 AS BIGINT) AS row_prefix, g.s AS shard_bytes
    FROM r JOIN leaf ON leaf.doc_id = r.doc_id JOIN g ON g.d = leaf.d AND g.p = r.h >> ({KEY_BITS} - leaf.d)"""
