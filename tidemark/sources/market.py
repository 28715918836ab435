"""The engine's views of the tables at hand: ticks from ``events``, daily series from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ordered import windowed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with gaps: zero bid, ask or last where the feed gave none."""
    e = table(spark, sf_dir, "events")
    e = windowed(e, ["event_type"], ["event_id"], F.to_date("ts"), 1, lambda t, w: t.withColumn("before", F.lag("value").over(w)))
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("time"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_msc"),
        F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.coalesce("before", "value")).alias("bid"),
        F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("ask"),
        F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("value")).alias("last"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean ticks, without the order-dependent columns: one pass over the scan, no shuffle."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("time"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_msc"),
        F.col("value").alias("last"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("volume > 0")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day: open, high, low, close of order totals and their count; open and close by order key."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.groupBy("day").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("n"),
    )


# The same views for the SQL side.
TICKS_SQL = """ticks AS (
  SELECT event_type AS symbol, event_id AS seq, ts AS time, epoch_us(ts) // 1000 AS time_msc, value AS last,
         CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume
  FROM events)"""
RAW_SQL = """raw AS (
  SELECT event_type AS symbol, event_id AS seq, ts AS time, epoch_us(ts) // 1000 AS time_msc,
         CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE coalesce(lag(value) OVER (PARTITION BY event_type ORDER BY event_id), value) END AS bid,
         CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS ask,
         CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS last,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume
  FROM events)"""
DEALS_SQL = TICKS_SQL + ", deals AS (SELECT * FROM ticks WHERE volume > 0)"
DAILY_SQL = """daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS n
  FROM orders GROUP BY 1)"""
