"""Aggregates, order and scalar helpers."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ieee import divided, floored
from ..plans.ordered import matched, running_sum
from ..plans.scratch import stored


def distribution(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, col, n, upto): each different value, how many rows have it and how many have it or a smaller one. Values are counted where they
    are, the counts are dealt out by ranges of values and summed up across those: neither a key nor a frequent value is one
    task. Nulls are left out."""
    n = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("n"))
    dealt = stored(n.repartitionByRange(*keys, col).withColumn("_part", F.spark_partition_id()), "values")
    return running_sum(dealt, F.col("n"), "upto", keys, [col], F.col("_part"))


def _ranked(df: DataFrame, keys: list[str], col: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, total, one column for each of ``ranks``): the values with these places, from 1, among ``total`` sorted ones. Keys without a value
    have nulls."""
    d = stored(distribution(df, keys, col).select(*keys, F.col(col).alias("_value"), "upto"), "distribution")
    d = matched(d, d.groupBy(*keys).agg(F.max("upto").alias("total")), keys)
    found = d.groupBy(*keys).agg(F.max("total").alias("total"), *(F.min(F.when(F.col("upto") >= rank, F.col("_value"))).alias(out) for out, rank in ranks.items()))
    return matched(df.select(*keys).distinct(), found, keys, "left") if keys else found


def quantiles(df: DataFrame, keys: list[str], col: str, points: dict[str, float]) -> DataFrame:
    """(keys, one column for each of ``points``): exact quantiles, linearly interpolated."""
    at = {out: p * (F.col("total") - 1) for out, p in points.items()}
    ranks = {f"_{side}_{out}": f(x) + 1 for out, x in at.items() for side, f in (("a", F.floor), ("b", F.ceil))}
    d = _ranked(df, keys, col, ranks)
    return d.select(*keys, *((F.col(f"_a_{out}") + (F.col(f"_b_{out}") - F.col(f"_a_{out}")) * (x - F.floor(x))).alias(out) for out, x in at.items()))


def percentiles(df: DataFrame, col: str, points: list[int], keys: list[str]) -> DataFrame:
    """Exact, linearly interpolated."""
    return quantiles(df, keys, col, {f"p{p}": p / 100 for p in points})


def nearest_rank(df: DataFrame, col: str, p: float, keys: list[str]) -> DataFrame:
    """The value at place max(round(p n + 0.5), 2) - 1 of the sorted ones, halves rounded away from zero."""
    return _ranked(df, keys, col, {"value": F.greatest(F.round(F.col("total") * p + 0.5), F.lit(2.0)) - 1}).drop("total").where("value IS NOT NULL")


def percentile_of(df: DataFrame, col: str, value: float, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((100 * F.avg((F.col(col) <= value).cast("double"))).alias("pct"))


def density(df: DataFrame, col: str, grid: list[float], width: float, bin_width: float) -> DataFrame:
    """Gaussian kernel density at the grid's points. Values are binned first, so each bin, not each row, meets the grid."""
    binned = df.groupBy((F.floor(F.col(col) / bin_width) * bin_width).alias("v")).agg(F.count("*").alias("n"))
    points = binned.select("n", "v", F.explode(F.array(*map(F.lit, grid))).alias("x"))
    return points.groupBy("x").agg((F.sum(F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / width, 2)) * F.col("n")) / (F.sum("n") * width * sqrt(2 * pi))).alias("density"))


def describe(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"), F.max(col).alias("hi"))


def first_of(df: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def sample(df: DataFrame, share: float, keys: list[str], seed: int) -> DataFrame:
    """A random share of rows that a hash of their key settles: the same rows on any machine and in any order."""
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def scalars(df: DataFrame, price: str = "last") -> DataFrame:
    x = F.col(price)
    return df.withColumns({"tick": F.floor(x / 0.05) * 0.05, "side": F.signum(x - 250), "root": F.sqrt(x), "lot": floored(divided(F.lit(10_000.0), x) / 100) * 100, "clipped": F.greatest(F.least(x, F.lit(400.0)), F.lit(50.0))})
