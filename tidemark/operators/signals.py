"""Signals: crossings, gaps, pivots, price levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def reentry(p: Column, lower: Column, upper: Column, by: WindowSpec) -> Column:
    """1 where the price comes back above the lower band, 2 where it comes back below the upper one, else 0."""
    q, lo, hi = (F.lag(c).over(by) for c in (p, lower, upper))
    return F.when((p > lower) & (q <= lo), 1).when((p < upper) & (q >= hi), 2).otherwise(0)


def reentry_or_mean(p: Column, lower: Column, mean: Column, by: WindowSpec) -> Column:
    q, lo, m = (F.lag(c).over(by) for c in (p, lower, mean))
    return F.when((p > lower) & (q <= lo), 1).when(((p >= mean) & (q < m)) | ((p <= mean) & (q > m)), 2).otherwise(0)


def breach(p: Column, lower: Column, upper: Column) -> Column:
    return F.when(p <= lower, 1).when(p >= upper, -1).otherwise(0)


def masks(signals: list[Column]) -> tuple[Column, Column]:
    """Bit masks of the bands that say buy, and of those that say sell."""
    bit = lambda c, v, k: F.when(c == v, F.lit(1 << k)).otherwise(0)
    up = down = F.lit(0)
    for k, c in enumerate(signals):
        up, down = up.bitwiseOR(bit(c, 1, k)), down.bitwiseOR(bit(c, -1, k))
    return up, down


def collapse(signals: list[Column]) -> Column:
    """The sign of the sum."""
    return F.signum(sum(signals[1:], signals[0])).cast("int")


def gaps(days: DataFrame) -> DataFrame:
    """Adds gap (open less the last close), gapdif, result and closed, by day."""
    w = Window.orderBy("day") if "symbol" not in days.columns else Window.partitionBy("symbol").orderBy("day")
    d = days.withColumn("gap", F.col("open") - F.lag("close").over(w)).where("gap IS NOT NULL")
    d = d.withColumn("gapdif", F.col("gap") + F.when(F.col("gap") > 0, F.col("low")).otherwise(F.col("high")) - F.col("open"))
    d = d.withColumn("result", -F.signum("gap") * F.col("gapdif"))
    return d.withColumn("closed", (F.col("result") >= 0).cast("int"))


def pivots(days: DataFrame, kind: str) -> DataFrame:
    """(day, level, price) of support and resistance levels from the day's high, low and close."""
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    r, p = h - l, (h + l + c) / 3
    levels = {
        "classic": {"R1": 2 * p - l, "R2": p + r, "S1": 2 * p - h, "S2": p - r},
        "fibonacci": {"S3": p - r, "S2": p - 0.618 * r, "R2": p + 0.618 * r, "R3": p + r},
        "camarilla": {"S3": c - r * 1.1 / 4, "S4": c - r * 1.1 / 2, "P": p, "R3": c + r * 1.1 / 4, "R4": c + r * 1.1 / 2},
    }[kind]
    return days.select("day", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), x.alias("price")) for n, x in levels.items()))).alias("v")).select("day", "v.level", "v.price")


def levels(df: DataFrame, price: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, price.alias("price")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """Counts (and sums) in ``bins`` bins from ``low``; empty bins are 0. The bins are a bounded table."""
    spark = df.sparkSession
    b = F.floor((F.col(value) - low) / width)
    g = df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count("*").alias("n"), *(x.alias(k) for k, x in (sums or {}).items()))
    return spark.range(bins).select(F.col("id").alias("bin")).join(g, "bin", "left").na.fill(0)


def peaks(hist: DataFrame, smooth: int, q: float, order: int, ties: bool = True) -> DataFrame:
    """Bins whose centred average reaches the q-quantile of all and no neighbour within ``order`` bins is larger (or, without
    ties, as large)."""
    w = Window.orderBy("bin")  # bins are few by construction
    h = hist.withColumn("s", F.avg("n").over(w.rowsBetween(-((smooth - 1) // 2), smooth // 2)))
    cut = h.agg(F.percentile("s", F.lit(q)).alias("cut"))
    sides = F.greatest(F.coalesce(F.max("s").over(w.rowsBetween(-order, -1)), F.lit(-1.0)), F.coalesce(F.max("s").over(w.rowsBetween(1, order)), F.lit(-1.0)))
    top = F.col("s") >= F.col("sides") if ties else F.col("s") > F.col("sides")
    return h.withColumn("sides", sides).join(F.broadcast(cut)).where((F.col("s") >= F.col("cut")) & top).select("bin", "n", "s")


def ladder(levels: DataFrame, quotes: DataFrame, n: int, reward_risk: float) -> DataFrame:
    """For each day the n supports next below the quote as orders, the furthest as their stop, the next resistance as target;
    left out where the reward is less than reward_risk times the risk."""
    j = levels.join(quotes, "day")
    below = j.where("price < quote").withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("price")))).where(F.col("k") <= n + 1)
    stop = below.groupBy("day").agg(F.min("price").alias("stop"))
    target = j.where("price > quote").groupBy("day").agg(F.min("price").alias("target"))
    out = below.join(stop, "day").join(target, "day").where((F.col("price") > F.col("stop")) & (F.col("k") <= n))
    return out.where((F.col("target") - F.col("price")) >= reward_risk * (F.col("price") - F.col("stop"))).select("day", "k", "price", "stop", "target")
