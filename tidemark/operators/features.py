"""Feature vectors, scaling and selection."""

from __future__ import annotations

from math import copysign, log
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import matched
from ..plans.scratch import stored
from . import indicators, stats

BAR_FEATURES = ["dtp", "wprice", "fd", "sadf", "csum", "stdev", "span", "nticks", "netvol", "dspan", "dnticks"]


def event_vectors(bars: DataFrame, events: DataFrame, cols: list[str], batch: int, extra: list[str], minbars: int = 1) -> DataFrame:
    """(symbol, twhen, vertbar, x, inf_start, inf_end): features of the ``batch`` bars up to the event, oldest first, then those of
    the label. An event whose look-back meets a missing value or the start of the data is left out. The span of
    information begins with the oldest bar's own history and ends when the label is known."""
    w = Window.partitionBy("symbol").orderBy("uid").rowsBetween(-(batch - 1), 0)
    whole = F.when(sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)) == len(cols), F.array(*(F.col(c).cast("double") for c in cols)))
    b = bars.select("symbol", F.col("uid").alias("twhen"), F.collect_list(whole).over(w).alias("back")).where(F.size("back") == batch)
    j = events.join(b, ["symbol", "twhen"])
    x = F.concat(F.flatten("back"), F.array(*(F.col(c).cast("double") for c in extra)))
    return j.select("symbol", "twhen", "vertbar", x.alias("x"), (F.col("twhen") - (batch - 1) - (minbars - 1)).alias("inf_start"), F.col("tdone").alias("inf_end"))


def log_volumes(df: DataFrame, cols: list[str], shift: float = 1.0) -> DataFrame:
    return df.withColumns({c: F.log(F.col(c) + shift) for c in cols})


def z_scores(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Less the mean, by the population deviation, within each key; the statistics are one row per key."""
    moments = df.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    return matched(df, moments, keys).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in "ms"))


def min_max(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    ends = df.groupBy(*keys).agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("a", F.min), ("b", F.max))))
    return matched(df, ends, keys).withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0)) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in "ab"))


def robust(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """Less the median, by the spread between the quartiles."""
    out = df
    for c in cols:
        out = matched(out, stats.quantiles(df, keys, c, {f"_a_{c}": 0.25, f"_m_{c}": 0.5, f"_b_{c}": 0.75}), keys)
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0)) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in "amb"))


def normal_score(df: DataFrame, col: str, keys: list[str], out: str) -> DataFrame:
    """The normal quantile of each value's rank within its key (a rational approximation by column expressions)."""
    d = stored(stats.distribution(df, keys, col), "distribution")
    n = d.groupBy(*keys).agg(F.max("upto").alias("_total"))
    df = matched(df, matched(d, n, keys).select(*keys, col, (F.col("upto") - F.col("n") + 1).alias("_rank"), "_total"), [*keys, col], "left")
    p = (F.col("_rank") - 0.5) / F.col("_total")
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return df.withColumn(out, F.when(p < 0.5, -z).otherwise(z)).drop("_rank", "_total")


def structural(df: DataFrame, keys: list[str], order: str, col: str, maxw: int, minw: int, lags: int, h: float, d: float, weights: int) -> DataFrame:
    """(keys, order, sadf, csum, fd): the supremum ADF of a series, the events of the CUSUM filter over that (bound ``h``), and the
    fractional difference of the series (``weights`` of them)."""
    s = stored(indicators.sadf(df, keys, order, col, maxw, minw, lags).select(*keys, order, "sadf"), "supremum")
    c = indicators.cusum(s, keys, order, "sadf", h).withColumnRenamed("event", "csum")
    f = indicators.long_fracdiff(df, keys, order, col, d, {"fd": weights})
    return matched(matched(s, c, [*keys, order]), f, [*keys, order])


def cut(x: Column, edges: list[float]) -> Column:
    """The number of edges at or below the value."""
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def normal_edges(n: int, mean: float = 0.0, deviation: float = 1.0) -> list[float]:
    """Quantiles at n evenly spaced probabilities from 0 to 1, for cut(): n - 1 bins of equal probability."""
    normal = NormalDist(mean, deviation)
    return [float("-inf"), *(normal.inv_cdf(k / (n - 1)) for k in range(1, n - 1)), float("inf")]


def laplace_edges(n: int, mean: float = 0.0, scale: float = 1.0) -> list[float]:
    at = [k / (n - 1) - 0.5 for k in range(1, n - 1)]
    return [float("-inf"), *(mean - scale * copysign(log(1 - 2 * abs(p)), p) if p else mean for p in at), float("inf")]


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))).alias("v")).select("v.*")


def similar(df: DataFrame, cols: list[str], above: float) -> DataFrame:
    """Columns to drop: the second of each pair whose correlation exceeds the bound."""
    return correlations(df, cols).where(F.abs("corr") > above).select(F.col("b").alias("col")).distinct()


def class_entropy(df: DataFrame, label: str, keys: list[str], base: int = 3) -> DataFrame:
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return p.groupBy(*keys).agg((-F.sum(F.col("p") * F.log(F.col("p")) / F.log(F.lit(float(base))))).alias("entropy"))


def clock(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour("time"), "minute": F.minute("time"), "weekday": F.weekday("time"), "yearday": F.dayofyear("time")})
