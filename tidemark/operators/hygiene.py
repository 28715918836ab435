"""Cleaning of ticks: fills, flags, filters, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import last_known, matched
from .stats import quantiles

SERIES = ["symbol"]
ORDER = ["seq"]


def fill_quotes(ticks: DataFrame, cols=("bid", "ask", "last"), day: bool = False) -> DataFrame:
    """Zero quotes take the last quote before them (0 where there is none), over the whole series or within each day."""
    known = {c: F.nullif(F.col(c), F.lit(0.0)) for c in cols}
    if day:
        w = Window.partitionBy(*SERIES, F.to_date("time")).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        return ticks.withColumns({c: F.coalesce(F.last(v, ignorenulls=True).over(w), F.lit(0.0)) for c, v in known.items()})
    return last_known(ticks, known, SERIES, ORDER, F.floor(F.col(ORDER[0]) / 50_000)).na.fill(0.0, list(cols))


def aggressor(ticks: DataFrame) -> DataFrame:
    """Adds flag: -1 for a deal at the bid, 1 at the ask, else 0; the bid wins ties."""
    return ticks.withColumn("flag", F.when(F.col("last") == F.col("bid"), -1).when(F.col("last") == F.col("ask"), 1).otherwise(0))


def trim_days(ticks: DataFrame, volume: str = "volume") -> DataFrame:
    """Without ticks before a day's first and after its last deal; days without a deal go."""
    w = Window.partitionBy(*SERIES, F.to_date("time"))
    dealt = F.when(F.col(volume) != 0, F.col("seq"))
    return ticks.withColumns({"_a": F.min(dealt).over(w), "_b": F.max(dealt).over(w)}).where("seq BETWEEN _a AND _b").drop("_a", "_b")


def clip_to_bars(ticks: DataFrame, bars: DataFrame) -> DataFrame:
    """Ticks of each day from its first bar to a minute past its last."""
    span = bars.groupBy("symbol", F.to_date("time").alias("_day")).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    joined = ticks.withColumn("_day", F.to_date("time")).join(span, ["symbol", "_day"])
    return joined.where((F.col("time") >= F.col("_a")) & (F.col("time") <= F.col("_b") + F.expr("INTERVAL 1 MINUTE"))).drop("_day", "_a", "_b")


def without_overlap(old: DataFrame, new: DataFrame, key=("symbol", "time_msc", "seq")) -> DataFrame:
    """New records that an earlier pull has not brought."""
    return new.join(old.select(*key).distinct(), list(key), "left_anti")


def placed(ticks: DataFrame, out: str = "place") -> DataFrame:
    """Adds each tick's place, from 1, within its millisecond."""
    return ticks.withColumn(out, F.row_number().over(Window.partitionBy("symbol", "time_msc").orderBy("seq")))


def replace_matched(simulated: DataFrame, reference: DataFrame, cols=("last", "volume"), place: str | None = None) -> DataFrame:
    """Simulated ticks take the values of the reference tick of the same millisecond and place within it. ``place``: the column of the
    simulated ticks that has their place, where some of a millisecond's ticks are not among them."""
    s = simulated.withColumn("_k", F.col(place)) if place else placed(simulated, "_k")
    r = placed(reference, "_k")
    r = r.select("symbol", "time_msc", "_k", *(F.col(c).alias(f"_{c}") for c in cols))
    out = s.join(r, ["symbol", "time_msc", "_k"])
    return out.withColumns({c: F.col(f"_{c}") for c in cols}).drop("_k", *(f"_{c}" for c in cols))


def full_days(df: DataFrame, at_least: int) -> DataFrame:
    """Rows of days with at least so many rows."""
    n = df.groupBy("symbol", F.to_date("time").alias("_day")).agg(F.count("*").alias("_n")).where(F.col("_n") >= at_least)
    return df.withColumn("_day", F.to_date("time")).join(n, ["symbol", "_day"]).drop("_day", "_n")


def missing_minutes(bars: DataFrame) -> DataFrame:
    """Per symbol the mean over days of the share of minutes between a day's first and last that have no bar."""
    d = bars.groupBy("symbol", F.to_date("time").alias("day")).agg(F.count("*").alias("n"), F.floor((F.unix_timestamp(F.max("time")) - F.unix_timestamp(F.min("time"))) / 60).alias("m"))
    return d.where("m > 0").groupBy("symbol").agg(F.avg((F.col("m") - F.col("n")) / F.col("m")).alias("missing"))


def without_borders(df: DataFrame, minutes: int, start: int = 10 * 60, stop: int = 17 * 60) -> DataFrame:
    """Rows strictly between start + minutes and stop - minutes of the day; days of fewer than 3 * minutes rows go."""
    at = F.hour("time") * 60 + F.minute("time") + F.second("time") / 60
    return full_days(df, 3 * minutes).where((at > start + minutes) & (at < stop - minutes))


def winsorize(df: DataFrame, cols: list[str], q: float, keys: list[str]) -> DataFrame:
    """Columns clipped to their exact quantiles q and 1 - q within each key."""
    out = df
    for c in cols:
        out = matched(out, quantiles(df, keys, c, {f"_a_{c}": q, f"_b_{c}": 1 - q}), keys)
    return out.withColumns({c: F.greatest(F.least(F.col(c), F.col(f"_b_{c}")), F.col(f"_a_{c}")) for c in cols}).drop(*(f"_{n}_{c}" for c in cols for n in "ab"))


def null_if(df: DataFrame, tokens: dict[str, list[Column | float]]) -> DataFrame:
    """Values that stand for a missing one become null."""
    return df.withColumns({c: F.when(~F.col(c).isin(*v), F.col(c)) for c, v in tokens.items()})


def lost_ratio(ticks: DataFrame, asked: Column) -> DataFrame:
    """Per symbol the share of records older than asked for."""
    return ticks.groupBy("symbol").agg((F.count_if(F.col("time_msc") < asked) / F.count("*")).alias("lost"))


def spread(bid: Column, ask: Column) -> tuple[Column, Column]:
    """The spread, and its share of the ask in per cent."""
    return ask - bid, F.try_divide(ask - bid, ask / 100)
