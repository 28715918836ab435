"""Bars: value bars in closed form, minute and daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import matched, running_sum
from .stats import quantiles


def bar_ids(deals: DataFrame, size: int) -> DataFrame:
    """Adds cum (money so far), uid (the bar that the deal belongs to) and closes (bars closed once it is in).

    money = cents * volume is integer, so bars are exact: a deal belongs to bar floor((cum - money) / size), what is left
    over is carried into the next bar, and bars run across days. Days are chunks: no symbol is one task.
    """
    d = deals.withColumn("money", F.col("cents") * F.col("volume"))
    d = running_sum(d, F.col("money"), "cum", ["symbol"], ["seq"], F.to_date("time"))
    return d.withColumns({"uid": F.floor((F.col("cum") - F.col("money")) / size), "closes": F.floor(F.col("cum") / size)})


def value_bars(deals: DataFrame, size: int, start: float = 10.0, stop: float = 17.0) -> DataFrame:
    """One row per closed bar: time span, open, high, low, wprice, highfirst, nticks, netvol, dtp, inday and running-VWAP order
    statistics. The last, open bar of a symbol is left out. A deal that closes several bars opens bars without a tick of
    their own: nticks = 0, dtp = 0, the other fields those of the bar it ended."""
    d = bar_ids(deals, size)
    if "flag" not in d.columns:
        d = d.withColumn("flag", F.lit(0))
    w = Window.partitionBy("symbol", "uid").orderBy("seq")
    cents, volume = F.sum(F.col("cents") * F.col("volume")).over(w), F.sum("volume").over(w)
    d = d.withColumn("vwap", cents / volume)
    n = F.size("vwaps")

    def order_stat(p: float) -> Column:
        return F.element_at("vwaps", F.greatest(F.round(n * p + 0.5), F.lit(2.0)).cast("int") - 1)

    g = d.groupBy("symbol", "uid").agg(
        F.min("time_msc").alias("smsc"), F.max("time_msc").alias("emsc"), F.min("time").alias("time"), F.min_by("last", "seq").alias("open"),
        F.max("last").alias("high"), F.min("last").alias("low"), F.sum(F.col("cents") * F.col("volume")).alias("m"), F.sum("volume").alias("v"),
        (F.min_by("seq", F.struct(-F.col("last"), "seq")) < F.min_by("seq", F.struct("last", "seq"))).cast("int").alias("highfirst"),
        F.count("*").alias("nticks"), F.try_divide(F.sum(F.col("flag") * F.col("money")), F.sum("money")).alias("netvol"), F.max("closes").alias("upto"),
        F.array_sort(F.collect_list("vwap")).alias("vwaps"),
    ).where("upto > uid")
    g = g.withColumns({"wprice": F.col("m") / F.col("v") / 100, "wprice10": order_stat(0.1) / 100, "wprice90": order_stat(0.9) / 100}).drop("m", "v", "vwaps")
    g = g.select("*", F.explode(F.sequence("uid", F.col("upto") - 1)).alias("id"))
    extra = F.col("id") > F.col("uid")
    g = g.withColumns({"nticks": F.when(extra, 0).otherwise(F.col("nticks")), "smsc": F.when(extra, F.col("emsc")).otherwise(F.col("smsc"))})
    by_bar = Window.partitionBy("symbol").orderBy("id")
    at = F.hour("time") + F.minute("time") / 60 + F.second("time") / 3600
    g = g.withColumns({"dtp": F.when(extra, 0.0).otherwise((F.col("smsc") - F.lag("emsc").over(by_bar)) / 1000), "inday": ((at > start) & (at < stop)).cast("int")})
    return g.drop("uid", "upto").withColumnRenamed("id", "uid")


def minute_range(deals: DataFrame, minutes: int = 1) -> DataFrame:
    """High and low of each minute with a deal; empty minutes have no row."""
    return deals.groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w")).agg(F.max("last").alias("high"), F.min("last").alias("low")).select("symbol", F.col("w.start").alias("time"), "high", "low")


def minute_bars(deals: DataFrame, minutes: int = 1) -> DataFrame:
    """Open, high, low, close, volume and count of each minute with a deal."""
    g = deals.groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w")).agg(
        F.min_by("last", "seq").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "seq").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n")
    )
    return g.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "n")


def daily_bars(deals: DataFrame) -> DataFrame:
    return deals.groupBy("symbol", F.to_date("time").alias("day")).agg(
        F.min_by("last", "seq").alias("open"), F.max("last").alias("high"), F.min("last").alias("low"), F.max_by("last", "seq").alias("close"), F.sum("volume").alias("volume")
    )


def session_checks(df: DataFrame) -> DataFrame:
    """Days that break the calendar: weekday steps other than 1 or -4, a first hour after 9, a last before 17."""
    d = df.groupBy("symbol", F.to_date("time").alias("day")).agg(F.min(F.hour("time")).alias("first_hour"), F.max(F.hour("time")).alias("last_hour"))
    step = F.weekday("day") - F.lag(F.weekday("day")).over(Window.partitionBy("symbol").orderBy("day"))
    d = d.withColumn("step", step)
    return d.withColumn("bad", (~F.coalesce(F.col("step").isin(1, -4), F.lit(True)) | (F.col("first_hour") != 9) | (F.col("last_hour") < 17)).cast("int"))


def bar_report(bars: DataFrame) -> DataFrame:
    """Bars per day, life and ticks of a bar at some percentiles, by symbol."""
    per_day = bars.groupBy("symbol", F.to_date("time").alias("day")).agg(F.count("*").alias("n")).groupBy("symbol").agg(F.avg("n").alias("bars_a_day"))
    bars = bars.withColumn("life", (F.col("emsc") - F.col("smsc")) / 1000)
    return matched(matched(per_day, quantiles(bars, ["symbol"], "life", {"life_p50": 0.5}), ["symbol"]), quantiles(bars, ["symbol"], "nticks", {"nticks_p90": 0.9}), ["symbol"])


def synthetic_ticks(bars: DataFrame) -> DataFrame:
    """Three ticks of a minute bar: open at second 0, high and low at two distinct seconds in 1..58 that its key settles."""
    h = F.pmod(F.crc32(F.concat_ws("|", "symbol", F.unix_timestamp("time").cast("string")).cast("binary")), F.lit(58 * 57))
    a = F.floor(h / 57)
    b = h % 57
    b = F.when(b >= a, b + 1).otherwise(b)
    t = F.unix_timestamp("time")
    rows = F.array(F.struct(t.alias("sec"), F.col("open").alias("last")), F.struct((t + 1 + a).alias("sec"), F.col("high").alias("last")), F.struct((t + 1 + b).alias("sec"), F.col("low").alias("last")))
    return bars.select("symbol", F.explode(rows).alias("r"), F.floor(F.col("volume") / 3).alias("volume")).select("symbol", "r.sec", "r.last", "volume")
