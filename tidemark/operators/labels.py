"""Forward-looking labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .joins import following


def triple_barrier(events: DataFrame, bars: DataFrame, multiple: float, first: int, step: int, count: int, skip: int = 0) -> DataFrame:
    """(symbol, twhen, vertbar, side, ret, tdone) of events (symbol, twhen): bar numbers.

    Entry is the event bar's wprice; the horizontal barriers lie sigma * multiple above and below. Each bar from the event on
    (from ``skip`` bars later) is tested at open, first and second extreme. Vertical barriers are ``first``, first + step, ...
    bars away: those before a hit give a label each, with the return at their bar and its sign (0 counts as -1); the first at
    or after the hit gives the hit. Barriers beyond the data give none. bars: symbol, uid, open, high, low, highfirst,
    wprice, sigma.
    """
    reach = first + step * (count - 1)
    start = bars.select("symbol", F.col("uid").alias("twhen"), F.col("wprice").alias("entry"), F.col("sigma").alias("width"))
    e = events.select("symbol", "twhen").join(start, ["symbol", "twhen"])
    c1 = F.when(F.col("highfirst") == 1, F.col("high")).otherwise(F.col("low"))
    c2 = F.when(F.col("highfirst") == 1, F.col("low")).otherwise(F.col("high"))
    pairs = following(e, bars.select("symbol", "uid", F.array("open", c1, c2).alias("prices")), "twhen", "uid", reach, ["symbol"])
    pairs = pairs.withColumn("rets", F.transform("prices", lambda p: F.try_divide(p, F.col("entry")) - 1))
    hit = F.filter("rets", lambda r: F.abs(r) >= multiple * F.col("width"))
    pairs = pairs.withColumn("hit", F.when(F.col("uid") >= F.col("twhen") + skip, F.get(hit, 0)))
    away = F.col("uid") - F.col("twhen")
    g = pairs.groupBy("symbol", "twhen").agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct("uid", "hit"))).alias("h"),
        *(F.max(F.when(away == first + step * k, F.element_at("rets", 3))).alias(f"_at{k}") for k in range(count)),
    )
    g = g.select("*", F.explode(F.sequence(F.lit(first), F.lit(reach), F.lit(step))).alias("vertbar"))
    end = F.col("twhen") + F.col("vertbar")
    is_hit = F.col("h").isNotNull() & (F.col("h.uid") <= end)
    late = is_hit & (F.col("h.uid") <= end - step) & (F.col("vertbar") > first)
    ret = F.when(is_hit, F.col("h.hit")).otherwise(F.get(F.array(*(f"_at{k}" for k in range(count))), ((F.col("vertbar") - first) / step).cast("int")))
    out = g.where(~late).withColumn("ret", ret).where("ret IS NOT NULL")
    return out.select("symbol", "twhen", "vertbar", F.when(F.col("ret") > 0, 1).otherwise(-1).alias("side"), "ret", F.when(is_hit, F.col("h.uid")).otherwise(end).alias("tdone"))


def traverse(df: DataFrame, signal: str = "signal", keys=("symbol", "day"), order: str = "seq") -> DataFrame:
    """Labels of band signals within a day: buy at the high on 1, sell at the low on the next 2. A later buy before that takes the
    place of the earlier one, which becomes 0. A profit labels the buy 1 and the sell 2, else both are 0; a buy left open at
    the day's end is null, as are rows that neither buy nor sell."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_sells", F.coalesce(F.sum((F.col(signal) == 2).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(*keys, "_sells").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a stretch ends with its sell; its last buy is the one that is sold
    d = d.withColumns({"_buy": F.max(F.when(F.col(signal) == 1, F.struct(order, "high"))).over(whole), "_sell": F.max(F.when(F.col(signal) == 2, F.struct(order, "low"))).over(whole)})
    last, gain = F.col(f"_buy.{order}") == F.col(order), F.col("_sell.low") > F.col("_buy.high")
    label = F.when((F.col(signal) == 1) & ~last, 0)
    label = label.when((F.col(signal) == 1) & F.col("_sell").isNotNull(), gain.cast("int"))
    label = label.when((F.col(signal) == 2) & F.col("_buy").isNotNull(), F.when(gain, 2).otherwise(0))
    return d.withColumn("label", label).drop("_sells", "_buy", "_sell")


def _outcomes(df: DataFrame, value: Column, target: float, stop: float, keys, order: str) -> DataFrame:
    """Adds, for signals (1 or -1), the signals of the day before and after (_before, _after) and what came of the position
    that each opens until the next one: 1 target, -1 stop, null neither (_out, _out_before). value: of the position's gain in
    money, from _side, _entry, high and low."""
    day = Window.partitionBy(*keys).orderBy(order)
    some = F.col("signal").isin(1, -1)
    d = df.withColumn("_run", F.sum(some.cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"_side": F.first("signal").over(run), "_entry": F.first(F.when(F.col("signal") > 0, F.col("high")).otherwise(F.col("low"))).over(run)})
    out = F.when(~some & (F.col("_run") > 0), F.when(value >= target, 1).when(value <= -stop, -1))
    d = d.withColumn("_hit", out).withColumn("_out", F.first("_hit", ignorenulls=True).over(whole))
    here = F.when(some, F.struct(F.col("signal").alias("signal"), F.col("_out").alias("out")))
    back = day.rowsBetween(Window.unboundedPreceding, -1)
    on = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)  # a frame to the end would be run through anew for every row
    d = d.withColumns({"_prior": F.last(here, ignorenulls=True).over(back), "_next": F.last(here, ignorenulls=True).over(on)})
    return d.withColumns({"_before": F.col("_prior.signal"), "_out_before": F.col("_prior.out"), "_after": F.col("_next.signal")})


_WORK = ("_run", "_side", "_entry", "_hit", "_out", "_prior", "_next", "_before", "_out_before", "_after")


def with_stops(df: DataFrame, amount: float, target: float, stop: float, side: int = 1, keys=("symbol", "day"), order: str = "seq") -> DataFrame:
    """Labels of entries to one side (signal = side): bought at the high and sold at the low of a later row without a signal (sides
    mirrored), where the gain times ``amount`` first reaches the target or the loss the stop, within the day.

    An entry is ``side`` if it opened a position that reached the target; 0 if it met the stop, if another entry took its
    place while it was open, or if the next signal of the day is to the other side, whatever came before that; null if it was
    open at the day's end, if it took another's place and reached the target, and where there is no entry. All of it follows
    from the next and previous signals, so it is windows by day and no machine."""
    exit_ = F.col("low") if side > 0 else F.col("high")
    d = _outcomes(df, side * (exit_ - F.col("_entry")) * amount, target, stop, keys, order)
    fresh = F.col("_before").isNull() | (F.col("_before") != side) | F.col("_out_before").isNotNull()
    label = F.when(F.col("_out") == -1, 0).when(F.col("_after") == -side, 0).when(F.col("_out") == 1, F.when(fresh, side)).when(F.col("_after") == side, 0)
    return d.withColumn("label", F.when(F.col("signal") == side, label)).drop(*_WORK)


def both_sides(df: DataFrame, amount: float, target: float, stop: float, keys=("symbol", "day"), order: str = "seq") -> DataFrame:
    """Labels of entries to either side (signal 1 or -1) in net mode, round(amount / entry) pieces each: every signal opens a
    position and takes the place of one that is open. The signal itself where the target was reached first, 0 where the
    stop was or another signal came before either, null where it was open at the day's end and where there is no signal."""
    side = F.col("_side")
    exit_ = F.when(side > 0, F.col("low")).otherwise(F.col("high"))
    pieces = F.coalesce(F.round(F.try_divide(F.lit(amount), F.col("_entry"))), F.lit(0.0))
    d = _outcomes(df, side * (exit_ - F.col("_entry")) * pieces, target, stop, keys, order)
    label = F.when(F.col("_out") == 1, F.col("signal")).when((F.col("_out") == -1) | F.col("_after").isNotNull(), 0)
    return d.withColumn("label", F.when(F.col("signal").isin(1, -1), label)).drop(*_WORK)


def delayed(rows: DataFrame, where: str, delay: int, reach: int, target: float, stop: float) -> DataFrame:
    """(symbol, k, label) of signals (rows that meet ``where``) executed ``delay`` rows late, within the day: 1 where the price first passes the
    target share, 0 where it first passes the stop; where neither is passed, 1 if the last price within reach has half the
    target. rows: symbol, k, time, last."""
    e = rows.where(where).select("symbol", F.col("k").alias("at"), F.col("last").alias("entry"), F.to_date("time").alias("day"))
    j = following(e, rows.select("symbol", "k", "last", F.to_date("time").alias("on")), "at", "k", reach, ["symbol"]).where((F.col("k") >= F.col("at") + delay) & (F.col("day") == F.col("on")))
    won, lost = F.col("last") >= F.col("entry") * (1 + target), F.col("last") <= F.col("entry") * (1 - stop)
    g = j.groupBy("symbol", "at").agg(
        F.min(F.when(won | lost, F.struct("k", won.cast("int").alias("won")))).alias("hit"), (F.max_by("last", "k") >= F.first("entry") * (1 + target / 2)).cast("int").alias("half")
    )
    return g.select("symbol", F.col("at").alias("k"), F.coalesce("hit.won", "half").alias("label"))


def merge_sides(buy: Column, sell: Column) -> Column:
    """Sell wins unless it is 0 or null; a sell beside a buy gives 0."""
    return F.when((buy == 1) & (sell != 0), 0).when(F.coalesce(sell, F.lit(0)) != 0, sell).otherwise(buy)


def ahead(x: Column, span: int, by: WindowSpec) -> Column:
    """Sign of the change over the next ``span`` rows; null where there are none."""
    return F.signum(F.lead(x, span).over(by) - x).cast("int")


def trend(x: Column, average: Column, span: int, by: WindowSpec) -> Column:
    """1 if the price ``span`` rows on is above its average there, else 0."""
    y = F.when(x > average, 1).when(average.isNotNull(), 0)
    return F.lead(y, span).over(by)


def direction(label: Column, span: int, share: float, by: WindowSpec) -> Column:
    """Sign of the sum of the next ``span`` labels where it reaches the share, else 0."""
    s = F.sum(label).over(by.rowsBetween(1, span))
    return F.when(F.abs(s) >= share * span, F.signum(s).cast("int")).otherwise(0)
