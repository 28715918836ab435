"""Back-tests: declarative ones, and the simulators whose every step depends on the last.

A simulator is one group per (scenario, symbol): sweeps run side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.ordered import running_sum, windowed

BUY, SELL, CHANGE, BUY_STOP, SELL_STOP, BUY_LIMIT, SELL_LIMIT = 0, 1, 2, 4, 5, 6, 7
BUCKET = 1_000  #: numbers of ticks that meet scenarios together


@dataclass
class Order:
    kind: int
    volume: float
    price: float = 0.0
    stop: float | None = None
    target: float | None = None
    deviation: float = float("inf")


@dataclass
class Account:
    """Cash, one net position, and resting orders; strategies see it on every tick and send orders."""

    money: float
    tick_value: float
    cost: float
    position: float = 0.0
    entry: float = 0.0
    stop: float | None = None
    target: float | None = None
    orders: list[Order] = field(default_factory=list)
    deals: int = 0

    def send(self, order: Order) -> None:
        self.orders.append(order)

    def _due(self, o: Order, price: float) -> bool:
        if o.kind in (BUY, SELL):
            return o.price == 0 or abs(price - o.price) < o.deviation
        if o.kind in (BUY_STOP, SELL_LIMIT):
            return price >= o.price
        return price <= o.price

    def trade(self, signed: float, price: float) -> float:
        """Fill: open, add (entry re-averaged), reduce, close or reverse. Returns the result realized."""
        self.deals += 1
        self.money -= self.cost
        old, new, gain = self.position, self.position + signed, 0.0
        if old == 0 or old * signed > 0:
            self.entry = (self.entry * abs(old) + price * abs(signed)) / (abs(old) + abs(signed))
        else:
            shut = min(abs(old), abs(signed))
            gain = (price - self.entry) * (1 if old > 0 else -1) * shut * self.tick_value
            self.money += gain
            if old * new < 0:
                self.entry = price
        self.position = new
        if new == 0:
            self.entry, self.stop, self.target = 0.0, None, None
        return gain

    def step(self, price: float) -> None:
        waiting, self.orders = self.orders, []
        for o in waiting:
            if o.kind == CHANGE:
                self.stop, self.target = o.stop, o.target
            elif self._due(o, price):
                self.trade(o.volume * (1 if o.kind in (BUY, BUY_STOP, BUY_LIMIT) else -1), price)
                if self.position and (o.stop is not None or o.target is not None):
                    self.stop, self.target = o.stop, o.target
            elif o.kind not in (BUY, SELL):
                self.orders.append(o)
        side = (self.position > 0) - (self.position < 0)
        if side and ((self.stop is not None and side * (price - self.stop) <= 0) or (self.target is not None and side * (price - self.target) >= 0)):
            self.send(Order(SELL if side > 0 else BUY, abs(self.position)))  # fills on the next tick
            self.stop = self.target = None

    def equity(self, price: float) -> float:
        return self.money + (price - self.entry) * self.position * self.tick_value - (2 * self.cost if self.position else 0)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, rows) of batches whose rows are sorted by key; a key's rows may come in several parts, one after the other."""
    for batch in batches:
        for key, part in batch.groupby(keys, sort=False, dropna=False):
            yield tuple(None if pd.isna(k) else k for k in key), part


def simulate(ticks: DataFrame, strategy: Callable[[Account, float, dict], None], money: float, tick_value: float, cost: float, keys=("symbol",), order: str = "seq", price: str = "last") -> DataFrame:
    """Equity, position and deals after every tick. ``strategy(account, price, memory)`` is called once a tick, after fills. A series is one
    task, which holds one batch of its rows at a time."""
    schema = ", ".join([*(f"`{k}` {ticks.schema[k].dataType.simpleString()}" for k in [*keys, order]), "equity double, position double, deals int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = account = memory = None
        for key, rows in _runs(batches, list(keys)):
            if account is None or key != at:
                at, account, memory = key, Account(money, tick_value, cost), {}
            out = []
            for p in rows[price].tolist():
                account.step(p)
                out.append((account.equity(p), account.position, account.deals))
                strategy(account, p, memory)
            yield rows[[*keys, order]].assign(equity=[o[0] for o in out], position=[o[1] for o in out], deals=[o[2] for o in out])

    return ticks.select(*keys, order, price).repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def cross_strategy(fast: int, slow: int, volume: float = 1.0) -> Callable:
    """Long while the fast exponential average is above the slow one."""

    def on_tick(account: Account, price: float, memory: dict) -> None:
        for name, n in (("f", fast), ("s", slow)):
            memory[name] = memory.get(name, price) + 2 / (n + 1) * (price - memory.get(name, price))
        want = volume if memory["f"] > memory["s"] else 0.0
        if want > account.position:
            account.send(Order(BUY, want - account.position))
        elif want < account.position:
            account.send(Order(SELL, account.position - want))

    return on_tick


def sweep(ticks: DataFrame, scenarios: DataFrame, money: float, tick_value: float, cost: float) -> DataFrame:
    """Final equity of each scenario (scenario, fast, slow, lo, hi) over its range of seq: one run per scenario and symbol, of which a task
    holds one batch of rows at a time.

    Ticks meet scenarios by buckets of seq, so that scenarios may be many."""
    ends = ticks.agg(F.min("seq").alias("_from"), F.max("seq").alias("_to"))
    bucket = lambda c: F.floor(c / BUCKET)
    first, last = F.greatest("lo", "_from"), F.least(F.col("hi") - 1, F.col("_to"))
    parts = scenarios.join(F.broadcast(ends)).where(first <= last).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last)))).drop("_from", "_to")
    rows = ticks.withColumn("_bucket", bucket(F.col("seq"))).join(parts, "_bucket").where("seq >= lo AND seq < hi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, account, p = None, None, 0.0
        ended = lambda: pd.DataFrame({"scenario": [at[0]], "symbol": [at[1]], "equity": [account.equity(p)], "deals": [account.deals]})
        for key, part in _runs(batches, ["scenario", "symbol"]):
            if account is None or key != at:
                if account is not None:
                    yield ended()
                at, account, memory = key, Account(money, tick_value, cost), {}
                act = cross_strategy(int(part["fast"].iloc[0]), int(part["slow"].iloc[0]))
            for p in part["last"].tolist():
                account.step(p)
                act(account, p, memory)
        if account is not None:
            yield ended()

    rows = rows.select("scenario", "symbol", "seq", "last", "fast", "slow").repartition("scenario", "symbol")
    return rows.sortWithinPartitions("scenario", "symbol", "seq").mapInPandas(run, "scenario long, symbol string, equity double, deals int")


def minute_simulate(bars: DataFrame, guesses: DataFrame, target: float, stop: float, expire: int, per_day: int) -> DataFrame:
    """Trades of guesses (symbol, day, k, direction) on minute bars (symbol, day, k, high, low): worst fills (buy at the high, sell at the
    low), target and stop as shares, closed after ``expire`` bars or on the day's last one; at most per_day entries."""
    rows = bars.join(guesses, ["symbol", "day", "k"], "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        out, entry, side, at, n = [], 0.0, 0, 0, 0
        last = part["k"].iloc[-1]
        for k, high, low, g in zip(part["k"], part["high"], part["low"], part["direction"]):
            if side:
                fill = low if side > 0 else high
                r = side * (fill / entry - 1) if entry else 0.0
                if r >= target or r <= -stop or k - at >= expire or k == last:
                    out.append((part["symbol"].iloc[0], part["day"].iloc[0], at, k, side, entry, fill, r))
                    side = 0
            elif pd.notna(g) and g and n < per_day and k != last:
                side, entry, at, n = int(g), high if g > 0 else low, k, n + 1
        return pd.DataFrame(out, columns=["symbol", "day", "opened", "shut", "side", "entry", "fill", "ret"])

    return rows.groupBy("symbol", "day").applyInPandas(run, "symbol string, day date, opened long, shut long, side int, entry double, fill double, ret double")


def close_orders(orders: DataFrame, bars: DataFrame, reach: int) -> DataFrame:
    """Where each order (symbol, at, upper, lower) ends: the first of the next ``reach`` bars (symbol, k, high, low, close) whose high passes
    upper or low passes lower, else the last of them; price is that bar's close."""
    from .joins import following

    j = following(orders, bars, "at", "k", reach, ["symbol"]).where("k > at")
    hit = F.when((F.col("high") > F.col("upper")) | (F.col("low") < F.col("lower")), F.struct("k", "close"))
    g = j.groupBy("symbol", "at").agg(F.min(hit).alias("h"), F.max(F.struct("k", "close")).alias("e"))
    return g.select("symbol", "at", F.coalesce("h.k", "e.k").alias("shut"), F.coalesce("h.close", "e.close").alias("price"), F.col("h").isNotNull().cast("int").alias("hit"))


def cash_replay(events: DataFrame, money: float, keys=("symbol",)) -> DataFrame:
    """Which buys a limited purse accepts. events: (keys, time, order_id, side, value); a sell pays its own accepted buy back at its value.
    Acceptance depends on every earlier one: one group per key."""
    schema = ", ".join([*(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys), "order_id long, accepted int"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["time", "side", "order_id"])
        cash, taken, out = money, set(), []
        for o, side, value in zip(part["order_id"], part["side"], part["value"]):
            if side > 0:
                ok = value <= cash
                out.append((o, int(ok)))
                if ok:
                    cash -= value
                    taken.add(o)
            elif o in taken:
                cash += value
        return pd.DataFrame({**{k: part[k].iloc[0] for k in keys}, "order_id": [o[0] for o in out], "accepted": [o[1] for o in out]})

    return events.groupBy(*keys).applyInPandas(run, schema)


def trailing_stop(df: DataFrame, average: str, stop: str = "stop", side: str = "side", keys=("symbol", "entry_id"), series=("symbol",), order: str = "seq") -> DataFrame:
    """Moves each position's own first ``stop`` with the average, in its favour only (side 1: up, -1: down).

    From the first row of the position where the average has moved that way since the row before (of the series), the stop is
    shifted by as much as the average's best value since then differs from the one before that row. A value beyond the best
    is always a move, so the best is a running maximum."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col(side) * F.col(average)
    d = windowed(df, list(series), [order], F.floor(F.col(order) / 50_000), 1, lambda t, w: t.withColumn("_before", F.col(side) * F.lag(average).over(w)))
    d = d.withColumn("_base", F.first(F.when(value > F.col("_before"), F.col("_before")), ignorenulls=True).over(w))
    d = d.withColumn("_best", F.max(F.when(F.col("_base").isNotNull(), value)).over(w))
    moved = F.coalesce(F.col("_best") - F.col("_base"), F.lit(0.0))
    return d.withColumn(stop, F.first(stop).over(w) + F.col(side) * moved).drop("_before", "_base", "_best")


def expired(positions: DataFrame, deals: DataFrame, age_ms: int) -> DataFrame:
    """(symbol, day, seq, shut): where each position (symbol, day, seq, time_msc) is closed: the first deal that is ``age_ms`` or more after
    it, within the day, else the day's last deal. An as-of join by day, never pairs."""
    from .joins import as_of

    due = positions.select("symbol", "day", "seq", (F.col("time_msc") + age_ms).alias("at"))
    right = deals.select("symbol", "day", F.col("time_msc").alias("at"), F.col("seq").alias("shut"))
    last = deals.groupBy("symbol", "day").agg(F.max_by("seq", F.struct("time_msc", "seq")).alias("end"))
    out = as_of(due, right, "at", ["shut"], ["symbol", "day"], forward=True).join(last, ["symbol", "day"])
    return out.select("symbol", "day", "seq", F.coalesce("shut", "end").alias("shut"))


def guarded(deals: DataFrame, per_day: int, gap: str) -> DataFrame:
    """The first ``per_day`` deals of a day that are at least ``gap`` (an interval) after the one before."""
    w = Window.partitionBy("symbol", F.to_date("time")).orderBy("time", "seq")
    d = deals.withColumn("_p", F.lag("time").over(w)).where(F.col("_p").isNull() | (F.col("time") >= F.col("_p") + F.expr(f"INTERVAL {gap}")))
    return d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_day).drop("_p", "_k")


def equity(deals: DataFrame, tick_value: float, cost: float) -> DataFrame:
    """Running result of a series of signed deals (symbol, seq, signed, price) marked at each deal's price."""
    d = deals
    for out, value in (("held", F.col("signed")), ("paid", F.col("signed") * F.col("price")), ("n", F.lit(1))):
        d = running_sum(d, value, out, ["symbol"], ["seq"], F.floor(F.col("seq") / 50_000))
    return d.withColumn("equity", (F.col("held") * F.col("price") - F.col("paid")) * tick_value - F.col("n") * cost)


def performance(daily: DataFrame, by: list[str], order: str) -> DataFrame:
    """Hit rate, profit, volatility and deepest drawdown of daily results (by, order, result)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("eq", F.sum("result").over(w)).withColumn("drop", F.max("eq").over(w) - F.col("eq"))
    return d.groupBy(*by).agg(F.avg((F.col("result") > 0).cast("double")).alias("hit_rate"), F.sum("result").alias("profit"), F.stddev_pop("result").alias("volatility"), F.max("drop").alias("drawdown"))


def downside_ratio(money: DataFrame, by: list[str], order: str, free: Column) -> DataFrame:
    """ratio: the final return beyond ``free`` (what money invested free of risk has become, as a multiple; it may depend on
    _n, the number of rows), divided by one plus the mean shortfall below the straight line from 1 to ``free``. The count of
    shortfalls starts at 1. money: (by, order, money), money as a multiple of what there was at first."""
    w = Window.partitionBy(*by).orderBy(order)
    d = money.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    line = 1 + (free - 1) * F.coalesce(F.try_divide(F.col("_k"), F.col("_n") - 1), F.lit(0.0))
    short = F.greatest(line - F.col("money"), F.lit(0.0))
    d = d.withColumns({"_short": short, "_free": free})
    total = F.max_by("money", order) / F.min_by("money", order) - F.first("_free")
    return d.groupBy(*by).agg((total / (1 + F.sum("_short") / (1 + F.count_if(F.col("_short") > 0)))).alias("ratio"))
