"""Queries of signals, labels, features, folds, statistics, back-tests, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ieee import divided
from ..operators import averages, backtest, bars, features, folds, indicators, labels, signals, stats
from ..sources import files, market
from ..sources.market import DAILY_SQL, DEALS_SQL, TICKS_SQL
from ..streaming import chain, live
from .market_queries import CUSUM, HOURS, MOVES, NUMBERED, VBARS, VOL, W, WS, _numbered, _recursion, _rows, _vbars, _volatile, rolled, shape, sql
from .ordered import row_number
from .registry import query
from .scratch import new_path, stored

def WT():
    return indicators.by("symbol", order="time")



def _hours(spark: SparkSession, d: str) -> DataFrame:
    return bars.minute_bars(market.deals(spark, d), 60)


# ---- F: signals -----------------------------------------------------------------------------------------------------

BANDED = DEALS_SQL + f""", banded AS (
  SELECT *, CASE WHEN row_number() OVER {WS} >= 20 THEN avg(last) OVER {_rows(20)} + stddev_pop(last) OVER {_rows(20)} END AS up,
         CASE WHEN row_number() OVER {WS} >= 20 THEN avg(last) OVER {_rows(20)} - stddev_pop(last) OVER {_rows(20)} END AS down,
         CASE WHEN row_number() OVER {WS} >= 20 THEN avg(last) OVER {_rows(20)} END AS mid FROM deals)"""
SIGNALED = BANDED + f""", signaled AS (
  SELECT *, CASE WHEN last > down AND lag(last) OVER {WS} <= lag(down) OVER {WS} THEN 1 WHEN last < up AND lag(last) OVER {WS} >= lag(up) OVER {WS} THEN 2 ELSE 0 END AS signal FROM banded)"""


def _banded(spark, d, more=lambda t, w: t):
    add = lambda t, w: more(indicators.bands(t, "last", 20, 1.0, w).withColumn("mid", indicators.sma(F.col("last"), 20, w)), w)
    return rolled(market.deals(spark, d), 20, add)


def _signaled(spark, d):
    return _banded(spark, d, lambda t, w: t.withColumn("signal", signals.reentry(F.col("last"), F.col("down"), F.col("up"), w)))


@query("f1_reentry", sql(SIGNALED, "SELECT * FROM signaled", "seq signal", "", "symbol"))
def f1(spark, d):
    return shape(_signaled(spark, d), "seq signal", "", "symbol")


@query("f2_reentry_or_mean", sql(BANDED, f"SELECT symbol, seq, CASE WHEN last > down AND p <= pd THEN 1 WHEN (last >= mid AND p < pm) OR (last <= mid AND p > pm) THEN 2 ELSE 0 END AS signal FROM (SELECT *, lag(last) OVER {WS} AS p, lag(down) OVER {WS} AS pd, lag(mid) OVER {WS} AS pm FROM banded)", "seq signal", "", "symbol"))
def f2(spark, d):
    return shape(_banded(spark, d, lambda t, w: t.withColumn("signal", signals.reentry_or_mean(F.col("last"), F.col("down"), F.col("mid"), w))), "seq signal", "", "symbol")


@query("f3_breach", sql(BANDED, "SELECT symbol, seq, CASE WHEN last <= down THEN 1 WHEN last >= up THEN -1 ELSE 0 END AS signal FROM banded", "seq signal", "", "symbol"))
def f3(spark, d):
    return shape(_banded(spark, d).withColumn("signal", signals.breach(F.col("last"), F.col("down"), F.col("up"))), "seq signal", "", "symbol")


MULTI = DEALS_SQL + ", multi AS (SELECT *, " + ", ".join(f"CASE WHEN row_number() OVER {WS} < {n} THEN 0 WHEN last <= avg(last) OVER {_rows(n)} - stddev_pop(last) OVER {_rows(n)} THEN 1 WHEN last >= avg(last) OVER {_rows(n)} + stddev_pop(last) OVER {_rows(n)} THEN -1 ELSE 0 END AS s{k}" for k, n in enumerate((10, 20, 30))) + " FROM deals)"


def _multi(spark, d):
    def add(t: DataFrame, w) -> DataFrame:
        for k, n in enumerate((10, 20, 30)):
            m, s = indicators.sma(F.col("last"), n, w), indicators.stddev(F.col("last"), n, w)
            t = t.withColumn(f"s{k}", signals.breach(F.col("last"), m - s, m + s))
        return t

    return rolled(market.deals(spark, d), 29, add)


@query("f4_masks", sql(MULTI, "SELECT symbol, seq, (CASE WHEN s0 = 1 THEN 1 ELSE 0 END) + (CASE WHEN s1 = 1 THEN 2 ELSE 0 END) + (CASE WHEN s2 = 1 THEN 4 ELSE 0 END) AS up, (CASE WHEN s0 = -1 THEN 1 ELSE 0 END) + (CASE WHEN s1 = -1 THEN 2 ELSE 0 END) + (CASE WHEN s2 = -1 THEN 4 ELSE 0 END) AS down FROM multi", "seq up down", "", "symbol"))
def f4(spark, d):
    up, down = signals.masks([F.col(f"s{k}") for k in range(3)])
    return shape(_multi(spark, d).withColumns({"up": up, "down": down}), "seq up down", "", "symbol")


@query("f5_last_signal", sql(MULTI, "SELECT symbol, arg_max(s0, seq) AS s0, arg_max(s1, seq) AS s1, arg_max(s2, seq) AS s2, max(CASE WHEN s0 <> 0 THEN 1 ELSE 0 END) AS any_signal FROM multi GROUP BY 1", "s0 s1 s2 any_signal", "", "symbol"))
def f5(spark, d):
    g = _multi(spark, d).groupBy("symbol").agg(*(F.max_by(f"s{k}", "seq").alias(f"s{k}") for k in range(3)), F.max((F.col("s0") != 0).cast("int")).alias("any_signal"))
    return shape(g, "s0 s1 s2 any_signal", "", "symbol")


@query("f6_collapse", sql(MULTI, "SELECT symbol, seq, sign(s0 + s1 + s2) AS s FROM multi", "seq s", "", "symbol"))
def f6(spark, d):
    return shape(_multi(spark, d).withColumn("s", signals.collapse([F.col(f"s{k}") for k in range(3)])), "seq s", "", "symbol")


@query("f7_cusum_events", "WITH RECURSIVE " + CUSUM + " SELECT r.symbol, CAST(n.seq AS BIGINT) AS seq, CAST(event AS BIGINT) AS event FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k WHERE event <> 0")
def f7(spark, d):
    return shape(indicators.cusum(market.deals(spark, d), ["symbol"], "seq", "last", 200.0).where("event <> 0"), "seq event", "", "symbol")


GAPS = DAILY_SQL + """, gaps AS (
  SELECT *, gap + CASE WHEN gap > 0 THEN low ELSE high END - open AS gapdif FROM (SELECT *, open - lag(close) OVER (ORDER BY day) AS gap FROM daily) WHERE gap IS NOT NULL)"""


@query("f8_gaps", sql(GAPS, "SELECT * FROM gaps WHERE abs(gap) BETWEEN 1000 AND 100000", "", "gap", "day"))
def f8(spark, d):
    return shape(signals.gaps(market.daily(spark, d)).where(F.abs("gap").between(1000, 100_000)), "", "gap", "day")


@query("f9_gap_closed", sql(GAPS, "SELECT day, -sign(gap) * gapdif AS result, CASE WHEN -sign(gap) * gapdif >= 0 THEN 1 ELSE 0 END AS closed FROM gaps", "closed", "result", "day"))
def f9(spark, d):
    return shape(signals.gaps(market.daily(spark, d)), "closed", "result", "day")


HN = HOURS + ", hn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) AS k FROM hours)"
TRENDS = HN + ", " + _recursion("eh", 3, "0.5", "hn", "high") + ", " + _recursion("el", 3, "0.5", "hn", "low") + """, tr AS (
  SELECT h.symbol, h.time, h.close, h.k, coalesce(CASE WHEN eh.v > lag(eh.v) OVER v AND el.v > lag(el.v) OVER v AND CASE WHEN h.k >= 10 THEN stddev_pop(close) OVER (PARTITION BY h.symbol ORDER BY h.k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END BETWEEN 15 AND 150 THEN 1 ELSE 0 END, 0) AS ok
  FROM hn h LEFT JOIN eh ON eh.symbol = h.symbol AND eh.k = h.k LEFT JOIN el ON el.symbol = h.symbol AND el.k = h.k WINDOW v AS (PARTITION BY h.symbol ORDER BY h.k))"""


@query("f10_up_trend", "WITH RECURSIVE " + TRENDS + " SELECT symbol, epoch_ms(time) AS msc, round(close, 6) AS close FROM tr QUALIFY min(ok) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1")
def f10(spark, d):
    h = stored(row_number(_hours(spark, d), "k", ["symbol"], ["time"], F.to_date("time")), "hours")
    j = averages.smoothed(h, ["symbol"], "k", {"eh": ("high", 3, 0.5, 1), "el": ("low", 3, 0.5, 1)}).withColumn("sd", indicators.stddev(F.col("close"), 10, WT()))
    ok = ((F.col("eh") > F.lag("eh").over(WT())) & (F.col("el") > F.lag("el").over(WT())) & F.col("sd").between(15, 150)).cast("int")
    j = j.withColumn("ok", F.coalesce(ok, F.lit(0))).withColumn("trend", F.min("ok").over(WT().rowsBetween(-2, 0)))
    return shape(j.where("trend = 1").withColumn("msc", F.unix_millis("time")), "msc", "close", "symbol")


PIVOTS = HN + ", " + _recursion("e", 10, "2.0 / 11", "hn", "close") + ", sides AS (SELECT h.symbol, h.time, h.k, sign(h.close - e.v) AS s, lag(sign(h.close - e.v)) OVER (PARTITION BY h.symbol ORDER BY h.k) AS p FROM hn h LEFT JOIN e ON e.symbol = h.symbol AND e.k = h.k)"


@query("f11_trend_pivots", "WITH RECURSIVE " + PIVOTS + " SELECT symbol, epoch_ms(time) AS msc, round(CAST(s AS DOUBLE), 6) AS s, CAST(epoch(lead(time) OVER (PARTITION BY symbol ORDER BY k)) - epoch(time) AS BIGINT) AS took FROM sides WHERE p IS NOT NULL AND s <> p")
def f11(spark, d):
    j = averages.ema(_hours(spark, d), ["symbol"], "time", "close", 10, chunk=F.to_date("time"))
    s = F.signum(F.col("close") - F.col("ema"))
    j = j.withColumn("s", s).withColumn("p", F.lag("s").over(WT())).where("p IS NOT NULL AND s <> p")
    j = j.withColumn("took", F.unix_timestamp(F.lead("time").over(WT())) - F.unix_timestamp("time"))
    return shape(j.withColumn("msc", F.unix_millis("time")), "msc took", "s", "symbol")


@query("f12_terciles", sql(DEALS_SQL, f"SELECT d.symbol, seq, CASE WHEN r > b THEN 1 WHEN r < a THEN -1 ELSE 0 END AS class FROM (SELECT *, last / lag(last) OVER {WS} - 1 AS r FROM deals) d JOIN (SELECT symbol, quantile_cont(r, 1/3.0) AS a, quantile_cont(r, 2/3.0) AS b FROM (SELECT symbol, last / lag(last) OVER {WS} - 1 AS r FROM deals) GROUP BY 1) q ON d.symbol = q.symbol WHERE r IS NOT NULL", "seq class", "", "symbol"))
def f12(spark, d):
    r = rolled(market.deals(spark, d), 1, lambda t, w: t.withColumn("r", divided(F.col("last"), F.lag("last").over(w)) - 1)).where("r IS NOT NULL")
    q = stats.quantiles(r, ["symbol"], "r", {"a": 1 / 3, "b": 2 / 3})
    return shape(r.join(q, "symbol").withColumn("class", F.when(F.col("r") > F.col("b"), 1).when(F.col("r") < F.col("a"), -1).otherwise(0)), "seq class", "", "symbol")


@query("f13_direction_strength", sql(SIGNALED, "SELECT symbol, seq, abs(sum(CASE signal WHEN 2 THEN -1 ELSE signal END) OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) AS strength FROM signaled", "seq strength", "", "symbol"))
def f13(spark, d):
    w = Window.partitionBy("symbol", F.to_date("time")).orderBy("seq").rowsBetween(-11, 0)
    return shape(_signaled(spark, d).withColumn("strength", F.abs(F.sum(F.when(F.col("signal") == 2, -1).otherwise(F.col("signal"))).over(w))), "seq strength", "", "symbol")


def _pivot_sql(levels: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT day, '{k}' AS level, {v} AS price FROM (SELECT *, (high + low + close) / 3 AS p, high - low AS r FROM daily)" for k, v in levels.items())


for _id, _kind, _levels in (
    ("f14", "classic", {"R1": "2 * p - low", "R2": "p + r", "S1": "2 * p - high", "S2": "p - r"}),
    ("f15", "fibonacci", {"S3": "p - r", "S2": "p - 0.618 * r", "R2": "p + 0.618 * r", "R3": "p + r"}),
    ("f16", "camarilla", {"S3": "close - r * 1.1 / 4", "S4": "close - r * 1.1 / 2", "P": "p", "R3": "close + r * 1.1 / 4", "R4": "close + r * 1.1 / 2"}),
):
    query(f"{_id}_{_kind}_pivots", sql(DAILY_SQL, _pivot_sql(_levels), "", "price", "day level"))(lambda spark, d, kind=_kind: shape(signals.pivots(market.daily(spark, d), kind), "", "price", "day level"))


@query("f17_price_levels", sql(DEALS_SQL, "SELECT symbol, floor(last) AS price, count(*) AS n FROM deals GROUP BY 1, 2", "n", "price", "symbol"))
def f17(spark, d):
    return shape(signals.levels(market.deals(spark, d), F.floor("last"), ["symbol"]), "n", "price", "symbol")


HIST = DEALS_SQL + ", hist AS (SELECT b AS bin, count(last) AS n, coalesce(sum(volume), 0) AS v FROM (SELECT unnest(range(0, CAST(floor(max(last) / 10) AS BIGINT) + 1)) AS b FROM deals) r LEFT JOIN deals ON floor(last / 10) = b GROUP BY 1)"


def _histogram(t: DataFrame, sums: dict | None = None) -> DataFrame:
    """Bins of ten up to the largest price."""
    bins = int((t.agg(F.max("last")).first()[0] or 0) // 10) + 1
    return signals.histogram(t, "last", 0.0, 10.0, bins, sums)


@query("f18_histogram_peaks", sql(HIST, "SELECT bin, n, s FROM (SELECT *, quantile_cont(s, 0.5) OVER () AS cut, greatest(coalesce(max(s) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), -1), coalesce(max(s) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), -1)) AS sides FROM (SELECT *, avg(n) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM hist)) WHERE s >= cut AND s >= sides", "bin n", "s"))
def f18(spark, d):
    return shape(signals.peaks(_histogram(market.deals(spark, d)), 3, 0.5, 2), "bin n", "s")


LADDER = DAILY_SQL + """, levels AS (SELECT day, unnest([2 * p - low, p + r, 2 * p - high, p - r, close - r * 1.1 / 4, close - r * 1.1 / 2, p, close + r * 1.1 / 4, close + r * 1.1 / 2]) AS price FROM (SELECT *, (high + low + close) / 3 AS p, high - low AS r FROM daily)),
rungs AS (SELECT l.day, l.price, row_number() OVER (PARTITION BY l.day ORDER BY l.price DESC) AS k FROM levels l JOIN daily d ON d.day = l.day AND l.price < d.close),
ends AS (SELECT day, min(price) AS stop FROM rungs WHERE k <= 3 GROUP BY 1), goals AS (SELECT l.day, min(l.price) AS target FROM levels l JOIN daily d ON d.day = l.day AND l.price > d.close GROUP BY 1)"""


@query("f19_order_ladder", sql(LADDER, "SELECT day, k, price, stop, target FROM rungs JOIN ends USING (day) JOIN goals USING (day) WHERE k <= 2 AND price > stop AND target - price >= 0.5 * (price - stop)", "k", "price stop target", "day"))
def f19(spark, d):
    days = market.daily(spark, d)
    quotes = days.select("day", F.col("close").alias("quote"))
    return shape(signals.ladder(signals.pivots(days, "classic").unionByName(signals.pivots(days, "camarilla")), quotes, 2, 0.5), "k", "price stop target", "day")


# ---- G: labels ------------------------------------------------------------------------------------------------------

BARRIER = VOL + """, ev AS (SELECT symbol, uid AS twhen, wprice AS entry, sigma FROM vol),
probe AS (
  SELECT e.symbol, e.twhen, b.uid, p.pos, p.price / entry - 1 AS r, sigma AS width FROM (SELECT ev.symbol, ev.twhen, ev.entry, ev.sigma AS width FROM ev) e
  JOIN (SELECT symbol, uid, open, high, low, highfirst FROM vol) b ON b.symbol = e.symbol AND b.uid BETWEEN e.twhen AND e.twhen + 30
  CROSS JOIN LATERAL (SELECT * FROM (VALUES (1, b.open), (2, CASE WHEN b.highfirst = 1 THEN b.high ELSE b.low END), (3, CASE WHEN b.highfirst = 1 THEN b.low ELSE b.high END)) v(pos, price)) p),
hits AS (SELECT symbol, twhen, arg_min(r, uid * 10 + pos) AS r, min(uid * 10 + pos) // 10 AS h FROM probe WHERE abs(r) >= 2 * width GROUP BY 1, 2),
grid AS (SELECT e.symbol, e.twhen, v.vb, h.h, h.r AS hr, q.r AS vr, coalesce(h.h <= e.twhen + v.vb, false) AS is_hit
  FROM ev e CROSS JOIN (VALUES (10), (20), (30)) v(vb) LEFT JOIN hits h ON h.symbol = e.symbol AND h.twhen = e.twhen
  LEFT JOIN probe q ON q.symbol = e.symbol AND q.twhen = e.twhen AND q.uid = e.twhen + v.vb AND q.pos = 3),
labels AS (SELECT symbol, twhen, vb AS vertbar, CASE WHEN is_hit THEN hr ELSE vr END AS ret, CASE WHEN is_hit THEN h ELSE twhen + vb END AS tdone
  FROM grid WHERE NOT (is_hit AND vb > 10 AND h <= twhen + vb - 10))"""
BARRIER = BARRIER.replace("sigma AS width FROM (SELECT ev.symbol", "width FROM (SELECT ev.symbol")


def _labels(spark, d, b=None):
    b = stored(_volatile(spark, d), "bars") if b is None else b
    return labels.triple_barrier(b.select("symbol", F.col("uid").alias("twhen")), b, 2.0, 10, 10, 3)


@query("g1_triple_barrier", sql(BARRIER, "SELECT *, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS side FROM labels WHERE ret IS NOT NULL", "twhen vertbar side tdone", "ret", "symbol"))
def g1(spark, d):
    return shape(_labels(spark, d), "twhen vertbar side tdone", "ret", "symbol")


@query("g3_pending_events", sql(BARRIER, "SELECT symbol, twhen FROM ev WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.symbol = ev.symbol AND l.twhen = ev.twhen AND ret IS NOT NULL)", "twhen", "", "symbol"))
def g3(spark, d):
    ev = _volatile(spark, d).select("symbol", F.col("uid").alias("twhen"))
    return shape(ev.join(_labels(spark, d).select("symbol", "twhen").distinct(), ["symbol", "twhen"], "left_anti"), "twhen", "", "symbol")


TRAVERSED = SIGNALED + """, acts AS (SELECT symbol, CAST(time AS DATE) AS day, seq, signal, last FROM signaled WHERE signal <> 0),
near AS (SELECT *, lag(signal) OVER v AS s0, lag(last) OVER v AS p0, lead(signal) OVER v AS s1, lead(last) OVER v AS p1 FROM acts WINDOW v AS (PARTITION BY symbol, day ORDER BY seq)),
labelled AS (SELECT symbol, seq, CASE WHEN signal = 1 AND s1 = 1 THEN 0 WHEN signal = 1 AND s1 = 2 THEN CASE WHEN p1 > last THEN 1 ELSE 0 END WHEN signal = 2 AND s0 = 1 THEN CASE WHEN last > p0 THEN 2 ELSE 0 END END AS label FROM near)"""


@query("g4_band_labels", sql(TRAVERSED, "SELECT s.symbol, s.seq, l.label FROM signaled s LEFT JOIN labelled l ON l.symbol = s.symbol AND l.seq = s.seq", "seq label", "", "symbol"))
def g4(spark, d):
    s = _signaled(spark, d).withColumns({"day": F.to_date("time"), "high": F.col("last"), "low": F.col("last")})
    return shape(labels.traverse(s), "seq label", "", "symbol")


def _machine(name: str, side: int) -> str:
    """The label machine of one side, row by row; a row may be labelled several times, the last time counts."""
    return f"""{name}_steps AS (
      SELECT symbol, day, n, CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS price, 0 AS held, CAST(NULL AS BIGINT) AS marked, CAST(NULL AS INTEGER) AS label, 0 AS done FROM sized
      UNION ALL
      SELECT symbol, day, n, CASE WHEN sig = {side} THEN k ELSE pos END, CASE WHEN sig = {side} THEN last ELSE price END,
        CASE WHEN sig = {side} THEN 1 WHEN sig = {-side} THEN 0 WHEN held = 1 AND ({side} * (last - price) >= 15 OR {side} * (last - price) <= -45) THEN 0 ELSE held END,
        CASE WHEN sig = {side} AND held = 0 THEN k WHEN sig <> 0 OR (held = 1 AND {side} * (last - price) <= -45 AND {side} * (last - price) < 15) THEN nullif(pos, 0) END,
        CASE WHEN sig = {side} AND held = 0 THEN {side} ELSE 0 END, k
      FROM (SELECT s.*, r.k, r.sig, r.last FROM {name}_steps s JOIN daily_rows r ON r.symbol = s.symbol AND r.day = s.day AND r.k = s.done + 1)),
    {name} AS (SELECT r.symbol, r.seq, CASE WHEN o.pos IS NULL THEN m.label END AS label FROM daily_rows r
      LEFT JOIN (SELECT symbol, day, marked, arg_max(label, done) AS label FROM {name}_steps WHERE marked IS NOT NULL GROUP BY ALL) m ON m.symbol = r.symbol AND m.day = r.day AND m.marked = r.k
      LEFT JOIN (SELECT symbol, day, pos FROM {name}_steps WHERE done = n AND held = 1) o ON o.symbol = r.symbol AND o.day = r.day AND o.pos = r.k)"""


DAILY_ROWS = """, daily_rows AS (SELECT symbol, CAST(time AS DATE) AS day, seq, s1 AS sig, last, row_number() OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY seq) AS k FROM multi),
sized AS (SELECT symbol, day, max(k) AS n FROM daily_rows GROUP BY ALL), """


def _sided(spark, d, side):
    s = _multi(spark, d).withColumns({"day": F.to_date("time"), "high": F.col("last"), "low": F.col("last"), "signal": F.col("s1")})
    return labels.with_stops(s, 1.0, 15.0, 45.0, side)


@query("g5_buy_labels", sql("RECURSIVE " + MULTI + DAILY_ROWS + _machine("buys", 1), "SELECT * FROM buys", "seq label", "", "symbol"))
def g5(spark, d):
    return shape(_sided(spark, d, 1), "seq label", "", "symbol")


@query("g6_sell_labels", sql("RECURSIVE " + MULTI + DAILY_ROWS + _machine("sells", -1), "SELECT * FROM sells", "seq label", "", "symbol"))
def g6(spark, d):
    return shape(_sided(spark, d, -1), "seq label", "", "symbol")


@query("g7_merged_sides", sql("RECURSIVE " + MULTI + DAILY_ROWS + _machine("buys", 1) + ", " + _machine("sells", -1), "SELECT b.symbol, b.seq, CASE WHEN s.label IS NULL OR s.label = 0 THEN b.label WHEN b.label = 1 THEN 0 ELSE s.label END AS merged FROM buys b JOIN sells s ON s.symbol = b.symbol AND s.seq = b.seq", "seq merged", "", "symbol"))
def g7(spark, d):
    a, b = _sided(spark, d, 1), _sided(spark, d, -1).select("symbol", "seq", F.col("label").alias("sell"))
    return shape(a.join(b, ["symbol", "seq"]).withColumn("merged", labels.merge_sides(F.col("label"), F.col("sell"))), "seq merged", "", "symbol")


@query("g10_trend_labels", sql(DEALS_SQL, f"SELECT symbol, seq, lead(y, 5) OVER {WS} AS label FROM (SELECT *, CASE WHEN last > m THEN 1 WHEN m IS NOT NULL THEN 0 END AS y FROM (SELECT *, CASE WHEN row_number() OVER {WS} >= 5 THEN avg(last) OVER {_rows(5)} END AS m FROM deals))", "seq label", "", "symbol"))
def g10(spark, d):
    add = lambda t, w: t.withColumn("m", indicators.sma(F.col("last"), 5, w)).withColumn("label", labels.trend(F.col("last"), F.col("m"), 5, w))
    return shape(rolled(market.deals(spark, d), 9, add, 5), "seq label", "", "symbol")


@query("g11_difference_labels", sql(DEALS_SQL, f"SELECT symbol, seq, sign(lead(last, 10) OVER {WS} - last) AS label FROM deals", "seq label", "", "symbol"))
def g11(spark, d):
    return shape(rolled(market.deals(spark, d), 0, lambda t, w: t.withColumn("label", labels.ahead(F.col("last"), 10, w)), 10), "seq label", "", "symbol")


@query("g13_next_day", sql(DAILY_SQL, "SELECT day, CASE WHEN lead(close) OVER (ORDER BY day) > close THEN 1 WHEN lead(close) OVER (ORDER BY day) <= close THEN 0 END AS up FROM daily", "up", "", "day"))
def g13(spark, d):
    nxt = F.lead("close").over(Window.orderBy("day"))
    return shape(market.daily(spark, d).withColumn("up", F.when(nxt > F.col("close"), 1).when(nxt <= F.col("close"), 0)), "up", "", "day")


@query("g14_direction_share", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN abs(s) >= 3 THEN sign(s) ELSE 0 END AS label FROM (SELECT symbol, seq, sum(c) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS s FROM (SELECT *, sign(last - lag(last) OVER {WS}) AS c FROM deals))", "seq label", "", "symbol"))
def g14(spark, d):
    add = lambda t, w: t.withColumn("c", F.signum(F.col("last") - F.lag("last").over(w)).cast("int")).withColumn("label", labels.direction(F.col("c"), 10, 0.3, w))
    return shape(rolled(market.deals(spark, d), 1, add, 10), "seq label", "", "symbol")


# ---- H: features ----------------------------------------------------------------------------------------------------


@query("h1_event_vectors", sql(BARRIER, "SELECT l.symbol, l.twhen, l.vertbar, 9 AS size, a.wprice AS first, l.vertbar AS last, l.twhen - 3 AS inf_start, l.tdone AS inf_end FROM labels l JOIN vol a ON a.symbol = l.symbol AND a.uid = l.twhen - 3 WHERE l.ret IS NOT NULL", "twhen vertbar size inf_start inf_end", "first last", "symbol"))
def h1(spark, d):
    b = stored(_volatile(spark, d), "bars")
    v = features.event_vectors(b, _labels(spark, d, b), ["wprice", "nticks"], 4, ["vertbar"])
    return shape(v.withColumns({"size": F.size("x"), "first": F.get("x", 0), "last": F.element_at("x", -1)}), "twhen vertbar size inf_start inf_end", "first last", "symbol")


GRID = ["open", "high", "low", "close", "volume", "n", "typical"]


def _grid_sql() -> str:
    with_, cols, joins_ = [], [], []
    for c in GRID:
        for b, (n, f, l) in enumerate(((10, 5, 7), (20, 10, 15))):
            for name, m, first in (("e", n, 1), ("f", f, l - f + 1), ("l", l, 1)):
                with_.append(_recursion(f"{name}_{c}{b}", m, f"2.0 / {m + 1}", "gn", c, first))
                joins_.append(f"LEFT JOIN {name}_{c}{b} ON {name}_{c}{b}.symbol = g.symbol AND {name}_{c}{b}.k = g.k")
            x, m = f"g.{c} - e_{c}{b}.v", f"f_{c}{b}.v - l_{c}{b}.v"
            cols += [f"round({x}, 6) AS dema_{c}{b}", f"round((lag({x}) OVER v) / ({x} + 1e-8), 6) AS demav_{c}{b}", f"round((lag({m}) OVER v) / ({m} + 1e-8), 6) AS dmacdv_{c}{b}"]
    gn = "gn AS (SELECT symbol, time, k, open, high, low, close, round(ln(volume + 5), 12) AS volume, round(ln(n + 5), 12) AS n, (open + high + low + close) / 4 AS typical FROM hn)"
    return f"WITH RECURSIVE {HN}, {gn}, {', '.join(with_)} SELECT g.symbol, epoch_ms(g.time) AS msc, {', '.join(cols)} FROM gn g {' '.join(joins_)} WINDOW v AS (PARTITION BY g.symbol ORDER BY g.k)"


@query("h4_indicator_grid", _grid_sql())
def h4(spark, d):
    """Seven columns and two bands: open, high, low, close, log volume, log count and typical price. Logarithms are rounded to twelve
    places, as libraries differ in their last bit and the ratios of small differences magnify it."""
    h = _hours(spark, d).withColumns({"volume": F.round(F.log(F.col("volume") + 5), 12), "n": F.round(F.log(F.col("n") + 5), 12), "typical": (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4})
    g = averages.grid(h, ["symbol"], "time", GRID, 20, 2, chunk=F.to_date("time"))
    return shape(g.withColumn("msc", F.unix_millis("time")), "msc", " ".join(f"{x}_{c}{b}" for c in GRID for b in range(2) for x in ("dema", "demav", "dmacdv")), "symbol")


CROSSED = MOVES + ", " + ", ".join(_recursion(f"a{n}", n, f"2.0 / {n + 1}", "numbered", "last") for n in (26, 20, 30)) + ", " + ", ".join(_recursion(f"f{slow}", n, f"2.0 / {n + 1}", "numbered", "last", slow - n + 1) for n, slow in ((12, 26), (10, 20), (10, 30))) + ", " + ", ".join(_recursion(f"{s}{k}", k * 10, f"1.0 / {k * 10}", "moves", c) for k in (2, 3) for s, c in (("u", "gain"), ("v", "loss")))


@query(
    "h5_cross_features",
    "WITH RECURSIVE " + CROSSED + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, CAST(hour(time) AS BIGINT) AS hour, CAST(isodow(time) - 1 AS BIGINT) AS weekday, CAST(minute(time) AS BIGINT) AS minute, round(a20.v, 6) AS ema_2, round(a30.v, 6) AS ema_3, round(last - a20.v, 6) AS dema_2, round(last - a30.v, 6) AS dema_3, round(f26.v - a26.v, 6) AS macd, round(f20.v - a20.v, 6) AS macd_mean, round(f30.v - a30.v, 6) AS macd_double, "
    + ", ".join(f"round(CASE WHEN u{k}.v + v{k}.v > 0 THEN 100 * u{k}.v / (u{k}.v + v{k}.v) WHEN u{k}.v IS NOT NULL THEN 0 END, 6) AS rsi_{k}" for k in (2, 3))
    + " FROM numbered n " + " ".join(f"LEFT JOIN {a}{n} ON {a}{n}.symbol = n.symbol AND {a}{n}.k = n.k" for n in (26, 20, 30) for a in "af") + " " + " ".join(f"LEFT JOIN {s}{k} ON {s}{k}.symbol = n.symbol AND {s}{k}.k = n.k - 1" for k in (2, 3) for s in "uv"),
)
def h5_cross(spark, d):
    t = averages.crosses(features.clock(market.deals(spark, d)), ["symbol"], "seq", "last", 10, chunk=F.to_date("time"))
    return shape(t, "seq hour weekday minute", "ema_2 ema_3 dema_2 dema_3 macd macd_mean macd_double rsi_2 rsi_3", "symbol")


@query("h5_clock_features", sql(DEALS_SQL, "SELECT symbol, seq, hour(time) AS hour, minute(time) AS minute, isodow(time) - 1 AS weekday, dayofyear(time) AS yearday FROM deals", "seq hour minute weekday yearday", "", "symbol"))
def h5(spark, d):
    return shape(features.clock(market.deals(spark, d)), "seq hour minute weekday yearday", "", "symbol")


@query("h6_log_volumes", sql(DEALS_SQL, "SELECT symbol, seq, ln(volume + 5) AS volume FROM deals", "seq", "volume", "symbol"))
def h6(spark, d):
    return shape(features.log_volumes(market.deals(spark, d), ["volume"], 5.0), "seq", "volume", "symbol")


@query("h7_z_scores", sql(DEALS_SQL, "SELECT d.symbol, seq, (last - m) / s AS last FROM deals d JOIN (SELECT symbol, avg(last) AS m, stddev_pop(last) AS s FROM deals GROUP BY 1) q ON d.symbol = q.symbol", "seq", "last", "symbol"))
def h7(spark, d):
    return shape(features.z_scores(market.deals(spark, d), ["last"], ["symbol"]), "seq", "last", "symbol")


@query("h8_min_max", sql(DEALS_SQL, "SELECT d.symbol, seq, (last - a) / (b - a) AS last FROM deals d JOIN (SELECT symbol, min(last) AS a, max(last) AS b FROM deals GROUP BY 1) q ON d.symbol = q.symbol", "seq", "last", "symbol"))
def h8(spark, d):
    return shape(features.min_max(market.deals(spark, d), ["last"], ["symbol"]), "seq", "last", "symbol")


@query("h9_robust", sql(DEALS_SQL, "SELECT d.symbol, seq, (last - m) / (b - a) AS last FROM deals d JOIN (SELECT symbol, quantile_cont(last, 0.25) AS a, quantile_cont(last, 0.5) AS m, quantile_cont(last, 0.75) AS b FROM deals GROUP BY 1) q ON d.symbol = q.symbol", "seq", "last", "symbol"))
def h9(spark, d):
    return shape(features.robust(market.deals(spark, d), ["last"], ["symbol"]), "seq", "last", "symbol")


NORMAL = DEALS_SQL + """, ranked AS (SELECT symbol, seq, (rank() OVER (PARTITION BY symbol ORDER BY last) - 0.5) / count(*) OVER (PARTITION BY symbol) AS p FROM deals),
scored AS (SELECT symbol, seq, p, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM ranked)"""


@query("h9_normal_score", sql(NORMAL, "SELECT symbol, seq, CASE WHEN p < 0.5 THEN -1 ELSE 1 END * (t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))) AS z FROM scored", "seq", "z", "symbol"))
def h9n(spark, d):
    return shape(features.normal_score(market.deals(spark, d), "last", ["symbol"], "z"), "seq", "z", "symbol")


@query("h10_bins", sql(DEALS_SQL, "SELECT symbol, seq, CASE WHEN last >= 300 THEN 3 WHEN last >= 200 THEN 2 WHEN last >= 100 THEN 1 ELSE 0 END AS bin FROM deals", "seq bin", "", "symbol"))
def h10(spark, d):
    return shape(market.deals(spark, d).withColumn("bin", features.cut(F.col("last"), [100.0, 200.0, 300.0])), "seq bin", "", "symbol")


@query("h11_correlations", sql("", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS corr FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem", "", "corr", "a b"))
def h11(spark, d):
    return shape(features.correlations(market.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "", "corr", "a b")


@query("h12_class_entropy", sql(SIGNALED, "SELECT symbol, -sum(p * ln(p) / ln(3)) AS entropy FROM (SELECT symbol, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM signaled GROUP BY symbol, signal) GROUP BY 1", "", "entropy", "symbol"))
def h12(spark, d):
    return shape(features.class_entropy(_signaled(spark, d), "signal", ["symbol"]), "", "entropy", "symbol")


# ---- J, K, L: aggregates, order, sets -------------------------------------------------------------------------------


@query("j2_percentiles", sql(DEALS_SQL, "SELECT symbol, quantile_cont(last, 0.1) AS p10, quantile_cont(last, 0.5) AS p50, quantile_cont(last, 0.9) AS p90 FROM deals GROUP BY 1", "", "p10 p50 p90", "symbol"))
def j2(spark, d):
    return shape(stats.percentiles(market.deals(spark, d), "last", [10, 50, 90], ["symbol"]), "", "p10 p50 p90", "symbol")


@query("j3_nearest_rank", sql(DEALS_SQL, "SELECT symbol, v[CAST(greatest(round(len(v) * 0.1 + 0.5), 2) AS INT) - 1] AS p10 FROM (SELECT symbol, list_sort(list(last)) AS v FROM deals GROUP BY 1)", "", "p10", "symbol"))
def j3(spark, d):
    return shape(stats.nearest_rank(market.deals(spark, d), "last", 0.1, ["symbol"]).withColumnRenamed("value", "p10"), "", "p10", "symbol")


@query("j4_percentile_of_score", sql(DEALS_SQL, "SELECT symbol, 100 * avg(CASE WHEN last <= 100 THEN 1.0 ELSE 0.0 END) AS pct FROM deals GROUP BY 1", "", "pct", "symbol"))
def j4(spark, d):
    return shape(stats.percentile_of(market.deals(spark, d), "last", 100.0, ["symbol"]), "", "pct", "symbol")


@query("j5_histogram", sql(HIST, "SELECT * FROM hist", "bin n v"))
def j5(spark, d):
    return shape(_histogram(market.deals(spark, d), {"v": F.sum("volume")}), "bin n v")


@query("j6_distinct", sql(DEALS_SQL, "SELECT symbol, count(DISTINCT volume) AS n FROM deals GROUP BY 1", "n", "", "symbol"))
def j6(spark, d):
    return shape(market.deals(spark, d).groupBy("symbol").agg(F.countDistinct("volume").alias("n")), "n", "", "symbol")


@query("j8_confusion", sql("", "SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2", "y p n"))
def j8(spark, d):
    return shape(folds.confusion(market.table(spark, d, "labels"), "quality", "toxic").withColumnsRenamed({"quality": "y", "toxic": "p"}), "y p n")


@query("j8_precision", sql("", "SELECT toxic AS label, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS precision, count(*) AS n FROM labels GROUP BY 1", "label n", "precision"))
def j8p(spark, d):
    return shape(folds.precision(market.table(spark, d, "labels"), "quality", "toxic"), "label n", "precision")


@query("j8_scores", sql(DEALS_SQL, "SELECT avg(CASE WHEN CAST(p >= 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END) AS accuracy, -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss FROM (SELECT last / 500 AS p, CASE WHEN volume > 49 THEN 1 ELSE 0 END AS y FROM deals)", "", "accuracy log_loss"))
def j8s(spark, d):
    return shape(folds.scores(market.deals(spark, d).select((F.col("last") / 500).alias("p"), (F.col("volume") > 49).cast("int").alias("y")), "y", "p"), "", "accuracy log_loss")


@query("j9_density", sql(DEALS_SQL, "SELECT g AS x, sum(exp(-0.5 * pow((g - v) / 10.0, 2)) * n) / (sum(n) * 10.0 * sqrt(2 * pi())) AS density FROM (SELECT b * 50 AS g FROM range(11) r(b)) CROSS JOIN (SELECT floor(last) AS v, count(*) AS n FROM deals GROUP BY 1) GROUP BY 1", "x", "density"))
def j9(spark, d):
    return shape(stats.density(market.deals(spark, d), "last", [50.0 * k for k in range(11)], 10.0, 1.0), "x", "density")


@query("j10_mixture")
def j10(spark, d):
    return shape(folds.mixture(market.deals(spark, d), "last", [2, 3]), "k", "aic bic")


DAY_RESULTS = DEALS_SQL + ", dr AS (SELECT symbol, CAST(time AS DATE) AS day, arg_max(last, seq) - arg_min(last, seq) AS result FROM deals GROUP BY 1, 2)"


def _day_results(spark, d):
    return bars.daily_bars(market.deals(spark, d)).withColumn("result", F.col("close") - F.col("open"))


@query("j11_performance", sql(DAY_RESULTS, "SELECT symbol, avg(CASE WHEN result > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(result) AS profit, stddev_pop(result) AS volatility, max(top - eq) AS drawdown FROM (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY day) AS top FROM (SELECT *, sum(result) OVER (PARTITION BY symbol ORDER BY day) AS eq FROM dr)) GROUP BY 1", "", "hit_rate profit volatility drawdown", "symbol"))
def j11(spark, d):
    return shape(backtest.performance(_day_results(spark, d), ["symbol"], "day"), "", "hit_rate profit volatility drawdown", "symbol")


@query("j12_downside_ratio", sql(DAY_RESULTS, "SELECT symbol, (arg_max(money, day) / arg_min(money, day) - any_value(free)) / (1 + coalesce(sum(line - money) FILTER (money < line), 0) / (1 + count(*) FILTER (money < line))) AS ratio FROM (SELECT *, 1 + (free - 1) * k / greatest(n - 1, 1) AS line FROM (SELECT symbol, day, 1 + sum(result) OVER (PARTITION BY symbol ORDER BY day) / 1000 AS money, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n, pow(1.00034, count(*) OVER (PARTITION BY symbol)) AS free FROM dr)) GROUP BY 1", "", "ratio", "symbol"))
def j12(spark, d):
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return shape(backtest.downside_ratio(_day_results(spark, d).withColumn("money", 1 + F.sum("result").over(w) / 1000), ["symbol"], "day", F.pow(F.lit(1.00034), F.col("_n"))), "", "ratio", "symbol")


@query("j13_summary", sql("", "SELECT l_returnflag AS flag, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1", "n", "mean sd lo hi", "flag"))
def j13(spark, d):
    return shape(stats.describe(market.table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumnRenamed("l_returnflag", "flag"), "n", "mean sd lo hi", "flag")


@query("k1_top", sql(DEALS_SQL, "SELECT symbol, seq, last FROM deals ORDER BY last DESC, seq LIMIT 50", "seq", "last", "symbol"))
def k1(spark, d):
    return shape(market.deals(spark, d).orderBy(F.desc("last"), "seq").limit(50), "seq", "last", "symbol")


@query("k2_nearest", sql(DEALS_SQL, "SELECT symbol, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(last - 250), seq) AS r FROM deals) WHERE r <= 4", "seq", "", "symbol"))
def k2(spark, d):
    return shape(stats.first_of(market.deals(spark, d), 4, ["symbol"], [F.abs(F.col("last") - 250), F.col("seq")]), "seq", "", "symbol")


@query("k4_sample")
def k4(spark, d):
    return shape(stats.sample(market.deals(spark, d), 0.1, ["symbol", "seq"], 7), "seq", "", "symbol")


@query("k5_expression", sql(DEALS_SQL, "SELECT symbol, seq FROM deals WHERE last > 100 AND volume < 20", "seq", "", "symbol"))
def k5(spark, d):
    return shape(market.deals(spark, d).where("last > 100 AND volume < 20"), "seq", "", "symbol")


@query("k6_keep_first", sql(DEALS_SQL, "SELECT symbol, volume, min(seq) AS seq FROM deals GROUP BY 1, 2", "volume seq", "", "symbol"))
def k6(spark, d):
    return shape(market.deals(spark, d).groupBy("symbol", "volume").agg(F.min("seq").alias("seq")), "volume seq", "", "symbol")


@query("l1_union", sql(DEALS_SQL, "SELECT symbol, seq FROM deals UNION ALL SELECT symbol, seq FROM ticks WHERE last > 100", "seq", "", "symbol"))
def l1(spark, d):
    t = market.ticks(spark, d)
    return shape(market.deals(spark, d).unionByName(t.where("last > 100")), "seq", "", "symbol")


@query("l2_membership", sql(DEALS_SQL, "SELECT symbol, seq FROM deals WHERE symbol IN ('view', 'click')", "seq", "", "symbol"))
def l2(spark, d):
    return shape(market.deals(spark, d).where(F.col("symbol").isin("view", "click")), "seq", "", "symbol")


@query("l3_set_difference", sql(TICKS_SQL, "SELECT symbol, volume FROM ticks EXCEPT ALL SELECT symbol, volume FROM ticks WHERE last > 250", "volume", "", "symbol"))
def l3(spark, d):
    t = market.ticks(spark, d)
    return shape(t.select("symbol", "volume").exceptAll(t.where("last > 250").select("symbol", "volume")), "volume", "", "symbol")


@query("m1_scalars", sql(DEALS_SQL, "SELECT symbol, seq, floor(last / 0.05) * 0.05 AS tick, sign(last - 250) AS side, sqrt(last) AS root, floor(10000 / last / 100) * 100 AS lot, greatest(least(last, 400), 50) AS clipped FROM deals", "seq", "tick side root lot clipped", "symbol"))
def m1(spark, d):
    return shape(stats.scalars(market.deals(spark, d)), "seq", "tick side root lot clipped", "symbol")


# ---- N: folds -------------------------------------------------------------------------------------------------------


FOLDS = NUMBERED + ", m AS (SELECT symbol, max(k) AS m FROM numbered GROUP BY 1), folds AS (SELECT symbol, unnest(range(0, CAST(floor((m - 800) / 500.0) AS BIGINT) + 1)) AS fold FROM m WHERE m >= 800), folded AS (SELECT n.symbol, fold, k, k - fold * 500 AS place FROM folds f JOIN numbered n ON n.symbol = f.symbol AND n.k > fold * 500 AND n.k <= fold * 500 + 800)"


@query("n1_sequential_folds", sql(FOLDS, "SELECT symbol, fold, count(*) AS n, min(k) AS lo, max(k) AS hi FROM folded GROUP BY 1, 2", "fold n lo hi", "", "symbol"))
def n1(spark, d):
    f = folds.sequential(_numbered(spark, d), "k", 800, 500, ("symbol",))
    return shape(f.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")), "fold n lo hi", "", "symbol")


@query("n2_split", sql(FOLDS, "SELECT symbol, fold, CASE WHEN place > 760 THEN 'predict' WHEN place <= 570 THEN 'train' ELSE 'valid' END AS part, count(*) AS n FROM folded GROUP BY ALL", "fold n", "", "symbol part"))
def n2(spark, d):
    f = folds.split(folds.sequential(_numbered(spark, d), "k", 800, 500, ("symbol",)), "k", 800, 500, 0.75, 40)
    return shape(f.groupBy("symbol", "fold", "part").agg(F.count("*").alias("n")), "fold n", "", "symbol part")


def _folded(spark, d, k=5):
    v = _labels(spark, d).select("symbol", "twhen", "vertbar", "side", F.col("twhen").alias("inf_start"), F.col("tdone").alias("inf_end"))
    return folds.purged(stored(v, "labels"), k, ["twhen", "symbol", "vertbar"], F.floor(F.col("twhen") / 1000))


@query("n3_purged_folds", sql(BARRIER + ", f AS (SELECT *, ntile(5) OVER (ORDER BY twhen, symbol, vertbar) - 1 AS b FROM labels WHERE ret IS NOT NULL), s AS (SELECT b AS fold, min(twhen) AS lo, max(tdone) AS hi FROM f GROUP BY 1)", "SELECT fold, 'train' AS part, count(*) AS n FROM f, s WHERE b <> fold AND (tdone < lo OR twhen > hi) GROUP BY 1 UNION ALL SELECT b, 'test', count(*) FROM f GROUP BY 1", "fold n", "", "part"))
def n3(spark, d):
    return shape(_folded(spark, d).groupBy("fold", "part").agg(F.count("*").alias("n")), "fold n", "", "part")


PURGED = BARRIER + """, f AS (SELECT *, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS side, ntile(5) OVER (ORDER BY twhen, symbol, vertbar) - 1 AS b FROM labels WHERE ret IS NOT NULL), s AS (SELECT b AS fold, min(twhen) AS lo, max(tdone) AS hi FROM f GROUP BY 1),
parted AS (SELECT fold, side, 1 AS train FROM f, s WHERE b <> fold AND (tdone < lo OR twhen > hi) UNION ALL SELECT b, side, 0 FROM f)"""


@query("n4_fold_scores", sql(PURGED, "SELECT fold, CASE WHEN count(DISTINCT side) FILTER (train = 1) > 1 AND count(DISTINCT side) FILTER (train = 0) > 1 THEN avg(CASE WHEN side = best THEN 1.0 ELSE 0.0 END) FILTER (train = 0) END AS score FROM parted LEFT JOIN (SELECT fold, arg_max(side, n * 2 - CASE WHEN side > 0 THEN 1 ELSE 0 END) AS best FROM (SELECT fold, side, count(*) AS n FROM parted WHERE train = 1 GROUP BY ALL) GROUP BY 1) USING (fold) GROUP BY 1", "fold", "score"))
def n4(spark, d):
    return shape(folds.majority_score(_folded(spark, d), "side"), "fold", "score")


@query("n8_forest")
def n8(spark, d):
    t = rolled(market.deals(spark, d), 1, lambda t, w: t.withColumns({"r": F.col("last") - F.lag("last").over(w), "y": (F.lead("last").over(w) > F.col("last")).cast("int")}), 1).na.drop()
    m = folds.forest(t, ["r", "last", "volume"], "y", trees=5, depth=3)
    return shape(m.transform(t).groupBy("y", "prediction").agg(F.count("*").alias("n")), "y prediction n")


@query("n9_perceptron")
def n9(spark, d):
    t = rolled(market.deals(spark, d), 1, lambda t, w: t.withColumns({"r": F.col("last") - F.lag("last").over(w), "y": (F.lead("last").over(w) > F.col("last")).cast("int")}), 1).na.drop()
    m = folds.perceptron(t, ["r", "last"], "y", hidden=4)
    return shape(m.transform(t).groupBy("y", "prediction").agg(F.count("*").alias("n")), "y prediction n")


# ---- O: back-tests --------------------------------------------------------------------------------------------------


@query("o1_simulator")
def o1(spark, d):
    t = market.deals(spark, d)
    return shape(backtest.simulate(t, backtest.cross_strategy(5, 20), 10_000.0, 0.2, 1.0), "seq deals", "equity position", "symbol")


@query("o5_equity", sql(DEALS_SQL, f"SELECT symbol, seq, (held * last - paid) * 0.2 - n * 1.0 AS equity FROM (SELECT symbol, seq, last, sum(s) OVER {WS} AS held, sum(s * last) OVER {WS} AS paid, count(*) OVER {WS} AS n FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS s FROM deals))", "seq", "equity", "symbol"))
def o5(spark, d):
    t = market.deals(spark, d).select("symbol", "seq", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("signed"), F.col("last").alias("price"))
    return shape(backtest.equity(t, 0.2, 1.0), "seq", "equity", "symbol")


@query("o6_minute_simulator")
def o6(spark, d):
    h = _hours(spark, d).withColumns({"day": F.to_date("time"), "k": F.hour("time").cast("long")})
    g = h.select("symbol", "day", "k", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"))
    return shape(backtest.minute_simulate(h, g, 0.2, 0.3, 6, 3), "opened shut side", "entry fill ret", "symbol day")


@query("o7_close_orders", sql(NUMBERED, "SELECT symbol, k AS opened, coalesce(h, e) AS shut, CASE WHEN h IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT a.symbol, a.k, min(CASE WHEN b.last > a.last * 1.3 OR b.last < a.last * 0.7 THEN b.k END) AS h, max(b.k) AS e FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.k > a.k AND b.k <= a.k + 15 GROUP BY 1, 2)", "opened shut hit", "", "symbol"))
def o7(spark, d):
    n = _numbered(spark, d)
    o = n.select("symbol", F.col("k").alias("at"), (F.col("last") * 1.3).alias("upper"), (F.col("last") * 0.7).alias("lower"))
    b = n.select("symbol", "k", F.col("last").alias("high"), F.col("last").alias("low"), F.col("last").alias("close"))
    return shape(backtest.close_orders(o, b, 15).withColumnRenamed("at", "opened"), "opened shut hit", "", "symbol")


@query("o8_cash_replay")
def o8(spark, d):
    n = _numbered(spark, d)
    e = n.select("symbol", F.col("k").alias("time"), F.col("k").alias("order_id"), F.lit(1).alias("side"), F.col("last").alias("value"))
    s = n.select("symbol", (F.col("k") + 40).alias("time"), F.col("k").alias("order_id"), F.lit(-1).alias("side"), (F.col("last") * 1.01).alias("value"))
    return shape(backtest.cash_replay(e.unionByName(s), 600.0), "order_id accepted", "", "symbol")


@query("o9_scenarios")
def o9(spark, d):
    """Stretches of 800 numbers, one for every 400, over all of seq."""
    deals = market.deals(spark, d)
    last = deals.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    pairs = spark.createDataFrame([(0, 3, 10), (1, 5, 20)], "nth long, fast int, slow int")
    grid = spark.range(last // 400 + 1).join(F.broadcast(pairs)).select((F.col("id") * 2 + F.col("nth")).alias("scenario"), "fast", "slow", (F.col("id") * 400).alias("lo"), (F.col("id") * 400 + 800).alias("hi"))
    return shape(backtest.sweep(deals, grid, 10_000.0, 0.2, 1.0), "scenario deals", "equity", "symbol")


TRAILED = DEALS_SQL + f""", moved AS (SELECT symbol, seq, last, m, lag(m) OVER {WS} AS before, seq // 100 AS entry_id, CASE WHEN seq // 100 % 2 = 0 THEN 1 ELSE -1 END AS side,
  row_number() OVER (PARTITION BY symbol, seq // 100 ORDER BY seq) AS k FROM (SELECT *, avg(last) OVER {_rows(5)} AS m FROM deals)),
trail AS (
  SELECT symbol, entry_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, last - 10 * side AS stop, CAST(NULL AS DOUBLE) AS used FROM moved WHERE k = 1
  UNION ALL
  SELECT t.symbol, t.entry_id, x.k, x.seq, CASE WHEN go THEN t.stop + x.m - coalesce(t.used, x.before) ELSE t.stop END, CASE WHEN go THEN x.m ELSE t.used END
  FROM trail t JOIN moved x ON x.symbol = t.symbol AND x.entry_id = t.entry_id AND x.k = t.k + 1, LATERAL (SELECT coalesce(x.side * x.m > x.side * x.before AND (t.used IS NULL OR x.side * x.m > x.side * t.used), false) AS go))"""


@query("o10_trailing_stop", sql("RECURSIVE " + TRAILED, "SELECT * FROM trail WHERE k > 0", "seq", "stop", "symbol"))
def o10(spark, d):
    side = F.when(F.floor(F.col("seq") / 100) % 2 == 0, 1).otherwise(-1)
    t = rolled(market.deals(spark, d), 4, lambda t, w: t.withColumn("m", F.avg("last").over(w.rowsBetween(-4, 0)))).withColumns({"entry_id": F.floor(F.col("seq") / 100), "side": side})
    return shape(backtest.trailing_stop(t.withColumn("stop", F.col("last") - 10 * F.col("side")), "m"), "seq", "stop", "symbol")


@query("o11_guards", sql(DEALS_SQL, "SELECT symbol, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time, seq) AS r FROM (SELECT *, lag(time) OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time, seq) AS p FROM deals) WHERE p IS NULL OR time >= p + INTERVAL 10 MINUTE) WHERE r <= 5", "seq", "", "symbol"))
def o11(spark, d):
    return shape(backtest.guarded(market.deals(spark, d), 5, "10 MINUTES"), "seq", "", "symbol")


@query("o11_expiry", sql(DEALS_SQL + ", dd AS (SELECT symbol, seq, time_msc, CAST(time AS DATE) AS day FROM deals)", "SELECT p.symbol, p.seq, coalesce(x.seq, e.seq) AS shut FROM (SELECT *, time_msc + 7200000 AS due FROM dd) p ASOF LEFT JOIN (SELECT symbol, day, time_msc, min(seq) AS seq FROM dd GROUP BY ALL) x ON x.symbol = p.symbol AND x.day = p.day AND p.due <= x.time_msc JOIN (SELECT symbol, day, arg_max(seq, (time_msc, seq)) AS seq FROM dd GROUP BY ALL) e ON e.symbol = p.symbol AND e.day = p.day", "seq shut", "", "symbol"))
def o11_expiry(spark, d):
    t = market.deals(spark, d).withColumn("day", F.to_date("time"))
    return shape(backtest.expired(t, t, 7_200_000), "seq shut", "", "symbol")


# ---- P: streams (drained as of now, read back) -----------------------------------------------------------------------


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    at, path = new_path(spark, "checkpoint"), new_path(spark, "stream")
    schema = stream.schema
    live.drain(stream, at, path)
    return spark.read.schema(schema).parquet(path)


LIVE = 500_000  #: ticks of a batch whose rows Python holds, about


def _arriving(spark, d, size: int | None = None) -> str:
    """The ticks in files of about ``size`` (LIVE, if not given), three at least, one after the other by event_id: a stream takes one at
    a time, so that a batch stays as large as it is, however many ticks there are."""
    parts, path = new_path(spark, "parts"), new_path(spark, "arriving")
    e = market.table(spark, d, "events")
    count = max(3, -(-e.count() // (size or LIVE)))
    e.repartitionByRange(count, "event_id").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(parts)
    for k in range(count):  # streams take files by their time
        e = spark.read.schema(live.EVENTS + ", part int").parquet(parts).where(F.col("part") == k).drop("part")
        e.coalesce(1).write.mode("append").parquet(path)
    return path


@query("p1_stream_value_bars", sql(VBARS, "SELECT * FROM vbars", "uid nticks", "high low", "symbol"))
def p1(spark, d):
    out = _drained(spark, live.value_bar_stream(live.tick_stream(spark, _arriving(spark, d)), 2_000_000))
    b = out.withColumn("real", F.col("nticks"))
    return shape(b, "uid nticks", "high low", "symbol")


@query("p2_stream_cusum", "WITH RECURSIVE " + CUSUM + " SELECT r.symbol, CAST(n.seq AS BIGINT) AS seq, CAST(event AS BIGINT) AS event FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k WHERE event <> 0")
def p2(spark, d):
    return shape(_drained(spark, live.cusum_stream(live.tick_stream(spark, _arriving(spark, d)), 200.0)), "seq event", "", "symbol")


def _chained(spark, d, h=None):
    stream = chain.labels(live.tick_stream(spark, _arriving(spark, d)), 2_000_000, h=h)
    with live.keyed_state(spark):
        return _drained(spark, stream)


@query("p1_live_labels", sql(BARRIER, "SELECT symbol, twhen, vertbar, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS side, tdone, ret FROM labels WHERE ret IS NOT NULL", "twhen vertbar side tdone", "ret", "symbol"))
def p1_labels(spark, d):
    """Triple-barrier labels of all bars, from ticks as they arrive: bars, windows and open events are state."""
    out = _chained(spark, d).where("kind = 'label'").withColumnRenamed("uid", "twhen")
    return shape(out, "twhen vertbar side tdone", "ret", "symbol")


@query("p2_live_events", "WITH RECURSIVE " + VBARS.replace("WITH ", "") + """, r AS (
  SELECT symbol, uid, wprice, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS event FROM vbars WHERE uid = 0 UNION ALL
  SELECT symbol, uid, wprice, CASE WHEN u > 60 THEN 0.0 ELSE u END, CASE WHEN u <= 60 AND v < -60 THEN 0.0 ELSE v END, CASE WHEN u > 60 THEN 1 WHEN v < -60 THEN -1 ELSE 0 END
  FROM (SELECT b.symbol, b.uid, b.wprice, greatest(0.0, r.up + b.wprice - r.wprice) AS u, least(0.0, r.dn + b.wprice - r.wprice) AS v FROM r JOIN vbars b ON b.symbol = r.symbol AND b.uid = r.uid + 1))
  SELECT symbol, CAST(uid AS BIGINT) AS uid, CAST(event AS BIGINT) AS event FROM r WHERE event <> 0""")
def p2_events(spark, d):
    """Events of the CUSUM filter over the bars' prices, from ticks as they arrive."""
    return shape(_chained(spark, d, 60.0).where("kind = 'bar' AND event <> 0"), "uid event", "", "symbol")


@query("p4_stream_dedup", sql(TICKS_SQL, "SELECT * FROM ticks", "seq", "", "symbol"))
def p4(spark, d):
    return shape(_drained(spark, live.deduplicated(live.tick_stream(spark, f"{d}/events.parquet*"))), "seq", "", "symbol")


FILE = 250_000  #: ticks of a file that arrives, about


LATE = TICKS_SQL + ", h AS (SELECT max(seq) // 2 AS h FROM ticks), marked AS (SELECT *, seq % 10 = 0 AND seq < h AS held FROM ticks, h)"


@query("p4_late_ticks", sql(LATE, "SELECT symbol, count(*) AS n, count(*) FILTER (held AND time_msc < (SELECT max(time_msc) FROM marked o WHERE o.symbol = m.symbol AND NOT o.held)) AS late FROM marked m GROUP BY 1", "n late", "", "symbol"))
def p4_late(spark, d):
    """All ticks as a stream of three batches, each of as many files; every tenth of the first half comes last, and late."""
    path = new_path(spark, "arriving")
    e = market.table(spark, d, "events")
    half = e.agg((F.floor(F.max("event_id") / 2)).alias("h"))  # one row
    count = e.count() // FILE + 1
    e = e.join(F.broadcast(half)).withColumn("held", (F.col("event_id") % 10 == 0) & (F.col("event_id") < F.col("h")))
    for part in ("NOT held AND event_id < h", "NOT held AND event_id >= h", "held"):
        e.where(part).drop("h", "held").repartition(count).write.mode("append").parquet(path)
    out = _drained(spark, live.late_ticks(live.tick_stream(spark, path, count)))
    return shape(out.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("late").alias("late")), "n late", "", "symbol")


# ---- A: files -------------------------------------------------------------------------------------------------------


def _by_day(t: DataFrame) -> DataFrame:
    """Names of files: the symbol and the day."""
    return t.withColumn("name", F.concat_ws("_", "symbol", F.date_format("time", "yyyyMMdd")))


def _saved(spark: SparkSession, rows: DataFrame, kind, order: list[str]) -> DataFrame:
    path = new_path(spark, "packed")
    files.write_packed(rows, kind, path, "name", order)
    return files.read_packed(spark, path, kind)


@query("a1_packed_ticks", sql(DEALS_SQL, "SELECT symbol, time_msc, last, volume, CAST(time AS DATE) AS day, row_number() OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY time_msc) - 1 AS nth FROM deals", "time_msc volume nth", "last", "symbol"))
def a1(spark, d):
    """Ticks written to packed files, one for each symbol and day, and read back with their place in the file."""
    t = _by_day(market.deals(spark, d)).select("name", F.unix_timestamp("time").alias("time"), F.col("last").alias("bid"), F.col("last").alias("ask"), "last", "volume", "time_msc", "seq", F.lit(0).alias("flags"), F.lit(0.0).alias("volume_real"))
    return shape(_saved(spark, t, files.TICK, ["time_msc", "seq"]).withColumnRenamed("seq", "nth"), "time_msc volume nth", "last", "symbol")


@query("a10_value_bar_files", sql(VBARS, "SELECT symbol, emsc AS msc, wprice FROM vbars", "msc", "wprice", "symbol"))
def a10(spark, d):
    """Value bars in the old packed layout, and back."""
    b = _by_day(_vbars(spark, d)).select("name", F.col("low").alias("bid"), F.col("high").alias("ask"), F.col("wprice").alias("last"), F.col("emsc").alias("msc"), "uid")
    return shape(_saved(spark, b, files.VALUE_BAR, ["uid"]).withColumnRenamed("last", "wprice"), "msc", "wprice", "symbol")


@query("a11_parameter_grid", "SELECT 'size' AS name, v AS value FROM (VALUES (10.0), (15.0), (20.0)) t(v)")
def a11(spark, d):
    lines = spark.createDataFrame([("; comment",), ("size=10||10||5||20||Y",), ("devs=2||1||1||3||N",)], "value string")
    path = new_path(spark, "grid")
    files.write_grid(files.parse_grid(lines), path)
    return shape(files.grid_values(files.read_grid(spark, path)), "", "value", "name")


@query("a12_optimizer_reports", sql(DAILY_SQL, "SELECT 'WIN' AS symbol, 'bands' AS expert, 'true' AS forward, day, close FROM daily", "", "close", "symbol expert forward day"))
def a12(spark, d):
    """A spreadsheet report of all days, written as text and read back by name, row and column."""
    path = new_path(spark, "report")
    cell = lambda c: F.format_string('<Cell><Data ss:Type="String">%s</Data></Cell>', F.col(c).cast("string"))
    row = F.concat(F.lit("<Row>"), cell("day"), cell("close"), F.lit("</Row>")).alias("value")
    days = market.daily(spark, d).select("day", "close")
    head = spark.createDataFrame([('<Workbook xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet><Table><Row><Cell><Data ss:Type="String">day</Data></Cell><Cell><Data ss:Type="String">close</Data></Cell></Row>',)], "value string")
    end = spark.createDataFrame([("</Table></Worksheet></Workbook>",)], "value string")
    parts = [t.coalesce(1).withColumn("k", F.lit(k)) for k, t in enumerate((head, days.select(row), end))]
    parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(1).sortWithinPartitions("k").select("value").write.text(path)  # a report is one file
    r = files.read_optimizations(spark, files.renamed(spark, path, "optbands_WIN_forward.xml"))
    g = r.groupBy("symbol", "expert", "forward", "row").agg(F.max(F.when(F.col("name") == "day", F.col("value"))).alias("day"), F.max(F.when(F.col("name") == "close", F.col("value"))).alias("close"))
    return shape(g, "", "close", "symbol expert forward day")
