"""Queries of the time-series operators over the tables at hand, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.ieee import divided, logarithm
from ..operators import averages, bars, hygiene, indicators, joins
from ..sources import market
from ..sources.market import DAILY_SQL, DEALS_SQL, RAW_SQL, TICKS_SQL
from .ordered import overlapping, row_number, running_sum, windowed
from .registry import query
from .scratch import stored

SIZE = 2_000_000  #: money of a value bar, in cents


def shape(df: DataFrame, longs: str = "", doubles: str = "", strings: str = "") -> DataFrame:
    """The named columns with plain types; doubles to six places."""
    return df.select(*(F.col(c).cast("long").alias(c) for c in longs.split()), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in doubles.split()), *(F.col(c).cast("string").alias(c) for c in strings.split()))


def sql(with_: str, source: str, longs: str = "", doubles: str = "", strings: str = "") -> str:
    cols = [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()] + [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in strings.split()]
    return (f"WITH {with_} " if with_ else "") + f"SELECT {', '.join(cols)} FROM ({source})"


def W():
    return indicators.by("symbol", order="seq")


def by_day():
    return F.expr("floor(time_msc / 86400000)")


def rolled(t: DataFrame, history: int, add, ahead: int = 0) -> DataFrame:
    """Rolling columns of ticks, in blocks of numbered rows."""
    return windowed(t, ["symbol"], ["seq"], F.to_date("time"), history, add, ahead=ahead)


def rolled_bars(b: DataFrame, history: int, add) -> DataFrame:
    """Rolling columns of value bars, which number themselves."""
    cut = overlapping(b.withColumn("_k", F.col("uid") + 1), "_k", 50_000, history)
    return add(cut, Window.partitionBy("symbol", "block").orderBy("uid")).where("NOT warmup").drop("_k", "block", "warmup")


WS = "(PARTITION BY symbol ORDER BY seq)"


def _rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


# ---- B: hygiene -----------------------------------------------------------------------------------------------------

FILLED = RAW_SQL + """, filled AS (
  SELECT symbol, seq, time, time_msc, volume,
    coalesce(last_value(nullif(bid, 0.0) IGNORE NULLS) OVER w, 0.0) AS bid, coalesce(last_value(nullif(ask, 0.0) IGNORE NULLS) OVER w, 0.0) AS ask,
    coalesce(last_value(nullif(last, 0.0) IGNORE NULLS) OVER w, 0.0) AS last
  FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("b1_fill_quotes", sql(FILLED, "SELECT * FROM filled", "seq", "bid ask last", "symbol"))
def b1(spark: SparkSession, d: str) -> DataFrame:
    return shape(hygiene.fill_quotes(market.raw_ticks(spark, d)), "seq", "bid ask last", "symbol")


@query("b2_aggressor", sql(FILLED, "SELECT symbol, CASE WHEN last = bid THEN -1 WHEN last = ask THEN 1 ELSE 0 END AS flag, count(*) AS n FROM filled GROUP BY ALL", "flag n", "", "symbol"))
def b2(spark, d):
    return shape(hygiene.aggressor(hygiene.fill_quotes(market.raw_ticks(spark, d))).groupBy("symbol", "flag").agg(F.count("*").alias("n")), "flag n", "", "symbol")


@query("b3_deals", sql(DEALS_SQL, "SELECT * FROM deals", "seq volume", "last", "symbol"))
def b3(spark, d):
    return shape(market.deals(spark, d), "seq volume", "last", "symbol")


@query("b4_overlap", sql(TICKS_SQL, "SELECT * FROM ticks WHERE seq % 3 <> 0", "seq", "", "symbol"))
def b4(spark, d):
    t = market.ticks(spark, d)
    return shape(hygiene.without_overlap(t.where("seq % 3 = 0"), t), "seq", "", "symbol")


@query("b5_lost_ratio", sql(TICKS_SQL, "SELECT symbol, avg(CASE WHEN seq < 100 THEN 1.0 ELSE 0.0 END) AS lost FROM ticks GROUP BY 1", "", "lost", "symbol"))
def b5(spark, d):
    t = market.ticks(spark, d)
    asked = t.where("seq = 100").agg(F.min("time_msc").alias("asked"))  # one row
    return shape(t.join(F.broadcast(asked)).groupBy("symbol").agg((F.count_if(F.col("time_msc") < F.col("asked")) / F.count("*")).alias("lost")), "", "lost", "symbol")


@query("b7_fill_by_day", sql(RAW_SQL, "SELECT symbol, seq, coalesce(last_value(nullif(last, 0.0) IGNORE NULLS) OVER (PARTITION BY symbol, CAST(time AS DATE) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS last FROM raw", "seq", "last", "symbol"))
def b7(spark, d):
    return shape(hygiene.fill_quotes(market.raw_ticks(spark, d), cols=("last",), day=True), "seq", "last", "symbol")


@query("b8_trim_days", sql(TICKS_SQL, "SELECT t.symbol, t.seq FROM ticks t JOIN (SELECT symbol, CAST(time AS DATE) AS day, min(seq) AS a, max(seq) AS b FROM ticks WHERE volume <> 0 GROUP BY ALL) s ON t.symbol = s.symbol AND CAST(t.time AS DATE) = s.day AND t.seq BETWEEN a AND b", "seq", "", "symbol"))
def b8(spark, d):
    return shape(hygiene.trim_days(market.ticks(spark, d)), "seq", "", "symbol")


MINUTES = DEALS_SQL + """, minutes AS (
  SELECT symbol, date_trunc('minute', time) AS time, arg_min(last, seq) AS open, max(last) AS high, min(last) AS low, arg_max(last, seq) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM deals GROUP BY 1, 2)"""
HOURS = DEALS_SQL + """, hours AS (
  SELECT symbol, date_trunc('hour', time) AS time, arg_min(last, seq) AS open, max(last) AS high, min(last) AS low, arg_max(last, seq) AS close,
         CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM deals GROUP BY 1, 2)"""


@query("b9_clip_to_bars", sql(HOURS, "SELECT t.symbol, t.seq FROM ticks t JOIN (SELECT symbol, CAST(time AS DATE) AS day, min(time) AS a, max(time) AS b FROM hours GROUP BY ALL) s ON t.symbol = s.symbol AND CAST(t.time AS DATE) = s.day AND t.time >= a AND t.time <= b + INTERVAL 1 MINUTE", "seq", "", "symbol"))
def b9(spark, d):
    return shape(hygiene.clip_to_bars(market.ticks(spark, d), bars.minute_bars(market.deals(spark, d), 60)), "seq", "", "symbol")


@query("b10_replace_matched", sql(TICKS_SQL, "SELECT symbol, seq, last * 2 AS last FROM ticks WHERE seq % 2 = 0", "seq", "last", "symbol"))
def b10(spark, d):
    t = market.ticks(spark, d)
    return shape(hygiene.replace_matched(hygiene.placed(t).where("seq % 2 = 0"), t.withColumn("last", F.col("last") * 2), place="place"), "seq", "last", "symbol")


@query("b11_full_days", sql(DEALS_SQL, "SELECT symbol, seq FROM (SELECT *, count(*) OVER (PARTITION BY symbol, CAST(time AS DATE)) AS c FROM deals) WHERE c >= 5", "seq", "", "symbol"))
def b11(spark, d):
    return shape(hygiene.full_days(market.deals(spark, d), 5), "seq", "", "symbol")


@query("b12_missing_minutes", sql(MINUTES, "SELECT symbol, avg((m - n) / m) AS missing FROM (SELECT symbol, CAST(time AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n, floor((epoch(max(time)) - epoch(min(time))) / 60) AS m FROM minutes GROUP BY ALL) WHERE m > 0 GROUP BY 1", "", "missing", "symbol"))
def b12(spark, d):
    return shape(hygiene.missing_minutes(bars.minute_bars(market.deals(spark, d))), "", "missing", "symbol")


@query("b13_day_borders", sql(DEALS_SQL, "SELECT symbol, seq FROM (SELECT *, hour(time) * 60 + minute(time) + second(time) / 60.0 AS clock, count(*) OVER (PARTITION BY symbol, CAST(time AS DATE)) AS c FROM deals) WHERE c >= 3 AND clock > 601 AND clock < 1019", "seq", "", "symbol"))
def b13(spark, d):
    return shape(hygiene.without_borders(market.deals(spark, d), 1), "seq", "", "symbol")


@query("b14_winsorize", sql(DEALS_SQL, "SELECT d.symbol, seq, greatest(least(last, b), a) AS last FROM deals d JOIN (SELECT symbol, quantile_cont(last, 0.05) AS a, quantile_cont(last, 0.95) AS b FROM deals GROUP BY 1) q ON d.symbol = q.symbol", "seq", "last", "symbol"))
def b14(spark, d):
    return shape(hygiene.winsorize(market.deals(spark, d), ["last"], 0.05, ["symbol"]), "seq", "last", "symbol")


@query("b15_nulls", sql(RAW_SQL, "SELECT symbol, seq, coalesce(nullif(ask, 0.0), 0.0) AS ask, bid FROM raw WHERE bid <> 0.0", "seq", "ask bid", "symbol"))
def b15(spark, d):
    t = hygiene.null_if(market.raw_ticks(spark, d), {"bid": [0.0], "ask": [0.0]})
    return shape(t.na.drop(subset=["bid"]).na.fill({"ask": 0.0}), "seq", "ask bid", "symbol")


# ---- C: bars --------------------------------------------------------------------------------------------------------

VBARS = DEALS_SQL + f""", c1 AS (
  SELECT *, cents * volume AS money, CAST(sum(cents * volume) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS cum FROM deals),
c2 AS (SELECT *, (cum - money) // {SIZE} AS uid0, cum // {SIZE} AS closes, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS flag FROM c1),
c3 AS (SELECT *, CAST(sum(money) OVER v AS DOUBLE) / CAST(sum(volume) OVER v AS DOUBLE) AS vwap FROM c2 WINDOW v AS (PARTITION BY symbol, uid0 ORDER BY seq)),
c4 AS (
  SELECT symbol, uid0, min(time_msc) AS smsc0, max(time_msc) AS emsc, min(time) AS time, arg_min(last, seq) AS open, max(last) AS high, min(last) AS low,
         CAST(sum(money) AS DOUBLE) / sum(volume) / 100 AS wprice, CAST(sum(flag * money) AS DOUBLE) / sum(money) AS netvol, count(*) AS nticks0, max(closes) AS upto,
         arg_min(seq, struct_pack(a := -last, b := seq)) AS firsthigh, arg_min(seq, struct_pack(a := last, b := seq)) AS firstlow, list_sort(list(vwap)) AS vwaps
  FROM c3 GROUP BY 1, 2 HAVING max(closes) > uid0),
c5 AS (SELECT *, unnest(range(CAST(uid0 AS BIGINT), CAST(upto AS BIGINT))) AS uid FROM c4),
vbars AS (
  SELECT symbol, uid, CASE WHEN uid > uid0 THEN emsc ELSE smsc0 END AS smsc, emsc, time, open, high, low, wprice, netvol, CASE WHEN uid > uid0 THEN 0 ELSE nticks0 END AS nticks,
         CASE WHEN firsthigh < firstlow THEN 1 ELSE 0 END AS highfirst,
         vwaps[CAST(greatest(round(len(vwaps) * 0.1 + 0.5), 2) AS INT) - 1] / 100 AS wprice10, vwaps[CAST(greatest(round(len(vwaps) * 0.9 + 0.5), 2) AS INT) - 1] / 100 AS wprice90,
         CASE WHEN uid > uid0 THEN 0.0 ELSE (smsc0 - lag(emsc) OVER (PARTITION BY symbol ORDER BY uid)) / 1000.0 END AS dtp,
         CASE WHEN hour(time) + minute(time) / 60.0 + second(time) / 3600.0 > 10 AND hour(time) + minute(time) / 60.0 + second(time) / 3600.0 < 17 THEN 1 ELSE 0 END AS inday
  FROM c5)"""


def _vbars(spark, d, size=SIZE):
    return bars.value_bars(market.deals(spark, d).withColumn("flag", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)), size)


@query("c1_value_bars", sql(VBARS, "SELECT * FROM vbars", "uid smsc emsc nticks highfirst inday", "open high low wprice netvol dtp", "symbol"))
def c1(spark, d):
    return shape(_vbars(spark, d), "uid smsc emsc nticks highfirst inday", "open high low wprice netvol dtp", "symbol")


@query("c2_large_deals", sql(VBARS.replace(f"// {SIZE}", "// 200000"), "SELECT symbol, count(*) AS n, sum(CASE WHEN nticks = 0 THEN 1 ELSE 0 END) AS empty FROM vbars GROUP BY 1", "n empty", "", "symbol"))
def c2(spark, d):
    return shape(_vbars(spark, d, 200_000).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("nticks") == 0).alias("empty")), "n empty", "", "symbol")


@query("c5_vwap_order_statistics", sql(VBARS, "SELECT * FROM vbars", "uid", "wprice10 wprice90", "symbol"))
def c5(spark, d):
    return shape(_vbars(spark, d), "uid", "wprice10 wprice90", "symbol")


@query("c9_minute_range", sql(MINUTES, "SELECT symbol, epoch_ms(time) AS msc, high, low FROM minutes", "msc", "high low", "symbol"))
def c9(spark, d):
    return shape(bars.minute_range(market.deals(spark, d)).withColumn("msc", F.unix_millis("time")), "msc", "high low", "symbol")


@query("c10_minute_bars", sql(MINUTES, "SELECT *, epoch_ms(time) AS msc FROM minutes", "msc volume n", "open high low close", "symbol"))
def c10(spark, d):
    return shape(bars.minute_bars(market.deals(spark, d)).withColumn("msc", F.unix_millis("time")), "msc volume n", "open high low close", "symbol")


@query("c12_daily_bars", sql(DEALS_SQL, "SELECT symbol, CAST(time AS DATE) AS day, arg_min(last, seq) AS open, max(last) AS high, min(last) AS low, arg_max(last, seq) AS close, sum(volume) AS volume FROM deals GROUP BY 1, 2", "volume", "open high low close", "symbol day"))
def c12(spark, d):
    return shape(bars.daily_bars(market.deals(spark, d)), "volume", "open high low close", "symbol day")


@query("c13_session_checks", sql(DEALS_SQL, "SELECT *, CASE WHEN coalesce(step NOT IN (1, -4), false) OR first_hour <> 9 OR last_hour < 17 THEN 1 ELSE 0 END AS bad FROM (SELECT symbol, CAST(time AS DATE) AS day, min(hour(time)) AS first_hour, max(hour(time)) AS last_hour, (isodow(CAST(time AS DATE)) - 1) - lag(isodow(CAST(time AS DATE)) - 1) OVER (PARTITION BY symbol ORDER BY CAST(time AS DATE)) AS step FROM deals GROUP BY symbol, CAST(time AS DATE))", "first_hour last_hour step bad", "", "symbol day"))
def c13(spark, d):
    return shape(bars.session_checks(market.deals(spark, d)), "first_hour last_hour step bad", "", "symbol day")


@query("c14_bar_report", sql(VBARS, "SELECT a.symbol, bars_a_day, life_p50, nticks_p90 FROM (SELECT symbol, avg(n) AS bars_a_day FROM (SELECT symbol, CAST(time AS DATE) AS day, count(*) AS n FROM vbars GROUP BY ALL) GROUP BY 1) a JOIN (SELECT symbol, quantile_cont((emsc - smsc) / 1000.0, 0.5) AS life_p50, quantile_cont(nticks, 0.9) AS nticks_p90 FROM vbars GROUP BY 1) b ON a.symbol = b.symbol", "", "bars_a_day life_p50 nticks_p90", "symbol"))
def c14(spark, d):
    return shape(bars.bar_report(_vbars(spark, d)), "", "bars_a_day life_p50 nticks_p90", "symbol")


@query("a18_synthetic_ticks")
def a18(spark, d):
    return shape(bars.synthetic_ticks(bars.minute_bars(market.deals(spark, d))), "sec volume", "last", "symbol")


# ---- D, I: look-ups and joins ---------------------------------------------------------------------------------------


@query("d1_bar_by_id", sql(VBARS, "SELECT symbol, uid, smsc FROM vbars WHERE uid IN (0, 5, 10)", "uid smsc", "", "symbol"))
def d1(spark, d):
    wanted = spark.createDataFrame([(0,), (5,), (10,)], "uid long")
    return shape(_vbars(spark, d).join(F.broadcast(wanted), "uid"), "uid smsc", "", "symbol")


@query("d2_first_bar_from", sql(VBARS, "SELECT t.symbol, t.seq, b.smsc FROM ticks t ASOF LEFT JOIN (SELECT symbol, time_msc, min(time_msc) AS smsc FROM deals GROUP BY 1, 2) b ON t.symbol = b.symbol AND t.time_msc <= b.time_msc", "seq smsc", "", "symbol"))
def d2(spark, d):
    t = market.ticks(spark, d).select("symbol", "time_msc", "seq")
    right = market.deals(spark, d).select("symbol", "time_msc", F.col("time_msc").alias("smsc"))
    return shape(joins.as_of(t, right, "time_msc", ["smsc"], ["symbol"], forward=True, chunk=by_day()), "seq smsc", "", "symbol")


@query("d5_nearest_values", sql(DEALS_SQL, "SELECT symbol, min(CASE WHEN last > 250 THEN last END) AS above, max(CASE WHEN last < 250 THEN last END) AS below FROM deals GROUP BY 1", "", "above below", "symbol"))
def d5(spark, d):
    return shape(market.deals(spark, d).groupBy("symbol").agg(F.min(F.when(F.col("last") > 250, F.col("last"))).alias("above"), F.max(F.when(F.col("last") < 250, F.col("last"))).alias("below")), "", "above below", "symbol")


NUMBERED = DEALS_SQL + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS k FROM deals)"


def _numbered(spark, d):
    return row_number(market.deals(spark, d), "k", ["symbol"], ["seq"], F.to_date("time"))


@query("d6_next_greater", sql(NUMBERED, "SELECT a.symbol, a.k, min(b.k) AS next FROM numbered a LEFT JOIN numbered b ON a.symbol = b.symbol AND b.k > a.k AND b.k <= a.k + 20 AND b.last > a.last * 1.2 GROUP BY 1, 2", "k next", "", "symbol"))
def d6(spark, d):
    n = _numbered(spark, d)
    j = joins.following(n.select("symbol", F.col("k").alias("at"), F.col("last").alias("from")), n.select("symbol", "k", "last"), "at", "k", 20, ["symbol"])
    g = j.groupBy("symbol", "at").agg(F.min(F.when((F.col("k") > F.col("at")) & (F.col("last") > F.col("from") * 1.2), F.col("k"))).alias("next"))
    return shape(g.withColumnRenamed("at", "k"), "k next", "", "symbol")


@query("d7_last_known", sql(DEALS_SQL, "SELECT t.symbol, t.seq, b.price FROM (SELECT * FROM ticks WHERE volume = 0) t ASOF LEFT JOIN (SELECT symbol, time_msc, max(last) AS price FROM deals GROUP BY 1, 2) b ON t.symbol = b.symbol AND t.time_msc >= b.time_msc", "seq", "price", "symbol"))
def d7(spark, d):
    t = market.ticks(spark, d).where("volume = 0").select("symbol", "time_msc", "seq")
    right = market.deals(spark, d).select("symbol", "time_msc", F.col("last").alias("price"))
    return shape(joins.as_of(t, right, "time_msc", ["price"], ["symbol"], chunk=by_day()), "seq", "price", "symbol")


@query("d8_last_rows", sql(DEALS_SQL, "SELECT symbol, seq, last FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS r FROM deals) WHERE r <= 10", "seq", "last", "symbol"))
def d8(spark, d):
    return shape(market.deals(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("seq")))).where("r <= 10"), "seq", "last", "symbol")


RUNS = TICKS_SQL + """, parts AS (SELECT symbol, 'deals' AS part, time_msc, seq, last FROM ticks WHERE volume > 0 UNION ALL SELECT symbol, 'later', time_msc, seq, last FROM ticks WHERE seq >= 300),
a AS (SELECT *, row_number() OVER (PARTITION BY symbol, part ORDER BY time_msc, seq, last) AS n FROM parts),
b AS (SELECT f.part, t.*, row_number() OVER (PARTITION BY t.symbol, f.part ORDER BY t.time_msc, t.seq, t.last) AS n FROM ticks t JOIN (SELECT symbol, part, min(time_msc) AS o FROM parts GROUP BY 1, 2) f ON f.symbol = t.symbol AND t.time_msc >= f.o)"""


@query("a3_contained", sql(RUNS, "SELECT a.symbol, a.part, bool_and(coalesce(a.time_msc = b.time_msc AND a.seq = b.seq AND a.last = b.last, false)) AS contained FROM a LEFT JOIN b USING (symbol, part, n) GROUP BY 1, 2", "", "", "symbol part contained"))
def a3(spark, d):
    """Whether all deals, and all ticks from number 300 on, are contiguous runs of the ticks."""
    t = market.ticks(spark, d)
    parts = (t.where("volume > 0").withColumn("part", F.lit("deals")), t.where("seq >= 300").withColumn("part", F.lit("later")))
    whole = t.withColumn("part", F.explode(F.array(F.lit("deals"), F.lit("later"))))
    return shape(joins.contained(parts[0].unionByName(parts[1]), whole, ["seq", "last"], "time_msc", ["symbol", "part"], F.floor(F.col("time_msc") / 86_400_000)), "", "", "symbol part contained")


@query("i1_aligned_symbols", sql(HOURS, "SELECT epoch_ms(time) AS msc, min(close) AS lowest, max(close) AS highest FROM hours GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM hours)", "msc", "lowest highest"))
def i1(spark, d):
    h = bars.minute_bars(market.deals(spark, d), 60)
    n = h.agg(F.countDistinct("symbol").alias("all"))
    g = h.groupBy("time").agg(F.countDistinct("symbol").alias("n"), F.min("close").alias("lowest"), F.max("close").alias("highest"))
    return shape(g.join(F.broadcast(n)).where(F.col("n") == F.col("all")).withColumn("msc", F.unix_millis("time")), "msc", "lowest highest")


@query("i2_daily_left_join", sql(DEALS_SQL + ", " + DAILY_SQL, "SELECT b.symbol, b.day, b.close, d.close AS total FROM (SELECT symbol, CAST(time AS DATE) AS day, arg_max(last, seq) AS close FROM deals GROUP BY 1, 2) b LEFT JOIN daily d ON b.day = d.day", "", "close total", "symbol day"))
def i2(spark, d):
    b = bars.daily_bars(market.deals(spark, d)).select("symbol", "day", "close")
    return shape(b.join(market.daily(spark, d).select("day", F.col("close").alias("total")), "day", "left"), "", "close total", "symbol day")


@query("i7_window_distances", sql("", "SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))) AS dist FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id + 4 AND b.vec_id <= a.vec_id + 12", "a b", "dist").replace("dist AS DOUBLE), 6)", "dist AS DOUBLE), 4)"))
def i7(spark, d):
    e = market.table(spark, d, "embeddings")
    j = joins.following(e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a", "b", 12, ["label"]).where("b > a + 4")
    dist = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))
    return j.select("a", "b", F.round(dist, 4).alias("dist"))


@query("i9_day_positions", sql(NUMBERED, "SELECT symbol, k, min(k) OVER (PARTITION BY symbol, CAST(time AS DATE)) AS day_first, max(k) OVER (PARTITION BY symbol, CAST(time AS DATE)) AS day_last FROM numbered", "k day_first day_last", "", "symbol"))
def i9(spark, d):
    w = Window.partitionBy("symbol", F.to_date("time"))
    return shape(_numbered(spark, d).withColumns({"day_first": F.min("k").over(w), "day_last": F.max("k").over(w)}), "k day_first day_last", "", "symbol")


# ---- E: indicators --------------------------------------------------------------------------------------------------

RN = f"row_number() OVER {WS}"


@query("e1_averages", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN {RN} >= 5 THEN avg(last) OVER {_rows(5)} END AS sma, CASE WHEN {RN} >= 3 THEN (last * 3 + lag(last) OVER {WS} * 2 + lag(last, 2) OVER {WS}) / 6 END AS wma FROM deals", "seq", "sma wma", "symbol"))
def e1(spark, d):
    x = F.col("last")
    return shape(rolled(market.deals(spark, d), 4, lambda t, w: t.withColumns({"sma": indicators.sma(x, 5, w), "wma": indicators.wma(x, 3, w)})), "seq", "sma wma", "symbol")


@query("e1_trima", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN {RN} >= 5 THEN avg(m) OVER {_rows(3)} END AS trima FROM (SELECT symbol, seq, CASE WHEN {RN} >= 3 THEN avg(last) OVER {_rows(3)} END AS m FROM deals)", "seq", "trima", "symbol"))
def e1t(spark, d):
    return shape(rolled(market.deals(spark, d), 4, lambda t, w: indicators.trima(t, "last", 5, w, "trima")), "seq", "trima", "symbol")


def _ema_sql(n: int, alpha: str, out: str) -> str:
    return NUMBERED + f""", seeded AS (SELECT symbol, avg(last) AS s FROM numbered WHERE k <= {n} GROUP BY 1),
    r AS (SELECT s.symbol, CAST({n} AS BIGINT) AS k, s.s AS v FROM seeded s UNION ALL
          SELECT r.symbol, n.k, r.v + {alpha} * (n.last - r.v) FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1)"""


@query("e2_ema", ("WITH RECURSIVE " + _ema_sql(10, "2.0 / 11", "ema") + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(r.v, 6) AS ema FROM numbered n LEFT JOIN r ON n.symbol = r.symbol AND n.k = r.k"))
def e2(spark, d):
    return shape(averages.ema(market.deals(spark, d), ["symbol"], "seq", "last", 10, chunk=F.to_date("time")), "seq", "ema", "symbol")


def _recursion(name: str, n: int, alpha: str, source: str, value: str, first: int = 1) -> str:
    """An average over ``value`` of ``source`` (symbol, k from 1), seeded with the mean of n values from number ``first`` on."""
    return f"""{name}(symbol, k, v) AS (SELECT symbol, CAST({first + n - 1} AS BIGINT), avg({value}) FROM {source} WHERE k BETWEEN {first} AND {first + n - 1} GROUP BY 1 HAVING count(*) = {n} UNION ALL
      SELECT r.symbol, n.k, r.v + {alpha} * (n.{value} - r.v) FROM {name} r JOIN {source} n ON n.symbol = r.symbol AND n.k = r.k + 1)"""


@query("e3_macd", "WITH RECURSIVE " + NUMBERED + ", " + _recursion("fast", 12, "2.0 / 13", "numbered", "last", 15) + ", " + _recursion("slow", 26, "2.0 / 27", "numbered", "last") + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(f.v - s.v, 6) AS macd FROM numbered n LEFT JOIN fast f ON f.symbol = n.symbol AND f.k = n.k LEFT JOIN slow s ON s.symbol = n.symbol AND s.k = n.k")
def e3(spark, d):
    return shape(averages.macd(market.deals(spark, d), ["symbol"], "seq", "last", 12, 26, chunk=F.to_date("time")), "seq", "macd", "symbol")


MOVES = NUMBERED + ", moves AS (SELECT symbol, k - 1 AS k, greatest(c, 0) AS gain, greatest(-c, 0) AS loss FROM (SELECT symbol, k, last - lag(last) OVER (PARTITION BY symbol ORDER BY k) AS c FROM numbered) WHERE k > 1)"


@query("e4_rsi", "WITH RECURSIVE " + MOVES + ", " + _recursion("ups", 14, "1.0 / 14", "moves", "gain") + ", " + _recursion("downs", 14, "1.0 / 14", "moves", "loss") + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(CASE WHEN u.v + d.v > 0 THEN 100 * u.v / (u.v + d.v) WHEN u.v IS NOT NULL THEN 0 END, 6) AS rsi FROM numbered n LEFT JOIN ups u ON u.symbol = n.symbol AND u.k = n.k - 1 LEFT JOIN downs d ON d.symbol = n.symbol AND d.k = n.k - 1")
def e4(spark, d):
    return shape(averages.rsi(market.deals(spark, d), ["symbol"], "seq", "last", 14, chunk=F.to_date("time")), "seq", "rsi", "symbol")


def _chained(n: int, times: int) -> str:
    """Averages of averages: e1, e2, ..., each numbered from where it begins."""
    out = _recursion("e1", n, f"2.0 / {n + 1}", "numbered", "last")
    for i in range(2, times + 1):
        out += f", s{i} AS (SELECT symbol, k - {(n - 1) * (i - 1)} AS k, v FROM e{i - 1}), {_recursion(f'r{i}', n, f'2.0 / {n + 1}', f's{i}', 'v')}, e{i} AS (SELECT symbol, k + {(n - 1) * (i - 1)} AS k, v FROM r{i})"
    return out


def _joined(times: int) -> str:
    return "FROM numbered n " + " ".join(f"LEFT JOIN e{i} ON e{i}.symbol = n.symbol AND e{i}.k = n.k" for i in range(1, times + 1))


@query("e1_double_triple", "WITH RECURSIVE " + NUMBERED + ", " + _chained(5, 3) + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(2 * e1.v - e2.v, 6) AS dema, round(3 * e1.v - 3 * e2.v + e3.v, 6) AS tema " + _joined(3))
def e1_double(spark, d):
    return shape(averages.multiples(market.deals(spark, d), ["symbol"], "seq", "last", 5, chunk=F.to_date("time")), "seq", "dema tema", "symbol")


@query("e1_t3", "WITH RECURSIVE " + NUMBERED + ", " + _chained(4, 6) + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(-0.343 * e6.v + (3 * 0.49 + 3 * 0.343) * e5.v + (-6 * 0.49 - 3 * 0.7 - 3 * 0.343) * e4.v + (1 + 3 * 0.7 + 0.343 + 3 * 0.49) * e3.v, 6) AS t3 " + _joined(6))
def e1_t3(spark, d):
    return shape(averages.t3(market.deals(spark, d), ["symbol"], "seq", "last", 4, chunk=F.to_date("time")), "seq", "t3", "symbol")


SHARES = NUMBERED + """, steps AS (SELECT symbol, k, last, abs(last - lag(last, 10) OVER v) AS way, abs(last - lag(last) OVER v) AS step FROM numbered WINDOW v AS (PARTITION BY symbol ORDER BY k)),
shares AS (SELECT symbol, k, last, pow(coalesce(way / nullif(sum(step) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0), 1) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS c FROM steps),
kama(symbol, k, v) AS (SELECT symbol, k, last FROM shares WHERE k = 10 UNION ALL SELECT a.symbol, s.k, a.v + s.c * (s.last - a.v) FROM kama a JOIN shares s ON s.symbol = a.symbol AND s.k = a.k + 1)"""


@query("e1_kama", "WITH RECURSIVE " + SHARES + " SELECT n.symbol, CAST(n.seq AS BIGINT) AS seq, round(a.v, 6) AS kama FROM numbered n LEFT JOIN kama a ON a.symbol = n.symbol AND a.k = n.k AND n.k > 10")
def e1_kama(spark, d):
    return shape(averages.kama(market.deals(spark, d), ["symbol"], "seq", "last", 10, chunk=F.to_date("time")), "seq", "kama", "symbol")


@query("e1_mama")
def e1_mama(spark, d):
    return shape(averages.mama(market.deals(spark, d), ["symbol"], "seq", "last"), "seq", "mama fama", "symbol")


@query("e5_stddev", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN {RN} >= 20 THEN stddev_pop(last) OVER {_rows(20)} END AS sd FROM deals", "seq", "sd", "symbol"))
def e5(spark, d):
    return shape(rolled(market.deals(spark, d), 19, lambda t, w: t.withColumn("sd", indicators.stddev(F.col("last"), 20, w))), "seq", "sd", "symbol")


@query("e6_bands", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN {RN} >= 20 THEN avg(last) OVER {_rows(20)} + 2 * stddev_pop(last) OVER {_rows(20)} END AS up, CASE WHEN {RN} >= 20 THEN avg(last) OVER {_rows(20)} - 2 * stddev_pop(last) OVER {_rows(20)} END AS down FROM deals", "seq", "up down", "symbol"))
def e6(spark, d):
    return shape(rolled(market.deals(spark, d), 19, lambda t, w: indicators.bands(t, "last", 20, 2.0, w)), "seq", "up down", "symbol")


@query("e7_sample_bands", sql(DEALS_SQL, f"SELECT symbol, seq, CASE WHEN {RN} >= 20 THEN avg(last) OVER {_rows(20)} + 2 * stddev_samp(last) OVER {_rows(20)} END AS up FROM deals", "seq", "up", "symbol"))
def e7(spark, d):
    return shape(rolled(market.deals(spark, d), 19, lambda t, w: indicators.bands(t, "last", 20, 2.0, w, sample=True)), "seq", "up", "symbol")


def WT():
    return indicators.by("symbol", order="time")



@query("e8_band_set", sql(HOURS, "SELECT symbol, epoch_ms(time) AS msc, " + ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY time) >= {n} THEN avg(t) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) + 2 * stddev_pop(t) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS up{k}" for k, n in enumerate((5, 10, 15))) + " FROM (SELECT *, (open + high + low + close) / 4 AS t FROM hours)", "msc", "up0 up1 up2", "symbol"))
def e8(spark, d):
    return shape(indicators.band_set(bars.minute_bars(market.deals(spark, d), 60), 10, 2.0, 3, WT()).withColumn("msc", F.unix_millis("time")), "msc", "up0 up1 up2", "symbol")


def _frac_sql() -> str:
    from ..functions.recursive import fracdiff_weights

    w = fracdiff_weights(0.56, 10)
    return " + ".join(f"({float(c)!r}) * lag(x, {k}) OVER {WS}" if k else f"x * {float(c)!r}" for k, c in enumerate(w))


@query("e9_fracdiff", sql(DEALS_SQL, f"SELECT symbol, seq, {_frac_sql()} AS fd FROM (SELECT *, ln(last) AS x FROM deals)", "seq", "fd", "symbol"))
def e9(spark, d):
    return shape(rolled(market.deals(spark, d), 9, lambda t, w: t.withColumn("fd", indicators.fracdiff(logarithm(F.col("last")), 0.56, 10, w))), "seq", "fd", "symbol")


def _long_frac_sql() -> str:
    from ..functions.recursive import fracdiff_weights

    w = fracdiff_weights(0.56, 512)
    return f"""WITH w AS (SELECT unnest([{", ".join(repr(float(v)) for v in w)}]) AS c, unnest(range(512)) AS lag),
    {NUMBERED.removeprefix("WITH ")}, x AS (SELECT symbol, seq, k, ln(last) AS x FROM numbered),
    s AS (SELECT a.symbol, a.seq, a.k, sum(CASE WHEN lag < 128 THEN c * b.x END) AS fd_128, sum(c * b.x) AS fd_512 FROM x a JOIN w ON a.k > lag JOIN x b ON b.symbol = a.symbol AND b.k = a.k - lag GROUP BY ALL)
    SELECT symbol, CAST(seq AS BIGINT) AS seq, CASE WHEN k >= 128 THEN round(fd_128, 6) END AS fd_128, CASE WHEN k >= 512 THEN round(fd_512, 6) END AS fd_512 FROM s"""


@query("e9_long_fracdiff", _long_frac_sql())
def e9_long(spark, d):
    """Fractional differences of 128 and 512 weights."""
    t = market.deals(spark, d).withColumn("x", logarithm(F.col("last")))
    return shape(indicators.long_fracdiff(t, ["symbol"], "seq", "x", 0.56, {"fd_128": 128, "fd_512": 512}, F.to_date("time")), "seq", "fd_128 fd_512", "symbol")


RETURNS = VBARS + """, returns AS (
  SELECT *, (0.75 * (open / lag(CASE WHEN highfirst = 1 THEN low ELSE high END) OVER (PARTITION BY symbol ORDER BY uid) - 1) + 0.85 * (CASE WHEN highfirst = 1 THEN high ELSE low END / open - 1)
            + (CASE WHEN highfirst = 1 THEN low ELSE high END / CASE WHEN highfirst = 1 THEN high ELSE low END - 1)) / 2.6 AS ret FROM vbars)"""
def WU():
    return indicators.by("symbol", order="uid")



@query("e10_bar_return", sql(RETURNS, "SELECT * FROM returns", "uid", "ret", "symbol"))
def e10(spark, d):
    return shape(rolled_bars(_vbars(spark, d), 1, lambda b, w: b.withColumn("ret", indicators.bar_return(w))), "uid", "ret", "symbol")


VOL = RETURNS + """, vol AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY uid) >= 31 THEN stddev_pop(ret) OVER (PARTITION BY symbol ORDER BY uid ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS sigma FROM returns)"""


def _volatile(spark, d, n=30):
    def add(b: DataFrame, w) -> DataFrame:
        b = b.withColumn("ret", indicators.bar_return(w))
        return b.withColumn("sigma", F.when(F.col("uid") >= n, F.stddev_pop("ret").over(w.rowsBetween(-(n - 1), 0))))

    return rolled_bars(_vbars(spark, d), n + 1, add)


@query("e11_volatility", sql(VOL, "SELECT * FROM vol", "uid", "sigma", "symbol"))
def e11(spark, d):
    return shape(_volatile(spark, d), "uid", "sigma", "symbol")


@query("e13_sadf")
def e13(spark, d):
    b = stored(_vbars(spark, d).withColumn("x", F.log("wprice")), "bars")
    return shape(indicators.sadf(b, ["symbol"], "uid", "x", 24, 16, 2), "uid", "sadf spread", "symbol")


@query("e15_sadf_max")
def e15(spark, d):
    b = stored(_vbars(spark, d).withColumn("x", F.log("wprice")), "bars")
    return shape(indicators.sadf(b, ["symbol"], "uid", "x", 20, 16, 1, mode="max"), "uid", "sadf spread", "symbol")


CUSUM = NUMBERED.replace("WITH ", "") + """, r AS (
  SELECT symbol, k, last, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS event FROM numbered WHERE k = 1 UNION ALL
  SELECT symbol, k, last, CASE WHEN u > 200 THEN 0.0 ELSE u END, CASE WHEN u <= 200 AND v < -200 THEN 0.0 ELSE v END, CASE WHEN u > 200 THEN 1 WHEN v < -200 THEN -1 ELSE 0 END
  FROM (SELECT n.symbol, n.k, n.last, greatest(0.0, r.up + n.last - r.last) AS u, least(0.0, r.dn + n.last - r.last) AS v FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1))"""


@query("e17_cusum", "WITH RECURSIVE " + CUSUM + " SELECT r.symbol, CAST(n.seq AS BIGINT) AS seq, CAST(event AS BIGINT) AS event FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k")
def e17(spark, d):
    return shape(indicators.cusum(market.deals(spark, d), ["symbol"], "seq", "last", 200.0, chunk=F.to_date("time")), "seq event", "", "symbol")


MASKED = NUMBERED + """, valid AS (SELECT *, hour(time) BETWEEN 6 AND 18 AS ok FROM numbered), r AS (
  SELECT symbol, k, last, ok, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS event FROM valid WHERE k = 1 UNION ALL
  SELECT symbol, k, last, ok, CASE WHEN u > 150 THEN 0.0 ELSE u END, CASE WHEN u <= 150 AND v < -150 THEN 0.0 ELSE v END, CASE WHEN u > 150 THEN 1 WHEN v < -150 THEN -1 ELSE 0 END
  FROM (SELECT n.symbol, n.k, n.last, n.ok, CASE WHEN n.ok AND r.ok THEN greatest(0.0, r.up + n.last - r.last) ELSE 0 END AS u, CASE WHEN n.ok AND r.ok THEN least(0.0, r.dn + n.last - r.last) ELSE 0 END AS v FROM r JOIN valid n ON n.symbol = r.symbol AND n.k = r.k + 1))"""


@query("e18_masked_cusum", "WITH RECURSIVE " + MASKED + " SELECT r.symbol, CAST(n.seq AS BIGINT) AS seq, CAST(event AS BIGINT) AS event FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k")
def e18(spark, d):
    t = market.deals(spark, d).withColumn("ok", F.hour("time").between(6, 18).cast("double"))
    return shape(indicators.cusum(t, ["symbol"], "seq", "last", 150.0, "ok"), "seq event", "", "symbol")


@query("e19_differences", sql(DEALS_SQL, f"SELECT symbol, seq, last - lag(last) OVER {WS} AS d1, last / lag(last, 5) OVER {WS} - 1 AS r5, lead(last) OVER {WS} AS nxt FROM deals", "seq", "d1 r5 nxt", "symbol"))
def e19(spark, d):
    x = F.col("last")
    return shape(rolled(market.deals(spark, d), 5, lambda t, w: t.withColumns({"d1": x - F.lag(x).over(w), "r5": divided(x, F.lag(x, 5).over(w)) - 1, "nxt": F.lead(x).over(w)}), 1), "seq", "d1 r5 nxt", "symbol")


@query("e20_moving_sum", sql(TICKS_SQL, "SELECT symbol, seq, sum(volume) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM ticks", "seq s", "", "symbol"))
def e20(spark, d):
    return shape(rolled(market.ticks(spark, d), 2, lambda t, w: t.withColumn("s", F.sum("volume").over(w.rowsBetween(-2, 2))), 2), "seq s", "", "symbol")


@query("e21_cumulative_rate", sql(DEALS_SQL, f"SELECT symbol, seq, avg(CASE WHEN last > 250 THEN 1.0 ELSE 0.0 END) OVER {WS} AS rate FROM deals", "seq", "rate", "symbol"))
def e21(spark, d):
    t = running_sum(market.deals(spark, d).withColumn("hit", (F.col("last") > 250).cast("long")), F.struct("hit").getField("hit"), "hits", ["symbol"], ["seq"], F.to_date("time"))
    t = row_number(t, "k", ["symbol"], ["seq"], F.to_date("time"))
    return shape(t.withColumn("rate", F.col("hits") / F.col("k")), "seq", "rate", "symbol")


@query("e22_day_parity", sql(DEALS_SQL, "SELECT symbol, seq, (dense_rank() OVER (PARTITION BY symbol ORDER BY CAST(time AS DATE)) - 1) % 2 AS parity, date_diff('day', DATE '2020-01-01', CAST(time AS DATE)) AS day FROM deals", "seq parity day", "", "symbol"))
def e22(spark, d):
    t = market.deals(spark, d)
    days = t.select("symbol", F.to_date("time").alias("_d")).distinct().withColumn("parity", (F.dense_rank().over(Window.partitionBy("symbol").orderBy("_d")) - 1) % 2)
    return shape(t.withColumn("_d", F.to_date("time")).join(days, ["symbol", "_d"]).withColumn("day", F.datediff("_d", F.lit("2020-01-01"))), "seq parity day", "", "symbol")


@query("e23_lookback", sql(DEALS_SQL, f"SELECT symbol, seq, lag(last, 3) OVER {WS} AS x0, lag(last, 1) OVER {WS} AS x4 FROM deals QUALIFY {RN} > 3", "seq", "x0 x4", "symbol"))
def e23(spark, d):
    t = market.deals(spark, d).withColumn("v", F.col("volume").cast("double"))
    t = rolled(t, 3, lambda t, w: t.withColumn("x", indicators.lookback(["last", "v"], 3, w))).where("x IS NOT NULL")
    return shape(t.withColumns({"x0": F.get("x", 0), "x4": F.get("x", 4)}), "seq", "x0 x4", "symbol")


@query("e24_swing", sql(DAILY_SQL, "SELECT day, CASE WHEN row_number() OVER (ORDER BY day) >= 126 THEN CASE WHEN close > 1.01 * min(close) OVER w AND close < 0.99 * max(close) OVER w THEN 1 ELSE 0 END END AS swing FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 125 PRECEDING AND CURRENT ROW)", "swing", "", "day"))
def e24(spark, d):
    return shape(market.daily(spark, d).withColumn("swing", indicators.swinging(F.col("close"), 126, Window.orderBy("day"))), "swing", "", "day")


@query("e25_detrend", sql(NUMBERED, "SELECT n.symbol, k, last - (a + b * k) AS rest FROM numbered n JOIN (SELECT symbol, regr_slope(last, k) AS b, regr_intercept(last, k) AS a FROM numbered GROUP BY 1) s ON n.symbol = s.symbol", "k", "rest", "symbol"))
def e25(spark, d):
    n = _numbered(spark, d)
    s = n.groupBy("symbol").agg(F.regr_slope("last", "k").alias("b"), F.regr_intercept("last", "k").alias("a"))
    return shape(n.join(s, "symbol").withColumn("rest", F.col("last") - (F.col("a") + F.col("b") * F.col("k"))), "k", "rest", "symbol")


@query("e25_periodogram")
def e25p(spark, d):
    return shape(indicators.periodogram(bars.minute_bars(market.deals(spark, d), 60), ["symbol"], "time", "close"), "", "frequency power", "symbol")
