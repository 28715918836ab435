"""Further queries: files, folds over models, combined labels, band vectors, session streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import backtest, bars, features, folds, hygiene, indicators, joins, labels, mixtures, motifs, trees
from ..sources import files, market
from ..sources.market import DEALS_SQL, TICKS_SQL
from ..streaming import live
from .market_queries import FILLED, HOURS, NUMBERED, RETURNS, WS, _numbered, rolled, shape, sql
from .more_queries import BARRIER, DAILY_ROWS, FOLDS, MULTI, VOL, _by_day, _drained, _labels, _multi, _saved, _volatile
from .ordered import overlapping
from .registry import query
from .scratch import new_path, stored


@query("a4_packed_bars", sql(HOURS, "SELECT symbol, epoch_us(time) // 1000000 AS time, open, close, volume FROM hours", "time volume", "open close", "symbol"))
def a4(spark, d):
    """Bars written to packed files, one for each symbol and day, and read back."""
    h = _by_day(bars.minute_bars(market.deals(spark, d), 60))
    rows = h.select("name", F.unix_timestamp("time").alias("time"), "open", "high", "low", "close", F.col("volume").alias("tick_volume"), F.lit(0).alias("spread"), F.lit(0).alias("real_volume"))
    return shape(_saved(spark, rows, files.BAR, ["time"]).withColumnRenamed("tick_volume", "volume"), "time volume", "open close", "symbol")


@query("a8_bar_csv", sql(HOURS, "SELECT epoch_us(time) // 1000000 AS time, open, close, volume FROM hours", "time volume", "open close"))
def a8(spark, d):
    path = new_path(spark, "bars")
    files.write_bar_csv(bars.minute_bars(market.deals(spark, d), 60), path)
    return shape(files.read_bars(spark, path).withColumn("time", F.unix_timestamp("time")), "time volume", "open close")


@query("a9_tick_csv", sql(TICKS_SQL, "SELECT time_msc, last, volume FROM ticks", "time_msc volume", "last"))
def a9(spark, d):
    path = new_path(spark, "csv")
    t = market.ticks(spark, d).withColumns({"bid": F.col("last"), "ask": F.col("last")})
    files.write_tick_csv(t, path)
    return shape(files.read_tick_csv(spark, path).withColumn("time_msc", F.unix_millis("time")), "time_msc volume", "last")


@query("a14_prediction_sink", sql(DEALS_SQL, "SELECT symbol, epoch_us(time) // 1000000 AS time, volume AS quantity FROM deals", "time quantity", "", "symbol"))
def a14(spark, d):
    """Signed quantities written to packed files, one for each symbol and day, and read back."""
    rows = _by_day(market.deals(spark, d)).select("name", F.unix_timestamp("time").alias("time"), F.col("volume").alias("quantity"))
    return shape(_saved(spark, rows, files.SIGNAL, ["time"]), "time quantity", "", "symbol")


@query("a8_null_tokens", sql(HOURS, "SELECT epoch_us(time) // 1000000 AS time, close, CASE WHEN volume % 3 <> 0 THEN volume END AS volume FROM hours", "time volume", "close"))
def a8_nulls(spark, d):
    """Bars with two tokens for a missing value: volumes of 0 are none."""
    path = new_path(spark, "bars")
    b = bars.minute_bars(market.deals(spark, d), 60)
    files.write_bar_csv(b.withColumn("volume", F.when(F.col("volume") % 3 != 0, F.col("volume")).otherwise(0)), path)
    r = files.read_bar_csv(spark, path, nulls=("null", "0"))
    t = F.unix_timestamp(F.to_timestamp(F.concat_ws(" ", F.col("<DATE>"), F.col("<TIME>")), "yyyy.MM.dd HH:mm:ss"))
    return shape(r.select(t.alias("time"), F.col("<CLOSE>").alias("close"), F.col("<VOLUME>").alias("volume")), "time volume", "close")


@query("d3_first_tick_from", sql(TICKS_SQL, "SELECT symbol, min(CASE WHEN seq >= 500 THEN seq END) AS seq FROM ticks GROUP BY 1", "seq", "", "symbol"))
def d3(spark, d):
    t = market.ticks(spark, d)
    at = t.where("seq = 500").agg(F.min("time_msc").alias("t0"))  # one row
    return shape(t.join(F.broadcast(at)).groupBy("symbol").agg(F.min_by("seq", F.when(F.col("time_msc") >= F.col("t0"), F.struct("time_msc", "seq"))).alias("seq")), "seq", "", "symbol")


@query("e13_long_series_blocks", sql(NUMBERED, "SELECT symbol, k, CASE WHEN k >= 20 THEN avg(last) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma FROM numbered", "k", "sma", "symbol"))
def e_blocks(spark, d):
    b = overlapping(_numbered(spark, d), "k", 256, 19)
    w = Window.partitionBy("symbol", "block").orderBy("k").rowsBetween(-19, 0)
    return shape(b.withColumn("sma", F.when(F.col("k") >= 20, F.avg("last").over(w))).where("NOT warmup"), "k", "sma", "symbol")


NETTED = MULTI + DAILY_ROWS + """net AS (
  SELECT symbol, day, n, CAST(0 AS BIGINT) AS pos, CAST(0 AS DOUBLE) AS price, 0 AS held, CAST(NULL AS BIGINT) AS marked, CAST(NULL AS INTEGER) AS label, 0 AS done FROM sized
  UNION ALL
  SELECT symbol, day, n, CASE WHEN sig <> 0 THEN k ELSE pos END, CASE WHEN sig <> 0 THEN last ELSE price END, CASE WHEN sig <> 0 THEN sig WHEN gain >= 1000 OR gain <= -800 THEN 0 ELSE held END,
    CASE WHEN held <> 0 AND (sig <> 0 OR gain <= -800 AND gain < 1000 OR gain >= 1000) THEN pos END, CASE WHEN sig = 0 AND gain >= 1000 THEN held ELSE 0 END, k
  FROM (SELECT s.*, r.k, r.sig, r.last, s.held * (r.last - s.price) * coalesce(round(10000 / nullif(s.price, 0)), 0) AS gain FROM net s JOIN daily_rows r ON r.symbol = s.symbol AND r.day = s.day AND r.k = s.done + 1))"""


@query("g8_both_sides", sql("RECURSIVE " + NETTED, "SELECT r.symbol, r.seq, m.label FROM daily_rows r LEFT JOIN net m ON m.symbol = r.symbol AND m.day = r.day AND m.marked = r.k", "seq label", "", "symbol"))
def g8(spark, d):
    s = _multi(spark, d).withColumns({"day": F.to_date("time"), "high": F.col("last"), "low": F.col("last"), "signal": F.col("s1")})
    return shape(labels.both_sides(s, 10_000.0, 1000.0, 800.0), "seq label", "", "symbol")


@query("g9_delayed_labels", sql(NUMBERED, "SELECT a.symbol, a.k, coalesce(arg_min(CASE WHEN b.last >= a.last * 1.1 THEN 1 ELSE 0 END, b.k) FILTER (b.last >= a.last * 1.1 OR b.last <= a.last * 0.9), CASE WHEN arg_max(b.last, b.k) >= a.last * 1.05 THEN 1 ELSE 0 END) AS label FROM numbered a JOIN numbered b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 2 AND a.k + 30 AND CAST(a.time AS DATE) = CAST(b.time AS DATE) GROUP BY a.symbol, a.k, a.last", "k label", "", "symbol"))
def g9(spark, d):
    return shape(labels.delayed(_numbered(spark, d), "true", 2, 30, 0.1, 0.1), "k label", "", "symbol")


@query("g12_shifted_labels", sql(DEALS_SQL, f"SELECT symbol, seq, lead(CASE WHEN volume > 49 THEN 1 ELSE 0 END, 3) OVER {WS} AS label FROM deals", "seq label", "", "symbol"))
def g12(spark, d):
    return shape(rolled(market.deals(spark, d), 0, lambda t, w: t.withColumn("label", F.lead((F.col("volume") > 49).cast("int"), 3).over(w)), 3), "seq label", "", "symbol")


@query("h3_band_vectors", sql(MULTI, f"SELECT symbol, seq, s0 AS m0, s1 AS m1, lag(last, 1) OVER {WS} AS x FROM multi QUALIFY row_number() OVER {WS} > 2", "seq m0 m1", "x", "symbol"))
def h3(spark, d):
    t = _multi(spark, d).withColumn("v", F.col("volume").cast("double"))
    t = rolled(t, 2, lambda t, w: t.withColumn("back", indicators.lookback(["last", "v"], 2, w))).where("back IS NOT NULL")
    x = t.withColumn("x", F.concat(F.array(F.col("s0").cast("double"), F.col("s1").cast("double")), "back"))
    return shape(x.select("symbol", "seq", F.get("x", 0).alias("m0"), F.get("x", 1).alias("m1"), F.get("x", 4).alias("x")), "seq m0 m1", "x", "symbol")


@query("i3_inner_by_number", sql(VOL, "SELECT a.symbol, a.uid, b.sigma FROM vbars a JOIN vol b ON a.symbol = b.symbol AND a.uid = b.uid WHERE b.sigma IS NOT NULL", "uid", "sigma", "symbol"))
def i3(spark, d):
    v = _volatile(spark, d)
    return shape(v.select("symbol", "uid").join(v.where("sigma IS NOT NULL").select("symbol", "uid", "sigma"), ["symbol", "uid"]), "uid", "sigma", "symbol")


@query("i6_overlap_purge", sql(BARRIER, "SELECT symbol, twhen, vertbar FROM labels WHERE ret IS NOT NULL AND (tdone < 50 OR twhen > 80)", "twhen vertbar", "", "symbol"))
def i6(spark, d):
    spans = spark.createDataFrame([(0, 50, 80)], "fold int, lo long, hi long")
    v = _labels(spark, d).withColumns({"inf_start": F.col("twhen"), "inf_end": F.col("tdone")})
    return shape(joins.overlap_purge(v, spans), "twhen vertbar", "", "symbol")


@query("j1_by_day", sql(DEALS_SQL, "SELECT CAST(time AS DATE) AS day, count(*) AS n, sum(volume) AS volume, avg(last) AS mean, min(last) AS lo, max(last) AS hi FROM deals GROUP BY 1", "n volume", "mean lo hi", "day"))
def j1(spark, d):
    return shape(market.deals(spark, d).groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.avg("last").alias("mean"), F.min("last").alias("lo"), F.max("last").alias("hi")), "n volume", "mean lo hi", "day")


@query("k3_tail", sql(HOURS, "SELECT symbol, epoch_us(time) // 1000 AS msc FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS r FROM hours) WHERE r <= 3", "msc", "", "symbol"))
def k3(spark, d):
    h = bars.minute_bars(market.deals(spark, d), 60)
    t = h.withColumn("r", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).where("r <= 3")
    return shape(t.withColumn("msc", F.unix_millis("time")), "msc", "", "symbol")


def _model_rows(spark, d):
    add = lambda t, w: t.withColumns({"r": F.col("last") - F.lag("last").over(w), "y": (F.lead("last").over(w) > F.col("last")).cast("int")})
    return rolled(_numbered(spark, d), 1, add, 1).na.drop(subset=["r", "y"])


def _scored(size: int, step: int, parts: str, where: str = "true") -> str:
    return NUMBERED + f""", rows_ AS (SELECT symbol, k, r, y FROM (SELECT symbol, k, last - lag(last) OVER v AS r, CASE WHEN lead(last) OVER v > last THEN 1 WHEN lead(last) OVER v <= last THEN 0 END AS y FROM numbered WINDOW v AS (PARTITION BY symbol ORDER BY k)) WHERE r IS NOT NULL AND y IS NOT NULL),
    m AS (SELECT symbol, max(k) AS m FROM rows_ GROUP BY 1), g AS (SELECT symbol, unnest(range(0, CAST(floor((m - {size}) / {step}.0) AS BIGINT) + 1)) AS fold FROM m WHERE m >= {size}),
    p AS (SELECT * FROM (SELECT n.*, fold, {parts.format(place=f"(k - fold * {step})")} AS part FROM g JOIN rows_ n ON n.symbol = g.symbol AND n.k > fold * {step} AND n.k <= fold * {step} + {size}) WHERE {where}),
    h AS (SELECT p.*, CASE WHEN (r > a) = (y = 1) THEN 1.0 ELSE 0.0 END AS hit FROM p JOIN (SELECT symbol, fold, avg(r) AS a FROM p WHERE part = 'train' GROUP BY ALL) t USING (symbol, fold)),
    scored AS (SELECT symbol, fold, CASE WHEN count(DISTINCT y) FILTER (part = 'train') > 1 AND count(DISTINCT y) FILTER (part <> 'train') > 1
      THEN CASE WHEN avg(hit) FILTER (part = 'train') >= 0.5 THEN avg(hit) FILTER (part <> 'train') ELSE 1 - avg(hit) FILTER (part <> 'train') END END AS score FROM h GROUP BY 1, 2)"""


@query("n5_walk_forward", sql(_scored(150, 100, "CASE WHEN {place} > 130 THEN 'predict' WHEN {place} <= 91 THEN 'train' ELSE 'valid' END"), "SELECT * FROM scored", "fold", "score", "symbol"))
def n5(spark, d):
    f = folds.split(folds.sequential(_model_rows(spark, d), "k", 150, 100, ("symbol",)), "k", 150, 100, 0.7, 20)
    return shape(folds.split_score(f, "r", "y", ("symbol",)), "fold", "score", "symbol")


@query("n6_sliding_predictions", sql(_scored(150, 20, "CASE WHEN {place} > 130 THEN 'predict' WHEN {place} <= 117 THEN 'train' ELSE 'valid' END", "part <> 'valid'"), "SELECT *, CASE WHEN score >= 0.9 THEN 1 WHEN score < 0.9 THEN 0 END AS act FROM scored", "fold act", "score", "symbol"))
def n6(spark, d):
    f = folds.split(folds.sequential(_model_rows(spark, d), "k", 150, 20, ("symbol",)), "k", 150, 20, 0.9, 20)
    s = folds.split_score(f.where("part <> 'valid'"), "r", "y", ("symbol",))
    return shape(s.withColumn("act", (F.col("score") >= 0.9).cast("int")), "fold act", "score", "symbol")


TREE_FEATURES = ["r", "volume", "hour"]


@query("n2_random_folds")
def n2_random(spark, d):
    """Two folds of each symbol, drawn by a hash of their number."""
    f = folds.chosen(folds.sequential(_numbered(spark, d), "k", 300, 100, ("symbol",)), sample=2, by=("symbol",))
    return shape(f.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.min("k").alias("lo")), "fold n lo", "", "symbol")


@query("n8_extra_trees")
def n8_trees(spark, d):
    """Accuracy of extremely randomised trees on what follows each fold's training rows; all symbols and folds grow together."""
    rows = _model_rows(spark, d).withColumn("hour", F.hour("time"))
    f = stored(folds.split(folds.sequential(rows, "k", 150, 100, ("symbol",)), "k", 150, 100, 0.7, 20), "folds")
    model = trees.fit(f.where("part = 'train'"), TREE_FEATURES, "y", ["symbol", "fold"], trees=5, depth=3)
    p = trees.predict(f.where("part = 'predict'"), model, TREE_FEATURES, ["symbol", "fold"], depth=3)
    s = p.groupBy("symbol", "fold").agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"), F.avg("p").alias("mean"))
    return shape(s, "fold n", "accuracy mean", "symbol")


@query("n2_last_folds", sql(FOLDS, "SELECT symbol, fold, count(*) AS n FROM folded SEMI JOIN (SELECT symbol, fold FROM folds QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fold DESC) <= 2) USING (symbol, fold) GROUP BY ALL", "fold n", "", "symbol"))
def n2_last(spark, d):
    f = folds.chosen(folds.sequential(_numbered(spark, d), "k", 800, 500, ("symbol",)), last=2, by=("symbol",))
    return shape(f.groupBy("symbol", "fold").agg(F.count("*").alias("n")), "fold n", "", "symbol")


@query("n7_overlapping_slices", sql(NUMBERED, "SELECT symbol, b AS block, count(*) AS n FROM numbered, (SELECT unnest(range(0, (SELECT CAST((max(k) + 9) // 100 + 1 AS BIGINT) FROM numbered))) AS b) WHERE k - 1 >= b * 100 - 10 AND k - 1 < b * 100 + 100 GROUP BY 1, 2", "block n", "", "symbol"))
def n7(spark, d):
    b = overlapping(_numbered(spark, d), "k", 100, 10).groupBy("symbol", "block").agg(F.count("*").alias("n"), F.count_if(~F.col("warmup")).alias("own"))
    m = _numbered(spark, d).groupBy("symbol").agg(F.max("k").alias("m"))
    return shape(b.join(m, "symbol").where("block * 100 - 10 < m"), "block n", "", "symbol")


@query("n11_parameter_search")
def n11(spark, d):
    grid = spark.createDataFrame([(i, f, s, 0, 2**62) for i, (f, s) in enumerate((f, s) for f in (3, 5, 8) for s in (13, 21))], "scenario long, fast int, slow int, lo long, hi long")
    r = backtest.sweep(market.deals(spark, d), grid, 10_000.0, 0.2, 1.0).groupBy("scenario").agg(F.sum("equity").alias("equity"))
    return shape(r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("equity"), "scenario"))), "scenario rank", "equity")  # one row per scenario


#: a window is given out once the watermark, ten minutes behind the last deal, has passed its end
SEEN = "(SELECT max(time_msc) - 600000 FROM deals)"


@query("p3_stream_minutes", sql(DEALS_SQL, f"SELECT symbol, time_msc // 60000 * 60000 AS msc, max(last) AS high, min(last) AS low, count(*) AS n FROM deals GROUP BY 1, 2 HAVING time_msc // 60000 * 60000 + 60000 <= {SEEN}", "msc n", "high low", "symbol"))
def p3(spark, d):
    out = _drained(spark, live.minute_stream(live.tick_stream(spark, f"{d}/events.parquet*")))
    return shape(out.withColumn("msc", F.unix_millis("time")), "msc n", "high low", "symbol")


@query("p5_stream_sessions", sql(DEALS_SQL, f"SELECT symbol, min(time_msc) AS msc, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY time, seq) AS session FROM (SELECT *, CASE WHEN time > lag(time) OVER (PARTITION BY symbol ORDER BY time, seq) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM deals)) GROUP BY symbol, session HAVING max(time_msc) + 7200000 <= {SEEN}", "msc n", "", "symbol"))
def p5(spark, d):
    out = _drained(spark, live.session_stream(live.tick_stream(spark, f"{d}/events.parquet*"), gap="2 hours"))
    return shape(out.withColumn("msc", F.unix_millis("start")), "msc n", "", "symbol")


@query("m9_spread", sql(FILLED, "SELECT symbol, seq, ask - bid AS spread, (ask - bid) / nullif(ask / 100, 0) AS share FROM filled", "seq", "spread share", "symbol"))
def m9(spark, d):
    t = hygiene.fill_quotes(market.raw_ticks(spark, d))
    spread, share = hygiene.spread(F.col("bid"), F.col("ask"))
    return shape(t.withColumns({"spread": spread, "share": share}), "seq", "spread share", "symbol")


@query("c11_discounted_time", "WITH RECURSIVE " + NUMBERED + ", r AS (SELECT symbol, k, time_msc, time_msc AS begun FROM numbered WHERE k = 1 UNION ALL SELECT n.symbol, n.k, n.time_msc, CASE WHEN n.time_msc - r.begun > 25200000 THEN n.time_msc ELSE r.begun END FROM r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1) SELECT symbol, CAST(k AS BIGINT) AS k, CAST(time_msc - begun AS BIGINT) AS since FROM r")
def c11(spark, d):
    n = _numbered(spark, d)
    return shape(indicators.since_start(n, ["symbol"], "k", "time_msc", 25_200_000), "k since", "", "symbol")


@query("e12_adf")
def e12(spark, d):
    h = bars.minute_bars(market.deals(spark, d), 60).withColumn("month", F.date_trunc("month", "time"))
    return shape(indicators.adf(h, ["symbol", "month"], "time", "close", 2, True), "", "adf", "symbol")


def _edge_sql(edges: list[float]) -> str:
    return " + ".join(f"CASE WHEN x >= {e!r} THEN 1 ELSE 0 END" for e in edges if e > float("-inf") and e < float("inf"))


@query("h10_quantile_bins", sql(DEALS_SQL, f"SELECT symbol, seq, 1 + {_edge_sql(features.normal_edges(20, 250, 100))} AS normal, 1 + {_edge_sql(features.laplace_edges(20, 250, 30))} AS laplace FROM (SELECT *, last AS x FROM deals)", "seq normal laplace", "", "symbol"))
def h10_quantiles(spark, d):
    t = market.deals(spark, d)
    return shape(t.withColumns({"normal": features.cut(F.col("last"), features.normal_edges(20, 250, 100)), "laplace": features.cut(F.col("last"), features.laplace_edges(20, 250, 30))}), "seq normal laplace", "", "symbol")


@query("h11_similar", sql("", "SELECT DISTINCT b AS col FROM (SELECT 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS c FROM lineitem UNION ALL SELECT 'l_tax', corr(l_quantity, l_tax) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem) WHERE abs(c) > 0.001", "", "", "col"))
def h11s(spark, d):
    return shape(features.similar(market.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], 0.001), "", "", "col")


@query("h1_eleven_features")
def h1_eleven(spark, d):
    """All eleven features of the bars up to an event, and the label's side, stop and barrier."""
    b = stored(_volatile(spark, d).withColumn("x", F.log("wprice")), "bars")
    t = features.structural(b, ["symbol"], "uid", "x", maxw=24, minw=16, lags=2, h=1.0, d=0.56, weights=128)
    t = b.join(t, ["symbol", "uid"]).withColumns({"stdev": F.col("sigma"), "span": F.col("emsc") - F.col("smsc")})
    w = Window.partitionBy("symbol").orderBy("uid")
    t = t.withColumns({"dspan": F.col("span") - F.lag("span").over(w), "dnticks": F.col("nticks") - F.lag("nticks").over(w)})
    v = features.event_vectors(t, _labels(spark, d, b).withColumn("sltp", F.lit(2.0)), features.BAR_FEATURES, 4, ["side", "sltp", "vertbar"], 24)
    return shape(v.withColumns({"size": F.size("x"), "first": F.get("x", 0), "second": F.get("x", 1), "last": F.element_at("x", -1)}), "twhen vertbar size inf_start inf_end", "first second last", "symbol")


MOTIFS = RETURNS + """, w AS (SELECT symbol, uid, list(ret) OVER (PARTITION BY symbol ORDER BY uid ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS x FROM returns WHERE ret IS NOT NULL),
  m AS (SELECT * FROM w WHERE len(x) = 8),
  p AS (SELECT a.symbol, a.uid, b.uid AS other, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM m a JOIN m b ON a.symbol = b.symbol AND abs(a.uid - b.uid) >= 4)"""


@query("i7_motifs", sql(MOTIFS, "SELECT symbol, uid, other, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol, uid ORDER BY distance, other) AS rank FROM p) WHERE rank <= 3", "uid rank other", "distance", "symbol"))
def i7_motifs(spark, d):
    """The three nearest of all windows of eight returns, for each of them, four bars away or more."""
    b = stored(_volatile(spark, d), "bars").where("ret IS NOT NULL")
    w = Window.partitionBy("symbol").orderBy("uid").rowsBetween(-7, 0)
    x = b.select("symbol", F.col("uid").alias("id"), F.collect_list("ret").over(w).alias("x")).where("size(x) = 8")
    return shape(motifs.nearest(x, ["symbol"], 3, 4).withColumnRenamed("id", "uid"), "uid rank other", "distance", "symbol")


@query("j10_boundaries")
def j10_boundaries(spark, d):
    """Where the components of each symbol's mixtures of prices meet, and how well the mixtures fit."""
    m = stored(mixtures.fit(market.deals(spark, d), ["symbol"], "last", [2, 3], 5.0, 8), "mixtures")
    b = mixtures.boundaries(m, ["symbol"]).join(m.select("symbol", "k", "aic", "bic"), ["symbol", "k"])
    return shape(b, "k nth", "boundary aic bic", "symbol")
