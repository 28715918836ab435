"""The live path: the same ticks as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Ticks of the files that arrive at a path; the rate limit bounds a micro-batch. Event time is a timestamp with a zone, as watermarks ask for."""
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(path)
    t = F.col("ts").cast("timestamp")
    return e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), t.alias("time"), F.unix_millis(t).alias("time_msc"), F.col("value").alias("last"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("volume"))


def deduplicated(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each record once, whatever the pulls overlap, with state bounded by the watermark."""
    return ticks.withWatermark("time", late).dropDuplicatesWithinWatermark(["symbol", "seq"])


def late_ticks(ticks: DataFrame) -> DataFrame:
    """(symbol, n, late) of each micro-batch: its ticks, and how many are older than the newest of the batches before, which is the
    state of each symbol."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        n, late, top = 0, 0, newest
        for part in parts:
            t = part["time_msc"]
            n += len(t)
            late += int((t < newest).sum()) if newest is not None else 0
            top = int(t.max()) if top is None else max(top, int(t.max()))
        state.update((top,))
        yield pd.DataFrame({"symbol": [key[0]], "n": [n], "late": [late]})

    return ticks.select("symbol", "time_msc").groupBy("symbol").applyInPandasWithState(step, "symbol string, n long, late long", "newest long", "append", GroupStateTimeout.NoTimeout)


def minute_stream(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    g = ticks.where("volume > 0").withWatermark("time", late).groupBy("symbol", F.window("time", "1 minute").alias("w"))
    return g.agg(F.max("last").alias("high"), F.min("last").alias("low"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("time"), "high", "low", "n")


def session_stream(ticks: DataFrame, gap: str = "12 hours", late: str = "10 minutes") -> DataFrame:
    g = ticks.where("volume > 0").withWatermark("time", late).groupBy("symbol", F.session_window("time", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def value_bar_stream(ticks: DataFrame, size: int) -> DataFrame:
    """Closed value bars (symbol, uid, high, low, nticks), with the open bar of each symbol as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        uid, money, high, low, n = state.get if state.exists else (0, 0, float("-inf"), float("inf"), 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("seq")
        for cents, volume, last in zip(rows["cents"], rows["volume"], rows["last"]):
            money, high, low, n = money + int(cents) * int(volume), max(high, last), min(low, last), n + 1
            done, seen = money // size, n
            for k in range(int(done)):
                out.append((key[0], uid, high, low, seen if k == 0 else 0))
                uid += 1
            if done:
                money, high, low, n = money % size, float("-inf"), float("inf"), 0
        state.update((uid, money, high, low, n))
        yield pd.DataFrame(out, columns=["symbol", "uid", "high", "low", "nticks"])

    return ticks.where("volume > 0").groupBy("symbol").applyInPandasWithState(step, "symbol string, uid long, high double, low double, nticks long", "uid long, money long, high double, low double, n long", "append", GroupStateTimeout.NoTimeout)


def cusum_stream(ticks: DataFrame, h: float) -> DataFrame:
    """(symbol, seq, event) of the symmetric CUSUM filter over deals, its two sums and the last value as state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        has, last, up, down = state.get if state.exists else (False, 0.0, 0.0, 0.0)
        out = []
        for seq, x in pd.concat(list(parts)).sort_values("seq")[["seq", "last"]].itertuples(index=False):
            if has:
                up, down = max(0.0, up + x - last), min(0.0, down + x - last)
                if up > h:
                    out.append((key[0], int(seq), 1))
                    up = 0.0
                elif down < -h:
                    out.append((key[0], int(seq), -1))
                    down = 0.0
            has, last = True, float(x)
        state.update((has, last, up, down))
        yield pd.DataFrame(out, columns=["symbol", "seq", "event"])

    return ticks.where("volume > 0").groupBy("symbol").applyInPandasWithState(step, "symbol string, seq long, event long", "has boolean, last double, up double, down double", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, as list state and timers ask for, for streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> None:
    """Everything there is now, to Parquet, exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def act_when_new(stream: DataFrame, checkpoint: str, act: Callable[[DataFrame, int], None], least: int) -> None:
    """Runs ``act`` on micro-batches of at least ``least`` rows: the daemon's loop."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(least).count() >= least:
            act(batch, number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
