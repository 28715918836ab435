"""Streams over several files, one micro-batch each: state is carried over, and the whole equals the batch."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, indicators
from tidemark.sources import market
from tidemark.streaming import live

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arriving"))
    for k in range(4):
        spark.read.parquet(f"{DIR}/events.parquet").where(f"event_id >= {k * 250} AND event_id < {(k + 1) * 250}").coalesce(1).write.mode("append").parquet(path)
    return path


def drained(spark, stream, tmp_path):
    live.drain(stream, f"{tmp_path}/at", f"{tmp_path}/out")
    return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")


def test_value_bars(spark, arriving, tmp_path):
    out = drained(spark, live.value_bar_stream(live.tick_stream(spark, arriving), 2_000_000), tmp_path)
    want = bars.value_bars(market.deals(spark, DIR), 2_000_000)
    cols = ["symbol", "uid", "nticks"]
    assert sorted(map(tuple, out.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_cusum(spark, arriving, tmp_path):
    out = drained(spark, live.cusum_stream(live.tick_stream(spark, arriving), 200.0), tmp_path)
    want = indicators.cusum(market.deals(spark, DIR), ["symbol"], "seq", "last", 200.0).where("event <> 0")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select("symbol", "seq", "event").collect()))


def test_deduplication_over_batches(spark, arriving, tmp_path):
    again = f"{tmp_path}/twice"
    for _ in range(2):
        spark.read.parquet(f"{DIR}/events.parquet").where("event_id >= 900").coalesce(1).write.mode("append").parquet(again)
    out = drained(spark, live.deduplicated(live.tick_stream(spark, again), late="2 days"), tmp_path)
    assert sorted(r["seq"] for r in out.collect()) == list(range(900, 1000))


def test_daemon_acts_on_large_batches_only(spark, arriving, tmp_path):
    seen = []
    live.act_when_new(live.tick_stream(spark, arriving), f"{tmp_path}/at", lambda batch, number: seen.append(batch.count()), 250)
    live.act_when_new(live.tick_stream(spark, arriving), f"{tmp_path}/at2", lambda batch, number: seen.append(-1), 251)
    assert seen == [250] * 4


def test_late_ticks(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    kind = e.orderBy("event_id").first()["event_type"]
    first = e.where(F.col("event_type") == kind)
    for part in (first.where("event_id > 0"), first.where("event_id = 0")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = drained(spark, live.late_ticks(live.tick_stream(spark, f"{tmp_path}/in")), tmp_path)
    assert tuple(out.agg(F.sum("n"), F.sum("late")).first()) == (first.count(), 1)


def in_files(spark, path, cuts, where="true"):
    e = spark.read.parquet(f"{DIR}/events.parquet").where(where)
    for a, b in zip(cuts, cuts[1:]):
        e.where(f"event_id >= {a} AND event_id < {b}").coalesce(1).write.mode("append").parquet(path)


def labelled(spark, tmp_path, path, **options):
    from tidemark.streaming import chain

    stream = chain.labels(live.tick_stream(spark, path), 200_000, window=5, first=3, step=3, count=3, **options)
    with live.keyed_state(spark):
        return drained(spark, stream, tmp_path)


def batch_labels(spark, events=None):
    from pyspark.sql import Window
    from tidemark.operators import labels

    w = Window.partitionBy("symbol").orderBy("uid")
    b = bars.value_bars(market.deals(spark, DIR), 200_000).withColumn("ret", indicators.bar_return(w))
    b = b.withColumn("sigma", F.when(F.row_number().over(w) >= 6, F.stddev_pop("ret").over(w.rowsBetween(-4, 0)))).cache()
    ev = b.select("symbol", F.col("uid").alias("twhen")) if events is None else indicators.cusum(b, ["symbol"], "uid", "wprice", events).where("event <> 0").select("symbol", F.col("uid").alias("twhen"))
    return b, labels.triple_barrier(ev, b, 2.0, 3, 3, 3)


@pytest.mark.parametrize("h", [None, 30.0])
def test_chain_gives_the_labels_of_the_batch(spark, tmp_path, h):
    """Ticks in three files; the second run goes on from the checkpoint of the first."""
    path = f"{tmp_path}/in"
    in_files(spark, path, [0, 300])
    labelled(spark, tmp_path, path, h=h)
    in_files(spark, path, [300, 650, 1000])
    out = labelled(spark, tmp_path, path, h=h).cache()
    b, want = batch_labels(spark, h)
    got = {tuple(r)[:5]: r["ret"] for r in out.where("kind = 'label'").select("symbol", "uid", "vertbar", "side", "tdone", "ret").collect()}
    want = {tuple(r)[:5]: r["ret"] for r in want.select("symbol", "twhen", "vertbar", "side", "tdone", "ret").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(got) > 50
    cols = ["symbol", "uid", "nticks", "high", "low"]
    assert sorted(map(tuple, out.where("kind = 'bar'").select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_idle_symbols_are_forgotten(spark, tmp_path):
    """One symbol stops after the first file; its state goes once the watermark has passed its last tick by the idle time."""
    path = f"{tmp_path}/in"
    kind = spark.read.parquet(f"{DIR}/events.parquet").first()["event_type"]
    in_files(spark, path, [0, 100])
    in_files(spark, path, [100, 400, 700, 1000], f"event_type <> '{kind}'")
    out = labelled(spark, tmp_path, path, idle="1 hour").where("kind = 'idle'").collect()
    assert kind in {r["symbol"] for r in out}


def test_a_batch_does_not_grow_with_the_ticks(spark):
    """Files of so many ticks each, whole and in order, however many ticks there are."""
    from tidemark.plans import more_queries

    path = more_queries._arriving(spark, DIR, 100)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("t")).agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b")).orderBy("a").collect()
    assert sum(f["n"] for f in files) == 1000 and len(files) >= 8 and max(f["n"] for f in files) <= 200
    assert all(x["b"] < y["a"] and x["t"] < y["t"] for x, y in zip(files, files[1:]))
