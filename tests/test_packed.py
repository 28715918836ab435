"""Packed record files: ranges, columns, first records, appends, tasks that fail."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, packed


def records(spark, n=5000, names=("a_1", "b_1")):
    return spark.range(n).select(F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("name"), F.col("id").alias("time"), (F.col("id") % 7).cast("int").alias("quantity"))


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    a = np.zeros(300_000, dtype=files.TICK)
    a["time_msc"], a["last"] = np.arange(300_000), np.arange(300_000) / 8
    a.tofile(tmp_path / "WIN_x.bin")
    df = files.read_packed(spark, str(tmp_path), files.TICK)
    small = spark.read.format("packed").options(layout=packed.layout(files.TICK), records=20_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 1 and small.rdd.getNumPartitions() == 15
    assert tuple(small.agg(F.count("*"), F.sum("time_msc"), F.sum("last"), F.min("symbol"), F.max(F.abs(F.col("seq") - F.col("time_msc")))).first()) == (300_000, 44999850000, 44999850000 / 8, "WIN", 0)
    assert df.schema["flags"].dataType.simpleString() == "int"


def test_columns_and_first_records(spark, tmp_path):
    files.write_packed(records(spark), files.SIGNAL, str(tmp_path), "name", ["time"])
    df = files.read_packed(spark, str(tmp_path), files.SIGNAL, first=10, columns=["symbol", "quantity"])
    assert df.columns == ["symbol", "quantity"]
    assert sorted(map(tuple, df.collect())) == sorted((s, k % 7) for s, at in (("a", 0), ("b", 1)) for k in range(at, 20, 2))


def test_write_read_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for _ in range(2):
        files.write_packed(records(spark), files.SIGNAL, path, "name", ["time"])
    df = files.read_packed(spark, path, files.SIGNAL)
    got = df.orderBy("symbol", "seq").collect()
    assert [(r["symbol"], r["seq"], r["time"], r["quantity"]) for r in got] == [(s, k, (2 * k + at) % 5000, ((2 * k + at) % 5000) % 7) for s, at in (("a", 0), ("b", 1)) for k in range(5000)]
    assert len(os.listdir(path)) >= 8 and not [f for f in os.listdir(path) if f.startswith("_")]  # a series is written by several tasks
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files.write_packed(records(spark, 10), files.SIGNAL, path, "name", ["time"], "overwrite")
    assert files.read_packed(spark, path, files.SIGNAL).count() == 10


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="no file name"):
        files.write_packed(records(spark, 50, ("a_1", "b/1")), files.SIGNAL, path, "name", ["time"])
    assert [f for f in (os.listdir(path) if os.path.isdir(path) else []) if not f.startswith("_")] == []


def test_files_of_other_symbols_stay_shut(spark, tmp_path):
    files.write_packed(records(spark), files.SIGNAL, str(tmp_path), "name", ["time"])
    for f in os.listdir(tmp_path):
        if f.startswith("b_"):
            os.truncate(tmp_path / f, 7)
    reader = packed.Packed({"layout": packed.layout(files.SIGNAL), "path": str(tmp_path), "symbols": "a\nc"})
    assert {p.symbol for p in reader.reader(reader.schema()).partitions()} == {"a"}
    assert files.read_packed(spark, str(tmp_path), files.SIGNAL, symbols=["a"]).count() == 2500


def test_no_files(spark, tmp_path):
    assert files.read_packed(spark, str(tmp_path / "none"), files.TICK).collect() == []
