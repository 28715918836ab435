"""Binary, text and spreadsheet files of the trading terminal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import packed

# Fixed layouts, little-endian and packed.
TICK = np.dtype([("time", "<i8"), ("bid", "<f8"), ("ask", "<f8"), ("last", "<f8"), ("volume", "<i8"), ("time_msc", "<i8"), ("flags", "<i4"), ("volume_real", "<f8")])
BAR = np.dtype([("time", "<i8"), ("open", "<f8"), ("high", "<f8"), ("low", "<f8"), ("close", "<f8"), ("tick_volume", "<i8"), ("spread", "<i4"), ("real_volume", "<i8")])
VALUE_BAR = np.dtype([("bid", "<f8"), ("ask", "<f8"), ("last", "<f8"), ("msc", "<i8")])
SIGNAL = np.dtype([("time", "<u8"), ("quantity", "<i4")])


def read_packed(spark: SparkSession, path: str, kind: np.dtype, symbol: str = r"([A-Za-z0-9$]+?)_?[^/_]*$", first: int | None = None, columns: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Records of all files of a folder or glob, each with its file's symbol (first group of the pattern on the file name) and its number
    within its series. Files are read by ranges of records. columns: only these; first: so many records of each series; symbols: files of others
    are not opened."""
    spark.dataSource.register(packed.Packed)
    reader = spark.read.format("packed").options(layout=packed.layout(kind), symbol=symbol, **({} if first is None else {"first": first}), **({} if symbols is None else {"symbols": "\n".join(symbols)}))
    if columns:
        whole = packed.Packed({"layout": packed.layout(kind)}).schema()
        reader = reader.schema(StructType([whole[c] for c in columns]))
    return reader.load(path)


def write_packed(df: DataFrame, kind: np.dtype, path: str, name: str, order: list[str], mode: str = "append") -> None:
    """Write records in the packed layout to ``path``. The column ``name`` names a record's series, whose records are written in order:
    by several tasks, into as many files, where there are many. All of a write becomes visible at its end, or nothing. Values must
    not be null."""
    df.sparkSession.dataSource.register(packed.Packed)
    rows = df.select(name, *dict.fromkeys([*kind.names, *order])).repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    rows.select(name, *kind.names).write.format("packed").options(layout=packed.layout(kind)).mode(mode).save(path)


def read_tick_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ticks with the date and the time in two columns."""
    raw = spark.read.csv(path, sep="\t", header=True, schema="date string, clock string, bid double, ask double, last double, volume long, flags int")
    return raw.select(F.to_timestamp(F.concat_ws(" ", "date", "clock"), "yyyy.MM.dd HH:mm:ss.SSS").alias("time"), "bid", "ask", "last", "volume", "flags")


def read_bar_csv(spark: SparkSession, path: str, sep: str = "\t", nulls=("null", "0")) -> DataFrame:
    """Bars with several tokens for a missing value."""
    raw = spark.read.csv(path, sep=sep, header=True)
    return raw.select(*(F.when(~F.col(c).isin(*nulls), F.col(c)).alias(c) for c in raw.columns))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars as write_bar_csv() writes them, with their time."""
    b = read_bar_csv(spark, path, nulls=("null",))
    t = F.to_timestamp(F.concat_ws(" ", F.col("<DATE>"), F.col("<TIME>")), "yyyy.MM.dd HH:mm:ss")
    return b.select(t.alias("time"), *(F.col(f"<{c.upper()}>").cast("double").alias(c) for c in ("open", "high", "low", "close")), F.col("<VOLUME>").cast("long").alias("volume"))


def write_tick_csv(ticks: DataFrame, path: str) -> None:
    t = ticks.select(F.date_format("time", "yyyy.MM.dd").alias("<DATE>"), F.date_format("time", "HH:mm:ss.SSS").alias("<TIME>"), F.col("bid").alias("<BID>"), F.col("ask").alias("<ASK>"), F.col("last").alias("<LAST>"), F.col("volume").alias("<VOLUME>"))
    t.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_bar_csv(bars: DataFrame, path: str) -> None:
    b = bars.select(F.date_format("time", "yyyy.MM.dd").alias("<DATE>"), F.date_format("time", "HH:mm:ss").alias("<TIME>"), *(F.col(c).alias(f"<{c.upper()}>") for c in ("open", "high", "low", "close", "volume")))
    b.write.mode("overwrite").csv(path, sep="\t", header=True)


def parse_grid(lines: DataFrame) -> DataFrame:
    """(name, default, min, step, max, use) of lines ``name=default||min||step||max||use``; comments and other lines go."""
    v = F.split(F.regexp_extract("value", r"^[^=]+=(.*)$", 1), r"\|\|")
    out = lines.where(F.col("value").rlike(r"^[^;=][^=]*=") & (F.size(v) == 5))
    return out.select(F.trim(F.regexp_extract("value", r"^([^=]+)=", 1)).alias("name"), *(v[i].cast("double").alias(n) for i, n in enumerate(("default", "min", "step", "max"))), (v[4] == "Y").alias("use"))


def grid_values(grid: DataFrame) -> DataFrame:
    """(name, value) of every value of each parameter in use."""
    n = F.floor((F.col("max") - F.col("min")) / F.col("step") + 1e-9)
    return grid.where("use AND step > 0").select("name", "min", "step", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("k")).selectExpr("name", "min + k * step AS value")


def write_grid(grid: DataFrame, path: str) -> None:
    num = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    line = F.concat(F.col("name"), F.lit("="), F.concat_ws("||", num("default"), num("min"), num("step"), num("max"), F.when(F.col("use"), "Y").otherwise("N")))
    grid.select(line.alias("value")).write.mode("overwrite").option("encoding", "UTF-16").csv(path, quote="")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Parameters as write_grid() writes them."""
    return parse_grid(spark.read.options(encoding="UTF-16", multiLine=True).csv(path, sep="\x01", quote="", schema="value string"))


def read_optimizations(spark: SparkSession, path: str) -> DataFrame:
    """All reports under a path or glob, whose names are ``optEXPERT_SYMBOL_KIND.xml``: (symbol, expert, forward, name, row, value) for each
    cell, named by the report's first row; forward: KIND speaks of a forward test."""
    r = read_report(spark, path).withColumn("at", F.monotonically_increasing_id())
    first = r.groupBy("file").agg(F.min_by("cells", "at").alias("names"), F.min("at").alias("top"))  # one row per report
    part = F.split(F.regexp_replace("file", r"\.xml$", ""), "_")
    d = r.join(first, "file").where("at > top").withColumn("row", (F.col("at") - F.col("top")).cast("long"))
    d = d.select(part[1].alias("symbol"), F.regexp_replace(part[0], "^opt", "").alias("expert"), part[2].contains("forward").alias("forward"), "row", F.explode(F.arrays_zip("names", "cells")).alias("c"))
    return d.select("symbol", "expert", "forward", F.col("c.names").alias("name"), "row", F.col("c.cells").alias("value"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SpreadsheetML optimizer reports: one array of cell texts per row, with the file's name."""
    rows = spark.read.format("xml").option("rowTag", "Row").schema("Cell array<struct<Data:string>>").load(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.transform("Cell", lambda c: c["Data"]).alias("cells"))


def renamed(spark: SparkSession, path: str, name: str) -> str:
    """Give the one part file of a folder a name, as the terminal's files have them, and return its path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")]
    target = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
    store.rename(parts[0], target)
    return target.toString()
