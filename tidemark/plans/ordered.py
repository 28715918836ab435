"""Ordered work on series that may be too long for one task.

``Window.partitionBy("symbol")`` sends a symbol to one task. These helpers cut each series into chunks first (by day, say),
work within chunks, and carry totals over from a table with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal; without keys every row of ``right``, which must be one, belongs to every other."""
    if not keys:
        return left.crossJoin(right)
    names = {k: f"_same_{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    same = [left[k].eqNullSafe(right[n]) for k, n in names.items()]
    return left.join(right, same, how).drop(*names.values())


def running_sum(df: DataFrame, value: Column, out: str, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Adds ``out``: the sum of ``value`` from the start of the series up to and including the row.

    ``chunk`` must not decrease along ``order``. The only shuffle of rows is by (keys, chunk). Rows with null keys are a series
    like others, and rows whose order, and so whose chunk, is null come first.
    """
    df = df.withColumn("_v", value).withColumn("_chunk", chunk)
    totals = df.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_before", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(*keys, "_chunk", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return matched(df.withColumn("_in", inside), before, [*keys, "_chunk"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_v", "_chunk", "_in", "_before")


def row_number(df: DataFrame, out: str, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Adds ``out``: 1, 2, ... along each series, as running_sum() counts."""
    return running_sum(df, F.lit(1).cast("long"), out, keys, order, chunk)


def overlapping(df: DataFrame, number: str, size: int, back: int, ahead: int = 0) -> DataFrame:
    """Blocks of ``size`` numbered rows, each with the ``back`` rows before it and the ``ahead`` rows after it, so that windows of so many
    rows to either side are whole within (keys, block). Adds block and warmup (true for rows that only serve as history or outlook)."""
    own = F.floor((F.col(number) - 1) / size)
    first = F.greatest(F.floor((F.col(number) - 1 - ahead) / size), F.lit(0)) if ahead else own
    last = F.floor((F.col(number) - 1 + back) / size)
    spread = df.withColumn("_own", own).withColumn("block", F.explode(F.sequence(first, last)))
    return spread.withColumn("warmup", F.col("block") != F.col("_own")).drop("_own")


def windowed(df: DataFrame, keys: list[str], order: list[str], chunk: Column, history: int, add, block: int = 100_000, ahead: int = 0) -> DataFrame:
    """``add(rows, window)`` for long series: rows are numbered and cut into blocks that begin with the ``history`` rows before
    them and end with the ``ahead`` rows after them, and the window runs within a block. Right for columns of which a row's value needs
    no more than those rows, or none where there are fewer."""
    cut = overlapping(row_number(df, "_k", keys, order, chunk), "_k", block, history, ahead)
    return add(cut, Window.partitionBy(*keys, "block").orderBy("_k")).where("NOT warmup").drop("_k", "block", "warmup")


def last_known(df: DataFrame, values: dict[str, Column], keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Adds, for each of ``values``, its last value that is not null up to and including the row. ``chunk`` must not decrease along
    ``order``; what the chunks before leave is carried over from one row per chunk."""
    d = df.withColumns({f"_v_{n}": v for n, v in values.items()}).withColumn("_chunk", chunk)
    ends = d.groupBy(*keys, "_chunk").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_e_{n}") for n in values))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_chunk", *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_e_{n}") for n in values))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = matched(d, ends, [*keys, "_chunk"])
    return d.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), f"_e_{n}") for n in values}).drop("_chunk", *(f"_{x}_{n}" for n in values for x in "ve"))
