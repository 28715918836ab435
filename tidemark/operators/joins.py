"""Ordered look-ups, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import matched, row_number


def as_of(left: DataFrame, right: DataFrame, on: str, value: list[str], keys: list[str], forward: bool = False, chunk: Column | None = None) -> DataFrame:
    """Each left row with the right row of the same keys that is the last at or before ``on`` (the first at or after it, if
    forward). One union and one window: no pair of rows is ever made. Ties on the right: the smallest values first, the last
    of them counts backward, the first forward. With ``chunk`` (of ``on``, which it must not decrease along) windows run within
    chunks, and what the chunks before (after) have is carried over from a table with one row per chunk. Null keys are equal, and
    rows whose ``on`` is null stand before all others, with or without chunks."""
    mark = F.struct(*(F.col(v) for v in value))
    cols = [c for c in left.columns if c not in [*keys, on]]
    a = left.select(*keys, on, F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(mark.alias("m")).schema["m"].dataType).alias("_r"), F.lit(1 if not forward else 0).alias("_side"))
    b = right.select(*keys, on, F.lit(None).cast(left.select(F.struct(*cols).alias("m")).schema["m"].dataType).alias("_l"), mark.alias("_r"), F.lit(0 if not forward else 1).alias("_side"))
    both = a.unionByName(b).withColumn("_chunk", F.lit(0) if chunk is None else chunk)
    # forward is backward in the opposite order: a frame that ends with the partition is run through anew for every row
    along = [F.desc(c) if forward else F.asc(c) for c in (on, "_side", "_r")]
    w = Window.partitionBy(*keys, "_chunk").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    if chunk is not None:
        of = F.when(F.col("_r").isNotNull(), F.struct(on, "_r"))
        ends = both.groupBy(*keys, "_chunk").agg((F.min(of) if forward else F.max(of)).getField("_r").alias("_e"))
        near = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if forward else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_chunk", F.last("_e", ignorenulls=True).over(near).alias("_e"))
        out = matched(out, ends, [*keys, "_chunk"]).withColumn("_r", F.coalesce("_r", "_e"))
    return out.select(*keys, on, "_l.*", *(F.col(f"_r.{v}").alias(v) for v in value))


def following(events: DataFrame, rows: DataFrame, at: str, number: str, reach: int, keys: list[str]) -> DataFrame:
    """Pairs of an event and the rows numbered ``at`` to ``at + reach``, as an equi-join on buckets of ``reach + 1`` numbers."""
    size = reach + 1
    e = events.withColumn("_b", F.explode(F.array(F.floor(F.col(at) / size), F.floor(F.col(at) / size) + 1)))
    r = rows.withColumn("_b", F.floor(F.col(number) / size))
    return e.join(r, [*keys, "_b"]).where((F.col(number) >= F.col(at)) & (F.col(number) <= F.col(at) + reach)).drop("_b")


def contained(part: DataFrame, whole: DataFrame, cols: list[str], order: str, keys: list[str], chunk: Column) -> DataFrame:
    """(keys, contained): whether ``part`` is a contiguous run of ``whole`` from the first record with part's first order value.
    Both are numbered chunk by chunk (``chunk`` must not decrease along ``order``) and compared number by number."""
    first = part.groupBy(*keys).agg(F.min(order).alias("_o"))
    start = whole.join(first, keys).where(F.col(order) >= F.col("_o")).drop("_o")
    a, b = (row_number(t.select(*keys, order, *cols), "_n", keys, [order, *cols], chunk).select(*keys, "_n", F.struct(order, *cols).alias(n)) for t, n in ((part, "_a"), (start, "_b")))
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return a.join(b, [*keys, "_n"], "left").groupBy(*keys).agg(F.bool_and(same).alias("contained"))


def overlap_purge(train: DataFrame, test_spans: DataFrame, start: str = "inf_start", end: str = "inf_end", embargo: int = 0) -> DataFrame:
    """Train rows, for each fold of (fold, lo, hi), that lie wholly before or wholly after the fold's span. The spans are one
    row per fold, so they may be broadcast."""
    spans = F.broadcast(test_spans)
    return train.join(spans, (F.col(end) < F.col("lo")) | (F.col(start) > F.col("hi") + embargo))
