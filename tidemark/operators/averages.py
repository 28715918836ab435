"""Recursive averages over series of any length.

Each is a chain of steps s + share (value - s), whose parts are column expressions. Such steps compose, so series are cut into
blocks of numbered rows: every block is a task of its own that starts from nothing and returns one row, a table of those carries
the averages over, and every block runs once more from what stood before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import recursive
from ..plans.ordered import row_number, running_sum
from ..plans.scratch import stored

BLOCK = 50_000  #: rows


def _scan(share: np.ndarray, value: np.ndarray, more: np.ndarray, s: np.ndarray) -> np.ndarray:
    """s + share (value - s) + more down the rows of each column, from s, in this order of operations."""
    if s.size > 12:
        out = np.empty(value.shape)
        for i in range(len(out)):
            s = out[i] = s + share[i] * (value[i] - s) + more[i]
        return out

    def step(s: float, now: tuple) -> float:
        return s + now[0] * (now[1] - s) + now[2]

    columns = zip(share.T.tolist(), value.T.tolist(), more.T.tolist(), s.tolist())
    return np.array([list(accumulate(zip(c, v, m), step, initial=s))[1:] for c, v, m, s in columns]).T.reshape(value.shape)


def affine(df: DataFrame, keys: list[str], number: str, steps: dict[str, tuple[Column, Column, Column]], block: int = BLOCK) -> DataFrame:
    """Adds a column for each of ``steps`` (name to share, value and more): s becomes s + share (value - s) + more along each series, from
    0. Rows are numbered from 1; those that share a number come one after the other, those that change nothing last. The three must
    not be null; null keys are a series like others.

    A first pass returns one row for each block (the end of its steps and the product of what they leave of s), the second runs the
    blocks again from what was carried over. All columns share the passes."""
    names, columns = list(steps), df.columns
    parts = ["_p0", "_p1", "_p2"]
    d = df.withColumn("_block", F.floor((F.col(number) - 1) / block))
    d = d.withColumns({p: F.array(*(t[i].cast("double") for t in steps.values())) for i, p in enumerate(parts)})
    ids = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    by = [*keys, "_block"]

    def coefficients(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        c, v, m = (t.column(p).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for p in parts)
        order = np.lexsort((((c == 0) & (m == 0)).all(axis=1), t.column(number).to_numpy()))
        return order, [x[order] for x in (c, v, m)]

    def end(t: pa.Table) -> pa.Table:
        _, found = coefficients(t)
        ends = [_scan(*found, np.zeros(len(names)))[-1], np.multiply.reduce(1 - found[0], axis=0)]
        return pa.table([*(t.column(k).slice(0, 1) for k in by), *(pa.array([e.tolist()], pa.list_(pa.float64())) for e in ends)], [*by, "_z", "_p"])

    ends = d.select(*by, number, *parts).groupBy(*by).applyInArrow(end, ", ".join([*ids, "_block long, _z array<double>, _p array<double>"]))

    def carry(rows: pd.DataFrame) -> pd.DataFrame:  # one row per block
        rows = rows.sort_values("_block")
        before, s = [], np.zeros(len(names))
        for z, p in zip(rows["_z"], rows["_p"]):
            before.append(s)
            s = z + p * s
        return rows[by].assign(_c=before)

    carried = ends.groupBy(*keys).applyInPandas(carry, ", ".join([*ids, "_block long, _c array<double>"]))
    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])

    def run(t: pa.Table, start: pa.Table) -> pa.Table:
        order, found = coefficients(t)
        z = _scan(*found, np.array(start.column("_c")[0].as_py()))
        return pa.table([*(c.take(order) for c in t.select(columns).columns), *(pa.array(c) for c in z.T.copy())], [*columns, *names])

    return d.groupBy(*by).cogroup(carried.groupBy(*by)).applyInArrow(run, schema)


def smoothed(df: DataFrame, keys: list[str], number: str, averages: dict[str, tuple[str, int, float, int]]) -> DataFrame:
    """Adds averages with a fixed share of each new value, name to (column, n, share, first): the column begins with number
    ``first``; the average is seeded with the mean of its first n values and null before there are so many. Where a value is null
    the average stays as it was; number rows so that such rows have their predecessor's number, as ema() does, or a null among the
    first n counts as 0."""
    k, steps = F.col(number), {}
    for out, (c, n, share, first) in averages.items():
        x, at = F.coalesce(F.col(c).cast("double"), F.lit(0.0)), first + n - 1
        seen = F.col(c).isNotNull() & (k >= first)
        steps[f"_s_{out}"] = F.when(seen & (k > at), F.lit(share)).otherwise(0.0), x, F.when(seen & (k <= at), x / n).otherwise(0.0)
    d = affine(df, keys, number, steps)
    return d.withColumns({out: F.when(k >= first + n - 1, F.col(f"_s_{out}")) for out, (_, n, _, first) in averages.items()}).drop(*steps)


def _numbered(df: DataFrame, keys: list[str], order: str, col: str, chunk: Column | None) -> DataFrame:
    """Adds _x, the value, and _k, the number of values up to the row: a null value has its predecessor's."""
    chunk = F.floor(F.col(order) / BLOCK) if chunk is None else chunk
    d = df.withColumn("_x", F.col(col).cast("double"))
    return stored(running_sum(d, F.col("_x").isNotNull().cast("long"), "_k", keys, [order], chunk), "numbered")


def ema(df: DataFrame, keys: list[str], order: str, col: str, n: int, out: str = "ema", alpha: float | None = None, chunk: Column | None = None) -> DataFrame:
    """Adds the exponential average. ``chunk`` must not decrease along ``order`` (row numbers are counted by it); by default order
    is a number and BLOCK of it a chunk. Where a value is null the average stays as it was."""
    d = _numbered(df, keys, order, col, chunk)
    return smoothed(d, keys, "_k", {out: ("_x", n, 2 / (n + 1) if alpha is None else alpha, 1)}).drop("_k", "_x")


def _chain(df: DataFrame, keys: list[str], n: int, times: int) -> DataFrame:
    for i in range(1, times + 1):
        df = stored(smoothed(df, keys, "_k", {f"_e{i}": ("_x" if i == 1 else f"_e{i - 1}", n, 2 / (n + 1), 1 + (i - 1) * (n - 1))}), "averages")
    return df


def multiples(df: DataFrame, keys: list[str], order: str, col: str, n: int, chunk: Column | None = None) -> DataFrame:
    """Adds dema and tema, the double and the triple exponential average."""
    d = _chain(_numbered(df, keys, order, col, chunk), keys, n, 3)
    return d.withColumns({"dema": 2 * F.col("_e1") - F.col("_e2"), "tema": 3 * F.col("_e1") - 3 * F.col("_e2") + F.col("_e3")}).drop("_k", "_x", "_e1", "_e2", "_e3")


def t3(df: DataFrame, keys: list[str], order: str, col: str, n: int, v: float = 0.7, out: str = "t3", chunk: Column | None = None) -> DataFrame:
    """Six chained averages, combined."""
    d = _chain(_numbered(df, keys, order, col, chunk), keys, n, 6)
    e3, e4, e5, e6 = (F.col(f"_e{i}") for i in range(3, 7))
    value = -(v**3) * e6 + (3 * v**2 + 3 * v**3) * e5 + (-6 * v**2 - 3 * v - 3 * v**3) * e4 + (1 + 3 * v + v**3 + 3 * v**2) * e3
    return d.withColumn(out, value).drop("_k", "_x", *(f"_e{i}" for i in range(1, 7)))


def kama(df: DataFrame, keys: list[str], order: str, col: str, n: int, out: str = "kama", chunk: Column | None = None) -> DataFrame:
    """Kaufman's adaptive average: the share of a new value follows how straight the last n moves were (fast 2, slow 30)."""
    w = Window.partitionBy(*keys).orderBy("_k")
    d = _numbered(df, keys, order, col, chunk).withColumn("_d", F.abs(F.col("_x") - F.lag("_x").over(w)))
    way, path = F.abs(F.col("_x") - F.lag("_x", n).over(w)), F.sum("_d").over(w.rowsBetween(-(n - 1), 0))
    share = F.pow(F.coalesce(F.try_divide(way, path), F.lit(1.0)) * (2 / 3 - 2 / 31) + 2 / 31, F.lit(2))
    d = d.withColumn("_c", F.when(F.col("_x").isNull(), 0.0).when(F.col("_k") > n, F.coalesce(share, F.lit(0.0))).when(F.col("_k") == n, 1.0).otherwise(0.0))
    d = affine(stored(d, "shares"), keys, "_k", {"_s": (F.col("_c"), F.coalesce("_x", F.lit(0.0)), F.lit(0.0))})
    return d.withColumn(out, F.when(F.col("_k") > n, F.col("_s"))).drop("_k", "_x", "_d", "_c", "_s")


def _pair(f: str, l: str, col: str, fast: int, slow: int) -> dict[str, tuple[str, int, float, int]]:
    return {f: (col, fast, 2 / (fast + 1), slow - fast + 1), l: (col, slow, 2 / (slow + 1), 1)}


def macd(df: DataFrame, keys: list[str], order: str, col: str, fast: int, slow: int, out: str = "macd", chunk: Column | None = None) -> DataFrame:
    """Fast less slow average. The fast one is seeded with the mean of the values that end where the slow one begins."""
    d = smoothed(_numbered(df, keys, order, col, chunk), keys, "_k", _pair("_f", "_l", "_x", fast, slow))
    return d.withColumn(out, F.col("_f") - F.col("_l")).drop("_k", "_x", "_f", "_l")


def rsi(df: DataFrame, keys: list[str], order: str, col: str, n: int, out: str = "rsi", chunk: Column | None = None) -> DataFrame:
    """Relative strength with Wilder's smoothing; 0 where nothing has moved."""
    move = F.col("_x") - F.lag("_x").over(Window.partitionBy(*keys).orderBy("_k"))
    d = _numbered(df, keys, order, col, chunk).withColumn("_d", move).withColumns({"_gain": F.greatest("_d", F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))})
    d = smoothed(d, keys, "_k", {"_u": ("_gain", n, 1 / n, 2), "_v": ("_loss", n, 1 / n, 2)})
    return d.withColumn(out, strength(F.col("_u"), F.col("_v"))).drop("_k", "_x", "_d", "_gain", "_loss", "_u", "_v")


def strength(up: Column, down: Column) -> Column:
    return F.when(up + down > 0, 100 * up / (up + down)).when(up.isNotNull(), 0.0)


def grid(df: DataFrame, keys: list[str], order: str, cols: list[str], window: int = 20, count: int = 3, chunk: Column | None = None) -> DataFrame:
    """Adds, for each column and band (0.5, 1, 1.5, ... times ``window``): dema_ (value less its average), demav_ (the one before by
    this one) and dmacdv_ (the same of the difference of averages of half and three quarters the band's length)."""
    d = stored(row_number(df, "_k", keys, [order], F.floor(F.col(order) / BLOCK) if chunk is None else chunk), "numbered")
    spec = {}
    for c in cols:
        for b in range(count):
            n = int(window * (b + 1) / 2)
            spec[f"_e_{c}{b}"] = c, n, 2 / (n + 1), 1
            spec |= _pair(f"_f_{c}{b}", f"_l_{c}{b}", c, int(n * 0.5), int(n * 0.75))
    d = smoothed(d, keys, "_k", spec)
    w = Window.partitionBy(*keys).orderBy("_k")
    names = [f"{c}{b}" for c in cols for b in range(count)]
    d = d.withColumns({f"dema_{n}": F.col(n[: -len(str(count - 1))]) - F.col(f"_e_{n}") for n in names} | {f"_macd_{n}": F.col(f"_f_{n}") - F.col(f"_l_{n}") for n in names})
    d = d.withColumns({f"{out}_{n}": F.lag(f"{c}_{n}").over(w) / (F.col(f"{c}_{n}") + 1e-8) for n in names for out, c in (("demav", "dema"), ("dmacdv", "_macd"))})
    return d.drop("_k", *spec, *(f"_macd_{n}" for n in names))


def crosses(df: DataFrame, keys: list[str], order: str, col: str, span: int, chunk: Column | None = None) -> DataFrame:
    """Adds ema_2, ema_3 (averages over two and three spans), dema_2, dema_3 (value less those), macd (12, 26), macd_mean (span, two
    spans), macd_double (span, three spans), rsi_2 and rsi_3."""
    w = Window.partitionBy(*keys).orderBy("_k")
    d = _numbered(df, keys, order, col, chunk).withColumn("_d", F.col("_x") - F.lag("_x").over(w))
    d = d.withColumns({"_gain": F.greatest("_d", F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))})
    spec = {f"_a{n}": ("_x", n, 2 / (n + 1), 1) for n in (2 * span, 3 * span)}
    spec |= _pair("_f26", "_l26", "_x", 12, 26) | _pair("_f2", "_l2", "_x", span, 2 * span) | _pair("_f3", "_l3", "_x", span, 3 * span)
    spec |= {f"_{s}{k}": (c, k * span, 1 / (k * span), 2) for k in (2, 3) for s, c in (("u", "_gain"), ("v", "_loss"))}
    d = smoothed(d, keys, "_k", spec)
    a = lambda n: F.col(f"_a{n}")
    d = d.withColumns({
        "ema_2": a(2 * span), "ema_3": a(3 * span), "dema_2": F.col("_x") - a(2 * span), "dema_3": F.col("_x") - a(3 * span),
        "macd": F.col("_f26") - F.col("_l26"), "macd_mean": F.col("_f2") - F.col("_l2"), "macd_double": F.col("_f3") - F.col("_l3"),
        "rsi_2": strength(F.col("_u2"), F.col("_v2")), "rsi_3": strength(F.col("_u3"), F.col("_v3")),
    })
    return d.drop("_k", "_x", "_d", "_gain", "_loss", *spec)


def mama(df: DataFrame, keys: list[str], order: str, col: str, fast: float = 0.5, slow: float = 0.05) -> DataFrame:
    """(keys, order, mama, fama): Ehlers' adaptive averages, whose share of a new value follows the phase of the dominant cycle.
    Its phase feeds back into itself, so that a series is one task, which holds one batch of its rows at a time."""
    from .backtest import _runs

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, order]), "mama double, fama double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = average = None
        for key, rows in _runs(batches, keys):
            if average is None or key != at:
                at, average = key, recursive.Mama(fast, slow)
            found = average.run(rows[col].to_numpy(dtype=float, na_value=np.nan))
            yield rows[[*keys, order]].assign(**{name: pd.Series(v, index=rows.index).astype(object).where(~np.isnan(v), None) for name, v in zip(("mama", "fama"), found)})

    return df.select(*keys, order, col).repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_last(order)).mapInPandas(run, schema)
