"""Indicators over ordered series: window expressions where they can be, grouped functions for recursions.

Outputs are as long as inputs; values are null until the window is full.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions import recursive
from ..functions.ieee import divided


def _last(by: WindowSpec, n: int) -> WindowSpec:
    return by.rowsBetween(-(n - 1), 0)


def _full(by: WindowSpec, n: int, x: Column) -> Column:
    return F.when(F.row_number().over(by) >= n, x)


def sma(x: Column, n: int, by: WindowSpec) -> Column:
    return _full(by, n, F.avg(x).over(_last(by, n)))


def wma(x: Column, n: int, by: WindowSpec) -> Column:
    """Weights 1 (oldest) to n."""
    total = sum((F.lag(x, k).over(by) if k else x) * (n - k) for k in range(n))
    return _full(by, n, total / (n * (n + 1) / 2))


def trima(df: DataFrame, col: str, n: int, by: WindowSpec, out: str) -> DataFrame:
    """A moving average of a moving average."""
    a, b = ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)
    df = df.withColumn("_m", sma(F.col(col), a, by))
    return df.withColumn(out, _full(by, n, F.avg("_m").over(_last(by, b)))).drop("_m")


def stddev(x: Column, n: int, by: WindowSpec, sample: bool = False) -> Column:
    return _full(by, n, (F.stddev_samp if sample else F.stddev_pop)(x).over(_last(by, n)))


def bands(df: DataFrame, col: str, n: int, devs: float, by: WindowSpec, kind: str = "sma", sample: bool = False) -> DataFrame:
    """Adds up and down: the average plus and minus devs deviations."""
    middle = (sma if kind == "sma" else wma)(F.col(col), n, by)
    s = stddev(F.col(col), n, by, sample)
    return df.withColumns({"up": middle + devs * s, "down": middle - devs * s})


def band_set(df: DataFrame, n: int, devs: float, count: int, by: WindowSpec) -> DataFrame:
    """Bands 0.5, 1, 1.5, ... times n wide on the typical price; one sort serves all."""
    df = df.withColumn("typical", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    cols = {}
    for k in range(count):
        w = int(n * (k + 1) / 2)
        m, s = sma(F.col("typical"), w, by), stddev(F.col("typical"), w, by)
        cols |= {f"up{k}": m + devs * s, f"down{k}": m - devs * s}
    return df.withColumns(cols)


def fracdiff(x: Column, d: float, n: int, by: WindowSpec) -> Column:
    """Fixed-width fractional difference as one array expression per row; for wide windows use series()."""
    w = [float(v) for v in recursive.fracdiff_weights(d, n)[::-1]]
    held = F.collect_list(x).over(_last(by, n))
    return _full(by, n, F.aggregate(F.zip_with(held, F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))


def bar_return(by: WindowSpec) -> Column:
    """Return of a bar against the second extreme of the one before, its own extremes in their order."""
    p2 = F.lag(F.when(F.col("highfirst") == 1, F.col("low")).otherwise(F.col("high"))).over(by)
    c1 = F.when(F.col("highfirst") == 1, F.col("high")).otherwise(F.col("low"))
    c2 = F.when(F.col("highfirst") == 1, F.col("low")).otherwise(F.col("high"))
    o = F.col("open")
    return (0.75 * (divided(o, p2) - 1) + 0.85 * (divided(c1, o) - 1) + (divided(c2, c1) - 1)) / 2.6


def swinging(x: Column, n: int, by: WindowSpec) -> Column:
    """Strictly between 1.01 times the lowest and 0.99 times the highest of the last n."""
    lo, hi = F.min(x).over(_last(by, n)), F.max(x).over(_last(by, n))
    return _full(by, n, ((x > 1.01 * lo) & (x < 0.99 * hi)).cast("int"))


def lookback(cols: list[str], n: int, by: WindowSpec) -> Column:
    """The n rows before this one, flattened oldest first; null unless there are n."""
    held = F.collect_list(F.array(*cols)).over(by.rowsBetween(-n, -1))
    return F.when(F.size(held) == n, F.flatten(held))


def series(df: DataFrame, keys: list[str], order: str, inputs: list[str], outputs: dict[str, str], f: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """A recursion along each series: f gets the inputs as arrays, in order, and returns the outputs ({name: type}).

    A recursion is one task per series by nature; only its columns are sent.
    """
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, order]), *(f"{k} {t}" for k, t in outputs.items())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        found = f(*(rows[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs))
        out = rows[[*keys, order]].copy()
        for k, t in outputs.items():
            v = pd.Series(found[k], index=out.index)
            out[k] = v.astype("Int64") if t in ("long", "int") else v.astype(object).where(v.notna(), None)
        return out

    return df.select(*keys, order, *inputs).groupBy(*keys).applyInPandas(run, schema)


def cusum(df: DataFrame, keys: list[str], order: str, col: str, h: float, valid: str | None = None, chunk: Column | None = None) -> DataFrame:
    """(keys, order, event) of the symmetric CUSUM filter, in blocks of rows whose sums are carried over."""
    from ..plans.scans import scanned

    def run(first: int, state: list[float], x: np.ndarray, v: np.ndarray | None = None) -> tuple[list[np.ndarray], list[float]]:
        before = max(0, first - 1)
        out, up, down = recursive.cusum_from(x[before:], h, None if v is None else v[before:] > 0, *state)
        return [out if first else np.concatenate([np.zeros(min(1, len(x)), np.int64), out])], [up, down]

    return scanned(df, keys, order, [col, valid] if valid else [col], {"event": "long"}, [0.0, 0.0], run, chunk)


def in_blocks(df: DataFrame, keys: list[str], order: str, inputs: list[str], outputs: dict[str, str], history: int, f: Callable[..., dict[str, np.ndarray]], chunk: Column | None = None, block: int = 50_000) -> DataFrame:
    """As series(), for what needs no more than the ``history`` rows before a row: series are cut into blocks of numbered rows that
    begin with them, and every block is a task of its own. ``chunk`` must not decrease along ``order``; by default that is a number."""
    from ..plans.ordered import overlapping, row_number

    chunk = F.floor(F.col(order) / 50_000) if chunk is None else chunk
    numbered = row_number(df.select(*keys, order, *inputs, chunk.alias("_by")), "_n", keys, [order], F.col("_by"))
    blocks = overlapping(numbered, "_n", block, history).withColumn("warmup", F.col("warmup").cast("double"))
    out = series(blocks, [*keys, "block"], order, [*inputs, "warmup"], {**outputs, "_warm": "double"}, lambda *x: {**f(*x[:-1]), "_warm": x[-1]})
    return out.where("_warm = 0").drop("block", "_warm")


def sadf(df: DataFrame, keys: list[str], order: str, col: str, maxw: int, minw: int, lags: int, trend: bool = True, mode: str = "quantile", block: int = 2_000) -> DataFrame:
    """SADF and its spread over windows of maxw to minw + 1 values."""
    f = lambda x: dict(zip(("sadf", "spread"), recursive.sadf(x, maxw, minw, lags, trend, mode)))
    return in_blocks(df, keys, order, [col], {"sadf": "double", "spread": "double"}, maxw - 1, f, block=block)


def long_fracdiff(df: DataFrame, keys: list[str], order: str, col: str, d: float, widths: dict[str, int], chunk: Column | None = None) -> DataFrame:
    """(keys, order, one column for each of ``widths``): fractional differences with hundreds of weights, as convolutions of blocks that
    overlap by the widest. A window that holds a missing value gives none; infinite ones give what they do in a sum, not a number if
    they are of both signs there."""

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        out, missing = {}, np.concatenate([[0], np.cumsum(np.isnan(x))])
        for name, n in widths.items():
            with np.errstate(invalid="ignore"):
                v = recursive.fracdiff(x, d, n)
            whole = np.zeros(len(x), bool)
            whole[n - 1 :] = missing[n:] == missing[: max(0, len(x) - n + 1)]
            out |= {name: v, f"_{name}": np.where(whole & np.isnan(v), 1.0, 0.0)}  # nulls and not-a-numbers are one in pandas
        return out

    found = in_blocks(df, keys, order, [col], dict.fromkeys([x for n in widths for x in (n, f"_{n}")], "double"), max(widths.values()) - 1, run, chunk)
    return found.withColumns({n: F.when(F.col(f"_{n}") == 1, F.lit(float("nan"))).otherwise(F.col(n)) for n in widths}).drop(*(f"_{n}" for n in widths))


def adf(df: DataFrame, keys: list[str], order: str, col: str, lags: int, trend: bool = True) -> DataFrame:
    """(keys, adf): the augmented Dickey-Fuller statistic of each series, which is one task: have keys for parts of long ones."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "adf double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[col].to_numpy(dtype=float)
        value = recursive.adf(x, lags, trend) if len(x) > lags + 1 else np.nan
        return pd.DataFrame({**{k: rows[k].iloc[:1].tolist() for k in keys}, "adf": [None if np.isnan(value) else value]})

    return df.select(*keys, order, col).groupBy(*keys).applyInPandas(run, schema)


def since_start(df: DataFrame, keys: list[str], order: str, col: str, limit: int) -> DataFrame:
    """(keys, order, since): how far ``col``, a whole number that does not fall along ``order`` (numbered 1, 2, ...), is beyond the start
    of its session; the first value more than ``limit`` beyond it starts a new one.

    Where the next session would start is an as-of join for every row. The starts are those that the first row leads to, found by
    doubling: each round joins the steps that are left with themselves, so that n sessions take log2(n) rounds and no series is one task."""
    from ..plans.ordered import matched
    from ..plans.scratch import stored
    from .joins import as_of

    rows = stored(df.select(*keys, F.col(order).cast("long").alias("_k"), F.col(col).cast("long").alias("_x")), "rows")
    due = rows.select(*keys, "_k", (F.col("_x") + limit + 1).alias("_at"))
    there = rows.select(*keys, F.col("_x").alias("_at"), F.col("_k").alias("_to"))
    steps = stored(as_of(due, there, "_at", ["_to"], keys, forward=True, chunk=F.floor(F.col("_at") / (limit + 1))).where("_to IS NOT NULL").select(*keys, "_k", "_to"), "steps")
    starts, known = rows.groupBy(*keys).agg(F.min("_k").alias("_k")), 0
    starts = stored(starts, "starts")
    while (found := starts.count()) > known:
        known = found
        more = matched(starts, steps, [*keys, "_k"]).select(*keys, F.col("_to").alias("_k"))
        starts = stored(starts.unionByName(more).distinct(), "starts")
        # later starts are where a step leads: other rows need no steps, and fewer are left each round
        led = steps.select(*keys, F.col("_to").alias("_k")).unionByName(starts).distinct()
        steps = stored(matched(steps, led, [*keys, "_k"], "left_semi"), "led")
        twice = matched(steps.withColumnsRenamed({"_k": "_from", "_to": "_k"}), steps, [*keys, "_k"])
        steps = stored(twice.select(*keys, F.col("_from").alias("_k"), "_to"), "steps")
    begun = matched(rows, starts, [*keys, "_k"], "left_semi").select(*keys, "_k", F.col("_x").alias("_begun"))
    out = as_of(rows, begun, "_k", ["_begun"], keys, chunk=F.floor(F.col("_k") / 50_000))
    kind = df.schema[order].dataType.simpleString()
    return out.select(*keys, F.col("_k").cast(kind).alias(order), (F.col("_x") - F.col("_begun")).alias("since"))


def periodogram(df: DataFrame, keys: list[str], order: str, col: str) -> DataFrame:
    """Power of each frequency of the linearly detrended series, by one grouped FFT per key."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "frequency double, power double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[col].to_numpy(dtype=float)
        t = np.arange(len(x))
        x = x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x
        p = np.abs(np.fft.rfft(x)) ** 2 / max(1, len(x))
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "frequency": np.fft.rfftfreq(len(x)), "power": p})

    return df.select(*keys, order, col).groupBy(*keys).applyInPandas(run, schema)


def by(*keys: str, order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))
