"""State machines along series that may be too long for one task.

Where a block of a series ends depends on the state it began with. Blocks run at once, each from a guess: the state that the
last rows of the block before lead to. A table with one row per block then says which guesses were wrong; only those blocks run
again, until all begin where their predecessor ended. Machines that forget (a sum that is reset, say) need a round or two. One that
never forgets needs as many rounds as it has blocks, as if they ran one after the other, and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import matched, overlapping, row_number
from .scratch import stored

BLOCK = 50_000  #: rows
WARM = 500  #: rows of the block before from which a start is guessed


def scanned(df: DataFrame, keys: list[str], order: str, inputs: list[str], outputs: dict[str, str], start: list[float], run: Callable, chunk: Column | None = None, block: int | None = None, warm: int | None = None) -> DataFrame:
    """(keys, order, outputs). ``run(first, state, *inputs)`` goes from row ``first`` on with the state before it, and returns the
    outputs of those rows as a list of arrays and the state after them; it sees the row before ``first`` if there is one. The first
    row of a series comes with ``start``. ``chunk`` must not decrease along ``order``; by default order is a number."""
    block, warm = block or BLOCK, warm or WARM
    chunk = F.floor(F.col(order) / BLOCK) if chunk is None else chunk
    numbered = row_number(df.select(*keys, order, *(F.col(c).cast("double").alias(c) for c in inputs), chunk.alias("_by")), "_k", keys, [order], F.col("_by"))
    rows = stored(overlapping(numbered, "_k", block, warm), "blocks")
    by = [*keys, "block"]
    ids = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    ends_schema = ", ".join([*ids, "block long, begun array<double>, ended array<double>"])

    def taken(t: pd.DataFrame) -> tuple[int, list[np.ndarray], pd.DataFrame]:
        t = t.sort_values("_k", kind="stable")
        return int(t["warmup"].sum()), [t[c].to_numpy(dtype=float, na_value=np.nan) for c in inputs], t

    def ended(t: pd.DataFrame, state: list[float], first: int, x: list) -> pd.DataFrame:
        after = run(first, state, *x)[1]
        return t[by].iloc[:1].assign(begun=[list(map(float, state))], ended=[list(map(float, after))])

    def guess(t: pd.DataFrame) -> pd.DataFrame:
        first, x, t = taken(t)
        return ended(t, run(0, start, *(v[:first] for v in x))[1] if first else start, first, x)

    def again(t: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if t.empty or known.empty:
            return pd.DataFrame(columns=[*by, "begun", "ended"])
        first, x, t = taken(t)
        return ended(t, known["begun"].iloc[0].tolist(), first, x)

    ends = stored(rows.groupBy(*by).applyInPandas(guess, ends_schema), "ends")
    near = Window.partitionBy(*keys).orderBy("block")  # one row per block
    while True:
        wanted = ends.withColumn("due", F.coalesce(F.lag("ended").over(near), F.array(*map(F.lit, start))))
        wrong = stored(wanted.where("due <> begun").select(*by, F.col("due").alias("begun")), "wrong")
        if wrong.isEmpty():
            break
        redone = matched(rows, wrong.select(*by), by, "left_semi").groupBy(*by).cogroup(wrong.groupBy(*by)).applyInPandas(again, ends_schema)
        ends = stored(matched(ends, wrong.select(*by), by, "left_anti").unionByName(redone), "ends")

    def final(t: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        first, x, t = taken(t)
        found, _ = run(first, known["begun"].iloc[0].tolist(), *x)
        out = t[[*keys, order]].iloc[first:].copy()
        for (name, kind), v in zip(outputs.items(), found):
            v = pd.Series(v, index=out.index)
            out[name] = v.astype("Int64") if kind in ("long", "int") else v.astype(object).where(v.notna(), None)
        return out

    schema = ", ".join([*ids, f"`{order}` {df.schema[order].dataType.simpleString()}", *(f"{n} {t}" for n, t in outputs.items())])
    return rows.groupBy(*by).cogroup(ends.groupBy(*by)).applyInPandas(final, schema)
