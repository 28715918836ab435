"""Motifs: the nearest other windows of every window of a series, exactly.

A tree of medians, fitted to a sample, parts the windows into cells of about ``BLOCK``, and within a task into leaves of ``LEAF``. A
window first meets its own cell, which bounds how far its nearest ones can be. Other cells, and the leaves of a cell, are visited only
if the box around their windows is no farther away than the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..plans.ordered import matched
from ..plans.scratch import stored

PIVOTS = 256  #: cells of a series, at most
SAMPLE = 64  #: windows for each of them, from which the tree is made
BLOCK = 16_384  #: windows of a cell that a task holds
STRIPE = BLOCK  #: visitors that meet them in one task, about
LEAF = 256
ROWS = 64  #: guests that are compared with a leaf at once
NONE = np.iinfo(np.int64).max  #: stands for a window where there are fewer than n
SLACK = 1 + 1e-9  #: of squares, for rounding


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _widest(x: np.ndarray) -> int:
    return int(np.subtract(*np.quantile(x, (0.9, 0.1), axis=0)).argmax())


def _tree(x: np.ndarray, cells: int) -> list[tuple[int, float, int]]:
    """Splits (feature, threshold, cells below it) of the sample into ``cells`` parts, each followed by those of its lower and its upper
    side."""
    if cells < 2 or len(x) < 2:
        return [(-1, 0.0, cells)]
    k, low = _widest(x), cells // 2
    at = float(np.quantile(x[:, k], low / cells))
    under = x[:, k] < at
    return [(k, at, low), *_tree(x[under], low), *_tree(x[~under], cells - low)]


def _cells(x: np.ndarray, tree: list[tuple[int, float, int]]) -> np.ndarray:
    """The cell of each window, down the tree."""
    cell, places = np.zeros(len(x), np.int32), iter(tree)

    def down(rows: np.ndarray, first: int) -> None:
        k, at, low = next(places)
        if k < 0:
            cell[rows] = first
            return
        under = x[rows, k] < at
        down(rows[under], first)
        down(rows[~under], first + low)

    down(np.arange(len(x)), 0)
    return cell


def _leaves(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    if len(rows) <= LEAF:
        return [rows]
    order, half = np.argsort(x[rows, _widest(x[rows])], kind="stable"), len(rows) // 2
    return _leaves(x, np.sort(rows[order[:half]])) + _leaves(x, np.sort(rows[order[half:]]))


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of the rows from a box."""
    return (np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(1)


class _Nearest:
    """The n nearest hosts (rows of y, with ids) of each guest, equal ones by smaller id, among those no farther than its bound."""

    def __init__(self, x: np.ndarray, own: np.ndarray, bound: np.ndarray, n: int, apart: int):
        self.x, self.own, self.bound, self.n, self.apart = x, own, bound, n, apart
        self.far, self.id = np.full((len(x), n), np.inf), np.full((len(x), n), NONE)
        with np.errstate(over="ignore"):
            self.product = np.column_stack([-2 * x, np.ones(len(x)), (x**2).sum(1)])

    def limit(self, rows=slice(None)) -> np.ndarray:
        return np.minimum(self.bound[rows], self.far[rows, -1]) ** 2 * SLACK

    def meet(self, y: np.ndarray, other: np.ndarray, same: bool) -> None:
        """``same``: the hosts are the guests, in the same order."""
        by_id = np.argsort(other, kind="stable")
        leaves = _leaves(y, by_id)
        if same:
            for leaf in leaves:
                for a in range(0, len(leaf), ROWS):
                    self._compare(leaf[a : a + ROWS], y[leaf], other[leaf])
        for leaf in leaves:
            hosts, ids = y[leaf], other[leaf]
            limit = self.limit()
            due = _gap(self.x, hosts.min(0), hosts.max(0)) <= limit
            due &= (limit > 0) | (ids[0] < self.id[:, -1])  # equal windows come by id
            if same:
                due[leaf] = False
            rows = np.flatnonzero(due)
            for a in range(0, len(rows), ROWS):
                self._compare(rows[a : a + ROWS], hosts, ids)

    def _compare(self, rows: np.ndarray, hosts: np.ndarray, ids: np.ndarray) -> None:
        """Products say which hosts may be near enough, differences how far those are, so that near ones are exact."""
        own, size = self.own[rows], (hosts**2).sum(1)
        far = self.product[rows] @ np.column_stack([hosts, size, np.ones(len(hosts))]).T
        wrong = 4e-15 * (hosts.shape[1] + 8) * (self.product[rows, -1] + size.max())  # by rounding, at most
        near = ~(far > (self.limit(rows) + wrong)[:, None])
        many = np.count_nonzero(near)
        if not many:
            return
        if len(hosts) > self.n and many > 8 * self.n * len(rows):
            far[np.abs(own[:, None] - ids) < self.apart] = np.inf
            near &= ~(far > (np.partition(far, self.n - 1, axis=1)[:, self.n - 1] * SLACK + 2 * wrong)[:, None])
        row, host = np.nonzero(near)
        keep = np.abs(own[row] - ids[host]) >= self.apart
        row, host = row[keep], host[keep]
        exact = np.zeros(len(row))
        for v, w in zip(self.x[rows].T, hosts.T):
            exact += (v[row] - w[host]) ** 2
        keep = exact <= self.limit(rows)[row]
        row, host, exact = row[keep], host[keep], np.sqrt(exact[keep])
        if not len(row):
            return
        some = np.unique(row)
        all_ = np.concatenate([np.repeat(rows[some], self.n), rows[row]])
        far = np.concatenate([self.far[rows[some]].ravel(), exact])
        ids = np.concatenate([self.id[rows[some]].ravel(), ids[host]])
        order = np.lexsort((ids, far, all_))
        start = np.flatnonzero(np.diff(all_[order], prepend=-1))
        taken = order[start[:, None] + np.arange(self.n)]  # each row has its n of before, at least
        self.far[all_[order[start]]], self.id[all_[order[start]]] = far[taken], ids[taken]


def _endless(beyond: DataFrame, rows: DataFrame, keys: list[str], n: int, apart: int) -> DataFrame:
    """(keys, id, other, distance) of pairs with a window ``beyond`` the finite ``rows``: all finite windows are as far from it, so the
    first ``few`` of a series, by id, suffice, and it only counts for finite windows of series with fewer."""
    few = n + 2 * apart
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("_r") <= few)
    short = first.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < few).select(*keys)
    other = lambda t: t.select(*keys, F.col("id").alias("other"), F.col("x").alias("_y"))
    pairs = matched(beyond, other(first.drop("_r").unionByName(beyond)), keys).unionByName(matched(matched(first.drop("_r"), short, keys, "left_semi"), other(beyond), keys))
    far = F.sqrt(F.aggregate(F.zip_with("x", "_y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return pairs.where(F.abs(F.col("id") - F.col("other")) >= apart).select(*keys, "id", "other", far.alias("distance"))


def nearest(windows: DataFrame, keys: list[str], n: int, apart: int) -> DataFrame:
    """(keys, id, rank, other, distance): the n nearest windows (keys, id, x) of each window of the same series (``keys``), by Euclidean
    distance, equal ones by smaller id. Windows that are less than ``apart`` ids away do not count, and so never the window itself. x: arrays
    of one length; windows with a null or missing value in x are left out. Windows with an infinite value, which should be few, are
    infinitely far from others, or at no number from those with one at the same place, which comes last. A window without another has no row."""
    spark = windows.sparkSession
    rows = windows.where(F.expr("id IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))")).select(*keys, F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    rows = stored(rows, "windows")
    endless = F.exists("x", lambda v: F.abs(v) == F.lit(float("inf")))
    beyond, rows = rows.where(endless), rows.where(~endless)
    w = Window.partitionBy(*keys, "id").orderBy("distance", "other")
    last = lambda t: t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*keys, "id", "rank", "other", "distance")
    longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0]
    if not longest:
        return last(_endless(beyond, rows, keys, n, apart))
    most = min(PIVOTS, -(-longest // BLOCK))
    sample = _matrix(rows.orderBy(F.xxhash64("x"), "id").limit(SAMPLE * most).select("x").toArrow()["x"])
    tree = _tree(sample, most)

    def assign(batches):
        for batch in batches:
            yield batch.append_column("cell", pa.array(_cells(_matrix(batch.column("x")), tree)))

    cells, place = [*keys, "cell"], [*keys, "cell", "block"]
    d = stored(rows.mapInArrow(assign, StructType([*rows.schema.fields, StructField("cell", IntegerType())])), "cells")
    box = [F.array(*(f(F.get("x", i)) for i in range(sample.shape[1]))).alias(name) for name, f in (("low", F.min), ("high", F.max))]
    plan = stored(d.groupBy(*cells).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), *box), "cell-plan")
    d = matched(d, plan.select(*cells, "blocks"), cells).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    d = stored(d, "blocks")
    there = plan.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("cell", "blocks", "low", "high"))).alias("there"))  # up to PIVOTS of each series
    there = matched(plan.select(*cells, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")), there, keys)
    kinds = [rows.schema[k] for k in keys]
    lists = [StructField("others", ArrayType(LongType())), StructField("distances", ArrayType(DoubleType()))]
    first = StructType([*kinds, StructField("cell", IntegerType()), StructField("block", IntegerType()), StructField("id", LongType()), StructField("x", ArrayType(DoubleType())), StructField("bound", DoubleType()), *lists, StructField("to", ArrayType(IntegerType()))])

    def found(near: _Nearest) -> list[pa.Array]:
        known = near.id != NONE
        at = pa.array(np.concatenate([[0], known.sum(1).cumsum()]).astype(np.int32))
        return [pa.ListArray.from_arrays(at, pa.array(v[known])) for v in (near.id, near.far)]

    def within(members: pa.Table, cells_: pa.Table) -> pa.Table:
        x, own = _matrix(members.column("x")), members.column("id").to_numpy()
        near = _Nearest(x, own, np.full(len(x), np.inf), n, apart)
        near.meet(x, own, True)
        all_, limit = cells_.column("there")[0].as_py(), near.limit()
        reached = np.column_stack([_gap(x, np.array(c["low"]), np.array(c["high"])) <= limit for c in all_])
        at = pa.array(np.concatenate([[0], reached.sum(1).cumsum()]).astype(np.int32))
        to = pa.ListArray.from_arrays(at, pa.array(np.array([c["cell"] for c in all_], np.int32)[np.nonzero(reached)[1]]))
        return pa.table([*(members.column(c) for c in [*place, "id", "x"]), pa.array(near.far[:, -1]), *found(near), to], [f.name for f in first.fields])

    near = stored(d.groupBy(*place).cogroup(there.groupBy(*place)).applyInArrow(within, first), "near")
    asking = near.select(*keys, "id", "x", "bound", F.col("cell").alias("_cell"), F.col("block").alias("_block"), F.explode("to").alias("cell"))
    asking = matched(asking, plan.select(*cells, "blocks"), cells).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where("NOT (cell = _cell AND block = _block)")
    asking = stored(asking.select(*place, "id", "x", "bound"), "visits")
    stripes = stored(asking.groupBy(*place).agg(F.ceil(F.count("*") / STRIPE).cast("int").alias("stripes")), "stripes")
    asking = matched(asking, stripes, place).withColumn("stripe", F.pmod(F.xxhash64("id"), F.col("stripes")).cast("int")).select(*place, "stripe", "id", "x", "bound")
    hosts = matched(d.select(*place, "id", "x"), stripes, place).withColumn("stripe", F.explode(F.expr("sequence(0, stripes - 1)"))).select(*place, "stripe", "id", "x")
    second = StructType([*kinds, StructField("id", LongType()), *lists])

    def between(guests: pa.Table, members: pa.Table) -> pa.Table:
        if not guests.num_rows:
            return pa.Table.from_batches([], pa.schema([(f.name, members.schema.field(f.name).type) for f in [*kinds, StructField("id", LongType())]] + [("others", pa.list_(pa.int64())), ("distances", pa.list_(pa.float64()))]))
        near = _Nearest(_matrix(guests.column("x")), guests.column("id").to_numpy(), guests.column("bound").to_numpy(), n, apart)
        near.meet(_matrix(members.column("x")), members.column("id").to_numpy(), False)
        return pa.table([*(guests.column(c) for c in [*keys, "id"]), *found(near)], [*keys, "id", "others", "distances"])

    met = asking.groupBy(*place, "stripe").cogroup(hosts.groupBy(*place, "stripe")).applyInArrow(between, second)
    pairs = near.select(*keys, "id", "others", "distances").unionByName(met).select(*keys, "id", F.explode(F.arrays_zip("others", "distances")).alias("p"))
    pairs = pairs.select(*keys, "id", F.col("p.others").alias("other"), F.col("p.distances").alias("distance"))
    return last(pairs.unionByName(_endless(beyond, rows, keys, n, apart)))
