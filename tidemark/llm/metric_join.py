"""Near-duplicate vectors by an exact range join in the metric of angles.

1. Equal vectors are one class with a multiplicity; copies never meet in pairs.
2. Pivots are vectors that are farther apart than the radius. Each class belongs to the cell of its nearest pivot. Classes
   within half a radius of it are the cell's core: by the triangle inequality they are all linked with each other, so a
   core is counted and never compared with itself, however large it is.
3. A class x (nearest pivot q) is sent to the cell of p only if a member can be within the radius r of it. That takes
   d(x, p) <= d(x, q) + 2 r and d(x, p) <= r + the largest distance of the cell's members from p, both by the triangle
   inequality, and that x is within the radius' chord of the half space that is nearer to p than to q. Of two cells one
   sends to the other, so a pair meets once.
4. Cells join independently: large ones in blocks of their members, many visitors in stripes. A task holds one block in
   memory and streams the visitors past it. It returns counts and a spanning forest of its links, not the links.

How much the bounds save depends on the vectors. Where all are about equally far from each other, as random ones of many
dimensions are, most cells stay within reach of most vectors, and the work grows with the square of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from .graph import components
from .store import join_counted, materialize, spread

PIVOTS = 1_024  #: at most, over vectors of all lengths
BLOCK = 2_048  #: members of a cell that a task holds
STRIPE = 16 * BLOCK  #: visitors that one task compares with a block, about
ROWS = 512  #: visitors that are multiplied at once
SLACK = 1e-9  #: for rounding, in bounds only


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> list[np.ndarray]:
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return [np.flatnonzero(size == n) for n in np.unique(size)]


class Cells:
    """Pivots of one vector length, and what the triangle inequality says about their cells.

    Cell 2 p is the core of pivot p, cell 2 p + 1 the rest of what is nearest to it."""

    def __init__(self, pivots: np.ndarray, threshold: float, first: int):
        self.pivots, self.first = pivots, first
        self.radius = math.acos(threshold)
        self.chord = math.sqrt(2 - 2 * threshold) + SLACK
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        self.reach = np.full(2 * len(pivots), -1.0)  # no members: out of reach

    @classmethod
    def choose(cls, sample: np.ndarray, threshold: float, most: int, first: int) -> Cells:
        """Of the sample those that no earlier one is within the radius of, in order, up to ``most``."""
        kept = np.zeros((0, sample.shape[1]))
        for x in sample:
            if len(kept) == most:
                break
            if not len(kept) or (kept @ x).max() < threshold:
                kept = np.vstack([kept, x])
        return cls(kept, threshold, first)

    def home(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near: cosines with the pivots. Nearest pivot, its angle, cell."""
        q = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(q)), q], -1, 1))
        return q, angle, 2 * q + (angle > self.radius / 2 - SLACK)

    def visits(self, near: np.ndarray) -> list[np.ndarray]:
        """The cells that each row must be sent to, besides its own."""
        q, angle, cell = self.home(near)
        m = 2 * len(self.pivots)
        gap = near[np.arange(len(q)), q][:, None] - near
        some = gap <= self.chord * self.apart[q] + SLACK
        some &= near >= np.cos(np.minimum(np.pi, angle + 2 * self.radius))[:, None] - SLACK
        both = np.repeat(some, 2, axis=1)
        limit = np.where(self.reach < 0, 2.0, np.cos(np.minimum(np.pi, self.reach + self.radius)) - SLACK)
        both &= np.repeat(near, 2, axis=1) >= limit
        ahead = (cell[:, None] - np.arange(m)) % m
        both &= (ahead > 0) & ((2 * ahead < m) | ((2 * ahead == m) & (cell[:, None] < np.arange(m))))
        return [np.flatnonzero(b) for b in both]


def _cells(classes: DataFrame, threshold: float) -> dict[int, Cells]:
    """Cells for each vector length. The driver gets up to four candidates for each pivot (1,024 at most)."""
    lengths = {r["size"]: r["n"] for r in classes.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).collect()}
    total, out, first = sum(lengths.values()), {}, 0
    for size in sorted(lengths):
        most = max(1, min(PIVOTS * lengths[size] // total, -(-lengths[size] // BLOCK)))
        sample = classes.where(F.size("vec") == size).orderBy(F.xxhash64("id"), "id").limit(4 * most).select("vec").toArrow()
        out[size] = Cells.choose(_matrix(sample["vec"].combine_chunks()), threshold, most, first)
        first += 2 * len(out[size].pivots)
    return out


def _homes(batch: pa.RecordBatch, cells: dict[int, Cells]):
    for rows in _by_length(batch.column("vec")):
        for at in range(0, len(rows), ROWS):
            some = batch.take(pa.array(rows[at : at + ROWS]))
            x = _matrix(some.column("vec"))
            own = cells[x.shape[1]]
            yield some, own, x @ own.pivots.T


def _assigned(classes: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(id, n, vec, cell, visits) of each class; makes the radius of each cell first."""
    at = classes.sparkSession.sparkContext.broadcast(cells)

    def radii(batches):
        for batch in batches:
            for _, own, near in _homes(batch, at.value):
                _, angle, cell = own.home(near)
                most = np.full(2 * len(own.pivots), -1.0)
                np.maximum.at(most, cell, angle)
                some = np.flatnonzero(most >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(own.first + some), pa.array(most[some])], ["cell", "reach"])

    found = dict(map(tuple, classes.mapInArrow(radii, "cell long, reach double").groupBy("cell").agg(F.max("reach").alias("reach")).collect()))  # two rows a pivot
    for own in cells.values():
        own.reach = np.array([found.get(own.first + c, -1.0) for c in range(2 * len(own.pivots))])
    sent = classes.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        for batch in batches:
            for some, own, near in _homes(batch, sent.value):
                lists = own.visits(near)
                offsets = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                visits = pa.ListArray.from_arrays(offsets, pa.array(own.first + np.concatenate(lists).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(own.first + own.home(near)[2]), visits], [*some.schema.names, "cell", "visits"])

    schema = StructType([*classes.schema.fields, StructField("cell", LongType()), StructField("visits", ArrayType(LongType()))])
    return materialize(classes.mapInArrow(assign, schema), "cells")


def _merge(label: np.ndarray, row: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Members that one row is linked with get one label, the smallest. row: sorted, with the members it is linked with."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    size = np.diff(np.append(start, len(row)))
    while len(row):
        low = np.minimum.reduceat(label[member], start)
        low = np.repeat(low, size)
        if (label[member] == low).all():
            break
        new = label.copy()
        np.minimum.at(new, label[member], low)
        np.minimum.at(new, member, low)
        while (new != new[new]).any():
            new = new[new]
        label = new
    return label


class _Block:
    """Members of a cell: counts their links with visitors and with each other, and joins what is linked."""

    def __init__(self, parts: list[tuple], threshold: float):
        self.id, self.n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.x = np.concatenate([p[2] for p in parts])
        self.links = np.zeros(len(self.id), dtype=np.int64)
        self.label = np.arange(len(self.id))
        self.threshold = threshold

    def meet(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray):
        """Visitors: (id, links, one that it is linked with) of those with a link."""
        for at in range(0, len(ids), ROWS):
            row, member = np.nonzero(x[at : at + ROWS] @ self.x.T >= self.threshold)
            if len(row):
                self.links += np.bincount(member, n[at + row], len(self.id)).astype(np.int64)
                self.label = _merge(self.label, row, member)
                some, first = np.unique(row, return_index=True)
                links = np.bincount(row, self.n[member])[some].astype(np.int64)
                yield ids[at + some], links, self.id[member[first]]

    def own(self) -> None:
        for at in range(0, len(self.id), ROWS):
            row, member = np.nonzero(self.x[at : at + ROWS] @ self.x.T >= self.threshold)
            row, member = row[other := row + at != member], member[other]
            if len(row):
                self.links[at : at + ROWS] += np.bincount(row, self.n[member], len(self.id[at : at + ROWS])).astype(np.int64)
                row, member = np.append(row, some := np.unique(row)), np.append(member, at + some)  # each is linked with itself as well
                order = np.argsort(row, kind="stable")
                self.label = _merge(self.label, row[order], member[order])

    def done(self):
        some = np.flatnonzero(self.links)
        return self.id[some], self.links[some], self.id[self.label[some]]


def _compared(assigned: DataFrame, threshold: float) -> DataFrame:
    """(id, links, other): links of classes, in parts, each with one that it is linked with, which joins all that are."""
    members = assigned.groupBy("cell").agg(F.count("*").alias("members"))
    visitors = assigned.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count("*").alias("visitors"))
    plan = members.join(visitors, "cell", "left").fillna(0).withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    within = (F.col("cell") % 2 == 1) & (F.col("blocks") > 1)
    plan = plan.withColumn("stripes", F.ceil((F.col("visitors") + F.when(within, F.col("members") / 2).otherwise(0)) / STRIPE).cast("int"))
    plan = plan.withColumn("stripes", F.when(F.col("cell") % 2 == 1, F.greatest("stripes", F.lit(1))).otherwise(F.col("stripes")))
    plan = F.broadcast(materialize(plan.select("cell", "blocks", "stripes"), "cell-plan"))  # two rows a pivot
    h = F.xxhash64("id")
    rows = assigned.join(plan, "cell").withColumn("block", F.pmod(h, F.col("blocks")).cast("int"))
    stripe = F.pmod(F.xxhash64("id", F.lit(1)), F.col("stripes")).cast("int").alias("stripe")
    own = rows.where("stripes > 0").select("cell", "block", F.explode(F.expr("sequence(0, stripes - 1)")).alias("stripe"), F.lit(0).alias("side"), "id", "n", "vec")
    ahead = "filter(sequence(0, blocks - 1), b -> pmod(block - b, blocks) > 0 AND (2 * pmod(block - b, blocks) < blocks OR (2 * pmod(block - b, blocks) = blocks AND block < b)))"
    inner = rows.where("cell % 2 = 1 AND blocks > 1").select("cell", F.explode(F.expr(ahead)).alias("block"), stripe, F.lit(1).alias("side"), "id", "n", "vec")
    sent = assigned.select(F.explode("visits").alias("cell"), "id", "n", "vec").join(plan, "cell")
    sent = sent.select("cell", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), stripe, F.lit(1).alias("side"), "id", "n", "vec")
    key = ["cell", "block", "stripe"]
    dealt = own.unionByName(inner).unionByName(sent).repartition(spread(assigned.sparkSession), *key).sortWithinPartitions(*key, "side")

    def compare(batches):
        last, parts, block = None, [], None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "links", "other"])

        def finish():
            nonlocal block, parts
            if last and not block:
                block = _Block(parts, threshold)
            if last and last[0] % 2 and not last[2]:
                block.own()
            if last:
                yield out(block.done())
            block, parts = None, []

        for batch in batches:
            number = [batch.column(c).to_numpy() for c in (*key, "side")]
            edge = np.flatnonzero(np.any([np.diff(x, prepend=x[:1] - 1) != 0 for x in number], axis=0))
            for a, b in zip(edge, [*edge[1:], batch.num_rows]):
                now = tuple(int(x[a]) for x in number[:3])
                if now != last:
                    yield from finish()
                    last = now
                some = batch.slice(a, b - a)
                found = some.column("id").to_numpy(), some.column("n").to_numpy(), _matrix(some.column("vec"))
                if not number[3][a]:
                    parts.append(found)
                    continue
                if not block:
                    block, parts = _Block(parts, threshold), []
                for more in block.meet(*found):
                    yield out(more)
        yield from finish()

    return dealt.mapInArrow(compare, "id long, links long, other long")


def _valid(c: str) -> str:
    return f"coalesce(size({c}) > 0 AND NOT exists({c}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists({c}, x -> x <> 0), false)"


def links(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding).

    Vectors are linked if their cosine in double precision is at least ``threshold`` (0.5 to under 1). n_links counts the other
    rows linked with a row, component_id is the smallest vec_id that links reach, kept says whether that is its own.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    lengths. Each row gives one row, also where vec_ids repeat: such rows are vectors of their own, and those of one vec_id
    count as one node for component_id. Rows with null vec_id stand alone, with no links and null component_id, and are kept. Other
    columns take no part.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("the threshold must be at least 0.5 and under 1")
    kind = next(f.dataType.elementType for f in vectors.schema.fields if f.name == "embedding")
    kind = "float" if isinstance(kind, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    rows = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.expr(_valid("vec")))
    key = ["k1", "k2"]
    hashed = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    named = materialize(rows.select("vec_id", *hashed, "ok"), "vector-keys")
    same = rows.where("ok").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    same = materialize(same.select(F.monotonically_increasing_id().alias("id"), "n", "least", *hashed, "vec"), "vector-classes")
    classes = same.select("id", "n", "vec")
    assigned = _assigned(classes, _cells(classes, threshold))
    found = materialize(_compared(assigned, threshold), "vector-links")

    core = assigned.where("cell % 2 = 0").select("id", "n", "cell")
    whole = F.broadcast(core.groupBy("cell").agg(F.sum("n").alias("whole"), F.min("id").alias("other")))  # one row a pivot
    core = core.join(whole, "cell").select("id", (F.col("whole") - F.col("n")).alias("links"), "other")
    found = found.unionByName(core)
    own = named.where("ok").select("vec_id", *key)
    twice = own.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    twice = own.join(twice, "vec_id").distinct().join(same.select("id", *key), key).select("vec_id", "id")
    twice = twice.join(twice.groupBy("vec_id").agg(F.min("id").alias("other")), "vec_id")
    joined = components(found.selectExpr("id AS a", "other AS b").unionByName(twice.selectExpr("id AS a", "other AS b")).where("a <> b"), "vector-components")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    table = same.select("id", "n", "least", *key).join(sums, "id", "left").join(joined, "id", "left")
    table = materialize(table.select(*key, "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "vector-table")
    smallest = materialize(table.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c")), "vector-smallest")
    table = materialize(join_counted(table, smallest, ["component"], "c").select(*key, "n", "n_links", "component_id"), "vector-found")
    out = join_counted(own, table, key).select("vec_id", "n_links", "component_id")
    rest = named.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def brute_force(rows: list[tuple[int, list | None]], threshold: float = 0.95) -> dict[int, tuple[int, int, bool]]:
    """vec_id (each once) to (n_links, component_id, kept) over all pairs; for tests."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links_of = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(good):
        for b, y in good[:k]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links_of[a] += 1
                links_of[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (links_of[i], find(i), find(i) == i) for i in root}
