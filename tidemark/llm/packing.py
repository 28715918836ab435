"""Best-two-fit packing of token sequences.

Packing sees lengths alone, and pieces of one length are interchangeable, so the plan is made on the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus) and carried out by Spark: pieces are numbered within their
length, and number ranges of the plan say which sequence and offset they get. The plan has as many rows as its distinct
bin patterns have slots, which the number of lengths bounds, so it may be broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import free, materialize, slices
from .tokens import PieceEncoder


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut into pieces of ``capacity``;
    the first piece takes the remainder. A null or empty text is the end id alone. ids (array<int>) only if asked for."""

    def encode(batches):
        encoder = PieceEncoder.of(vocabulary)
        for batch in slices(batches, tokenizes=True):
            ids, n = encoder.ids([t or "" for t in batch.column("text").to_pylist()])
            n = n + 1
            stop = np.cumsum(n)
            full = np.full(int(stop[-1]) if len(stop) else 0, end_id, dtype="<u4")
            keep = np.ones(len(full), dtype=bool)
            keep[stop - 1] = False
            full[keep] = ids
            count = -(-n // capacity)
            first = n - (count - 1) * capacity
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            at = (stop - n)[row] + start
            raw = memoryview(full).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(full)).astype(np.int32)), pa.array(full.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


SPARE = (0, 2, 8, 32)  #: tokens of room that a bin may keep without an exchange


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin's items, how many such bins), by best-two-fit.

    Exchanges use up short items, of which later bins may be in need: how much room is worth one depends on the lengths at
    hand. Plans are made for each of SPARE, and one without any exchange; the one with the fewest bins is taken."""
    return min((_plan(counts, capacity, spare) for spare in (*SPARE, capacity)), key=lambda p: sum(times for _, times in p))


def _plan(counts: dict[int, int], capacity: int, spare: int) -> list[tuple[list[int], int]]:
    """A bin is filled greedily with the longest items that fit. If more than ``spare`` room is left, its smallest item is
    exchanged for the two unpacked items that fill the widened gap best, if they fill it better. The pattern is repeated as
    long as its items last, so every round uses up at least one length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while left.any():
        rest = left.copy()
        bins: list[int] = []
        room = capacity
        while room > 0:
            fits = np.flatnonzero(rest[1 : room + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            bins.append(length)
            rest[length] -= 1
            room -= length
        if room > spare:
            smallest = bins[-1]
            gap = room + smallest
            have = np.flatnonzero(rest[1 : gap + 1]) + 1
            best = None
            if len(have):
                # the largest partner of each length: of those that are left, at most what it leaves
                partner = np.searchsorted(have, gap - have, side="right") - 1
                ok = partner >= 0
                other = np.where(ok, have[np.maximum(partner, 0)], 0)
                clash = ok & (other == have) & (rest[have] < 2)
                other = np.where(clash, np.where(partner > 0, have[np.maximum(partner - 1, 0)], 0), other)
                total = np.where(other > 0, have + other, 0)
                k = int(total.argmax())
                if total[k] > smallest:
                    best = (int(have[k]), int(other[k]))
            if best:
                bins[-1:] = sorted(best, reverse=True)
        used = np.bincount(bins, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        out.append((bins, times))
    return out


def _slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, one past the last, first sequence, items of this length in a bin, offset of the first)."""
    given: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, times in patterns:
        offset = 0
        for length in dict.fromkeys(bins):
            k = bins.count(length)
            at = given.get(length, 0)
            rows.append((length, at, at + k * times, sequence, k, offset))
            given[length] = at + k * times
            offset += k * length
        sequence += times
    return rows


def pack(found: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to rows with ``length`` (1 to capacity). Offsets in a sequence are gapless from 0. If a column
    has one of these names it stays, and the new one gets an underscore before it.

    Rows are numbered within their length from counts per partition and length, so that no length, however common,
    passes through one task. Equal rows are packed one by one. An empty table gives an empty one.
    """
    spark = found.sparkSession
    names = [free(n, found.columns) for n in ("sequence_id", "offset")]
    rows = materialize(found.select(F.struct(*found.columns).alias("row"), F.col("length").cast("long").alias("length"), F.spark_partition_id().alias("part")), "pieces")
    order = [f"row.{c}" for c in ("doc_id", "piece") if c in found.columns]
    local = rows.withColumn("nth", F.row_number().over(Window.partitionBy("part", "length").orderBy(*order or [F.lit(0)])) - 1)
    counted = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(_slots(plan(counts, capacity)) or [], "length long, lo long, hi long, sequence long, each long, at long")
    numbered = local.join(before, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    placed = numbered.join(F.broadcast(slots), (numbered.length == slots.length) & (numbered.number >= slots.lo) & (numbered.number < slots.hi)).drop(slots.length)
    k = F.col("number") - F.col("lo")
    return placed.select(
        "row.*",
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias(names[0]),
        (F.col("at") + k % F.col("each") * F.col("length")).cast("long").alias(names[1]),
    )
