"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Texts with the same shingle set are one class, represented by its first row; copies never meet in pairs. Classes that
   share a doc_id are linked.
2. A class keeps the k smallest hashes of its set. Two sets with the wanted similarity share most of those, so only a
   class's rarest retained values need to be looked up (prefix filter): if at least ``least`` of k are shared, two
   classes meet in the inverted list of one of the ``k - least + 1`` rarest values of each.
3. Links are found in rounds. First every list links its members to its smallest one. Then, in lists whose members are
   still in different components, the members are compared with each other across components: short lists by a join,
   long ones in blocks of similar size.
4. A pair goes on if the union sketch estimates enough similarity, and is a link if the exact Jaccard says so (blocks
   hold the whole sets and need no estimate).

With k = 64 and similarity s >= 0.8, the union sketch of a pair shares fewer than 34 values (expected: 51, deviation: 3.2)
once in three million; filter and estimate both rest on 34. Sets of up to ``0.8 k`` shingles are kept whole, so for them the
filter is exact. Lists are not capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .store import join_counted, marked, materialize, slices
from .words import chunks, encoded, shingle_sets

K = 64
LEAST = 34  #: of K retained values, shared by any similar pair (see above)
SMALL = 12  #: lists of up to so many members are compared by a join, longer ones in blocks of numpy
BLOCK = 256
_CHUNK = 1 << 18  #: bytes of text whose shingles are made at once


def sketches(docs: DataFrame, words: int = 5, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, sketch): set size, a 128-bit fingerprint of the set, its k smallest hashes.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer than ``words`` words: the whole
    sequence is the one shingle. Null, empty and blank texts have an empty set.
    """

    def sketch(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id")
            for at, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK):
                rows = [(*_fingerprint(s), s[:k].view(np.int64)) for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch array<long>")


def _fingerprint(s: np.ndarray) -> tuple[int, int, int]:
    if not len(s):
        return 0, 0, 0
    odd = (s | np.uint64(1)) >> np.uint64(7) | np.uint64(1)
    return len(s), int(s.sum().view(np.int64)), int((s * odd).sum().view(np.int64))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, grams): the whole sets of the wanted classes (id, doc_id, n_shingles, fp1, fp2), from a document of each."""

    def whole(batches):
        for batch in slices(batches):
            for _, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK):
                rows = [(*_fingerprint(s), s.view(np.int64)) for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["n_shingles", "fp1", "fp2", "grams"])

    wanted = materialize(wanted.select("id", "doc_id", "n_shingles", "fp1", "fp2"), "wanted")
    texts = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted.select("doc_id"), "may")
    some = texts.where("may").select("doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = some.mapInArrow(whole, "n_shingles long, fp1 long, fp2 long, grams array<long>")
    return sets.join(wanted.drop("doc_id"), ["n_shingles", "fp1", "fp2"]).select("id", "grams").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, k: int, percent: int) -> DataFrame:
    """Of the (a, b) pairs those with 100 * intersection >= percent * union, after the estimate of the union sketch."""
    pairs = materialize(pairs, "pairs")
    side = marked(reps.select("id", "n_shingles", "sketch"), "id", pairs.select(F.explode(F.array("a", "b"))), "may").where("may")
    both = pairs.join(side.selectExpr("id AS a", "n_shingles AS na", "sketch AS sa"), "a").join(side.selectExpr("id AS b", "n_shingles AS nb", "sketch AS sb"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    both = both.withColumn("u", F.expr(f"slice(array_sort(array_union(sa, sb)), 1, {k})"))
    near = both.where(F.expr(f"{K} * size(array_intersect(u, array_intersect(sa, sb))) >= {LEAST} * size(u)"))
    near = materialize(near.select("a", "b", "na", "nb"), "estimated")
    needed = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_sets(docs, reps.join(needed, "id", "left_semi"), words), "sets")
    exact = near.join(sets.selectExpr("id AS a", "grams AS ga"), "a").join(sets.selectExpr("id AS b", "grams AS gb"), "b")
    exact = exact.withColumn("common", F.size(F.array_intersect("ga", "gb")).cast("long"))
    return exact.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def classes(docs: DataFrame, words: int = 5, percent: int = 85, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id that links reach, kept says whether that is the document itself. Empty sets link with nothing. Each row gives one
    row, also where doc_ids repeat: such rows are compared by their own texts, and those of one doc_id that are not empty
    count as linked. Rows with null doc_id stand alone, with null component_id, and are kept. Other columns take no part.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the sketch's bounds hold for a similarity of 0.8 or more")
    found = materialize(sketches(docs, words, k).withColumn("row", F.monotonically_increasing_id()), "sketches")
    key = ["n_shingles", "fp1", "fp2"]
    members = found.where("doc_id IS NOT NULL AND n_shingles > 0").select("row", "doc_id", *key)
    same = members.groupBy(*key).agg(F.min(F.struct("row", "doc_id")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("n"))
    same = materialize(same.select(*key, F.col("first.row").alias("id"), F.col("first.doc_id").alias("doc_id"), "least", "n"), "classes")
    reps = materialize(same.select("id", "doc_id", *key).join(found.select(F.col("row").alias("id"), "sketch"), "id"), "representatives")
    twice = members.select("row", "doc_id", *key).groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    twice = members.join(twice, "doc_id").select("doc_id", *key).distinct().join(same.select("id", *key), key).select("doc_id", "id")
    twice = twice.join(twice.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a < id").selectExpr("a", "id AS b")

    # rarest retained values
    listed = reps.select("id", "n_shingles", F.explode("sketch").alias("value"))
    often = listed.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    listed = listed.join(often, "value")
    whole = int(k * percent / 100)
    prefix = F.expr(f"least(n_shingles, {k}) - CASE WHEN n_shingles <= {whole} THEN ceil(n_shingles * {percent} / 100) ELSE {LEAST * k // K} END + 1")
    ranked = listed.groupBy("id", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
    ranked = ranked.withColumn("room", (prefix - (F.least("n_shingles", F.lit(k)) - F.size("shared"))).cast("int")).where("room > 0")
    lists = materialize(ranked.select("id", "n_shingles", F.explode(F.expr("slice(shared, 1, room)")).alias("s")).selectExpr("s.value AS value", "id", "n_shingles"), "lists")

    # round 1: each list's smallest member with all others
    hub = lists.groupBy("value").agg(F.min("id").alias("a"))
    star = lists.join(hub, "value").where("a < id").selectExpr("a", "id AS b").distinct()
    edges = materialize(_confirmed(star, reps, docs, words, k, percent).unionByName(twice), "links")
    first = materialize(components(edges), "first-components")

    # round 2: members of the same list in different components
    parts = lists.join(first.withColumnRenamed("component", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed = parts.groupBy("value").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("members"), F.min("id").alias("hub")).where("lo < hi AND members > 2")
    parts = materialize(parts.join(mixed.select("value", "members", "hub"), "value"), "mixed-lists")
    few = parts.where(f"members <= {SMALL}")
    near = few.alias("x").join(few.alias("y"), "value").where(f"x.id < y.id AND x.part <> y.part AND x.id <> x.hub AND 100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles)").selectExpr("x.id AS a", "y.id AS b")
    linked = _in_blocks(parts.where(f"members > {SMALL}"), reps, docs, words, percent)
    more = _confirmed(near.distinct(), reps, docs, words, k, percent)
    final = components(edges.unionByName(more).unionByName(linked))

    joined = materialize(same.join(final, "id", "left").select(*key, "least", F.col("n").alias("copies"), F.coalesce("component", "id").alias("component")), "components")
    least = materialize(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    joined = materialize(join_counted(joined, least, ["component"]).select(*key, "component_id", F.col("copies").alias("n")), "classes-found")
    rest = found.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_counted(members.select("doc_id", *key), joined, key).select("doc_id", "n_shingles", "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _in_blocks(parts: DataFrame, reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) links between members of different components that share a long list.

    A document's home is the smallest id in any of its long lists and its band of sizes, so that a cloud of similar documents
    has one home or a few, however many lists it shares. Homes of the same or neighbouring bands that meet in a list are
    compared, in blocks of documents: each pair of blocks is one small task that computes exact similarities in numpy. No
    list is ever gathered, and of the links between two components a task returns one. The work for documents that share a
    long list, have similar sizes and are not similar grows with the square of their number.
    """
    band = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(1.2501))).cast("int").alias("band")  # similar sets: next to each other at most
    homes = materialize(parts.groupBy("id", "n_shingles", "part").agg(F.min("hub").alias("hub")).select("id", "n_shingles", "part", F.struct("hub", band).alias("home")), "homes")
    sizes = homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    met = parts.select("value", "id").join(homes.select("id", "home"), "id").select("value", "home").distinct()
    pairs = met.alias("x").join(met.alias("y"), "value").where("x.home <= y.home AND abs(x.home.band - y.home.band) <= 1").selectExpr("x.home AS h1", "y.home AS h2").distinct()
    pairs = pairs.join(sizes.selectExpr("home AS h1", "blocks AS n1"), "h1").join(sizes.selectExpr("home AS h2", "blocks AS n2"), "h2")
    pairs = materialize(pairs, "home-pairs")
    grams = _sets(docs, reps.join(homes.select("id"), "id", "left_semi"), words)
    rows = homes.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = materialize(rows.join(grams, "id").select("home", "block", "id", "n_shingles", "part", "grams"), "home-sets")
    one = rows.join(pairs, F.col("home") == F.col("h1")).select("h1", "h2", F.col("block").alias("i"), F.explode(F.sequence(F.when(F.col("h1") == F.col("h2"), F.col("block")).otherwise(F.lit(0)), F.col("n2") - 1)).alias("j"), F.lit(0).alias("side"), "id", "n_shingles", "part", "grams")
    two = rows.join(pairs, F.col("home") == F.col("h2")).select("h1", "h2", F.explode(F.sequence(F.lit(0), F.when(F.col("h1") == F.col("h2"), F.col("block")).otherwise(F.col("n1") - 1))).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "id", "n_shingles", "part", "grams")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (np.flatnonzero(rows.side.to_numpy() == s) for s in (0, 1))
        ids, size, part = rows.id.to_numpy(), rows.n_shingles.to_numpy(), rows.part.to_numpy()
        owner = np.repeat(np.arange(len(rows)), size)
        _, code, times = np.unique(np.concatenate(rows.grams.to_list()), return_inverse=True, return_counts=True)
        owner, code = owner[times[code] > 1], code[times[code] > 1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], np.unique(code[order], return_inverse=True)[1]
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        place = np.zeros(len(rows), dtype=np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        is_left = rows.side.to_numpy()[owner] == 0
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            x, y = (np.zeros((n, 4096), dtype=np.float32) for n in (len(left), len(right)))
            o, c, s = owner[lo:hi], code[lo:hi] - at, is_left[lo:hi]
            x[place[o[s]], c[s]] = 1
            y[place[o[~s]], c[~s]] = 1
            common += x @ y.T
        whole = size[left][:, None] + size[right][None] - common
        p, q = np.nonzero((100 * common >= percent * whole) & (part[left][:, None] != part[right][None]))
        out = pd.DataFrame({"a": ids[left[p]], "b": ids[right[q]], "pa": part[left[p]], "pb": part[right[q]]})
        return out.drop_duplicates(["pa", "pb"])[["a", "b"]]

    dealt = one.unionByName(two)
    return dealt.groupBy("h1", "h2", "i", "j").applyInPandas(compare, "a long, b long").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def brute_force(rows: list[tuple[int, str | None]], words: int = 5, percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id to (n_shingles, component_id, kept) over all pairs; for tests."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    common: dict = {}
    for d in sorted(sets):
        for s in sets[d]:
            for o in where.setdefault(s, []):
                common[o, d] = common.get((o, d), 0) + 1
            where[s].append(d)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}
