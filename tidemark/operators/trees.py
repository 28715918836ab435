"""Extremely randomised trees for many series and folds at once.

Trees grow level by level. A node's thresholds lie at random between the least and the largest value that it holds, so that a level
takes two grouped sums over (series, fold, tree, node): the values' ranges, and the classes on either side of each threshold. For each
of them rows meet all trees of their series and fold in one join, by one key, and are summed up where that leaves them; which node they
are in follows from the splits found so far. Random numbers are hashes of what they are
for, so that a model is the same on any machine and in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ordered import matched
from ..plans.scratch import stored


def _random(seed: int, *of) -> Column:
    """From 0 to under 1."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in of))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32


def _placed(rows: DataFrame, depth: int) -> DataFrame:
    """Adds the node, numbered from 1 as in a heap, that ``_splits`` (node to feature and threshold) lead the values ``_x`` to. A column for
    each step, as expressions within each other would grow with the power of the depth."""
    rows = rows.withColumn("node", F.lit(1))
    for _ in range(depth):
        rows = rows.withColumn("_split", F.try_element_at("_splits", F.col("node")))
        side = (F.get("_x", F.col("_split.feature")) >= F.col("_split.threshold")).cast("int")
        rows = rows.withColumn("node", F.when(F.col("_split").isNull(), F.col("node")).otherwise(2 * F.col("node") + side))
    return rows


def _values(features: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))


def fit(train: DataFrame, features: list[str], label: str, keys: list[str], trees: int = 10, depth: int = 4, tries: int | None = None, least: int = 2, seed: int = 1) -> DataFrame:
    """(keys, tree, splits, shares): the trees of each series and fold (``keys``), for predict().

    label: 0 or 1; rows with a null label are left out, a missing feature counts as 0. A node looks at ``tries`` features (the root of their
    number, if not given), each with one threshold, and takes the split that leaves its sides purest (of equals that of the first
    feature); it stays a leaf if it holds fewer than ``least`` rows, one class, or one value of each feature. Keys whose rows are all of
    one class have no trees."""
    tries, places = tries or max(1, round(len(features) ** 0.5)), range(len(features))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))  # never null, and equal where null keys are
    rows = stored(train.where(F.col(label).isNotNull()).select(key.alias("_key"), F.col(label).cast("long").alias("_y"), _values(features).alias("_x")), "train")
    both = rows.groupBy("_key").agg(F.min("_y").alias("a"), F.max("_y").alias("b")).where("a < b").select("_key")
    by, parts = ["_key", "tree", "node"], [F.col("_key")[k] for k in keys] + [F.col("tree"), F.col("node")]
    none = F.expr("map_from_entries(cast(array() as array<struct<key:int,value:struct<feature:int,threshold:double>>>))")
    model = stored(both.withColumn("_trees", F.array_repeat(none, trees)), "splits")

    def of_trees(nodes: DataFrame, value: Column, out: str) -> DataFrame:
        """One row of each key: tree to node to value."""
        nodes = nodes.groupBy("_key", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", value.alias("value")))).alias("_m"))
        return nodes.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("tree", "_m"))).alias(out))

    kept = []
    for level in range(depth + 1):
        at = _placed(rows.join(model, "_key").select("_key", "_y", "_x", F.posexplode("_trees").alias("tree", "_splits")), level).where(F.col("node") >= 1 << level)
        held = stored(at.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_y").alias("ones"), *(f(F.get("_x", i)).alias(f"_{s}{i}") for i in places for s, f in (("lo", F.min), ("hi", F.max)))), "nodes")
        kept.append(held.select(*by, "n", "ones"))
        if level == depth:
            break
        found = F.array(*(F.struct(_random(seed, *parts, F.lit(i), F.lit("which")).alias("r"), F.lit(i).alias("feature"), (F.col(f"_lo{i}") + _random(seed, *parts, F.lit(i)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias("threshold"), (F.col(f"_lo{i}") < F.col(f"_hi{i}")).alias("varied")) for i in places))
        tried = F.slice(F.array_sort(F.filter(found, lambda c: c["varied"])), 1, tries)
        open_ = held.where((F.col("n") >= least) & (F.col("ones") > 0) & (F.col("ones") < F.col("n"))).select(*by, "n", "ones", tried.alias("tried")).where("size(tried) > 0")
        asked = stored(model.join(of_trees(open_, F.struct("n", "ones", "tried"), "_open"), "_key"), "thresholds")
        d = rows.join(asked, "_key").select("_key", "_y", "_x", "_open", F.posexplode("_trees").alias("tree", "_splits")).withColumn("_o", F.try_element_at("_open", F.col("tree"))).where("_o IS NOT NULL")
        d = _placed(d, level).withColumn("_o", F.try_element_at("_o", F.col("node"))).select(*by, "_x", "_y", "_o.n", "_o.ones", F.explode("_o.tried").alias("c"))
        left = F.get("_x", F.col("c.feature")) < F.col("c.threshold")
        sides = d.groupBy(*by, F.col("c.feature").alias("feature"), F.col("c.threshold").alias("threshold")).agg(F.count_if(left).alias("m"), F.sum(F.when(left, F.col("_y")).otherwise(0)).alias("mo"), F.max("n").alias("n"), F.max("ones").alias("ones"))
        impure = lambda n, one: F.coalesce(F.try_divide(one * (n - one), n), F.lit(0.0))
        cost = impure(F.col("m"), F.col("mo")) + impure(F.col("n") - F.col("m"), F.col("ones") - F.col("mo"))
        best = sides.where("m > 0 AND m < n").withColumn("cost", cost).groupBy(*by).agg(F.min(F.struct("cost", "feature", "threshold")).alias("best"))
        new = of_trees(best, F.struct("best.feature", "best.threshold"), "_new")
        more = lambda m, i: F.coalesce(F.map_concat(m, F.try_element_at("_new", i)), m)
        model = stored(model.join(new, "_key", "left").select("_key", F.transform("_trees", more).alias("_trees")), "splits")
    nodes = kept[0]
    for k in kept[1:]:
        nodes = nodes.unionByName(k)
    shares = nodes.groupBy("_key", "tree").agg(F.map_from_entries(F.collect_list(F.struct("node", (F.col("ones") / F.col("n")).alias("value")))).alias("shares"))  # up to 2**(depth + 1) nodes
    out = model.select("_key", F.posexplode("_trees").alias("tree", "splits")).join(shares, ["_key", "tree"])
    return out.select(*(F.col("_key")[k].alias(k) for k in keys), "tree", "splits", "shares")


def predict(df: DataFrame, model: DataFrame, features: list[str], keys: list[str], depth: int = 4, out: str = "p") -> DataFrame:
    """Adds the probability of a 1: the mean over the trees of the share of ones in the leaf. Null where the keys have no trees."""
    trees = model.groupBy(*keys).agg(F.collect_list(F.struct("tree", F.col("splits").alias("_splits"), "shares")).alias("_trees"))
    d = matched(df.withColumn("_x", _values(features)), trees, keys, "left")

    def leaf(t: Column) -> Column:
        def step(node: Column, _: Column) -> Column:
            split = F.try_element_at(t["_splits"], node)
            return F.when(split.isNull(), node).otherwise(2 * node + (F.get("_x", split["feature"]) >= split["threshold"]).cast("int"))

        node = F.aggregate(F.array(*map(F.lit, range(depth))), F.lit(1), step) if depth else F.lit(1)
        return F.try_element_at(t["shares"], node)

    shares = F.transform(F.array_sort("_trees", lambda a, b: a["tree"] - b["tree"]), leaf)
    return d.withColumn(out, F.aggregate(shares, F.lit(0.0), lambda s, v: s + v) / F.size("_trees")).drop("_x", "_trees")
