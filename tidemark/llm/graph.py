"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import materialize, new_path, remove


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) edges to (id, component): the smallest id reachable. Ids without an edge are not listed.

    A node's neighbours are never gathered: each step takes their minimum by a partial aggregate and joins it back.
    """
    spark = edges.sparkSession
    path = new_path(spark, name)
    edges = materialize(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), name, path)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())

    before = mark(edges)
    while True:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        old, path = path, new_path(spark, name)
        edges = materialize(small.where("a <> b").distinct(), name, path)
        remove(spark, old)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS id", "m AS component").unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
