"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, root): the smallest node of each node's component.

    Edges may repeat, run either way or join a node to itself. A node whose own root it is, is
    returned too if it has an edge. Every round is a shuffle of the edges that are left, at most one
    per node after the first; each round's edges are written to the shared folder. Rounds go on until
    one changes nothing, which takes about the square of the logarithm of the largest component.
    """
    star = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    star = materialize(star, "edges")
    mark = _mark(star)
    while True:
        both = star.union(star.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        new = materialize(small, "edges")
        discard(star)
        star, old = new, mark
        mark = _mark(star)
        if mark == old:
            break
    return star.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(star.select("b", F.col("b").alias("root")).distinct())
