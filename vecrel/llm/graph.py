"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) links; a component is named by its least node.

    Alternates the large-star and small-star steps until the links no longer change.
    Minima are partial aggregates and go back by joins, so a node with very many links
    is never gathered in one task.  Every step is cut off by a written table.
    """
    edges = C.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, old = C.written(small, "edges"), edges
        C.free(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    named = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
