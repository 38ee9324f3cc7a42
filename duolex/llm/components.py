"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


#: Edges that one task of a round takes.
ROWS = 200_000


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component. Each round joins every node to the
    least of its neighbourhood; minima are combined before the shuffle and written, so a hub is a skewed or broadcast join, never
    a group in one task. Rounds grow with the logarithm of a component's size. No link reaches the driver."""
    edges = tables.put(links.where("a != b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    before = _mark(edges)
    while True:
        # A round's tables have about as many rows as there are edges: so many to a task, whatever the shuffle partitions are.
        few = max(1, before[0] // ROWS)
        put = lambda df, name: tables.put(df.coalesce(few), name)  # noqa: B023, E731
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = put(large.where("u != v").distinct(), "large")
        least = put(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = large.join(least, "u")
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, edges = edges, put(small.distinct(), "edges")
        now = _mark(edges)
        if now == before:
            break
        before = now
        tables.drop(old, large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
