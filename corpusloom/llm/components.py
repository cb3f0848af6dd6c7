"""Connected components of a table of links by alternating large and small stars, with joins and grouped minima only.

A hot node (the centre of a large star) is never gathered: its minimum is pre-aggregated and joined back, and Spark can
split the join. Every round is written to the shared checkpoint folder, so lineage stays short and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import checkpointed


def _mark(edges: DataFrame) -> tuple:
    """Count and sums that change whenever the set of links changes."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node; root is the smallest node of its component. Links with nulls are left out."""
    edges = checkpointed(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    state = _mark(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        found = small.select("a", F.col("low").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a > b").distinct()
        edges = checkpointed(found)
        before, state = state, _mark(edges)
        if state == before:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
