"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is a pair of aggregations and joins over the links; the driver sees counts only. Links
are written between rounds, which cuts the plan and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import written


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round over pairs (u, v): around every u, its neighbours move to the smallest node."""
    lowest = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
    joined = pairs.join(lowest, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component): the smallest node each linked node can reach.

    Links to itself and repeated links are allowed. Missing ends are not. An empty table gives an
    empty result.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = _print_of(edges)
    while before[0]:
        edges = written(_star(_both_ways(edges), True).filter("a <> b").distinct(), "large")
        downward = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = written(_star(downward, False).filter("a <> b").distinct(), "small")
        now = _print_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
