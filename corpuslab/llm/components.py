"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import staged


def _smallest(pairs: DataFrame) -> DataFrame:
    """node -> the smallest of itself and its neighbours; merged in the map tasks first."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _star(pairs: DataFrame) -> DataFrame:
    """Every neighbour with the smallest node around ``u``. Nodes with many neighbours are a join
    key of many rows; the joined table has one row per node, and adaptive joins split such keys."""
    return pairs.join(_smallest(pairs), "u")


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node that has a link.

    Each round attaches all larger neighbours of a node to the smallest node around it, then all
    smaller ones; it ends when no link changes. Links to itself and repeated links do no harm.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = staged(edges.filter("u > v").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u > v").distinct(), "large-star")
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = staged(small.filter("u > v").distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("the links did not settle")
