"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.session import staged


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; root is the smallest node it reaches.

    Each round hangs every node below its smallest neighbour, first over larger neighbours, then
    over smaller ones, so the rounds grow with the logarithm of the longest chain. A round
    aggregates minima per node, which combines before the shuffle, and joins them to the links, where
    a hub is one row on one side and its links on the other (AQE splits that partition). Each
    round is written to the shared folder, which cuts the lineage and outlives executors.
    Links with a null end or from a node to itself add nothing; nulls are dropped, a
    lone node linked to itself is its own root.
    """
    given = links.select(F.col(first).alias("a"), F.col(second).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = given.select("a").union(given.select("b")).distinct()
    edges = given.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(larger.distinct(), "links")
        # each row already points from the larger node to a smaller one
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        smaller = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(smaller.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return nodes.join(edges, "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("root"))
