"""Connected components of any size by star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import settled


def _both_ends(edges: DataFrame, a: str, of_a: Column, b: str, of_b: Column) -> DataFrame:
    """Two rows (a, b) of each edge, made in one pass: one of its end a with a value, one of its end b with a value."""
    row = lambda end, value: F.struct(F.col(end).alias(a), value.alias(b))
    return edges.select(F.inline(F.array(row("a", of_a), row("b", of_b))))


def _hung(edges: DataFrame) -> DataFrame:
    """Each greater neighbour of a node hung to the least one around that node. Edges run from the greater end a to the lesser b."""
    around = _both_ends(edges, "a", F.col("b"), "b", F.col("a"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    greater = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return greater.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _pulled(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours hung to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, which itself hangs on none: the next steps would change nothing."""
    of = _both_ends(edges, "node", F.lit(1), "hangs", F.lit(0)).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least"))
    return of.where("hangs > 1 or hangs = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of edges(a, b); an edge from a node to itself keeps the node.

    Both steps in turn until all are stars, which takes about log squared of the longest chain; no list of neighbours
    is ever built, only their least. Rows with a null end are left out.
    """
    given = settled(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stars = given.where("a <> b")
    while not _are_stars(stars):
        stars = settled(_pulled(_hung(stars)))
    every = _both_ends(stars, "node", F.col("b"), "component", F.col("b"))  # what hangs, and centres
    every = every.unionByName(given.where("a = b").select(F.col("b").alias("node"), F.col("b").alias("component")))  # edges from a node to itself
    return every.groupBy("node").agg(F.min("component").alias("component"))
