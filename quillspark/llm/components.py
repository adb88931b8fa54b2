"""Connected components of verified links by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize

#: Links that one part of a table of links has, about.
PART = 500_000


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes in links(a, b), a and b of one ordered type.

    Each round links every larger neighbour of a node to its least neighbour, then every smaller one;
    paths shorten at least by half in two rounds, and rounds end when no link changes. A node of many links is spread: the least
    neighbour is a partial aggregate, joined to the links with the join's skew left to the adaptive plan.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-links")
    before = _digest(edges)
    while True:
        small = materialize(_star(_star(edges, larger=True), larger=False).distinct().coalesce(1 + before[0] // PART), "cc-round")
        discard(edges)
        edges, now = small, _digest(small)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.groupBy("node").agg(F.min("component").alias("component")).unionByName(roots)


def extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after more links(a, b): components of components, so that only what is joined anew takes part."""
    one, two = (joined.select(F.col("node").alias(k), F.col("component").alias(f"of_{k}")) for k in "ab")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    more = materialize(components(between), "cc-more")
    moved = joined.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(more.join(joined, "node", "left_anti"))


def _digest(edges: DataFrame) -> tuple:
    """A number of the set of links, whatever their order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller and the node itself) neighbours of each node to the least of its neighbourhood."""
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v")
