"""Unions, intersections and Jaccard similarity of half-open spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_of(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Touching and overlapping spans of a key as one: an island begins where a span starts beyond all ends before it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(end) > F.col(start)).withColumn("_new", (before.isNull() | (F.col(start) > before)).cast("int"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def continuity(previous: DataFrame, following: DataFrame) -> DataFrame:
    """story_id, p, n, score, anchor: the best Jaccard similarity of the span unions of two claims in one version, and its overlap.

    Both: story_id, claim, claim_type, version, start, end. Only claims of one type with a common version meet.
    """
    keys = ["story_id", "claim", "claim_type", "version"]
    a, b = union_of(previous, keys), union_of(following, keys)
    sizes = [x.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("size")) for x in (a, b)]
    on = ["story_id", "claim_type", "version"]
    overlap = F.least("pe", "ne") - F.greatest("ps", "ns")
    left, right = a.withColumnsRenamed({"claim": "p", "start": "ps", "end": "pe"}), b.withColumnsRenamed({"claim": "n", "start": "ns", "end": "ne"})
    common = left.join(right, on).where(overlap > 0).groupBy(*on, "p", "n").agg(F.sum(overlap).alias("common"))
    common = common.join(sizes[0].withColumnsRenamed({"claim": "p", "size": "p_size"}), [*on, "p"]).join(sizes[1].withColumnsRenamed({"claim": "n", "size": "n_size"}), [*on, "n"])
    scored = common.withColumn("score", F.col("common") / (F.col("p_size") + F.col("n_size") - F.col("common")))
    best = scored.groupBy("story_id", "p", "n").agg(F.max(F.struct("score", "common")).alias("b"))
    return best.select("story_id", "p", "n", "b.score", F.col("b.common").alias("anchor"))
