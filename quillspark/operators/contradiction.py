"""Which quotes of a claim stand for it and which against it, from labels of pairs of quotes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import components
from quillspark.session import settled

KEYS = ["story_id", "claim_key"]


def _linked(evidence: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quotes with a number and their origins, and pairs with the numbers of their quotes (null: a quote of no evidence)."""
    nodes = evidence.groupBy(*KEYS, "quote_id").agg(F.collect_set("origin").alias("origins"))  # a quote's own
    nodes = settled(nodes.withColumn("node", F.monotonically_increasing_id()), "zstd")
    linked = pairs.select(*KEYS, "a", "b", "label")
    for end in "ab":
        linked = linked.join(nodes.select(*KEYS, F.col("quote_id").alias(end), F.col("node").alias(f"_{end}")), [*KEYS, end], "left")
    return nodes, settled(linked, "zstd")


def _twice(pairs: DataFrame, keys: list[str], a: Column, b: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """keys, reason of pairs of a and b with several labels, or none, or incompatible in both directions, or for which a condition
    of another reason holds: all found in one pass."""
    also = also or {}
    accuser = F.when(F.col("label") == "incompatible", a)
    odd = (F.count("label") == 0) | (F.min("label") != F.max("label"))  # one pass, where distinct counts take a row for each
    found = {"not one label for a pair": odd, "incompatible both ways": F.min(accuser) != F.max(accuser)} | {reason: F.bool_or(holds) for reason, holds in also.items()}
    reasons = F.array_compact(F.array(*(F.when(holds, reason) for reason, holds in found.items())))
    by_pair = pairs.groupBy(*keys, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(reasons.alias("reasons"))
    return by_pair.where("size(reasons) > 0").select(*keys, F.explode("reasons").alias("reason"))


def _mismatches(linked: DataFrame) -> DataFrame:
    """story_id, claim_key, reason: claims whose pairs name a quote that isn't theirs, pair a quote with itself, label a pair in
    two ways, or call it incompatible in both directions."""
    also = {"a quote of no evidence": F.expr("a <> b and (_a is null or _b is null)"), "a quote paired with itself": F.expr("a is null or b is null or a = b")}
    return _twice(linked, KEYS, F.col("a"), F.col("b"), also).distinct()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `claim`, the number of the first of their quotes: those of a row are numbered by their places from there on."""
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        sizes = pc.list_value_length(batch.column("quotes")).to_numpy().astype(np.int64)
        ends = at + np.cumsum(sizes)
        at = int(ends[-1]) if len(ends) else at
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - sizes)], names=[*batch.schema.names, "claim"])


def _listed(claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims with a number, their quotes with number and origins, and their pairs by number (null: a quote of no evidence)."""
    kinds = ", ".join(f"{c} {k}" for c, k in claims.select(*KEYS, "quotes", "pairs").dtypes)
    numbered = claims.where("size(quotes) > 0").select(*KEYS, "quotes", "pairs").mapInArrow(_placed, f"{kinds}, claim long")
    place = lambda q: F.nullif(F.array_position(F.transform("quotes", lambda x: x["quote_id"]), q), F.lit(0)) - 1 + F.col("claim")
    pairs = F.transform("pairs", lambda p: F.struct(place(p["a"]).alias("_a"), place(p["b"]).alias("_b"), (p["a"].isNull() | p["b"].isNull() | (p["a"] == p["b"])).alias("itself"), p["label"].alias("label")))
    origins = F.transform("quotes", lambda x: x["origins"])
    numbered = settled(numbered.select(*KEYS, "claim", origins.alias("_origins"), pairs.alias("pairs")), "zstd")
    nodes = numbered.select("claim", F.posexplode("_origins").alias("_n", "origins")).select("claim", (F.col("claim") + F.col("_n")).alias("node"), "origins")
    return numbered, nodes, numbered.select("claim", F.inline("pairs"))


def _unlike(numbered: DataFrame) -> DataFrame:
    """claim, reason as _mismatches() finds them: pairs are looked at in their claim, and only those of claims that repeat one are grouped."""
    strange = F.exists("pairs", lambda p: ~p["itself"] & (p["_a"].isNull() | p["_b"].isNull()))
    itself = F.exists("pairs", lambda p: p["itself"])
    known = numbered.withColumn("pairs", F.filter("pairs", lambda p: ~p["itself"] & p["_a"].isNotNull() & p["_b"].isNotNull()))
    ends = F.transform("pairs", lambda p: F.struct(F.least(p["_a"], p["_b"]).alias("x"), F.greatest(p["_a"], p["_b"]).alias("y")))
    again = known.where((F.size(F.array_distinct(ends)) < F.size("pairs")) | F.exists("pairs", lambda p: p["label"].isNull()))
    found = _twice(again.select("claim", F.inline("pairs")), ["claim"], F.col("_a"), F.col("_b"))
    single = [numbered.where(of).select("claim", F.lit(reason).alias("reason")) for of, reason in ((strange, "a quote of no evidence"), (itself, "a quote paired with itself"))]
    return reduce(DataFrame.unionByName, [*single, found]).distinct()


def _sides(nodes: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, origins, supports, opposes of nodes(keys, node, origins).

    An incompatible pair sets its first quote on the claim's side and its second against it; agreement carries both on. In a
    claim without such a pair all quotes that agree with one are on its side, and so is a quote that stands alone.
    """
    linked = linked.where("label in ('agree', 'incompatible')").select(F.col("_a").alias("a"), F.col("_b").alias("b"), (F.col("label") == "agree").alias("agree"))
    ends = F.inline(F.array(F.struct(F.col("a").alias("node"), ~F.col("agree")), F.struct(F.col("b").alias("node"), F.lit(False))))
    marks = linked.select("agree", ends.alias("node", "_for")).groupBy("node").agg(F.bool_or("agree").alias("_paired"), F.bool_or("_for").alias("_for"), F.bool_or(~F.col("agree") & ~F.col("_for")).alias("_against"))
    grown = settled(marks.join(components(linked.where("agree").select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node")), "zstd")
    sides = grown.where("_for or _against").groupBy("component").agg(F.bool_or("_for").alias("_for"), F.bool_or("_against").alias("_against"))
    marked = settled(nodes.join(grown.select("node", "_paired", "component").join(sides, "component", "left").drop("component"), "node", "left"), "zstd")
    no = F.lit(False)
    claims = marked.groupBy(*keys).agg(F.count("*").alias("_size"), F.coalesce(F.bool_or("_for"), no).alias("_torn"))
    calm = ~F.col("_torn") & F.coalesce("_paired", no)
    return marked.join(claims, keys).select(*keys, "origins", (F.coalesce("_for", no) | calm | (F.col("_size") == 1)).alias("supports"), F.coalesce("_against", no).alias("opposes"))


def judged(evidence: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(story_id, claim_key, supporting, conflicting, undeterminable; story_id, claim_key, reason of claims judged wrongly).

    evidence: story_id, claim_key, quote_id, origin; pairs: story_id, claim_key, a, b, label (agree, incompatible, unrelated,
    undeterminable). Origins on both sides are one origin that corrected itself: they count as supporting only. No origin: null.
    Names are shuffled to number the quotes; after that numbers are, and a quote's origins stay with it.
    """
    nodes, linked = _linked(evidence, pairs)
    return _verdicts(nodes, linked, settled(_mismatches(linked), "zstd"), KEYS)


def judged_lists(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As judged(), of claims(story_id, claim_key, quotes array<struct<quote_id, origins>>, pairs array<struct<a, b, label>>), one row a
    claim, quotes without repeats: names are looked up within their row, so that numbers alone are shuffled."""
    numbered, nodes, linked = _listed(claims)
    names = numbered.select("claim", *KEYS)
    good, wrong = _verdicts(nodes, linked, settled(_unlike(numbered), "zstd"), ["claim"])
    return names.join(good, "claim").drop("claim"), names.join(wrong, "claim").drop("claim")


def _verdicts(nodes: DataFrame, linked: DataFrame, wrong: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What judged() returns, by keys: of nodes(keys, node, origins), linked(keys, _a, _b, label) and wrong(keys, reason)."""
    judged_wrongly = wrong.select(*keys).distinct()
    fair = linked.join(judged_wrongly, keys, "left_anti")
    sides = settled(_sides(nodes.join(judged_wrongly, keys, "left_anti"), fair, keys), "zstd")
    torn = sides.where("supports and opposes").select(*keys, F.lit("a quote on both sides").alias("reason")).distinct()
    by_origin = sides.select(*keys, F.explode_outer("origins").alias("origin"), "supports", "opposes").groupBy(*keys, "origin").agg(F.bool_or("supports").alias("s"), F.bool_or("opposes").alias("o"), F.bool_or(F.col("supports") & F.col("opposes")).alias("t"))
    known = F.col("origin").isNotNull()
    counts = by_origin.groupBy(*keys).agg(F.count_if(known & F.col("s")).alias("supporting"), F.count_if(known & F.col("o") & ~F.col("s")).alias("conflicting"), F.bool_or("t").alias("_torn"))
    unsure = fair.where("label = 'undeterminable'").select(*keys).distinct().withColumn("undeterminable", F.lit(True))
    every = counts.where("not _torn").join(unsure, keys, "left")
    return every.select(*keys, "supporting", "conflicting", F.coalesce("undeterminable", F.lit(False)).alias("undeterminable")), wrong.unionByName(torn)
