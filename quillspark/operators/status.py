"""Status rules of claims and stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("single_source", "multi_agree", "conflict", "resolved", "corrected")


def claim_status(previous: Column, verified: Column, undeterminable: Column, supporting: Column, conflicting: Column, correction: Column, resolution: Column) -> Column:
    """A struct of publish, status and guard (1 to 6): the first guard that holds decides.

    1 holds a claim back; 2 conflict, also while an episode is open and nothing settles it; 3 corrected; 4 resolved; 5 several origins; 6 one.
    """
    opened = F.coalesce(previous == "conflict", F.lit(False))
    guard = (
        F.when(undeterminable | ~verified | (supporting <= 0), 1)
        .when((conflicting >= 1) | (opened & ~(correction | resolution)), 2)
        .when(correction, 3)
        .when(resolution & opened, 4)
        .when(supporting >= 2, 5)
        .otherwise(6)
    )
    names = F.array(*(F.lit(s) for s in (None, "conflict", "corrected", "resolved", "multi_agree", "single_source")))
    return F.struct((guard > 1).alias("publish"), F.element_at(names, guard).alias("status"), guard.alias("guard"))


def story_status(status: Column, open_episodes: Column) -> Column:
    """Aggregate: the status of a story from those of its claims."""
    any_ = lambda s: F.bool_or(status == s)
    return (
        F.when((open_episodes > 0) | any_("conflict"), "conflict")
        .when(any_("corrected"), "corrected")
        .when(any_("resolved"), "resolved")
        .when(any_("single_source"), "single_source")
        .otherwise("multi_agree")
    )


def status_counts(df: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    return df.groupBy(*keys).agg(*(F.count(F.when(F.col(status) == s, 1)).alias(s) for s in STATUSES))


def origins(wire: Column, source: Column, tier: Column) -> Column:
    """Aggregate: distinct reporting origins, link-only sources left out."""
    return F.countDistinct(F.when(tier != "link_only", F.coalesce(wire, source)))


# What a gate label does with its quote.
GATE_EFFECT = {"supported": "support", "conflicting": "oppose", "partial": "discard", "unsupported": "discard", "undeterminable": "discard"}


def gate_effect(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, effect in GATE_EFFECT.items():
        out = F.when(label == name, effect).otherwise(out)
    return out


def gate_two(labels: DataFrame) -> DataFrame:
    """story_id, claim_id, publish, kept quotes, valid from (story_id, claim_id, quote_id, label): every quote judged exactly once.

    One shuffle by claim: quotes judged twice show by the claim's own lists, where a distinct count takes a shuffle by quote before.
    """
    effect = gate_effect(F.col("label"))
    strong = F.coalesce(effect.isin("support", "oppose"), F.lit(False))
    kept, others = F.collect_list(F.when(strong, F.col("quote_id"))), F.collect_set(F.when(~strong, F.col("quote_id")))
    return labels.groupBy("story_id", "claim_id").agg(
        F.bool_or(effect == "support").alias("publish"),
        F.array_sort(kept).alias("kept"),
        ((F.count("quote_id") == F.size(F.array_union(kept, others))) & F.bool_and(effect.isNotNull())).alias("valid"),
    )


def sides(pairs: DataFrame) -> DataFrame:
    """claim_id, quote, side: quotes that an incompatible pair sets apart, and what agrees with them.

    pairs: claim_id, a, b, label. The lesser quote of an incompatible pair is on side 0 with all that agreement reaches from it; the others are on side 1.
    Reached quotes spread by joins until nothing is new; a claim's quotes are few, so rounds are few.
    """
    seeds = pairs.where("label = 'incompatible'").select("claim_id", F.least("a", "b").alias("quote")).distinct()
    agree = pairs.where("label = 'agree'").select("claim_id", "a", "b")
    edges = agree.unionByName(agree.select("claim_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached, n = seeds.checkpoint(), -1
    while (found := reached.count()) != n:
        n = found
        more = edges.join(reached.withColumnRenamed("quote", "a"), ["claim_id", "a"]).select("claim_id", F.col("b").alias("quote"))
        reached = reached.unionByName(more).distinct().checkpoint()
    other = pairs.where("label = 'incompatible'").select("claim_id", F.greatest("a", "b").alias("quote")).distinct().join(reached, ["claim_id", "quote"], "left_anti")
    return reached.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1)))
