"""Changes between versions of a set of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(previous: DataFrame, following: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """keys, change (added, removed, modified, unchanged); columns of the sides are p.* and n.*, `same` compares them."""
    p, n = previous.alias("p"), following.alias("n")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there = [F.col(f"{side}.{keys[0]}").isNotNull() for side in "pn"]
    change = F.when(~there[0], "added").when(~there[1], "removed").when(same, "unchanged").otherwise("modified")
    return p.join(n, on, "full_outer").select(*(F.coalesce(f"n.{k}", f"p.{k}").alias(k) for k in keys), change.alias("change"), F.struct("p.*").alias("previous"), F.struct("n.*").alias("current"))


def version_chain(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before under the key: a version begins."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn("is_new_version", before.isNull() | (before != F.col(value)))


def change_counts(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """Rows per kind for each key, 0 where there is none."""
    return df.groupBy(*keys).agg(*(F.count(F.when(F.col(kind) == k, 1)).alias(f"n_{k}") for k in kinds))


def counts_since(counts: DataFrame, seen: DataFrame, key: str, number: str, values: list[str]) -> DataFrame:
    """Sums of values over the numbers after the last one seen; none seen: none counted."""
    joined = counts.join(seen.withColumnRenamed(number, "_seen"), key)
    return joined.where(F.col(number) > F.col("_seen")).groupBy(key).agg(*(F.sum(v).alias(v) for v in values))


def match_kind(before: str, after: str) -> Column:
    """unchanged, wording_only or substantive from claim_type, modality, evidence_key and text of both sides."""
    same = [F.col(f"{before}.{c}").eqNullSafe(F.col(f"{after}.{c}")) for c in ("claim_type", "modality", "evidence_key")]
    return F.when(~(same[0] & same[1] & same[2]), "substantive").when(F.col(f"{before}.text") == F.col(f"{after}.text"), "unchanged").otherwise("wording_only")


def revision_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """Typed change log of claims(story_id, claim_id, claim_type, modality, evidence_key, text, status).

    Rows are wide: kind (claim, status), claim_change, claim_id, and texts and statuses of both sides.
    """
    d = diff(previous, following, ["story_id", "claim_id"], F.lit(True))
    d = d.withColumn("kind_of_match", F.when(F.col("change") == "unchanged", match_kind("previous", "current")))
    claim = d.withColumn("claim_change", F.when(F.col("change").isin("added", "removed"), F.col("change")).when(F.col("kind_of_match") == "substantive", "modified")).where("claim_change is not null")
    status = d.where((F.col("change") == "unchanged") & (F.col("previous.status") != F.col("current.status")))
    texts = [F.col("previous.text").alias("previous_text"), F.col("current.text").alias("current_text")]
    none = F.lit(None).cast("string")
    return claim.select("story_id", F.lit("claim").alias("kind"), "claim_change", "claim_id", *texts, none.alias("previous_status"), none.alias("current_status")).unionByName(
        status.select("story_id", F.lit("status").alias("kind"), none.alias("claim_change"), "claim_id", none.alias("previous_text"), none.alias("current_text"), F.col("previous.status").alias("previous_status"), F.col("current.status").alias("current_status"))
    )


def sources_added(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(story_id, article_id) that only the following revision has."""
    return following.select("story_id", "article_id").distinct().join(previous.select("story_id", "article_id"), ["story_id", "article_id"], "left_anti")


def text_changes(previous: DataFrame, following: DataFrame) -> DataFrame:
    """(story_id, article_id, article_version_id): articles that both have, in a version that only the following one has."""
    new = following.join(previous, ["story_id", "article_id", "article_version_id"], "left_anti").join(previous.select("story_id", "article_id").distinct(), ["story_id", "article_id"], "left_semi")
    return new.groupBy("story_id", "article_id").agg(F.min("article_version_id").alias("article_version_id"))


def unpivot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, before, after for every field that differs."""
    long = lambda df, name: df.unpivot(key, [F.col(f).cast("string").alias(f) for f in fields], "field", name)
    joined = long(old.select(key, *(F.col(f).cast("string").alias(f) for f in fields)), "before").join(long(new.select(key, *(F.col(f).cast("string").alias(f) for f in fields)), "after"), [key, "field"], "full_outer")
    return joined.where(~F.col("before").eqNullSafe(F.col("after")))
