"""Exact deduplication of collected articles and their version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ident import article_id, version_id

TOPICS = ("korea", "world", "economy", "tech")


def union_topics(topics):  # noqa: ANN001, ANN201
    """Aggregate: the topics of a group in their fixed order."""
    have = F.flatten(F.collect_list(topics))
    return F.filter(F.array(*map(F.lit, TOPICS)), lambda t: F.array_contains(have, t))


def exact_groups(df: DataFrame, ident: str, value: str) -> DataFrame:
    """hash, first id, size of every value that occurs: copies meet by hash, not by text."""
    return df.groupBy(F.sha2(F.coalesce(value, F.lit("")), 256).alias("hash")).agg(F.min(ident).alias("first_id"), F.count("*").alias("n_copies"))


def identify(collected: DataFrame, known: DataFrame) -> DataFrame:
    """collected with `id`: of the known article with its URL, else with its source, title and body, else a new one.

    collected: source_id, url, title, body_hash (normalised), observed_at; known: id, source_id, url, title, body_hash. Two equi-joins stand for the
    OR of both identities. Within a batch the earliest row under (source, title, body) lends its id to the others; a URL has one id.
    """
    by_url = known.select(F.col("url"), F.col("id").alias("id_by_url"))
    merge = ["source_id", "title", "body_hash"]
    by_body = known.where("body_hash is not null").groupBy(*merge).agg(F.min("id").alias("id_by_body"))
    joined = collected.join(by_url, "url", "left").join(by_body, merge, "left")
    own = joined.withColumn("id", F.coalesce("id_by_url", "id_by_body", article_id(F.col("url"))))
    first = F.row_number().over(Window.partitionBy("url").orderBy("observed_at", "id"))
    of_url = own.withColumn("_r", first).where("_r = 1").select("url", *merge, "id", "id_by_url", "observed_at")
    w = Window.partitionBy(*merge).orderBy(F.col("id_by_url").isNull(), "observed_at", "id")
    ids = of_url.withColumn("id", F.coalesce("id_by_url", F.first("id").over(w))).select("url", "id")
    return collected.join(ids, "url")


def versions(identified: DataFrame, latest: DataFrame) -> DataFrame:
    """New versions (id, body_hash, version_id, observed_at): rows whose hash is not that of the row before, the latest known one first."""
    before = F.coalesce(F.lag("body_hash").over(Window.partitionBy("id").orderBy("observed_at", "body_hash")), F.col("known_hash"))
    rows = identified.join(latest.select("id", F.col("body_hash").alias("known_hash")), "id", "left").withColumn("before", before)
    changed = rows.where(F.col("before").isNull() | (F.col("before") != F.col("body_hash")))
    return changed.select("id", "body_hash", version_id(F.col("id"), F.col("body_hash")).alias("version_id"), "observed_at")
