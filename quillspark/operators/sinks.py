"""Mutations as pure functions: from the state and what comes in to the new state, or to the rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(state: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key the state has not: append these, and doing so twice changes nothing."""
    return incoming.dropDuplicates(keys).join(state.select(*keys), keys, "left_anti")


def upsert(state: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """The state with columns taken from incoming where it has a value; of keep_old only where the state has none."""
    new = incoming.select(*keys, F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = state.join(new, keys, "full_outer")
    value = lambda c: F.coalesce(c, f"_{c}") if c in keep_old else F.coalesce(f"_{c}", c)
    return joined.select(*keys, *(value(c).alias(c) if c in columns else F.col(c) for c in state.columns if c not in keys))


def update_where(state: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return state.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def earliest(state: DataFrame, seen: DataFrame, key: str, time: str) -> DataFrame:
    """The state with the least time of a key, seen or known; nulls don't count."""
    least = seen.groupBy(key).agg(F.min(time).alias("_seen"))
    return state.join(least, key, "left").withColumn(time, F.least(time, "_seen")).drop("_seen")


def latest_visit(events: DataFrame, keys: list[str], number: str, columns: list[str]) -> DataFrame:
    """The last-seen row per key: it only moves to later numbers."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), number).alias("_v")).select(*keys, "_v.*")


def toggled(events: DataFrame, keys: list[str], time: Column, on: Column) -> DataFrame:
    """Keys whose last event is on: follows without those taken back."""
    return events.groupBy(*keys).agg(F.max_by(on, time).alias("_on")).where("_on").drop("_on")


def without(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def expire_oldest(state: DataFrame, value: str, expires: Column, now: Column, key: str, limit: int) -> DataFrame:
    """The state with value null in the first `limit` rows past their time, oldest first."""
    due = (expires <= now) & F.col(value).isNotNull()
    chosen = state.where(due).orderBy(expires, key).limit(limit).select(key, F.lit(True).alias("_gone"))
    return state.join(F.broadcast(chosen) if limit <= 100_000 else chosen, key, "left").withColumn(value, F.when(F.col("_gone"), None).otherwise(F.col(value))).drop("_gone")


def purge(state: DataFrame, expires: str, now: Column) -> DataFrame:
    return state.where(F.col(expires) > now)


def defer(stories: DataFrame, deferred: str, chosen: DataFrame, key: str, now: Column, hours: int = 48) -> DataFrame:
    """Chosen stories stamped once; again only when the stamp is older than 48 hours."""
    fresh = F.col(deferred).isNotNull() & (F.col(deferred) >= now - F.make_dt_interval(hours=F.lit(hours)))
    marked = stories.join(chosen.select(key, F.lit(True).alias("_mark")).distinct(), key, "left")
    return marked.withColumn(deferred, F.when(F.col("_mark") & ~fresh, now).otherwise(F.col(deferred))).drop("_mark")


def ledger(state: DataFrame, requests: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Counts per key added up."""
    return state.select(key, *counts).unionByName(requests.select(key, *counts)).groupBy(key).agg(*(F.sum(c).alias(c) for c in counts))


def repoint(evidence: DataFrame, articles: DataFrame, key: str, column: str) -> DataFrame:
    """evidence with its article's present value of the column."""
    now = articles.select(key, F.col(column).alias("_now"))
    return evidence.join(now, key, "left").withColumn(column, F.coalesce("_now", column)).drop("_now")


def flatten(revisions: DataFrame) -> dict[str, DataFrame]:
    """Nested revisions(id, claims array of struct with evidence array) as claims and evidence, by order."""
    claims = revisions.select(F.col("id").alias("revision_id"), F.posexplode("claims").alias("display_order", "c"))
    evidence = claims.select("revision_id", F.col("c.id").alias("claim_id"), F.posexplode("c.evidence").alias("evidence_order", "e"))
    return {"claims": claims.select("revision_id", "display_order", "c.*").drop("evidence"), "evidence": evidence.select("revision_id", "claim_id", "evidence_order", "e.*")}


def nest(rows: DataFrame, keys: list[str], order: str, into: str) -> DataFrame:
    """Rows as an array of structs per key, by order."""
    columns = [order, *(c for c in rows.columns if c not in [*keys, order])]
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(into))


def cache_tags(stories: DataFrame, chunk: int = 500) -> DataFrame:
    """chunk, tags: the tags of stories(story_id, revision_id) in chunks of 500."""
    tags = stories.select(F.explode(F.array(F.concat(F.lit("story:"), "story_id"), F.concat(F.lit("revision:"), "revision_id"))).alias("tag")).distinct()
    numbered = tags.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("tag")) - 1) / chunk))
    return numbered.groupBy("chunk").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
