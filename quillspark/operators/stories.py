"""State of stories between batches: assignment, recheck, leases of slots, and the reads a batch starts from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.vector import centroid
from quillspark.operators.dedup import TOPICS
from quillspark.operators.latest import latest
from quillspark.operators.sinks import append_new


def assigned(stories: DataFrame, known: DataFrame, incoming: DataFrame, now: Column, order: Sequence[str] = TOPICS) -> DataFrame:
    """stories(story, topics, centroid, last_report, processed, lifecycle) after articles were assigned to them; new stories are made.

    known, incoming: article, story, vector, topics, published. Topics, old and new, stand in the given order (others are no topics); the centroid is that of all
    articles, the last report only moves forward, and a story with a new article is active. Others stay as they are.
    """
    every = known.select("story", "vector").unionByName(incoming.select("story", "vector"))
    touched = incoming.select("story").distinct()
    centroids = centroid(every.join(touched, "story", "left_semi"), "story", "vector", "_centroid")
    added = incoming.groupBy("story").agg(F.array_distinct(F.flatten(F.collect_list("topics"))).alias("_topics"), F.max("published").alias("_published"))
    joined = stories.join(added.join(centroids, "story"), "story", "full_outer")
    new = F.col("_published").isNotNull()
    no = F.lit(False)
    return joined.select(
        "story",
        F.filter(F.array(*map(F.lit, order)), lambda t: F.coalesce(F.array_contains("topics", t), no) | F.coalesce(F.array_contains("_topics", t), no)).alias("topics"),
        F.coalesce("_centroid", "centroid").alias("centroid"),
        F.greatest("last_report", "_published").alias("last_report"),
        F.when(new, now).otherwise(F.col("processed")).alias("processed"),
        F.when(new, F.lit("active")).otherwise(F.col("lifecycle")).alias("lifecycle"),
    )


def rechecked(stories: DataFrame, versions: DataFrame, found: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The versions to append, and the stories with `processed` set where one was. versions, found: version, story."""
    new = append_new(versions, found, ["version"])
    touched = new.select("story").distinct().withColumn("_new", F.lit(True))
    return new, stories.join(touched, "story", "left").withColumn("processed", F.when(F.col("_new"), now).otherwise(F.col("processed"))).drop("_new")


def leases(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """slot, decision, attempt of each asked(slot, now): already_completed, busy (any slot's lease is alive) or started.

    runs: slot, status, attempt, lease_expires; one row per slot ever run, so few.
    """
    alive = runs.where("status = 'running'").agg(F.max(F.struct("lease_expires", "slot")).alias("m")).select(F.col("m.lease_expires").alias("alive_to"))
    joined = asked.join(runs, "slot", "left").crossJoin(F.broadcast(alive))  # one row
    decision = F.when(F.col("status") == "completed", "already_completed").when(F.col("alive_to") > F.col("now"), "busy").otherwise("started")
    return joined.select("slot", decision.alias("decision"), F.when(decision == "started", F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"))


def allowance(discovery: Column, recheck: Column, limit: int, share: int) -> Column:
    """Requests left for rechecks: of the day's limit and of their own share."""
    return F.least(F.lit(share) - recheck, F.greatest(F.lit(limit) - discovery - recheck, F.lit(0)))


def may_start(discovery: Column, recheck: Column, limit: int, share: int, each: int = 2) -> Column:
    """Whether a recheck may begin: only if all the requests that it can take, a retry included, are left."""
    return allowance(discovery, recheck, limit, share) >= each


def strip(revisions: DataFrame, story: str, number: str, upto: Column) -> DataFrame:
    """Revisions of a story up to a number, each with whether it is the story's latest of all."""
    newest = revisions.groupBy(story).agg(F.max(number).alias("_newest"))
    return revisions.where(F.col(number) <= upto).join(newest, story).withColumn("is_latest", F.col(number) == F.col("_newest")).drop("_newest")


def extendable(revisions: DataFrame, waiting: DataFrame, story: str, number: str, columns: list[str]) -> DataFrame:
    """The latest revision of each story that doesn't wait to be processed again."""
    return latest(revisions.join(waiting.select(story), story, "left_anti"), [story], F.col(number), [number, *columns])


def recheck_targets(versions: DataFrame, article: str, number: str, body: str) -> DataFrame:
    """The latest version of each article, if it has a body."""
    return latest(versions, [article], F.col(number), [number, body]).where(F.col(body).isNotNull())


def last_completed(runs: DataFrame, slot: str, status: str) -> DataFrame:
    return runs.where(F.col(status) == "completed").agg(F.max(slot).alias("last_slot"))


def reused(pending: DataFrame, known: DataFrame) -> DataFrame:
    """key, text, vector of pending(key, text): the vector of an equal text in known(text, vector); null where it must be asked for."""
    texts = known.groupBy("text").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    return pending.join(texts, "text", "left").select("key", "text", "vector")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id of one packet whose quotes share a sentence. Both: packet, id, sentences; sentences meet by equi-join."""
    one, two = (df.select("packet", F.col("id").alias(f"{n}_id"), F.explode("sentences").alias("sentence")) for df, n in ((a, "a"), (b, "b")))
    return one.join(two, ["packet", "sentence"]).select("packet", "a_id", "b_id").distinct()


def usage(calls: DataFrame, stage: str, *amounts: str) -> DataFrame:
    return calls.groupBy(stage).agg(*(F.sum(x).alias(x) for x in amounts))


def failures(errors: DataFrame, message: str, pattern: str) -> DataFrame:
    """stage, n: failures by the stage that their message names."""
    return errors.withColumn("stage", F.regexp_extract(message, pattern, 1)).where("stage <> ''").groupBy("stage").agg(F.count("*").alias("n"))


def confusion(points: DataFrame, classes: list, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """gold, predicted, n of every pair of classes, those that never occur as well."""
    names = points.sparkSession.createDataFrame([(g, p) for g in classes for p in classes], ["gold", "predicted"])  # as many as the metric has classes, squared
    counts = points.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
