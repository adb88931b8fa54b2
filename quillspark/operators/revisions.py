"""Building, comparing and reading revisions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ident import claim_id, content_hash
from quillspark.operators import latest, status


def build(claims: DataFrame) -> DataFrame:
    """story_id, revision_number, status, claims (in order, new ones with an id of their own), content from claims(story_id, revision_number, n, previous_id, claim_type, modality, evidence_key, text, status).

    content leaves out ids, numbers, times and wording, so that only what counts as a change makes it differ.
    """
    named = claims.withColumn("claim_id", F.coalesce("previous_id", claim_id(F.col("story_id"), F.col("revision_number"), F.col("n"))))
    return named.groupBy("story_id", "revision_number").agg(
        status.story_status(F.col("status"), F.lit(0)).alias("status"),
        F.array_sort(F.collect_list(F.struct("n", "claim_id", "claim_type", "modality", "evidence_key", "text", "status"))).alias("claims"),
        content_hash(F.collect_list(F.struct("claim_type", "modality", "evidence_key", "status"))).alias("content"),
    )


def finalise(candidates: DataFrame, newest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to publish, to confirm): candidates whose content is not, or is, that of the newest revision of their story."""
    before = newest.select("story_id", F.col("content").alias("_before"))
    joined = candidates.join(before, "story_id", "left")
    same = F.col("_before").eqNullSafe(F.col("content"))
    return joined.where(~same).drop("_before"), joined.where(same).select("story_id")


def with_sources(newest: DataFrame, added: DataFrame) -> DataFrame:
    """The newest revision of each story with more sources as its next revision. newest: story_id, revision_number, sources, ...; added: story_id, article_id."""
    more = added.groupBy("story_id").agg(F.collect_set("article_id").alias("_more"))
    new = newest.join(more, "story_id").withColumn("_all", F.concat("sources", F.array_sort(F.array_except("_more", "sources"))))
    grown = new.where(F.size("_all") > F.size("sources"))
    return grown.withColumn("sources", F.col("_all")).withColumn("revision_number", F.col("revision_number") + 1).drop("_more", "_all")


def carried(claims: DataFrame, evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Claims all of whose evidence is in versions without a body any more: they pass to the next revision as they are."""
    gone = evidence.join(versions.select("article_version_id", F.col("body").isNull().alias("_gone")), "article_version_id", "left")
    only = gone.groupBy("claim_id").agg(F.bool_and(F.coalesce("_gone", F.lit(True))).alias("_all")).where("_all")
    return claims.join(only.select("claim_id"), "claim_id", "left_semi")


def reprocess_context(versions: DataFrame, checked: DataFrame, history: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """What work on changed stories needs: current versions per article, articles changed since the check, open conflicts.

    versions: story_id, article_id, article_version_id, captured_at; checked: story_id, checked_at; history, current: story_id, claim_id, revision_number, status.
    """
    newest = latest.latest(versions, ["story_id", "article_id"], F.struct("captured_at", "article_version_id"), ["article_version_id", "captured_at"])
    changed = newest.join(checked, "story_id", "left").where(F.col("checked_at").isNull() | (F.col("captured_at") > F.col("checked_at")))
    return {"current": newest, "changed": changed.drop("checked_at"), "open": latest.last_status(history, current, "claim_id", F.col("revision_number"), "status", "conflict")}


def story_page(revisions: DataFrame, claims: DataFrame, sources: DataFrame, story: Column, number: Column | None = None) -> DataFrame:
    """A story as of a revision (the newest one without a number): its own claims and sources, and whether it is the newest.

    The filter on story and number stands before all joins; excerpts are masked by the sources' present tier.
    """
    own = revisions.where(F.col("story_id") == story)
    newest = own.agg(F.max("revision_number").alias("newest"))
    chosen = own.crossJoin(F.broadcast(newest)).where(F.col("revision_number") == (number if number is not None else F.col("newest")))  # one row
    c = claims.groupBy("story_id", "revision_number").agg(F.array_sort(F.collect_list(F.struct("display_order", "claim_id", "text", "status"))).alias("claims"))
    ids = chosen.select("story_id", "revision_number", F.explode("source_article_ids").alias("article_id"))
    s = ids.join(sources, "article_id").groupBy("story_id", "revision_number").agg(F.array_sort(F.collect_list(F.struct("published_at", "article_id", F.when(F.col("rights_tier") == "body_and_excerpt", F.col("excerpt")).alias("excerpt")))).alias("sources"))
    keys = ["story_id", "revision_number"]
    return chosen.withColumn("is_latest", F.col("revision_number") == F.col("newest")).join(c, keys, "left").join(s, keys, "left").drop("newest")


def compare_drafts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value_a, value_b, agree: items of two drafts (keys, value), those that only one has too."""
    x, y = a.select(*keys, F.col("value").alias("value_a")), b.select(*keys, F.col("value").alias("value_b"))
    return x.join(y, keys, "full_outer").withColumn("agree", F.coalesce(F.col("value_a") == F.col("value_b"), F.lit(False)))


def labels(items: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, label_source: an operator's decision first (an audit where the drafts agreed), else what the drafts agree on; else no value."""
    joined = items.join(decisions.select(*keys, F.col("value").alias("decided")), keys, "left")
    source = F.when(F.col("decided").isNotNull(), F.when(F.col("agree"), "operator_audit").otherwise("operator_decision")).when(F.col("agree"), "model_agreement")
    return joined.select(*keys, F.coalesce("decided", F.when(F.col("agree"), F.col("value_a"))).alias("value"), source.alias("label_source"))


#: Windows of private texts that may be broadcast, and characters of a text that are cut into windows at once.
SMALL_WINDOWS, CUT = 1_000_000, 1_000
#: Private windows that are looked up in a set.
KNOWN_WINDOWS = 250_000


def _leaking(known):  # noqa: ANN001, ANN202
    """The ids of texts that hold a known window: one place of each half is looked up first, then the windows around a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, halves, half, length = known.value

        def leaks(text: str | None) -> bool:
            hits = (j for j in range(0, len(text or "") - half + 1, half) if text[j : j + half] in halves)
            return any(text[i : i + length] in whole for j in hits for i in range(max(0, j - half + 1), j + 1))

        for batch in batches:
            found = pa.array([leaks(x.as_py()) for x in batch.column("text")], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(found)], names=["id"])

    return run


def text_leaks(output: DataFrame, private: DataFrame, length: int = 20) -> DataFrame:
    """output ids with a window of `length` characters that a private text has. Both: id, text; windows meet by equi-join.

    The windows of the private texts are broadcast where they are few; else both sides are shuffled. The windows of the outputs are only
    made where they are not looked up in a set: every window holds a whole half of its length at a multiple of that half.
    """

    def windows(df: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / CUT).cast("int"))
        parts = df.where(F.char_length("text") >= length).select("id", F.explode(F.transform(starts, lambda i: F.substring("text", i * CUT + 1, F.lit(CUT + length - 1)))).alias("part"))
        parts = parts.where(F.char_length("part") >= length)
        return parts.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("part") - length + 1), lambda i: F.substring("part", i, F.lit(length)))).alias("w"))

    secret = windows(private).select("w").distinct()
    count = secret.count()
    if count <= KNOWN_WINDOWS:
        whole = {r.w for r in secret.collect()}  # at most KNOWN_WINDOWS
        half = max(1, length // 2)
        known = output.sparkSession.sparkContext.broadcast((whole, {w[i : i + half] for w in whole for i in range(length - half + 1)}, half, length))
        kind = output.schema["id"].dataType.simpleString()
        return output.select("id", "text").mapInArrow(_leaking(known), f"id {kind}").distinct()
    return windows(output).join(F.broadcast(secret) if count <= SMALL_WINDOWS else secret, "w", "left_semi").select("id").distinct()
