"""What readers see: cards, feeds and masked excerpts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(sources: Column, deferred: Column, articles: Column, topic_rank: Column, ident: Column) -> list[Column]:
    """Order of work: several sources first, then what was deferred (the oldest first), then many articles, then topic and id."""
    return [F.desc((sources >= 2).cast("int")), deferred.asc_nulls_last(), articles.desc(), topic_rank.asc(), ident.asc()]


def masked(excerpt: Column, tier: Column) -> Column:
    """The excerpt where the source's present tier allows it."""
    return F.when(tier == "body_and_excerpt", excerpt)


def followed(stories: DataFrame, story_follows: DataFrame, topic_follows: DataFrame) -> DataFrame:
    """(user, story): stories followed themselves or by a topic; stories: story, topics.

    The OR of both ways is a union of two equi-joins; topics are few, so that side follows users, not pairs of all.
    """
    direct = story_follows.join(stories, "story").select("user", "story")
    by_topic = stories.select("story", F.explode("topics").alias("topic")).join(topic_follows, "topic").select("user", "story")
    return direct.unionByName(by_topic).distinct()


def followed_counts(stories: DataFrame, own: DataFrame, topics: DataFrame) -> DataFrame:
    """user, n, first_story of what `followed` lists, for stories(story, topic) of one topic each, without listing it.

    own: user, story; topics: user, topic. Stories are counted by topic first; own stories count where their topic isn't followed.
    """
    by_topic = stories.groupBy("topic").agg(F.count("*").alias("n"), F.min("story").alias("first_story"))
    topics = topics.distinct()
    apart = own.distinct().join(stories, "story").join(topics, ["user", "topic"], "left_anti").select("user", F.lit(1).alias("n"), F.col("story").alias("first_story"))
    every = topics.join(by_topic, "topic").select("user", "n", "first_story").unionByName(apart)
    return every.groupBy("user").agg(F.sum("n").alias("n"), F.min("first_story").alias("first_story"))


def feed_order(has_changes: Column, updated: Column, ident: Column) -> list[Column]:
    return [F.desc(has_changes), F.desc(updated), ident.asc()]


def lead_item(items: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The value of each key's earliest item that has one; items with a null in `order` don't count, and null where none does.

    min_by keeps any of equal items, so `order` should tell all apart.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (value, *order)])
    return items.groupBy(key).agg(F.min_by(value, F.when(known, F.struct(*order))).alias(value))
