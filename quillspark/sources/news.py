"""News pages: replayed API responses, requests, and a data source that plans one partition per topic and page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillspark.functions import url

ARTICLE = "struct<id:string,title:string,description:string,content:string,url:string,image:string,publishedAt:timestamp,source:struct<id:string,name:string,url:string,country:string>>"
RESPONSE = f"request struct<path:string,params:map<string,string>>, status int, body struct<totalArticles:int,articles:array<{ARTICLE}>>"
PAGE_SIZE, MOST_PAGES = 25, 2


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses; one that does not fit the schema is an error."""
    return spark.read.schema(RESPONSE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def collection_window(previous: Column, slot: Column) -> tuple[Column, Column]:
    """From an hour before the previous slot, so that late articles are read again, to this one."""
    return previous - F.expr("interval 1 hour"), slot


def request_url(base: str, query: str, start: str, end: str, page: int) -> str:
    return f"{base}?{urlencode({'q': query, 'lang': 'en', 'max': PAGE_SIZE, 'sortby': 'publishedAt', 'from': start, 'to': end, 'page': page})}"


def needed_pages(total: Column) -> Column:
    """A second page only where the first did not hold all."""
    return F.least(F.lit(MOST_PAGES), F.greatest(F.lit(1), F.ceil(total / PAGE_SIZE))).cast("int")


def with_source(rows: DataFrame, registry: DataFrame, column: str, prefix: str) -> DataFrame:
    """rows with source_id: of the longest registered domain that ends the URL's host, else made from prefix and host; excluded sources are marked.

    registry: id, domains, is_excluded. Hosts are expanded to their parents, so the match is an equi-join.
    """
    domains = registry.select("id", "is_excluded", F.explode("domains").alias("domain"))
    hosts = rows.select(url.host_of(F.col(column)).alias("host")).distinct().where("host is not null")
    best = hosts.select("host", F.explode(url.host_suffixes(F.col("host"))).alias("domain")).join(domains, "domain").groupBy("host").agg(F.max_by(F.struct("id", "is_excluded"), F.length("domain")).alias("s"))
    return rows.withColumn("host", url.host_of(F.col(column))).join(best, "host", "left").withColumn("source_id", F.coalesce("s.id", F.concat(F.lit(prefix), "host"))).withColumn("is_excluded", F.coalesce("s.is_excluded", F.lit(False))).drop("s")


def articles(pages: DataFrame, registry: DataFrame, topic: Column | None = None) -> DataFrame:
    """One row per article, excluded sources left out."""
    topic = topic if topic is not None else F.element_at("request.params", "topic")
    rows = pages.where("status = 200").select(topic.alias("topic"), F.explode("body.articles").alias("a"))
    flat = rows.select("topic", F.col("a.id").alias("external_id"), "a.title", "a.description", F.col("a.content").alias("raw_body"), "a.url", url.image_url(F.col("a.image")).alias("image_url"), F.col("a.publishedAt").alias("published_at"))
    return with_source(flat, registry, "url", "gnews:").where("not is_excluded").drop("is_excluded")


def recheck_match(found: DataFrame, targets: DataFrame) -> DataFrame:
    """article_id, outcome, raw_body: the first result under the target's URL, else unconfirmed. found: article_id, pos, url, raw_body."""
    same = found.withColumn("normalized", url.normalize_url(F.col("url"))).join(targets.select("article_id", F.col("normalized_url").alias("normalized")), ["article_id", "normalized"])
    first = same.groupBy("article_id").agg(F.min_by("raw_body", "pos").alias("raw_body"))
    return targets.select("article_id").join(first, "article_id", "left").withColumn("outcome", F.when(F.col("raw_body").isNotNull(), "found").otherwise("unconfirmed"))


class NewsSource(DataSource):
    """format("news"): reads pages by topic with one retry; `fetch` takes the place of HTTP in options["module"] as module:function."""

    @classmethod
    def name(cls) -> str:
        return "news"

    def schema(self) -> str:
        return "topic string, page int, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _NewsReader(self.options)


class _Page(InputPartition):
    def __init__(self, topic: str, query: str) -> None:
        self.topic, self.query = topic, query


class _NewsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_Page(k, v) for k, v in json.loads(self.options["queries"]).items()]

    def read(self, partition: _Page) -> Iterator[tuple]:
        from importlib import import_module

        module, name = self.options["fetch"].split(":")
        fetch = getattr(import_module(module), name)
        pages = 1
        for page in range(1, MOST_PAGES + 1):
            if page > pages:
                return
            target = request_url(self.options["base"], partition.query, self.options["from"], self.options["to"], page)
            try:
                body = fetch(target)
            except OSError:
                body = fetch(target)  # once more; a second failure ends this topic's task
            pages = 2 if json.loads(body).get("totalArticles", 0) > PAGE_SIZE * page else page
            yield partition.topic, page, body
