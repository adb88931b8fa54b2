"""The registry of sources, recorded model responses, and fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCE = "id string, domains array<string>, name string, region string, ownership string, isWire boolean, language string, isExcluded boolean, rightsTier string, basisUrl string, checkedOn string, wikidataId string"


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registered sources; an id or domain given twice is an error."""
    rows = spark.read.schema(SOURCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    domains = rows.select(F.explode("domains").alias("name")).groupBy("name").count().where("count > 1")
    twice = rows.groupBy(F.col("id").alias("name")).count().where("count > 1").unionByName(domains).limit(5).collect()
    if twice:
        raise ValueError(f"given twice: {', '.join(sorted(r.name for r in twice))}")
    return rows.select("id", "domains", "name", "region", "ownership", F.col("isWire").alias("is_wire"), "language", F.col("isExcluded").alias("is_excluded"), F.col("rightsTier").alias("rights_tier"))


def registered(sources: DataFrame) -> DataFrame:
    return sources.where(F.size("domains") > 0)


def sparql_query(domains: list[str]) -> str:
    """The query for the official sites of domains, with and without www and the closing slash."""
    sites = " ".join(f"<{scheme}://{www}{d}{slash}>" for d in domains for scheme in ("http", "https") for www in ("", "www.") for slash in ("", "/"))
    return f"SELECT ?item ?site ?label ?country ?owner WHERE {{ VALUES ?site {{ {sites} }} ?item wdt:P856 ?site . }}"


def drafts(bindings: DataFrame) -> DataFrame:
    """domain, item, names, countries, others: the item with most filled fields per domain. bindings: domain, item, name, country."""
    items = bindings.groupBy("domain", "item").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("country")).alias("countries"))
    filled = items.withColumn("filled", F.size("names") + F.size("countries"))
    w = Window.partitionBy("domain").orderBy(F.desc("filled"), "item")
    ranked = filled.withColumn("r", F.row_number().over(w)).withColumn("others", F.collect_list("item").over(Window.partitionBy("domain")))
    return ranked.where("r = 1").select("domain", "item", "names", "countries", F.array_remove("others", F.col("item")).alias("others"))


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """stage, key, output (JSON) of recorded responses, one file per stage; a key given twice is an error."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("stage", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    pairs = raw.select("stage", F.explode(F.from_json("value", "map<string,string>")).alias("key", "output"))
    twice = pairs.groupBy("stage", "key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"recorded twice: {twice[0].stage} {twice[0].key}")
    return pairs


def replay(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests(stage, key, ...) with output, and failure where there is none."""
    return requests.join(responses, ["stage", "key"], "left").withColumn("failure", F.when(F.col("output").isNull(), F.concat(F.lit("no response for "), "stage", F.lit(" "), "key")))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
