import hashlib
import json
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import times
from quillspark.sources import archive, news, registry
from quillspark.streaming import slots, stateful

EVENTS = "/root/testdata/sf0.001"


def fetch(target):
    """Stands in for HTTP: two pages for one topic, one for the other."""
    page = 2 if target.endswith("page=2") else 1
    return json.dumps({"totalArticles": 30 if "q=one" in target else 3, "articles": [{"page": page}]})


def registered(spark):
    return spark.createDataFrame([("big", ["example.com"], False), ("sub", ["news.example.com"], False), ("bad", ["bad.org"], True)], "id string, domains array<string>, is_excluded boolean")


def test_pages(spark, tmp_path):
    article = lambda n, host: {"id": n, "title": n, "description": None, "content": "c", "url": f"https://{host}/a?x=1", "image": None, "publishedAt": "2024-01-01T00:00:00Z", "source": {"id": "s", "name": "n", "url": "u", "country": None}}
    (tmp_path / "p.json").write_text(json.dumps({"request": {"path": "/search", "params": {"topic": "tech"}}, "status": 200, "body": {"totalArticles": 3, "articles": [article("1", "www.news.example.com"), article("2", "x.bad.org"), article("3", "other.net")]}}))
    got = news.articles(news.read_pages(spark, str(tmp_path)), registered(spark))
    assert sorted((r.external_id, r.source_id, r.topic) for r in got.collect()) == [("1", "sub", "tech"), ("3", "gnews:other.net", "tech")]


def test_news_source_plans_pages(spark, monkeypatch):
    spark.dataSource.register(news.NewsSource)
    df = spark.read.format("news").options(queries=json.dumps({"a": "one", "b": "two"}), fetch="test_sources_streaming:fetch", base="http://x", **{"from": "f", "to": "t"}).load()
    reader = news._NewsReader({"queries": json.dumps({"a": "one", "b": "two"}), "fetch": f"{__name__}:fetch", "base": "http://x", "from": "f", "to": "t"})
    assert df.schema.names == ["topic", "page", "body"]
    assert [(t, p) for part in reader.partitions() for t, p, _ in reader.read(part)] == [("a", 1), ("a", 2), ("b", 1)]


def test_archive(spark, tmp_path):
    row = lambda i, host, title: "\t".join([f"r{i}", "20240102030405", "1", host, f"https://{host}/{i}"] + [""] * 21 + [f"<PAGE_TITLE>{title}</PAGE_TITLE>"])
    data = (row(1, "a.example.com", "Bank of Korea &amp; Seoul") + "\n" + row(2, "bad.org", "Bank of Korea Seoul") + "\n" + "broken\n").encode() + row(3, "b.net", "caf\xe9 Seoul").encode("latin-1")
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", data)
    md5 = hashlib.md5((tmp_path / "f.zip").read_bytes()).hexdigest()
    sums = lambda m: spark.createDataFrame([("f.zip", m)], "name string, md5 string")
    assert archive.zip_lines(spark, str(tmp_path / "f.zip"), sums("0")).count() == 0
    links = archive.links(archive.rows(archive.zip_lines(spark, str(tmp_path / "f.zip"), sums(md5))), registered(spark))
    assert sorted((r.record_id, r.source_id, r.title) for r in links.collect()) == [("r1", "big", "Bank of Korea & Seoul"), ("r3", "gdelt:b.net", "caf\xe9 Seoul")]
    stories = spark.createDataFrame([("s1", ["bank of korea", "seoul"]), ("s2", ["tokyo", "seoul"])], "story string, terms array<string>").withColumns({"start": F.to_timestamp(F.lit("2024-01-01")), "end": F.to_timestamp(F.lit("2024-01-03"))})
    assert [(r.story, r.normalized_url) for r in archive.story_links(links, stories).collect()] == [("s1", "https://a.example.com/1")]
    (tmp_path / "list.txt").write_text("1 x http://h/20240102030000.gkg.zip\n1 x http://h/20240102030000.gkg.zip\n1 y http://h/20250102030000.gkg.zip\nodd\n")
    files = archive.file_list(spark, str(tmp_path / "list.txt"), F.to_timestamp(F.lit("2024-01-01")), F.to_timestamp(F.lit("2024-02-01")))
    assert files.count() == 1


def test_registry_and_recordings(spark, tmp_path):
    one = {"id": "a", "domains": ["x.y"], "name": "n", "region": "r", "ownership": "o", "isWire": False, "language": "en", "isExcluded": False, "rightsTier": "link_only", "checkedOn": "2024-01-01"}
    (tmp_path / "ok.json").write_text(json.dumps([one]))
    (tmp_path / "twice.json").write_text(json.dumps([one, one | {"id": "b"}]))
    assert registry.registered(registry.read_registry(spark, str(tmp_path / "ok.json"))).count() == 1
    try:
        registry.read_registry(spark, str(tmp_path / "twice.json"))
        raise AssertionError
    except ValueError as e:
        assert "x.y" in str(e)
    (tmp_path / "rec").mkdir()
    (tmp_path / "rec/gate.json").write_text(json.dumps({"k1": {"a": 1}, "k2": {"a": 2}}))
    asked = spark.createDataFrame([("gate", "k1"), ("gate", "k9")], "stage string, key string")
    got = {r.key: r for r in registry.replay(asked, registry.recorded(spark, str(tmp_path / "rec"))).collect()}
    assert json.loads(got["k1"].output) == {"a": 1} and got["k9"].failure
    d = registry.drafts(spark.createDataFrame([("x", "q1", "n", None), ("x", "q2", "n", "kr")], "domain string, item string, name string, country string")).first()
    assert (d.item, d.others) == ("q2", ["q1"])


def test_stream_equals_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{EVENTS}/events.parquet").schema
    stream = slots.read_events(spark, EVENTS, "events", schema)
    query = slots.run_slots(stream, lambda df, n: slots.append_batch(df.groupBy(times.slot_key(times.latest_slot(F.col("ts"))).alias("slot")).count(), n, str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = spark.read.parquet(f"{EVENTS}/events.parquet").groupBy(times.slot_key(times.latest_slot(F.col("ts"))).alias("slot")).count()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("slot", "count").collect())) == sorted(map(tuple, batch.collect()))


def test_online_clustering():
    rows = pd.DataFrame({"article": ["a", "b", "c", "d"], "at": [0, 10_000, 20_000, 10**9], "vector": [np.array([1.0, 0]), np.array([1.0, 0.05]), np.array([0, 1.0]), np.array([1.0, 0])]})
    assert list(stateful.fold(rows, stateful.OpenStories()).itertuples(index=False, name=None)) == [("a", "s-a"), ("b", "s-a"), ("c", "s-c"), ("d", "s-d")]
