"""State that goes on from one micro-batch to the next."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.streaming import stateful

START = datetime(2024, 1, 1, 3)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, batches, schema, through, at, name):
    """What a stream gives whose micro-batches are these lists of rows; and how many rows of state are left."""
    for i, rows in enumerate(batches):
        folder = at / "in" / f"{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i * 10,) * 2)
            f.rename(at / "in" / f"{i}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(at / "in"))
    q = through(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    left = [p for p in q.recentProgress if p.stateOperators]
    return spark.table(name).collect(), left[-1].stateOperators[0].numRowsTotal


def test_stories_go_on_in_the_next_batch(rocks, tmp_path):
    r = np.random.default_rng(4)
    centres = np.eye(4)
    rows = []
    for i in range(60):
        v = centres[i % 4] + r.normal(0, 0.05, 4)
        rows.append((f"a{i:02}", START + timedelta(hours=i), v.tolist(), "x" if i % 3 else "y"))
    schema = "article string, published_at timestamp, vector array<double>, topic string"
    through = lambda s: stateful.cluster_stream(s, "topic")
    whole, _ = streamed(rocks, [rows], schema, through, tmp_path / "one", "whole")
    split, _ = streamed(rocks, [rows[:17], rows[17:40], rows[40:]], schema, through, tmp_path / "three", "split")
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split)) and len(whole) == 60
    assert len({x.story for x in split}) == 8  # four in each topic
    at_once = stateful.cluster_batch(rocks.createDataFrame(rows, schema), "topic").collect()
    assert sorted(map(tuple, at_once)) == sorted(map(tuple, split))


def test_stories_close_and_are_dropped(rocks, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    one = [1.0, 0.0]
    rows = [[("a", at(0), one, "x"), ("b", at(71), one, "x")], [("c", at(71 + 72), one, "x"), ("d", at(71 + 72 + 73), one, "x")], [("z", at(900), one, "y")], [("y", at(901), one, "y")]]
    got, left = streamed(rocks, rows, "article string, published_at timestamp, vector array<double>, topic string", lambda s: stateful.cluster_stream(s, "topic"), tmp_path, "closing")
    assert {x.article: x.story for x in got} == {"a": "s-a", "b": "s-a", "c": "s-a", "d": "s-d", "z": "s-z", "y": "s-z"}
    assert left < 8  # topic x holds nothing any more


def test_a_lead_and_equal_stories():
    s = stateful.OpenStories([("s-1", [1.0, 0.0], [1.0, 0.0], 0), ("s-2", [0.99, 0.05], [1.0, 0.0], 0)])
    assert s.take("n", 5, np.array([1.0, 0.02])) == "s-n"  # two stories are as near
    assert stateful.OpenStories([("s-1", [0.0, 0.0], [0.0, 0.0], 0)]).take("n", 1, np.array([0.0, 0.0])) == "s-n"
    assert stateful.fold(pd.DataFrame({"article": [], "at": [], "vector": []}), stateful.OpenStories()).empty


ASK = "kind string, ident string, user string, at timestamp, action string, amount double"


def test_admission_is_all_or_nothing(rocks, tmp_path):
    s = lambda n: START + timedelta(seconds=n)
    ask = lambda i, u, n, a=1.0: ("k", i, u, s(n), "ask", a)
    paid = lambda i, u, n, a: ("k", i, u, s(n), "settle", a)
    batches = [
        [ask("1", "u", 0), ask("2", "u", 1), ask("3", "u", 2), ask("1", "u", 0), paid("1", "u", 3, 0.5), ask("4", "u", 4)],
        [ask("1", "u", 0), ask("5", "u", 59), ask("6", "v", 60, 9.0), paid("1", "u", 61, 5.0), ask("7", "v", 62, 3.0), ask("8", "w", 62, 1.0)],
        [ask("10", "u", 3), ask("9", "u", 125, 0.5)],  # 10 comes late, in a minute of its own that still counts
        [ask("d", "w", 4 * 86_400)],
        [ask("e", "w", 4 * 86_400 + 7200)],
        [ask("f", "w", 9 * 86_400)],
        [ask("g", "w", 9 * 86_400 + 7200)],
    ]
    got, left = streamed(rocks, batches, ASK, lambda x: stateful.admission_stream(x, 3, 4, 2, 6.0, late="10 minutes"), tmp_path, "asked")
    assert {r.ident: r.reason for r in got} == {"1": None, "2": None, "3": "concurrency", "4": None, "5": "rate-limited", "6": "budget-exhausted", "7": None, "8": "budget-exhausted", "10": "rate-limited", "9": None, "d": None, "e": None, "f": None, "g": None}
    assert len(got) == 14 and left < 30


def test_admission_against_a_plain_count(rocks, tmp_path):
    events = rocks.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.lit("k").alias("kind"), F.col("event_id").cast("string").alias("ident"), F.concat(F.lit("u"), F.col("user_id") % 9).alias("user"), F.date_trunc("second", "ts").alias("at"), F.lit("ask").alias("action"), F.lit(1.0).alias("amount"))
    rows = sorted(map(tuple, events.collect()), key=lambda r: (r[3], r[1]))
    got, _ = streamed(rocks, [rows[:400], rows[400:]], ASK, lambda x: stateful.admission_stream(x, 1, 2, 10**6, 10**6), tmp_path, "counted")
    minutes, days, want = {}, {}, {}
    for _, ident, user, at, _, _ in rows:
        m, d = (user, at.replace(second=0)), (user, (at + timedelta(hours=9)).date())
        want[ident] = minutes.get(m, 0) < 1 and days.get(d, 0) < 2
        if want[ident]:
            minutes[m], days[d] = minutes.get(m, 0) + 1, days.get(d, 0) + 1
    assert {r.ident: r.admitted for r in got} == want and 0 < sum(want.values()) < len(want)
