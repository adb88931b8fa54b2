"""State of stories between batches, on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from quillspark.functions import ident, times
from quillspark.operators import stories


def test_leases(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    schema = "slot string, status string, attempt int, lease_expires timestamp"
    runs = [("done", "completed", 1, at(1)), ("dead", "running", 2, at(2)), ("failed", "failed", 1, at(1))]
    ask = [(s, at(6)) for s in ("done", "dead", "failed", "new")]
    asked = spark.createDataFrame(ask, "slot string, now timestamp")
    free = {r.slot: (r.decision, r.attempt) for r in stories.leases(spark.createDataFrame(runs, schema), asked).collect()}
    assert free == {"done": ("already_completed", None), "dead": ("started", 3), "failed": ("started", 2), "new": ("started", 1)}
    held = spark.createDataFrame([*runs, ("other", "running", 1, at(9))], schema)
    assert {r.slot: r.decision for r in stories.leases(held, asked).collect()} == {"done": "already_completed", "dead": "busy", "failed": "busy", "new": "busy"}
    none = stories.leases(spark.createDataFrame([], schema), asked).collect()
    assert {(r.decision, r.attempt) for r in none} == {("started", 1)}


def test_recheck_touches_only_what_is_new(spark):
    state = spark.createDataFrame([("a", None), ("b", None)], "story string, processed timestamp")
    versions = spark.createDataFrame([("v1", "a")], "version string, story string")
    found = spark.createDataFrame([("v1", "a"), ("v2", "b")], "version string, story string")
    new, after = stories.rechecked(state, versions, found, F.lit("2024-01-01").cast("timestamp"))
    assert [r.version for r in new.collect()] == ["v2"]
    assert {r.story: r.processed is not None for r in after.collect()} == {"a": False, "b": True}


def test_assigned_makes_and_moves_stories(spark):
    schema = "article string, story string, vector array<double>, topics array<string>, published timestamp"
    known = spark.createDataFrame([("1", "a", [0.0, 2.0], ["x"], datetime(2024, 1, 5))], schema)
    incoming = spark.createDataFrame([("2", "a", [2.0, 0.0], ["x"], datetime(2024, 1, 2)), ("3", "b", [1.0, 1.0], None, datetime(2024, 1, 3))], schema)
    state = spark.createDataFrame([("a", ["y"], [0.0, 2.0], datetime(2024, 1, 5), None, "dormant"), ("c", [], None, None, None, "dormant")], "story string, topics array<string>, centroid array<double>, last_report timestamp, processed timestamp, lifecycle string")
    got = {r.story: r for r in stories.assigned(state, known, incoming, F.lit("2024-01-06").cast("timestamp"), ("w", "x", "y")).collect()}
    assert got["a"].topics == ["x", "y"] and got["a"].centroid == [1.0, 1.0] and got["a"].last_report == datetime(2024, 1, 5) and got["a"].lifecycle == "active"
    assert got["b"].centroid == [1.0, 1.0] and got["b"].topics == [] and got["c"].lifecycle == "dormant" and got["c"].processed is None


def test_keys_labels_and_quotes(spark):
    row = spark.range(1).select(
        ident.evidence_key(F.expr("array(named_struct('version', 'v2', 'start', 1, 'end', 4), named_struct('version', 'v1', 'start', 7, 'end', 9))")).alias("key"),
        ident.only_known(F.expr("array('q1')"), F.expr("array('q1', 'q2')")).alias("known"),
        ident.only_known(F.expr("cast(array() as array<string>)"), F.expr("array('q1')")).alias("none"),
        times.bin_label(F.lit("2026-09-16 21:00:00").cast("timestamp"), 6).alias("six"),
        times.bin_label(F.lit("2026-09-16 15:00:00").cast("timestamp"), 24).alias("day"),
        times.story_window(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")).alias("w"),
    ).first()
    assert (row.key, row.known, row.none) == ("v1:7-9|v2:1-4", True, False)
    assert (row.six, row.day, row.w.start) == ("2026. 9. 17. 06:00~12:00", "2026. 9. 17.", datetime(2024, 1, 1))
