from pyspark.sql import functions as F

from quillspark.operators import assign, dedup, diffs, evaluation, ledgers, matching, sinks, status
from quillspark.plans import serving, vectors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_dedup_identities_and_versions(spark):
    known = spark.createDataFrame([("a-1", "s", "u1", "t", "h1")], "id string, source_id string, url string, title string, body_hash string")
    got = spark.createDataFrame([("s", "u1", "t2", "h9", 1), ("s", "u2", "t", "h1", 2), ("s", "u3", "x", "h3", 3), ("s", "u4", "x", "h3", 4), ("o", "u5", "x", "h3", 5)], "source_id string, url string, title string, body_hash string, observed_at long")
    found = dedup.identify(got, known)
    ids = {r.url: r.id for r in found.collect()}
    assert ids["u1"] == ids["u2"] == "a-1" and ids["u3"] == ids["u4"] and ids["u5"] not in (ids["u3"], "a-1")
    new = dedup.versions(found, known)
    assert [(r.id, r.body_hash) for r in new.orderBy("observed_at").collect()][:2] == [("a-1", "h9"), ("a-1", "h1")] and new.count() == 4


def test_status_guards(spark):
    def guard(previous=None, verified=True, undet=False, sup=1, con=0, cor=False, res=False):
        c = status.claim_status(F.lit(previous).cast("string"), F.lit(verified), F.lit(undet), F.lit(sup), F.lit(con), F.lit(cor), F.lit(res))
        r = spark.range(1).select(c.alias("c")).first().c
        return r.guard, r.status

    assert guard(undet=True) == (1, None) and guard(verified=False)[0] == 1 and guard(sup=0)[0] == 1
    assert guard("conflict") == (2, "conflict") and guard(con=1) == (2, "conflict")
    assert guard("conflict", cor=True) == (3, "corrected") and guard("conflict", res=True) == (4, "resolved") and guard(res=True) == (6, "single_source")
    assert guard(sup=2) == (5, "multi_agree")


def test_revision_changes(spark):
    schema = "story_id string, claim_id string, claim_type string, modality string, evidence_key string, text string, status string"
    a = spark.createDataFrame([("s", "1", "f", "d", "e", "t", "single_source"), ("s", "2", "f", "d", "e", "t", "conflict"), ("s", "3", "f", "d", "e", "old", "conflict")], schema)
    b = spark.createDataFrame([("s", "1", "f", "d", "e", "wording", "multi_agree"), ("s", "3", "f", "d", "e2", "new", "conflict"), ("s", "4", "f", "d", "e", "t", "conflict")], schema)
    assert rows(diffs.revision_changes(a, b).select("kind", "claim_change", "claim_id")) == [("claim", "added", "4"), ("claim", "modified", "3"), ("claim", "removed", "2"), ("status", None, "1")]


def test_assignment_reasons(spark):
    c = spark.createDataFrame([("a", "x", 0.9, 0.8, True), ("a", "y", 0.5, 0.9, True), ("b", "x", 0.85, 0.8, True), ("b", "y", 0.84, 0.9, True), ("c", "x", 0.7, 0.9, True), ("d", "x", 0.9, 0.1, True), ("e", "x", 0.99, 0.99, False)], "article string, story string, centroid_similarity double, representative_similarity double, active boolean")
    assert rows(assign.decide(c)) == [("a", "x", "assigned"), ("b", None, "no_lead"), ("c", None, "centroid_far"), ("d", None, "representative_far"), ("e", None, "no_candidate")]


def test_sinks(spark):
    state = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, v string, t long")
    new = spark.createDataFrame([(2, None, 3), (3, "c", 1)], "k long, v string, t long")
    assert rows(sinks.upsert(state, new, ["k"], ["v", "t"])) == [(1, "a", None), (2, "b", 3), (3, "c", 1)]
    assert rows(sinks.upsert(state, new, ["k"], ["v", "t"], keep_old=("t",)))[1] == (2, "b", 5)
    once = sinks.append_new(state, new, ["k"])
    assert rows(once) == [(3, "c", 1)] and sinks.append_new(state.unionByName(once), new, ["k"]).count() == 0
    assert rows(sinks.earliest(state, new.where("k = 2"), "k", "t")) == [(1, "a", None), (2, "b", 3)]
    nested = spark.createDataFrame([("r", [("c1", [("e1",), ("e2",)]), ("c2", [])])], "id string, claims array<struct<id:string,evidence:array<struct<x:string>>>>")
    flat = sinks.flatten(nested)
    assert flat["claims"].count() == 2 and rows(flat["evidence"]) == [("r", "c1", 0, "e1"), ("r", "c1", 1, "e2")]
    assert sinks.cache_tags(spark.createDataFrame([("s", "r"), ("s", "q")], "story_id string, revision_id string")).first().tags == ["revision:q", "revision:r", "story:s"]


def test_alignment_keeps_outer_rows(spark):
    schema = "group string, id string, items array<int>"
    a = spark.createDataFrame([("g", "a1", [1, 2, 3]), ("g", "a2", [9])], schema)
    b = spark.createDataFrame([("g", "b1", [1, 2]), ("g", "b2", [7])], schema)
    assert rows(matching.align_sets(a, b).select("a", "b")) == [("a1", "b1"), ("a2", None), (None, "b2")]


def test_perfect_and_trivial_clusterings(spark):
    same = spark.createDataFrame([(i, i % 3, i % 3) for i in range(9)], "i long, gold long, predicted long")
    s = evaluation.clustering_scores(same).first()
    assert all(abs(x - 1) < 1e-9 for x in s)
    assert evaluation.clustering_scores(spark.createDataFrame([(0, 0), (0, 0)], "gold long, predicted long")).first().ari is None


def test_prefix_cut_and_samples(spark):
    jobs = spark.createDataFrame([(1, 4.0), (2, 3.0), (3, 9.0), (4, 1.0)], "k long, cost double")
    assert rows(ledgers.prefix_cut(jobs, [F.asc("k")], "cost", 8).select("k", "runs")) == [(1, True), (2, True), (3, False), (4, False)]
    assert rows(ledgers.seeded_sample(jobs, "k", "s", 2)) == rows(ledgers.seeded_sample(jobs.orderBy(F.desc("k")), "k", "s", 2))


def test_sessions_part_by_less_than_a_second(spark):
    at = ["2024-01-12 03:32:11.100000", "2024-01-12 15:32:11.100000", "2024-01-13 03:32:11.100001"]
    events = spark.createDataFrame([(1, x) for x in at], "user long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in ledgers.sessions(events, "user", "ts", 12).collect()) == [1, 2]


def test_lead_item_of_equal_lines_is_the_first_of_the_table(spark, tmp_path):
    made = [(k, 10 * k + p, "R" if p else "N", "1998-01-01", 3) for k in range(50) for p in (0, 2, 1, 3)]
    lines = spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_returnflag string, l_shipdate string, l_linenumber int")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(serving.lead_item(spark, str(tmp_path))) == sorted([(k, 10 * k + 2) for k in range(50)], key=repr)


def test_lead_item_of_lines_with_nulls_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    day, made = "1998-01-01 00:00:0", []
    made += [(1, None, "R", day + "0", 1), (1, 5, "R", day + "1", 1)]  # no part
    made += [(2, 7, "R", None, 1), (2, 8, "R", day + "1", 1), (3, 7, "R", day + "0", None), (3, 8, "R", day + "1", 1)]  # no day, no number
    made += [(4, None, "R", day + "0", 1), (5, 9, "R", None, 1), (6, 9, "N", day + "0", 1)]  # none that counts, none returned
    made += [(7, 1, "R", day + "0", 12), (7, 2, "R", day + "1", 1), (7, 3, "N", day + "0", 1)]  # a later second of a lesser number
    lines = spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_returnflag string, l_shipdate string, l_linenumber int")
    lines.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = duck.sql(serving.ORACLES["lead_item"]).fetchall()
    assert rows(serving.lead_item(spark, str(tmp_path))) == sorted(want, key=repr) == [(1, 5), (2, 8), (3, 8), (4, None), (5, None), (7, 2)]


def _plain_pairs(spark, n, seed):
    import random

    r = random.Random(seed)
    same = [r.uniform(-1, 1) for _ in range(6)]
    vectors = [None, [0.0] * 6] + [list(same) if i % 5 == 0 else [r.choice((-1.0, 0.5, 1.0)) if i % 2 else r.uniform(-1, 1) for _ in range(6)] for i in range(n - 2)]
    return spark.createDataFrame([(i, i % 3, r.randrange(4), v) for i, v in enumerate(vectors)], "item long, topic int, grp int, vector array<float>")


def test_neighbours_and_negatives_in_many_cells_equal_all_pairs(spark, monkeypatch):
    from quillspark.functions.vector import cosine

    monkeypatch.setattr(assign, "ASKED", 7)
    monkeypatch.setattr(assign, "ITEMS", 11)
    items = _plain_pairs(spark, 90, 1)
    near = assign.knn(items.where("item % 4 = 0").select(F.col("item").alias("query"), "vector"), items.select("item", "vector"), 5)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan  # pairs are not made one by one
    a, b = items.alias("a"), items.alias("b")
    pairs = a.join(b, F.col("a.item") != F.col("b.item")).select(F.col("a.item").alias("x"), F.col("b.item").alias("y"), (F.col("a.topic") == F.col("b.topic")).alias("t"), (F.col("a.grp") != F.col("b.grp")).alias("g"), F.round(cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("s")).collect()
    want = []
    for q in range(0, 90, 4):
        own = sorted(((-p.s, p.y) for p in pairs if p.x == q))[:5]
        want += [(q, y, -s + 0.0, k + 1) for k, (s, y) in enumerate(own)]
    assert sorted((r["query"], r["item"], r["similarity"], r["rank"]) for r in near.collect()) == sorted(want)
    for stated in (None, F.col("a.item") % 4 == 0):
        chosen = {(min(p.x, p.y), max(p.x, p.y), p.s) for p in pairs if p.t and p.g and (stated is None or p.x % 4 == 0)}
        want = sorted(chosen, key=lambda z: (-z[2], z[0], z[1]))[:30]
        assert [tuple(r) for r in assign.hard_negatives(items.union(items) if stated is not None else items, 30, -1.0, stated).collect()] == want


def test_neighbours_in_a_large_cell_equal_all_pairs(spark):
    from quillspark.functions.vector import cosine

    items = _plain_pairs(spark, 1500, 2).union(_plain_pairs(spark, 1500, 2).where("item % 7 = 0"))  # repeated rows as well
    near = assign.knn(items.where("item % 25 < 2").select(F.col("item").alias("query"), "vector"), items.select("item", "vector"), 5)
    a, b = items.where("item % 25 < 2").alias("a"), items.alias("b")
    pairs = a.crossJoin(b).where("a.item <> b.item").select(F.col("a.item").alias("x"), F.col("b.item").alias("y"), F.round(cosine(F.col("a.vector"), F.col("b.vector")), 6).alias("s")).collect()
    of = {}
    for p in pairs:
        of.setdefault(p.x, []).append((-p.s, p.y))
    want = [(x, y, -s + 0.0, k + 1) for x, own in of.items() for k, (s, y) in enumerate(sorted(own)[:5])]
    assert sorted((r["query"], r["item"], r["similarity"], r["rank"]) for r in near.collect()) == sorted(want)


def test_every_vector_has_its_neighbours(spark):
    sf = "/root/testdata/sf0.001"
    found = vectors.knn_top5(spark, sf).groupBy("query").count()
    assert rows(found) == sorted([(r.vec_id, 5) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()], key=repr)


def test_matches_of_many_stories_need_no_group_each(spark):
    import random

    r = random.Random(5)
    of = {}
    for s in range(300):
        chosen = r.sample([(p, n) for p in "0123" for n in "0123"], r.randrange(1, 9))
        of[str(s)] = [(p, n, r.choice((0.3, 0.5, 0.6, 0.65, 0.9)), r.choice((5, 30))) for p, n in chosen]
    pairs = spark.createDataFrame([(s, *x) for s, found in of.items() for x in found], "story_id string, p string, n string, score double, anchor long")
    matched = matching.match_claims(pairs)
    assert rows(matched) == sorted(((s, *x) for s, found in of.items() for x in matching.match_pairs(found)), key=repr)
    sets = [spark.createDataFrame([(g, i, r.sample(range(4), r.randrange(1, 4))) for g in range(200) for i in range(r.randrange(4))], "group long, id long, items array<int>") for _ in "ab"]
    aligned = matching.align_sets(*sets)
    assert all("FlatMapGroupsInArrow" not in df._jdf.queryExecution().executedPlan().toString() for df in (matched, aligned))
    a, b = ({(x.group, x.id): set(x["items"]) for x in df.collect()} for df in sets)
    want = set()
    for g in range(200):
        used = []
        for s, i, j in sorted((-len(a[g, i] & b[g, j]) / len(a[g, i] | b[g, j]), str(i), str(j)) for i in range(4) for j in range(4) if (g, i) in a and (g, j) in b):
            if -s >= 0.5 and i not in [u[0] for u in used] and j not in [u[1] for u in used]:
                used.append((i, j))
                want.add((str(g), i, j))
    assert {(x.group, x.a, x.b) for x in aligned.where("a is not null and b is not null").collect()} == want


def test_gate_two_shuffles_a_claim_once(spark):
    """Quotes judged twice, under one label or two, kept or not; null keys, quotes and labels, unknown labels, repeated rows."""
    rows = [("s", 1, 1, "supported"), ("s", 1, 2, "partial"), ("s", 1, 3, "conflicting"), ("s", 2, 1, "supported"), ("s", 2, 1, "supported"), ("s", 3, 1, "partial"), ("s", 3, 1, "unsupported")]
    rows += [("s", 4, 1, "supported"), ("s", 4, 1, "partial"), ("s", 5, None, "supported"), ("s", 5, None, "supported"), ("s", 5, 1, "conflicting"), ("s", 6, 1, None), ("s", 6, 2, "supported")]
    rows += [("s", 7, 1, "odd"), (None, None, 2, "conflicting"), (None, None, 1, "supported"), (None, 1, None, None)]
    got = status.gate_two(spark.createDataFrame(rows, "story_id string, claim_id int, quote_id int, label string"))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.story_id, r.claim_id): (r.publish, r.kept, r.valid) for r in got.collect()} == {
        ("s", 1): (True, [1, 3], True),
        ("s", 2): (True, [1, 1], False),
        ("s", 3): (False, [], False),
        ("s", 4): (True, [1], False),
        ("s", 5): (True, [1], True),
        ("s", 6): (True, [2], False),
        ("s", 7): (None, [], False),
        (None, None): (True, [1, 2], True),
        (None, 1): (None, [], False),
    }
