from pyspark.sql import functions as F

from quillspark.functions import costs, render
from quillspark.operators import revisions


def test_build_and_finalise(spark):
    schema = "story_id string, revision_number int, n int, previous_id string, claim_type string, modality string, evidence_key string, text string, status string"
    old = revisions.build(spark.createDataFrame([("s", 1, 0, None, "f", "d", "e", "one", "single_source"), ("t", 1, 0, None, "f", "d", "e", "one", "conflict")], schema))
    new = revisions.build(spark.createDataFrame([("s", 2, 0, "s-r1-c0", "f", "d", "e", "other words", "single_source"), ("t", 2, 0, "t-r1-c0", "f", "d", "e2", "one", "conflict"), ("u", 1, 0, None, "f", "d", "e", "x", "multi_agree")], schema))
    publish, confirm = revisions.finalise(new, old)
    assert sorted(r.story_id for r in publish.collect()) == ["t", "u"] and [r.story_id for r in confirm.collect()] == ["s"]
    assert old.where("story_id = 's'").first().claims[0].claim_id == "s-r1-c0"


def test_sources_carried_and_pages(spark):
    newest = spark.createDataFrame([("s", 3, ["a"]), ("t", 1, ["b"])], "story_id string, revision_number int, sources array<string>")
    added = spark.createDataFrame([("s", "c"), ("s", "a"), ("t", "b")], "story_id string, article_id string")
    assert [tuple(r) for r in revisions.with_sources(newest, added).select("story_id", "revision_number", "sources").collect()] == [("s", 4, ["a", "c"])]
    claims = spark.createDataFrame([("c1",), ("c2",)], "claim_id string")
    evidence = spark.createDataFrame([("c1", "v1"), ("c2", "v1"), ("c2", "v2")], "claim_id string, article_version_id string")
    versions = spark.createDataFrame([("v1", None), ("v2", "body")], "article_version_id string, body string")
    assert [r.claim_id for r in revisions.carried(claims, evidence, versions).collect()] == ["c1"]
    revs = spark.createDataFrame([("s", 1, ["a"]), ("s", 2, ["a", "b"])], "story_id string, revision_number int, source_article_ids array<string>")
    rows = spark.createDataFrame([("s", 1, 0, "c", "x", "conflict")], "story_id string, revision_number int, display_order int, claim_id string, text string, status string")
    sources = spark.createDataFrame([("a", 1, "link_only", "secret"), ("b", 2, "body_and_excerpt", "open")], "article_id string, published_at int, rights_tier string, excerpt string")
    old = revisions.story_page(revs, rows, sources, F.lit("s"), F.lit(1)).first()
    assert not old.is_latest and old.claims[0].text == "x" and [s.excerpt for s in old.sources] == [None]
    assert [s.excerpt for s in revisions.story_page(revs, rows, sources, F.lit("s")).first().sources] == [None, "open"]


def test_drafts_labels_and_leaks(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x")], "k string, value string")
    b = spark.createDataFrame([("1", "x"), ("3", "y")], "k string, value string")
    decided = spark.createDataFrame([("2", "z"), ("1", "x")], "k string, value string")
    got = {r.k: (r.value, r.label_source) for r in revisions.labels(revisions.compare_drafts(a, b, ["k"]), decided, ["k"]).collect()}
    assert got == {"1": ("x", "operator_audit"), "2": ("z", "operator_decision"), "3": (None, None)}
    text = "0123456789abcdefghijklmnop"
    out = spark.createDataFrame([("leak", "zz" + text[3:25]), ("fine", text[:19])], "id string, text string")
    assert [r.id for r in revisions.text_leaks(out, spark.createDataFrame([("p", text)], "id string, text string")).collect()] == ["leak"]


def test_costs_and_rendering(spark):
    s = F.array(F.lit("One."), F.lit("Two."), F.lit("Three."))
    ids = lambda *x: F.array(*map(F.lit, x))
    r = spark.range(1).select(costs.usage_usd(F.lit(1000), F.lit(400), F.lit(100), {"input": 1.0, "cached": 0.1, "output": 10.0}), costs.estimated_tokens(F.lit("😀ab")), render.quote_of(s, ids(2, 3)), render.quote_of(s, ids(1, 3)), render.numbered(F.slice(s, 1, 2)), render.claim_anchor(F.lit("#claim-a-1")), F.length(costs.counter_key("k", F.lit("2024-01-01"), F.lit("c"))), render.story_path(F.lit("a b"), F.lit(2))).first()
    assert tuple(r) == (0.00164, 2, "Two. Three.", None, "s1: One.\ns2: Two.", "a-1", 64, "/stories/a+b/revisions/2")


def test_leaks_are_the_same_by_set_and_by_join(spark, monkeypatch):
    import random

    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab€😀") for _ in range(n))
    private = [word(45) for _ in range(6)] + [word(19)]
    out = [(i, word(i % 37) + (p := r.choice(private))[(k := r.randrange(len(p))) : k + 16 + i % 8] + word(i % 23)) for i in range(400)] + [(400, None), (401, ""), (402, private[0])]
    want = {i for i, x in out if any(x and p[k : k + 20] in x for p in private for k in range(len(p) - 19))}
    frames = spark.createDataFrame(out, "id long, text string"), spark.createDataFrame(list(enumerate(private)), "id long, text string")
    found = revisions.text_leaks(*frames)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # no row per window
    assert {x.id for x in found.collect()} == want and 0 < len(want) < len(out)
    monkeypatch.setattr(revisions, "KNOWN_WINDOWS", 0)
    assert {x.id for x in revisions.text_leaks(*frames).collect()} == want
