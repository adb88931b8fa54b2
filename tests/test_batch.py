"""The batch, its commit, and what it is made of, on hand-made rows."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import batch, contradiction, ledgers
from quillspark.operators.commit import Conflict, Tables
from quillspark.operators.components import components

NOW = "2024-01-02 08:00:00"
EVIDENCE = "story_id string, claim_key string, quote_id string, origin string"
PAIRS = "story_id string, claim_key string, a string, b string, label string"


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 5)] + [(r.randrange(300, 420), r.randrange(300, 420)) for _ in range(70)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sides_and_origins_of_quotes(spark):
    quotes = {"two": {"q1": "x", "q2": "y", "q3": "x", "q4": "z", "q5": "w"}, "one": {"q1": "x"}, "calm": {"q1": "x", "q2": "y", "q3": "z"}, "silent": {"q1": "x", "q2": "y"}, "torn": {"q1": "x", "q2": "y", "q3": "z"}, "alien": {"q1": "x", "q2": "y"}, "doubled": {"q1": "x", "q2": "y"}, "crossed": {"q1": "x", "q2": "y"}, "unsure": {"q1": "x", "q2": None}}
    pairs = {
        "two": [("q1", "q3", "incompatible"), ("q1", "q2", "agree"), ("q3", "q4", "agree"), ("q4", "q5", "unrelated")],
        "calm": [("q1", "q2", "agree")],
        "silent": [("q1", "q2", "unrelated")],
        "torn": [("q1", "q2", "incompatible"), ("q1", "q3", "agree"), ("q2", "q3", "agree")],
        "alien": [("q1", "q9", "agree")],
        "doubled": [("q1", "q2", "agree"), ("q2", "q1", "unrelated")],
        "crossed": [("q1", "q2", "incompatible"), ("q2", "q1", "incompatible")],
        "unsure": [("q1", "q2", "agree"), ("q2", "q1", "agree")],
    }
    e = spark.createDataFrame([("s", c, q, o) for c, of in quotes.items() for q, o in of.items()], EVIDENCE)
    p = spark.createDataFrame([("s", c, *x) for c, of in pairs.items() for x in of], PAIRS)
    good, bad = contradiction.judged(e, p)
    # q3's origin is also on the claim's side: a source that corrected itself is no conflict
    assert {r.claim_key: (r.supporting, r.conflicting) for r in good.collect()} == {"two": (2, 1), "one": (1, 0), "calm": (2, 0), "silent": (0, 0), "unsure": (1, 0)}
    assert {r.claim_key: r.reason for r in bad.collect()} == {"torn": "a quote on both sides", "alien": "a quote of no evidence", "doubled": "not one label for a pair", "crossed": "incompatible both ways"}


def test_running_sums_over_ranges(spark):
    r = random.Random(5)
    costs = [(i, r.randrange(4)) for i in range(500)]
    got = {x.k: x.s for x in ledgers.running(spark.createDataFrame(costs, "k long, v long").repartition(7), [F.desc("v"), F.asc("k")], {"s": F.col("v")}).collect()}
    total, want = 0, {}
    for k, v in sorted(costs, key=lambda x: (-x[1], x[0])):
        total += v
        want[k] = total
    assert got == want


def answers(story, articles, claims, pairs=None):
    """Recorded responses: articles: version to {quote: text}; claims: key to its quotes and their label."""
    out = [("evidence_extract", v, {"quotes": [{"quote_id": q, "quote": t} for q, t in of.items()]}) for v, of in articles.items()]
    out.append(("claim_generate", story, {"claims": [{"claim_key": c, "text": f"text of {c}", "claim_type": "fact", "modality": "asserted", "quote_ids": list(of)} for c, of in claims.items()]}))
    out += [("gate_support", f"{story}:gate:{c}", {"judgments": [{"quote_id": q, "label": x} for q, x in of.items()]}) for c, of in claims.items()]
    out += [("contradiction", f"{story}:{c}", {"pairs": [dict(zip("ab", p[:2], strict=True), label=p[2]) for p in of]}) for c, of in (pairs or {}).items()]
    return [(s, k, json.dumps(o), 10, 1.0, None) for s, k, o in out]


def inputs(spark, articles, responses):
    rows = [(s, v[1:], v, source, body) for s, v, source, body in articles]
    return spark.createDataFrame(rows, "story_id string, article_id string, article_version_id string, source_id string, body string"), spark.createDataFrame(responses, "stage string, key string, output string, tokens long, spend double, failure string")


BODY = "The bridge opened on Monday. Two lanes are still closed. Nobody was hurt."
SOURCES = [("p", "body_and_excerpt", None), ("q", "body_only", None), ("l", "link_only", None)]


@pytest.fixture
def slot(spark):
    """Stories of every outcome: s is fine, u is sure of nothing, f fails at its second claim, g quotes what isn't there, n is unknown, d comes too late."""
    label = lambda *of: dict.fromkeys(of, "supported")
    articles = [("s", "v1", "p", BODY), ("s", "v2", "q", BODY), ("s", "v9", "l", None), ("u", "v3", "p", BODY), ("f", "v4", "p", BODY), ("g", "v5", "p", BODY), ("n", "v6", "p", BODY), ("n", "v8", "p", BODY), ("d", "v7", "p", BODY)]
    responses = answers("s", {"v1": {"a": "The bridge opened on Monday."}, "v2": {"b": "opened on Monday", "x": "Nobody was hurt."}}, {"c1": label("a", "b"), "c2": label("x"), "strange": label("a", "zz")}, {"c1": [("a", "b", "agree")]})
    responses += answers("u", {"v3": {"e": "Nobody was hurt."}}, {"c1": {"e": "partial"}})
    responses += answers("f", {"v4": {"h": "Nobody was hurt.", "i": "Two lanes are still closed."}}, {"c1": label("h"), "c2": {"i": "odd"}})
    responses += answers("g", {"v5": {"j": "The tunnel opened."}}, {"c1": label("j")})
    responses += answers("d", {"v7": {"k": "Nobody was hurt."}}, {"c1": label("k")})
    return *inputs(spark, articles, responses), spark.createDataFrame(SOURCES, "source_id string, rights_tier string, wire_id string")


def stories(spark):
    return spark.createDataFrame([(s, 9 if s == "d" else 0, None, None, None, datetime(2023, 12, 30) if s == "g" else None) for s in "sufgd"], batch.STORIES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_each_story_has_one_outcome(spark, slot):
    articles, responses, sources = slot
    done = batch.run(articles, sources, stories(spark), spark.createDataFrame([], batch.CLAIMS), responses, 17.0, 10_000)
    got = {r.story_id: (r.outcome, r.stage, r.reason) for r in batch.outcomes(done).collect()}
    assert got == {
        "s": ("revision", None, None),
        "u": ("failed", "revision", "no claim to show"),
        "f": ("failed", "gate_support", "not one label of its own: i"),
        "g": ("failed", "gate", "span_missing (j)"),
        "n": ("failed", "assign", "story not assigned"),
        "d": ("deferred", None, None),
    }
    assert rows(done.claims.select("claim_id", "status", "supporting", "evidence_key")) == [("s-r1-c0", "multi_agree", 2, "v1:0-28|v2:11-27"), ("s-r1-c1", "single_source", 1, "v2:57-73")]
    assert rows(done.dropped.select("story_id", "reason")) == [("u", "no quote supports it")]
    assert done.usage.where("stage = 'evidence_extract'").first().tokens == 50
    after = {r.story_id: r for r in batch.state_after(stories(spark), done, F.lit(NOW).cast("timestamp")).collect()}
    assert after["s"].revision_number == 1 and after["s"].checked_at and after["g"].deferred_at is None and after["d"].deferred_at == datetime(2024, 1, 2, 8) and after["u"].checked_at is None


def test_a_batch_of_nothing(spark):
    articles, responses = inputs(spark, [], [])
    done = batch.run(articles, spark.createDataFrame([], "source_id string, rights_tier string, wire_id string"), stories(spark), spark.createDataFrame([], batch.CLAIMS), responses, 1.0, 1)
    assert batch.outcomes(done).count() == 0 and done.changes.count() == 0


def test_two_slots_a_broken_one_and_reruns(spark, slot, tmp_path):
    articles, responses, sources = slot
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.commit("start", 1, {}, {"stories": stories(spark), "claims": spark.createDataFrame([], batch.CLAIMS)})
    run = lambda name, attempt, a, r, spend=17.0: batch.run_slot(tables, name, attempt, a, sources, r, spend, 10_000, F.lit(NOW).cast("timestamp"))
    # an attempt that breaks while its last table is written leaves all tables as they were
    broken = stories(spark).withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    before = tables.manifest()
    with pytest.raises(Exception, match="lost"):
        tables.commit("one", 1, {"runs": spark.createDataFrame([], batch.RUNS)}, {"stories": broken})
    assert tables.manifest() == before
    assert run("one", 2, articles, responses) and not run("one", 3, articles, responses)
    first = {n: rows(tables.read(n)) for n in ("revisions", "changes", "runs", "stories", "claims")}
    assert [(r[0], r[1]) for r in first["revisions"]] == [("s", 1)] and first["runs"][0][:8] == ("one", 2, 1, 0, 4, 1, 170, 17.0)
    # the next slot: s says the same again, d has its turn
    assert run("two", 1, articles.where("story_id in ('s', 'd')"), responses)
    state = {r.story_id: r for r in tables.read("stories").collect()}
    assert [(r[0], r[1]) for r in rows(tables.read("revisions"))] == [("d", 1), ("s", 1)] and state["s"].revision_number == 1 and state["d"].deferred_at is None
    # a third: the second source of s now stands against the first
    turned = responses.where("key <> 's:c1'").unionByName(inputs(spark, [], [("contradiction", "s:c1", json.dumps({"pairs": [{"a": "a", "b": "b", "label": "incompatible"}]}), 1, 1.0, None)])[1])
    assert run("three", 1, articles.where("story_id = 's'"), turned)
    changed = tables.read("changes").where("story_id = 's' and revision_number = 2").collect()
    assert [(r.kind, r.claim_id, r.previous_status, r.current_status) for r in changed] == [("status", "s-r1-c0", "multi_agree", "conflict")]
    assert sorted(tables.manifest()["slots"]) == ["one", "start", "three", "two"]
    # a commit computed before another one came
    with pytest.raises(Conflict):
        tables.commit("late", 1, {}, {"stories": stories(spark)}, before)


def test_judged_quotes_are_joined_by_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(contradiction, "components", lambda edges: seen.append(edges.dtypes) or components(edges))
    e = spark.createDataFrame([("s", "c", q, o) for q in ("q1", "q2", "q3") for o in ("x" + q, "y", None)], EVIDENCE)
    p = spark.createDataFrame([("s", "c", "q1", "q2", "agree"), ("s", "c", "q3", "q1", "incompatible")], PAIRS)
    good, bad = contradiction.judged(e, p)
    # y stands on both sides; xq1 and xq2 are against
    assert [tuple(r) for r in good.collect()] == [("s", "c", 2, 2, False)] and bad.count() == 0
    assert seen == [[("a", "bigint"), ("b", "bigint")]]


def test_stars_take_one_round(spark, monkeypatch):
    from quillspark.operators import components as module

    rounds = []
    monkeypatch.setattr(module, "_pulled", lambda edges, f=module._pulled: rounds.append(1) or f(edges))
    for edges, most in (([(1, k) for k in range(2, 9)], 0), ([(5, k) for k in range(1, 9)], 1)):
        rounds.clear()
        assert {r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {1}
        assert len(rounds) == most


def _scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_components_read_their_edges_once_a_step(spark, monkeypatch):
    from quillspark.operators import components as module
    from quillspark.session import settled

    edges = settled(spark.createDataFrame([(5, 1), (5, 2), (7, 5)], "a long, b long"))
    assert _scans(module._hung(edges)) == 2
    written = []
    monkeypatch.setattr(module, "settled", lambda df, f=module.settled: written.append(1) or f(df))
    got = components(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (1, 3), (9, 9), (1, 1), (None, 4), (4, None), (None, None)], "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (9, 9)] and len(written) == 1 and _scans(got) <= 4  # a plan and its last form


def test_mismatches_are_found_in_one_pass(spark):
    """Null and unknown quotes, quotes paired with themselves, labels that differ or lack, repeated pairs, null keys."""
    from quillspark.session import settled

    given = {
        "fair": [("p", "q", 1, 2, "agree"), ("p", "q", 1, 2, "agree"), ("r", "p", 3, 1, "incompatible")],
        "alien": [("p", "z", 1, None, "agree")],
        "nulls": [(None, "q", None, 2, "agree"), (None, None, None, None, "agree")],
        "itself": [("p", "p", 1, 1, "agree")],
        "unknown": [("z", "z", None, None, "agree")],
        "two": [("p", "q", 1, 2, "agree"), ("q", "p", 2, 1, "unrelated")],
        "none": [("p", "q", 1, 2, None)],
        "crossed": [("p", "q", 1, 2, "incompatible"), ("q", "p", 2, 1, "incompatible")],
        None: [("p", "z", 1, None, None)],
    }
    kind = "story_id string, claim_key string, a string, b string, _a long, _b long, label string"
    linked = settled(spark.createDataFrame([("s", c, a, b, x, y, label) for c, of in given.items() for a, b, x, y, label in of], kind))
    found = contradiction._mismatches(linked)
    assert _scans(found) == 1
    alien, itself, label = "a quote of no evidence", "a quote paired with itself", "not one label for a pair"
    want = [("alien", alien), ("nulls", itself), ("itself", itself), ("unknown", itself), ("two", label), ("none", label), ("crossed", "incompatible both ways"), (None, alien), (None, label)]
    assert sorted(((r.claim_key, r.reason) for r in found.collect()), key=str) == sorted(want, key=str)


def test_claims_judged_as_lists_equal_claims_judged_by_rows(spark, monkeypatch):
    r = random.Random(11)
    rows_, pairs, lists = [], [], []
    for c in range(150):
        own = {f"q{n}": r.choice(("x", "y", "z", None)) for n in r.sample(range(30), r.randrange(1, 7))}
        names = [*own, *(["q99"] if r.random() < 0.1 else [])]
        of = [(r.choice(names), r.choice(names), r.choice(("agree", "agree", "incompatible", "unrelated", "undeterminable"))) for _ in range(r.randrange(4))]
        of = [p for p in of if p[0] != p[1] or r.random() < 0.2]
        rows_ += [(f"s{c % 40}", f"c{c}", q, o) for q, o in own.items()]
        pairs += [(f"s{c % 40}", f"c{c}", *p) for p in of]
        lists.append((f"s{c % 40}", f"c{c}", [(q, [o] if o else []) for q, o in own.items()], of or None))
    good, bad = contradiction.judged(spark.createDataFrame(rows_, EVIDENCE), spark.createDataFrame(pairs, PAIRS))
    monkeypatch.setattr(contradiction, "_linked", None)  # no name is shuffled
    kind = "story_id string, claim_key string, quotes array<struct<quote_id:string,origins:array<string>>>, pairs array<struct<a:string,b:string,label:string>>"
    got, wrong = contradiction.judged_lists(spark.createDataFrame(lists, kind))
    least = lambda df: sorted(tuple(x) for x in df.groupBy("story_id", "claim_key").agg(F.min("reason")).collect())
    assert rows(got) == rows(good) and least(wrong) == least(bad) and len(least(bad)) > 9 and len(rows(good)) > 99


def test_what_is_said_of_a_story_meets_in_one_shuffle(spark):
    answer = lambda stage, key, out: (stage, key, json.dumps(out), 1, 1.0, None)
    claim = lambda c, *ids: {"claim_key": c, "text": c, "claim_type": "fact", "modality": "asserted", "quote_ids": list(ids)}
    responses = [answer("claim_generate", "s", {"claims": [claim("c:1", "a", "b", "a"), claim("c2", "zz"), claim("c3"), claim("c4", "d"), claim("c4", "a")]}), answer("claim_generate", "late", {"claims": [claim("c1", "a")]})]
    responses += [answer("gate_support", "s:gate:c:1", {"judgments": [{"quote_id": "a", "label": "supported"}]}), answer("gate_support", "s:c:1", {}), answer("contradiction", "s:c:1", {"pairs": []}), answer("contradiction", "s:other", {"pairs": []})]
    quotes = [("s", q, (f"v{q}", n, n + 1, None, "o")) for n, q in enumerate("abcdd")]
    started = spark.createDataFrame([("s",), ("mute",)], "story_id string")
    made = spark.createDataFrame(quotes, "story_id string, quote_id string, q struct<version:string,start:int,end:int,gate:string,origin:string>")
    met = batch._met(started, made, batch._about_stories(inputs(spark, [], responses)[1]))
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r.story_id, r.claim_key): r for r in met.collect()}
    assert set(got) == {("s", None), ("mute", None), *(("s", c) for c in ("c:1", "c2", "c3", "c4", "other"))}
    assert [q.quote_id for q in got["s", "c:1"].own] == ["a", "b"] and got["s", "c:1"].known and got["s", "c:1"].g and got["s", "c:1"].p
    assert not got["s", "c2"].known and not got["s", "c3"].known and got["s", "c4"].again and got["s", "other"].typed is None
    assert got["s", None].twice == "d" and got["s", None]._listed is None and got["mute", None]._listed == "no response"
