"""A slot's batch: stories in order of priority up to the budget, each through all stages or none, committed in one piece.

Model calls are not made here: their answers are rows. A stage is a join of what it asks with what was answered, for all
stories at once; a story that any stage fails is taken out of every result, and the others don't notice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import ident, span, text
from quillspark.operators import contradiction, diffs, feed, intervals, ledgers, matching, revisions, sinks, status
from quillspark.operators.commit import Tables
from quillspark.session import settled

#: Stages in the order in which a story's first failure is looked for.
STAGES = ("assign", "sources", "evidence_extract", "claim_generate", "gate", "gate_support", "contradiction", "revision")
#: What an answer holds, by stage.
ANSWERS = {
    "evidence_extract": "quotes array<struct<quote_id:string,quote:string>>",
    "claim_generate": "claims array<struct<claim_key:string,text:string,claim_type:string,modality:string,quote_ids:array<string>>>",
    "gate_support": "judgments array<struct<quote_id:string,label:string>>",
    "contradiction": "pairs array<struct<a:string,b:string,label:string>>",
}
CLAIMS = "story_id string, claim_id string, claim_type string, modality string, evidence_key string, text string, status string, evidence array<struct<version:string,start:int,end:int>>"
STORIES = "story_id string, topic_rank int, revision_number int, content string, checked_at timestamp, deferred_at timestamp"
REVISIONS = "story_id string, revision_number int, status string, content string, published_at timestamp, slot string"
CHANGES = "story_id string, revision_number int, kind string, claim_change string, claim_id string, previous_text string, current_text string, previous_status string, current_status string"
RUNS = "slot string, attempt int, published long, confirmed long, failed long, deferred long, tokens long, spend double, finished_at timestamp"
CLAIM = ["story_id", "claim_key"]
#: About so many quotes go to a task at most, since its sorts hold a row for a quote and one for each claim that names it.
QUOTES = 100_000


@dataclass(frozen=True)
class Batch:
    """Results of a batch: every story of its articles is in exactly one of revisions, confirmed, failures and deferred."""

    revisions: DataFrame  # story_id, revision_number, status, claims, content
    claims: DataFrame  # the claims of these revisions, as in CLAIMS, with revision_number, supporting and conflicting
    changes: DataFrame  # as in CHANGES
    confirmed: DataFrame  # story_id
    failures: DataFrame  # story_id, stage, reason: the first one
    deferred: DataFrame  # story_id
    dropped: DataFrame  # story_id, claim_key, reason: claims held back, of stories that failed as well
    usage: DataFrame  # stage, tokens, spend


def planned(articles: DataFrame, stories: DataFrame, responses: DataFrame, spend: float, tokens: int) -> DataFrame:
    """story_id, articles, sources, tokens, spend, runs: from the first story beyond the budget on, none runs."""
    own = articles.groupBy("story_id").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("source_id").alias("sources"))
    versions = articles.select("story_id", F.col("article_version_id").alias("key")).distinct()
    costs = _of_stories(versions, responses).groupBy("story_id").agg(F.sum("tokens").alias("tokens"), F.sum("spend").alias("spend"))
    known = stories.select("story_id", "topic_rank", "deferred_at")
    jobs = own.join(costs, "story_id", "left").join(known, "story_id", "left").fillna(0, ["tokens", "spend"])
    order = feed.priority(F.col("sources"), F.col("deferred_at"), F.col("articles"), F.coalesce("topic_rank", F.lit(2**31 - 1)), F.col("story_id"))
    by_spend = ledgers.running(jobs, order, {"_spent": F.col("spend"), "_tokens": F.col("tokens")})
    return by_spend.select("story_id", "articles", "sources", "tokens", "spend", ((F.round("_spent", 9) <= spend) & (F.col("_tokens") <= tokens)).alias("runs"))


def _of_stories(versions: DataFrame, responses: DataFrame) -> DataFrame:
    """story_id, stage, tokens, spend. Extraction is keyed by article version, all else by story id, up to the first colon."""
    extracted = responses.where("stage = 'evidence_extract'").join(versions, "key").select("story_id", "stage", "tokens", "spend")
    rest = responses.where("stage <> 'evidence_extract'").select(F.substring_index("key", ":", 1).alias("story_id"), "stage", "tokens", "spend")
    return extracted.unionByName(rest)


def _failed(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
    return rows.select("story_id", F.lit(STAGES.index(stage)).alias("place"), F.lit(stage).alias("stage"), reason.cast("string").alias("reason")).where("reason is not null")


def _greatest() -> Column:
    """r: of several answers to a key the greatest counts."""
    return F.max(F.struct("output", "failure")).alias("r")


def _about_stories(responses: DataFrame) -> DataFrame:
    """story_id, claim_key, stage, output, failure of the answers that name a story (claim_key is null) or a claim in their key."""
    story = F.substring_index("key", ":", 1)
    own = {"claim_generate": "", "gate_support": ":gate:", "contradiction": ":"}
    keyed = reduce(lambda w, x: w.when(F.col("stage") == x[0], F.concat(story, F.lit(x[1]))), list(own.items())[1:], F.when(F.col("stage") == "claim_generate", F.col("key")))
    rows = responses.where(F.col("stage").isin(list(own)) & F.startswith("key", keyed))
    claim = F.when(F.col("stage") != "claim_generate", F.substring("key", F.char_length(keyed) + 1, F.char_length("key")))
    return rows.select(F.when(claim.isNull(), F.col("key")).otherwise(story).alias("story_id"), claim.alias("claim_key"), "stage", "output", "failure")


def _read(rows: DataFrame, stage: str, r: str = "r", items: str = "items", reason: str = "_reason") -> DataFrame:
    """rows with the items of their answer r, or with the reason why there are none."""
    field, schema = ANSWERS[stage].split(" ", 1)
    read = rows.withColumn(items, F.from_json(f"{r}.output", ANSWERS[stage])[field])
    whole = F.coalesce(F.forall(items, lambda x: reduce(Column.__and__, [x[f.split(":")[0]].isNotNull() for f in _names(schema)])), F.lit(False))
    why = F.when(F.col(r).isNull(), "no response").when(F.col(f"{r}.failure").isNotNull(), F.col(f"{r}.failure")).when(~whole, "response does not fit")
    return read.withColumn(reason, why).drop(r).withColumn(items, F.when(F.col(reason).isNull(), F.col(items)))


def _names(schema: str) -> list[str]:
    """Fields of array<struct<...>>; an array within is the last one."""
    return schema[len("array<struct<") : -2].split(",")


def run(articles: DataFrame, sources: DataFrame, stories: DataFrame, claims: DataFrame, responses: DataFrame, spend: float, tokens: int) -> Batch:
    """The batch of articles(story_id, article_id, article_version_id, source_id, body), one version an article.

    sources: source_id, rights_tier, wire_id; stories and claims (of the newest revisions, their evidence already in the present
    versions): as in STORIES and CLAIMS; responses: stage, key, output (JSON as in ANSWERS), tokens, spend, failure.
    Null bodies hold no quote. Story ids hold no colon.
    """
    plan = settled(planned(articles, stories, responses, spend, tokens), "zstd")
    started = plan.where("runs").select("story_id")
    fails = [_failed(started.join(stories, "story_id", "left_anti"), "assign", F.lit("story not assigned"))]
    rows = articles.join(F.broadcast(sources.select("source_id", "rights_tier", "wire_id")), "source_id", "left")  # a registry: as many as there are sources
    fails.append(_failed(rows.where("rights_tier is null").select("story_id").distinct().join(started, "story_id", "left_semi"), "sources", F.lit("source not registered")))
    usable = rows.where("rights_tier <> 'link_only'").join(started, "story_id", "left_semi").withColumn("key", F.col("article_version_id"))

    extracts = responses.where("stage = 'evidence_extract'").groupBy("key").agg(_greatest())
    answered = _read(usable.join(extracts, "key", "left"), "evidence_extract")
    cut = answered.withColumn("_sentences", text.split_sentences(F.coalesce("body", F.lit("")))).withColumn("q", F.explode_outer("items"))
    at = cut.where("q is not null or _reason is not null").withColumn("at", span.find_span(F.coalesce("body", F.lit("")), F.col("q.quote")))
    gate = span.gate_one(F.col("body"), F.col("_sentences"), F.col("at.start"), F.col("at.end"), F.col("rights_tier"), F.lit(1))
    origin = F.when(F.col("rights_tier") != "link_only", F.coalesce("wire_id", "source_id"))
    quotes = settled(at.select("story_id", "_reason", "q.quote_id", F.col("article_version_id").alias("version"), "at.start", "at.end", F.when(F.col("at").isNull(), "span_missing").otherwise(gate).alias("gate"), origin.alias("origin")), "zstd")
    fails.append(_failed(quotes, "evidence_extract", F.col("_reason")))
    quotes = quotes.where("_reason is null").select("story_id", "quote_id", F.struct("version", "start", "end", "gate", "origin").alias("q"))

    met = _met(started, quotes, _about_stories(responses))
    met = _read(_read(met, "gate_support", "g", "judgments", "_gate"), "contradiction", "p", "pairs", "_pair")
    effects = F.transform("judgments", lambda j: F.struct(j["quote_id"].alias("quote_id"), status.gate_effect(j["label"]).alias("effect")))
    met = settled(met.withColumn("judgments", effects), "zstd")
    fails.append(_failed(met.where("twice is not null"), "evidence_extract", F.concat(F.lit("quote id twice: "), "twice")))
    fails.append(_failed(met.where("claim_key is null"), "claim_generate", F.col("_listed")))
    fails.append(_failed(met.where("again"), "claim_generate", F.concat(F.lit("claim key twice: "), "claim_key")))
    evidence = met.where("typed is not null and known")
    closed = F.transform(F.filter("own", lambda q: q["gate"].isNotNull()), lambda q: F.concat(q["gate"], F.lit(" ("), q["quote_id"], F.lit(")")))
    fails.append(_failed(evidence, "gate", F.array_min(closed)))
    fails.append(_failed(evidence, "gate_support", F.col("_gate")))

    supported = evidence.where("_gate is null")
    ids, judged = F.transform("own", lambda q: q["quote_id"]), F.transform("judgments", lambda j: j["quote_id"])
    unclear = F.transform(F.filter("judgments", lambda j: j["effect"].isNull()), lambda j: j["quote_id"])
    often = F.when(F.size(F.array_distinct(judged)) < F.size(judged), F.filter(F.array_distinct(judged), lambda x: F.size(F.filter(judged, lambda y: x == y)) > 1)).otherwise(F.array().cast("array<string>"))
    odd = reduce(F.array_union, [F.array_except(ids, judged), F.array_except(judged, ids), unclear, often])
    fails.append(_failed(supported, "gate_support", F.concat(F.lit("not one label of its own: "), F.array_min(odd))))
    effects = F.filter(F.transform("judgments", lambda j: j["effect"]), lambda e: e.isNotNull())
    supported = supported.withColumn("publish", F.when(F.size(effects) > 0, F.array_contains(effects, "support")))
    dropped = [supported.where("not publish").select(*CLAIM, F.lit("no quote supports it").alias("reason"))]
    strong = F.transform(F.filter("judgments", lambda j: j["effect"].isin("support", "oppose")), lambda j: j["quote_id"])
    kept = supported.where("publish").withColumn("kept", F.filter("own", lambda q: F.array_contains(strong, q["quote_id"]))).where("size(kept) > 0")

    was = settled(claims.select("story_id", F.col("claim_id").alias("claim"), "claim_type", F.explode("evidence").alias("e")).select("story_id", "claim", "claim_type", "e.*"), "zstd")
    now = kept.join(was.select("story_id").distinct(), "story_id", "left_semi").select("story_id", F.col("claim_key").alias("claim"), "typed.claim_type", F.explode("kept").alias("q"))
    carried = matching.match_claims(intervals.continuity(was, now.select("story_id", "claim", "claim_type", "q.version", "q.start", "q.end"))).select("story_id", F.col("n").alias("claim_key"), F.col("previous").alias("previous_id"))
    before = claims.select("story_id", F.col("claim_id").alias("previous_id"), F.col("status").alias("previous_status"))

    many = F.size("kept") > 1
    fails.append(_failed(kept.where(many), "contradiction", F.col("_pair")))
    sides = F.transform("kept", lambda q: F.struct(q["quote_id"].alias("quote_id"), F.array_compact(F.array(q["origin"])).alias("origins")))
    sides, wrong = contradiction.judged_lists(kept.select(*CLAIM, sides.alias("quotes"), F.when(many, F.col("pairs")).alias("pairs")))
    fails.append(_failed(wrong, "contradiction", F.concat("claim_key", F.lit(": "), "reason")))
    seen = sides.join(carried, CLAIM, "left").join(before, ["story_id", "previous_id"], "left")
    guard = status.claim_status(F.col("previous_status"), F.lit(True), F.col("undeterminable"), F.col("supporting"), F.col("conflicting"), F.coalesce(F.col("previous_status") == "corrected", F.lit(False)), F.lit(False))
    decided = settled(seen.withColumn("_g", guard).select(*CLAIM, "previous_id", "supporting", "conflicting", "_g.publish", "_g.status"), "zstd")
    dropped.append(decided.where("not publish").select(*CLAIM, F.lit("undeterminable or without an origin").alias("reason")))
    shown = decided.where("publish").drop("publish")
    spans = F.array_sort(F.transform("kept", lambda q: F.struct(q["version"].alias("version"), q["start"].alias("start"), q["end"].alias("end"))))
    numbered = shown.join(kept.select(*CLAIM, "typed.*", spans.alias("evidence")), CLAIM).join(stories.select("story_id", (F.coalesce("revision_number", F.lit(0)) + 1).alias("revision_number")), "story_id")
    numbered = numbered.withColumn("n", F.row_number().over(Window.partitionBy("story_id").orderBy("n")) - 1)
    built = settled(numbered.withColumn("claim_id", F.coalesce("previous_id", ident.claim_id(F.col("story_id"), F.col("revision_number"), F.col("n")))), "zstd")
    numbered = built.select("story_id").distinct()
    fails.append(_failed(started.join(numbered, "story_id", "left_anti"), "revision", F.lit("no claim to show")))

    first = settled(reduce(DataFrame.unionByName, fails).groupBy("story_id").agg(F.min(F.struct("place", "stage", "reason")).alias("f")).select("story_id", "f.stage", "f.reason"), "zstd")
    good = built.join(first, "story_id", "left_anti").withColumn("evidence_key", ident.evidence_key(F.col("evidence")))
    publish, confirm = revisions.finalise(revisions.build(good), stories.where("content is not null").select("story_id", "content"))
    publish = settled(publish, "zstd")
    fresh = good.join(publish, "story_id", "left_semi").select(*(c.split(" ")[0] for c in CLAIMS.split(", ")), "revision_number", "supporting", "conflicting")
    changes = diffs.revision_changes(claims.join(publish, "story_id", "left_semi"), fresh).join(publish.select("story_id", "revision_number"), "story_id")
    ran = _of_stories(articles.select("story_id", F.col("article_version_id").alias("key")).distinct(), responses).join(started, "story_id", "left_semi")
    usage = ran.groupBy("stage").agg(F.sum("tokens").alias("tokens"), F.sum("spend").alias("spend"))
    return Batch(publish, fresh, changes, confirm, first, plan.where("not runs").select("story_id"), reduce(DataFrame.unionByName, dropped), usage)


def _met(started: DataFrame, quotes: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each claim that a started story lists, its own quotes in a list and both answers (g, p) about it, and a row of each
    story under a null key, with the reason why no claims are listed.

    All that is said of a story meets in one shuffle; quotes then reach the claims that name them within its task.
    """
    parts = (started.withColumn("started", F.lit(True)), quotes, answers)
    tasks = max(int(started.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + quotes.count() // QUOTES)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition(tasks, "story_id")
    once = rows.groupBy("story_id", "quote_id", "stage", "claim_key").agg(F.max("started").alias("started"), F.min("q").alias("q"), F.count("q").alias("times"), _greatest())
    once = once.withColumn("r", F.when(F.col("stage").isNotNull(), F.col("r")))

    generated = F.col("stage") == "claim_generate"
    read = _read(once.withColumns({"_c": F.when(generated, F.col("r")), "r": F.when(~generated, F.col("r"))}), "claim_generate", "_c", "items", "_listed")  # read once, not carried to each name
    typed = lambda c, n: F.struct(n.alias("n"), c["claim_type"].alias("claim_type"), c["modality"].alias("modality"), c["text"].alias("text"))
    ids = lambda c: F.when(F.size(c["quote_ids"]) > 0, F.array_distinct(c["quote_ids"])).otherwise(F.array(F.lit(None).cast("string")))
    named = F.flatten(F.transform("items", lambda c, n: F.transform(ids(c), lambda q: F.struct(c["claim_key"].alias("claim_key"), q.alias("quote_id"), typed(c, n).alias("typed")))))
    with_names = read.withColumn("_named", named).withColumn("_itself", F.array(F.struct("claim_key", "quote_id", F.when(F.lit(False), F.col("_named")[0]["typed"]).alias("typed"))))
    each = with_names.select("story_id", "started", "q", "times", "stage", "r", "_listed", F.explode(F.concat("_itself", F.coalesce("_named", F.slice("_itself", 1, 0)))).alias("x"))
    each = each.select("story_id", "started", "q", "times", "stage", "r", "_listed", "x.*")

    found = each.withColumn("q", F.max("q").over(Window.partitionBy("story_id", "quote_id"))).withColumn("started", F.max("started").over(Window.partitionBy("story_id"))).where("started")
    lists = F.col("typed").isNotNull()
    own = F.collect_list(F.when(lists & F.col("q").isNotNull(), F.struct("quote_id", "q.*")))
    of = lambda stage: F.max(F.when((F.col("stage") == stage) & ~lists, F.col("r")))
    answered = generated & ~lists
    why = F.when(F.max(F.when(answered, F.lit(True))).isNull(), "no response").otherwise(F.max(F.when(answered, F.col("_listed"))))
    return found.groupBy(*CLAIM).agg(
        F.array_sort(own).alias("own"),
        F.bool_and(F.when(lists, F.col("q").isNotNull())).alias("known"),
        F.min(F.when((F.col("times") > 1) & ~lists, F.col("quote_id"))).alias("twice"),
        (F.min("typed.n") != F.max("typed.n")).alias("again"),
        F.min("typed").alias("typed"),
        of("gate_support").alias("g"),
        of("contradiction").alias("p"),
        why.alias("_listed"),
    )


def outcomes(batch: Batch) -> DataFrame:
    """story_id, outcome, stage, reason of every story of the batch."""
    none = F.lit(None).cast("string")
    named = [df.select("story_id", F.lit(n).alias("outcome"), none.alias("stage"), none.alias("reason")) for n, df in (("revision", batch.revisions), ("confirmed", batch.confirmed), ("deferred", batch.deferred))]
    return reduce(DataFrame.unionByName, [*named, batch.failures.select("story_id", F.lit("failed").alias("outcome"), "stage", "reason")])


def state_after(stories: DataFrame, batch: Batch, now: Column) -> DataFrame:
    """The stories once a batch is applied: numbers and contents of new revisions, when each was checked, and marks of deferral.

    A failed story loses its mark as well, so that one that always fails doesn't come first in every batch.
    """
    did = outcomes(batch).select("story_id", "outcome").join(batch.revisions.select("story_id", F.col("revision_number").alias("_number"), F.col("content").alias("_content")), "story_id", "left")
    s = stories.join(did, "story_id", "left")
    checked = F.col("outcome").isin("revision", "confirmed")
    s = s.withColumns({"revision_number": F.coalesce("_number", "revision_number"), "content": F.coalesce("_content", "content"), "checked_at": F.when(checked, now).otherwise(F.col("checked_at")), "deferred_at": F.when(checked | (F.col("outcome") == "failed"), None).otherwise(F.col("deferred_at"))})
    return sinks.defer(s.drop("outcome", "_number", "_content"), "deferred_at", batch.deferred, "story_id", now)


def apply(tables: Tables, slot: str, attempt: int, batch: Batch, stories: DataFrame, claims: DataFrame, now: Column, base: dict | None = None) -> bool:
    """Commit a batch: revisions and their changes added, stories and newest claims replaced, the run noted. False: the slot was done before.

    Revisions that are there already, under their story and number, are not added again.
    """
    number = ["story_id", "revision_number"]
    new = sinks.append_new(tables.read("revisions", REVISIONS, base), batch.revisions.select(*number, "status", "content", now.alias("published_at"), F.lit(slot).alias("slot")), number)
    columns = [c.split(" ")[0] for c in CLAIMS.split(", ")]
    newest = claims.join(batch.revisions, "story_id", "left_anti").select(*columns).unionByName(batch.claims.select(*columns))
    kinds = [F.count_if(F.col("outcome") == o).alias(n) for o, n in (("revision", "published"), ("confirmed", "confirmed"), ("failed", "failed"), ("deferred", "deferred"))]
    used = batch.usage.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("spend"), F.lit(0.0)).alias("spend"))
    noted = outcomes(batch).agg(*kinds).crossJoin(used).select(F.lit(slot).alias("slot"), F.lit(attempt).alias("attempt"), "published", "confirmed", "failed", "deferred", "tokens", "spend", now.alias("finished_at"))  # one row each
    changes = batch.changes.select(*(c.split(" ")[0] for c in CHANGES.split(", ")))
    return tables.commit(slot, attempt, {"revisions": new, "changes": changes, "runs": noted}, {"stories": state_after(stories, batch, now), "claims": newest}, base)


def run_slot(tables: Tables, slot: str, attempt: int, articles: DataFrame, sources: DataFrame, responses: DataFrame, spend: float, tokens: int, now: Column) -> bool:
    """Run and commit a slot from what the tables hold; nothing is computed for a slot that is done."""
    base = tables.manifest()
    if slot in base["slots"]:
        return False
    stories, claims = tables.read("stories", STORIES, base), tables.read("claims", CLAIMS, base)
    return apply(tables, slot, attempt, run(articles, sources, stories, claims, responses, spend, tokens), stories, claims, now, base)
