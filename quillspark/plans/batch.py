"""Catalogue: a whole batch from recorded answers, judged quotes, and components of labelled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import batch, contradiction
from quillspark.operators.components import components
from quillspark.session import settled
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with l as (select distinct 's' || o_custkey story, o_custkey ck, o_orderkey ok, o_orderpriority src, 'q' || l_orderkey || '-' || l_linenumber || '-' || l_partkey q, 'c' || (l_linenumber % 3) c,
max(l_returnflag) f, max(l_linestatus) ls from orders join lineitem on o_orderkey = l_orderkey where o_orderpriority <> '5-LOW' group by all),
e as (select *, case f when 'A' then 'supported' when 'R' then 'conflicting' else 'partial' end lab from l),
k as (select story, c, any_value(ck) ck, count(*) filter (lab <> 'partial') kept, bool_or(lab = 'supported') publish, arg_min(ls, q) filter (lab <> 'partial') firstls from e group by all),
o as (select story, c, src, bool_or(ls = firstls) sup, bool_or(ls <> firstls) opp from e join k using (story, c) where lab <> 'partial' and publish group by all),
j as (select story, c, count(*) filter (sup) s, count(*) filter (opp and not sup) n from o group by all),
r as (select 's' || o_custkey story, any_value(o_custkey) ck, count(*) articles, count(distinct o_orderpriority) sources, count(*) filter (o_orderpriority <> '5-LOW') asked from orders group by all),
g as (select story, count(*) claims, count(*) filter (kept > 1) compared from k group by all),
p as (select r.*, coalesce(claims, 0) claims, asked + case when claims > 0 and ck % 7 <> 3 then 1 else 0 end + coalesce(claims, 0) + coalesce(compared, 0) spend from r left join g using (story)),
b as (select *, sum(spend) over (order by (sources >= 2)::int desc, articles desc, ck % 5, story) <= floor(0.7 * sum(spend) over ()) runs from p),
x as (select story, count(*) shown, count(*) filter (n > 0) conflict, count(*) filter (n = 0 and s > 1) agree, sum(s)::bigint supporting from j group by all)
select story, case when not runs then 'deferred' when claims = 0 or ck % 7 = 3 or ck % 11 = 5 or shown is null then 'failed' else 'revision' end outcome,
case when not runs then null when claims = 0 or ck % 7 = 3 then 'claim_generate' when ck % 11 = 5 then 'gate_support' when shown is null then 'revision' end stage,
case when outcome = 'revision' then shown end claims, case when outcome = 'revision' then conflict end conflict, case when outcome = 'revision' then agree end agree, case when outcome = 'revision' then supporting end supporting from b left join x using (story)""")
def slot_batch(spark, sf):
    """Customers are stories, orders articles, order lines quotes; answers are recorded from the tables. Customers with 3 mod 7 have
    no answer about their claims, those with 5 mod 11 a wrong one about their quotes; the budget is 70 % of what all would spend."""
    story = F.concat(F.lit("s"), F.col("o_custkey"))
    orders = t(spark, sf, "orders")
    stories = orders.select(story.alias("story_id"), (F.col("o_custkey") % 5).cast("int").alias("topic_rank")).distinct()
    stories = stories.selectExpr("*", "cast(null as int) revision_number", "cast(null as string) content", "cast(null as timestamp) checked_at", "cast(null as timestamp) deferred_at")
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").repartition("l_orderkey")  # one shuffle for all that follows
    lines = lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line"))
    lines = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "flag", "line")).alias("lines"))  # an order's own lines
    orders = settled(orders.select("o_custkey", "o_orderkey", "o_orderpriority").join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey"), "zstd")
    quote = lambda order, i: F.concat(F.lit("q"), F.concat_ws("-", order, i["l_linenumber"], i["l_partkey"]))
    said = lambda i: F.concat(F.lit("Line "), i["l_linenumber"], F.lit(" holds part "), i["l_partkey"], F.lit("."))
    body = F.array_join(F.array_sort(F.transform("lines", said)), " ").alias("body")
    version = F.concat(F.lit("v"), F.col("o_orderkey"))
    articles = orders.select(story.alias("story_id"), F.col("o_orderkey").alias("article_id"), version.alias("article_version_id"), F.col("o_orderpriority").alias("source_id"), body)
    sources = orders.select(F.col("o_orderpriority").alias("source_id")).distinct().withColumns({"rights_tier": F.when(F.col("source_id") == "5-LOW", "link_only").otherwise("body_only"), "wire_id": F.lit(None).cast("string")})

    open_ = orders.where("o_orderpriority <> '5-LOW'")
    items = F.transform("lines", lambda i: F.struct(quote(F.col("o_orderkey"), i).alias("quote_id"), said(i).alias("quote")))
    extracts = open_.select("o_orderkey", F.array_sort(F.coalesce(items, F.array().cast("array<struct<quote_id:string,quote:string>>"))).alias("items"))
    quotes = open_.select("o_custkey", "o_orderkey", "lines").repartition("o_custkey").select("o_custkey", "o_orderkey", F.explode("lines").alias("i"))
    label = F.when(F.col("i.flag") == "A", "supported").when(F.col("i.flag") == "R", "conflicting").otherwise("partial")
    claim = quotes.select("o_custkey", F.concat(F.lit("c"), F.col("i.l_linenumber") % 3).alias("claim_key"), quote(F.col("o_orderkey"), F.col("i")).alias("q"), F.col("i.line").alias("line"), label.alias("label"))
    claim = claim.groupBy("o_custkey", "claim_key").agg(F.array_sort(F.collect_list(F.struct("q", "line", "label"))).alias("x"))  # a claim's own quotes
    claim = claim.withColumn("kept", F.filter("x", lambda i: i["label"] != "partial"))
    text = F.concat(F.lit("what "), "claim_key", F.lit(" says"))
    listed = F.struct("claim_key", text.alias("text"), F.lit("fact").alias("claim_type"), F.lit("asserted").alias("modality"), F.transform("x", lambda i: i["q"]).alias("quote_ids"))
    odd = F.col("o_custkey") % 11 == 5
    judged = F.transform("x", lambda i: F.struct(i["q"].alias("quote_id"), F.when(odd, "odd").otherwise(i["label"]).alias("label")))
    first = F.col("kept")[0]
    pairs = F.transform(F.slice("kept", 2, F.size("kept")), lambda i: F.struct(first["q"].alias("a"), i["q"].alias("b"), F.when(i["line"] == first["line"], "agree").otherwise("incompatible").alias("label")))
    answer = lambda stage, key, output: F.struct(F.lit(stage).alias("stage"), key.alias("key"), output.alias("output"))
    gate = answer("gate_support", F.concat(story, F.lit(":gate:"), "claim_key"), F.to_json(F.struct(judged.alias("judgments"))))
    compared = answer("contradiction", F.concat(story, F.lit(":"), "claim_key"), F.to_json(F.struct(pairs.alias("pairs"))))
    by_claim = claim.select("o_custkey", listed.alias("listed"), gate.alias("gate"), F.when(F.size("kept") > 1, compared).alias("compared"))
    by_story = by_claim.groupBy("o_custkey").agg(F.array_sort(F.collect_list("listed")).alias("listed"), F.collect_list("gate").alias("gates"), F.collect_list("compared").alias("compared"))  # a story's own answers
    generated = F.when(F.col("o_custkey") % 7 != 3, answer("claim_generate", story, F.to_json(F.struct(F.col("listed").alias("claims")))))
    answers = by_story.select(F.inline(F.concat(F.array_compact(F.array(generated)), "gates", "compared")))
    extracts = extracts.select(answer("evidence_extract", version, F.to_json(F.struct(F.col("items").alias("quotes")))).alias("a")).select("a.*")
    paid = {"tokens": F.lit(10).cast("long"), "spend": F.lit(1.0), "failure": F.lit(None).cast("string")}
    responses = settled(extracts.unionByName(answers).withColumns(paid), "zstd")
    done = batch.run(articles, sources, stories, spark.createDataFrame([], batch.CLAIMS), responses, float(int(0.7 * responses.count())), 2**62)
    counts = done.claims.groupBy("story_id").agg(F.count("*").alias("claims"), F.count_if(F.col("status") == "conflict").alias("conflict"), F.count_if(F.col("status") == "multi_agree").alias("agree"), F.sum("supporting").alias("supporting"))
    return batch.outcomes(done).join(counts, "story_id", "left").select(F.col("story_id").alias("story"), "outcome", "stage", "claims", "conflict", "agree", "supporting")


@query("""with e as (select l_suppkey sk, l_orderkey a, min(l_linestatus) ls from lineitem where l_returnflag <> 'N' group by all),
f as (select *, first_value(a) over w h, first_value(ls) over w hs from e window w as (partition by sk order by a)),
s as (select distinct l_suppkey sk, l_partkey % 5 src, l_orderkey a from lineitem where l_returnflag <> 'N'),
m as (select s.sk, src, bool_or(ls = hs) sup, bool_or(ls <> hs) opp from s join f on f.sk = s.sk and f.a = s.a group by all)
select sk as suppkey, count(*) filter (sup) supporting, count(*) filter (opp and not sup) conflicting from m group by sk""")
def quote_origins(spark, sf):
    """A supplier is a claim, its returned or accepted orders its quotes; the first quote agrees with those of its line status and is
    incompatible with the others. An order may have several origins."""
    lines = t(spark, sf, "lineitem").where("l_returnflag <> 'N'")
    quotes = lines.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linestatus").alias("line"), F.collect_set(F.col("l_partkey") % 5).alias("origins"))
    quotes = settled(quotes)
    head = quotes.groupBy("l_suppkey").agg(F.min_by(F.struct(F.col("l_orderkey").alias("q"), "line"), "l_orderkey").alias("h"))
    keys = [F.lit("s").alias("story_id"), F.col("l_suppkey").cast("string").alias("claim_key")]
    name = lambda c: F.col(c).cast("string")
    pairs = quotes.join(head, "l_suppkey").where("l_orderkey <> h.q").select(*keys, name("h.q").alias("a"), name("l_orderkey").alias("b"), F.when(F.col("line") == F.col("h.line"), "agree").otherwise("incompatible").alias("label"))
    evidence = quotes.select(*keys, name("l_orderkey").alias("quote_id"), F.explode("origins").alias("o")).withColumn("origin", name("o")).drop("o")
    good, _ = contradiction.judged(settled(evidence), settled(pairs))
    return good.select(F.col("claim_key").cast("long").alias("suppkey"), "supporting", "conflicting")


@query("""with recursive e as (select o_custkey * 10 + o_orderkey % 2 a, o_custkey * 10 + 2 + l_suppkey % 4 b from orders join lineitem on o_orderkey = l_orderkey group by all),
u as (select a, b from e union all select b, a from e), n as (select distinct a node from u),
r(node, reached) as (select node, node from n union select r.node, u.b from r join u on u.a = r.reached)
select node, min(reached) component from r group by node""")
def label_components(spark, sf):
    """Components of same-story labels: an order's parity and its lines' suppliers, mod 4, within a customer."""
    pairs = t(spark, sf, "orders").join(t(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return components(pairs.select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 2).alias("a"), (F.col("o_custkey") * 10 + 2 + F.col("l_suppkey") % 4).alias("b")))
