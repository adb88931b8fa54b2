"""Catalogue: stories between batches, reads of a batch, and counts of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import ident, times
from quillspark.operators import stories
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with s as (select o_custkey story, max(o_orderdate) last_report from orders where o_orderkey % 4 <> 0 group by 1), i as (select * from orders where o_orderkey % 4 = 0),
a as (select o_custkey story, max(o_orderdate) published, avg(o_totalprice) x from orders where o_custkey in (select o_custkey from i) group by 1)
select coalesce(s.story, a.story) story, greatest(s.last_report, (select max(o_orderdate) from i where o_custkey = a.story)) last_report, round(a.x, 6) centroid,
case when a.story is null then 'dormant' else 'active' end lifecycle, (select string_agg(p, ',' order by p) from (select distinct o_orderpriority p from i where o_custkey = a.story)) topics from s full join a on s.story = a.story""")
def assign_apply(spark, sf):
    articles = t(spark, sf, "orders").select(F.col("o_orderkey").alias("article"), F.col("o_custkey").alias("story"), F.array(F.col("o_totalprice")).alias("vector"), F.array("o_orderpriority").alias("topics"), F.col("o_orderdate").alias("published"))
    known, incoming = articles.where("article % 4 <> 0"), articles.where("article % 4 = 0")
    none, empty = F.lit(None), F.expr("cast(array() as array<string>)")
    before = known.groupBy("story").agg(F.max("published").alias("last_report")).select("story", empty.alias("topics"), none.cast("array<double>").alias("centroid"), "last_report", none.cast("timestamp").alias("processed"), F.lit("dormant").alias("lifecycle"))
    after = stories.assigned(before, known, incoming, F.lit("2024-02-01").cast("timestamp"), PRIORITIES)
    return after.select("story", "last_report", F.round(F.col("centroid")[0], 6).alias("centroid"), "lifecycle", F.when(F.size("topics") > 0, F.array_join("topics", ",")).alias("topics"))


@query("""with k as (select l_orderkey, l_partkey || ':' || l_linenumber || '-' || (l_linenumber + l_quantity::bigint) k from lineitem) select l_orderkey claim, string_agg(k, '|' order by k) evidence_key from k group by 1""")
def evidence_key(spark, sf):
    spans = F.struct(F.col("l_partkey").alias("version"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("end"))
    claims = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.collect_list(spans).alias("evidence"))  # a claim's own spans
    return claims.select("claim", ident.evidence_key(F.col("evidence")).alias("evidence_key"))


@query("""select conv_id, turn, turn = max(turn) over (partition by conv_id) is_latest from conversations qualify turn <= 3""")
def revision_strip(spark, sf):
    return stories.strip(t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.lit(3))


@query("""select conv_id, max(turn) turn, arg_max(role, turn) role from conversations where conv_id not in (select conv_id from conversations where turn = 4) group by conv_id""")
def extendable_revision(spark, sf):
    c = t(spark, sf, "conversations")
    return stories.extendable(c, c.where("turn = 4").distinct(), "conv_id", "turn", ["role"])


@query("""select source, max(doc_id) doc_id from documents group by source having arg_max(lang, doc_id) <> 'en'""")
def recheck_targets(spark, sf):
    versions = t(spark, sf, "documents").select("source", "doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("body"))
    return stories.recheck_targets(versions.where("source is not null"), "source", "doc_id", "body").select("source", "doc_id")


@query("""with r as (select o_orderkey slot, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'running' end status, o_orderkey % 3 attempt, o_orderdate lease_expires from orders where o_orderkey % 2 = 0),
m as (select max(lease_expires) alive_to from r where status = 'running'), a as (select o_orderkey slot, o_orderdate as now from orders)
select a.slot, case when status = 'completed' then 'already_completed' when alive_to > now then 'busy' else 'started' end decision, case when coalesce(status, '') <> 'completed' and not coalesce(alive_to > now, false) then coalesce(attempt, 0) + 1 end attempt from a left join r using (slot), m""")
def slot_leases(spark, sf):
    o = t(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    runs = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("slot"), status.alias("status"), (F.col("o_orderkey") % 3).alias("attempt"), F.col("o_orderdate").alias("lease_expires"))
    return stories.leases(runs, o.select(F.col("o_orderkey").alias("slot"), F.col("o_orderdate").alias("now")))


@query("""select user_id, count(*) filter (event_type = 'view') discovery, least(20 - count(*) filter (event_type = 'click'), greatest(70 - count(*) filter (event_type = 'view') - count(*) filter (event_type = 'click'), 0)) allowance, allowance >= 2 may_start from events group by user_id""")
def recheck_allowance(spark, sf):
    n = t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("discovery"), F.count_if(F.col("event_type") == "click").alias("recheck"))
    return n.select("user_id", "discovery", stories.allowance(F.col("discovery"), F.col("recheck"), 70, 20).alias("allowance"), stories.may_start(F.col("discovery"), F.col("recheck"), 70, 20).alias("may_start"))


@query("""select a.doc_id, b.text is not null reused from documents a left join (select distinct text from documents where doc_id % 2 = 0) b on a.text = b.text where a.doc_id % 2 = 1""")
def vector_reuse(spark, sf):
    d = t(spark, sf, "documents")
    known = d.where("doc_id % 2 = 0").select("text", F.array(F.col("n_chars")).alias("vector"))
    pending = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("key"), "text")
    return stories.reused(pending, known).select(F.col("key").alias("doc_id"), F.col("vector").isNotNull().alias("reused"))


@query("""select distinct a.l_suppkey packet, a.l_orderkey a_id, b.l_orderkey b_id from lineitem a join lineitem b on a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey where a.l_returnflag = 'R' and b.l_returnflag = 'A'""")
def quote_overlap(spark, sf):
    claims = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("packet"), F.col("l_orderkey").alias("id"), "l_returnflag").agg(F.collect_set("l_partkey").alias("sentences"))
    return stories.overlapping(claims.where("l_returnflag = 'R'"), claims.where("l_returnflag = 'A'"))


@query("select event_type, round(sum(value), 4) value, sum(event_id)::bigint event_id from events group by event_type")
def usage_totals(spark, sf):
    return stories.usage(t(spark, sf, "events"), "event_type", "value", "event_id").withColumn("value", F.round("value", 4))


@query(r"""select regexp_extract(o_orderpriority, '^[0-9]-([A-Z]+)', 1) stage, count(*) n from orders where regexp_matches(o_orderpriority, '^[0-9]-[A-Z]+') and o_orderstatus = 'F' group by 1""")
def failures_by_stage(spark, sf):
    return stories.failures(t(spark, sf, "orders").where("o_orderstatus = 'F'"), "o_orderpriority", "^[0-9]-([A-Z]+)")


@query("""with c as (select unnest([0, 1, 2]) c), l as (select quality gold, toxic predicted from labels) select a.c gold, b.c predicted, count(l.gold) n from c a cross join c b left join l on l.gold = a.c and l.predicted = b.c group by 1, 2""")
def confusion_matrix(spark, sf):
    return stories.confusion(t(spark, sf, "labels"), [0, 1, 2], "quality", "toxic").select(F.col("gold").cast("int").alias("gold"), F.col("predicted").cast("int").alias("predicted"), "n")


@query("""with e as (select event_id, ts + interval 9 hour as k from events) select event_id, year(k) || '. ' || month(k) || '. ' || day(k) || '. ' || lpad(hour(k)::varchar, 2, '0') || ':00~' || lpad((hour(k) + 6)::varchar, 2, '0') || ':00' label, year(k) || '. ' || month(k) || '. ' || day(k) || '.' as "day" from e""")
def bin_labels(spark, sf):
    return t(spark, sf, "events").select("event_id", times.bin_label(F.col("ts"), 6).alias("label"), times.bin_label(F.col("ts"), 24).alias("day"))
