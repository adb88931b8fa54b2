"""Catalogue: latest rows, changes, feeds and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import ident
from quillspark.operators import diffs, feed, latest, ledgers, sinks
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


@query("""with r as (select *, row_number() over (partition by conv_id order by turn) rn, row_number() over (partition by conv_id order by turn desc) rd from conversations)
select conv_id, max(turn) latest_order, max(case when rd = 1 then text end) latest_text, string_agg(case when rn <= 3 then text end, ' | ' order by turn) first_texts, count(distinct role) n_origins, count(*) n_rows from r group by conv_id""")
def today_cards(spark, sf):
    c = latest.card(t(spark, sf, "conversations"), "conv_id", "turn", "text", "role")
    return c.withColumn("first_texts", F.array_join("first_texts", " | "))


@query("""with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders)
select o_custkey, o_orderkey, round(o_totalprice, 2) o_totalprice from r where rn = 1""")
def latest_revision_max_by(spark, sf):
    found = latest.latest(t(spark, sf, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_totalprice"])
    return found.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc) rd from conversations),
p as (select * from r where rd = 2), n as (select * from r where rd = 1)
select coalesce(n.conv_id, p.conv_id) conv_id, case when p.conv_id is null then 'added' when n.conv_id is null then 'removed' when p.role = n.role then 'unchanged' else 'modified' end change, p.text previous_text, n.text current_text from n full join p on n.conv_id = p.conv_id""")
def revision_diff(spark, sf):
    ranked = latest.first_per(t(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 2, "rd")
    d = diffs.diff(ranked.where("rd = 2"), ranked.where("rd = 1"), ["conv_id"], F.col("p.role") == F.col("n.role"))
    return d.select("conv_id", "change", F.col("previous.text").alias("previous_text"), F.col("current.text").alias("current_text"))


@query("select l_orderkey, count(*) filter (l_returnflag = 'A') \"n_A\", count(*) filter (l_returnflag = 'N') \"n_N\", count(*) filter (l_returnflag = 'R') \"n_R\" from lineitem group by l_orderkey")
def revision_change_counts(spark, sf):
    return diffs.change_counts(t(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"])


@query("""with s as (select o_custkey, min(o_orderkey) seen from orders group by 1), c as (select o_custkey, l_orderkey, count(*) filter (l_returnflag = 'R') r from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)
select c.o_custkey, sum(r)::bigint r from c join s using (o_custkey) where l_orderkey > seen group by 1""")
def changes_since_seen(spark, sf):
    orders, lines = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    counts = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy("o_custkey", "l_orderkey").agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    seen = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("l_orderkey"))
    return diffs.counts_since(counts, seen, "o_custkey", "l_orderkey", ["r"])


@query("""with l as (select l_partkey, arg_max(l_linestatus, l_orderkey * 10 + l_linenumber) l_linestatus from lineitem group by 1)
select * from l where l_linestatus = 'O' and l_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_linenumber = 7)""")
def history_last_status(spark, sf):
    lines = t(spark, sf, "lineitem")
    return latest.last_status(lines, lines.where("l_returnflag = 'R' and l_linenumber = 7"), "l_partkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_linestatus", "O")


@query("""with h as (select source, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') h from documents)
select source, count(*) || ':' || sum(('0x' || substr(h, 1, 13))::bigint) || ':' || sum(('0x' || substr(h, 14, 13))::bigint) content from h group by source""")
def content_equality(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(ident.content_digest("lang", "n_chars").alias("content"))


@query("""select c.doc_id, c.lang from documents c join (select source, max(doc_id) m from documents group by 1) x on c.source = x.source and c.doc_id > x.m - 100""")
def recent_by_source(spark, sf):
    docs = t(spark, sf, "documents")
    last = docs.groupBy("source").agg(F.max("doc_id").alias("m"))
    return docs.join(last, "source").where(F.col("doc_id") > F.col("m") - 100).select("doc_id", "lang")


@query("""with c as (select l_orderkey, count(*) n, count(distinct l_suppkey) s from lineitem group by 1)
select o_orderkey, n, s from orders join c on l_orderkey = o_orderkey order by case when s >= 2 then 1 else 0 end desc, case when o_orderstatus = 'P' then o_orderdate end asc nulls last, n desc, o_orderpriority, o_orderkey limit 100""")
def priority_order(spark, sf):
    c = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("s"))
    o = t(spark, sf, "orders").join(c, F.col("l_orderkey") == F.col("o_orderkey"))
    deferred = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    return o.orderBy(*feed.priority(F.col("s"), deferred, F.col("n"), F.col("o_orderpriority"), F.col("o_orderkey"))).limit(100).select("o_orderkey", "n", "s")


@query("""select a.o_orderkey from orders a where a.o_orderdate < (select max(o_orderdate) from orders) - interval 48 hour and not exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderdate > a.o_orderdate)""")
def deferred_stale(spark, sf):
    o = t(spark, sf, "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"))
    now = o.agg(F.max("o_orderdate").alias("now"))
    joined = o.join(newest, "o_custkey").crossJoin(F.broadcast(now))  # one row
    return joined.where((F.col("o_orderdate") < F.col("now") - F.expr("interval 48 hours")) & (F.col("newest") <= F.col("o_orderdate"))).select("o_orderkey")


@query("""select o_custkey, bool_or(o_orderstatus = 'P') or max(case when o_orderstatus = 'F' then o_orderdate end) is null or max(o_orderdate) > max(case when o_orderstatus = 'F' then o_orderdate end) needs from orders group by o_custkey""")
def needs_reprocess(spark, sf):
    checked = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    needs = F.bool_or(F.col("o_orderstatus") == "P") | checked.isNull() | (F.max("o_orderdate") > checked)
    return t(spark, sf, "orders").groupBy("o_custkey").agg(needs.alias("needs"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(f"""with f as (select o_custkey usr, o_orderkey story from orders union select c_custkey, o_orderkey from customer join orders on o_orderpriority = ({PRIORITIES})[c_custkey % 5 + 1])
select usr, count(*) n, min(story) first_story from f group by usr""")
def topic_overlap_feed(spark, sf):
    orders, customers = t(spark, sf, "orders"), t(spark, sf, "customer")
    stories = orders.select(F.col("o_orderkey").alias("story"), F.col("o_orderpriority").alias("topic"))
    own = orders.select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("story"))
    topics = customers.select(F.col("c_custkey").alias("user"), F.element_at(F.array(*map(F.lit, PRIORITIES)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("topic"))
    return feed.followed_counts(stories, own, topics).withColumnRenamed("user", "usr")


@query("select l_orderkey, arg_min(l_partkey, epoch(l_shipdate) * 10 + l_linenumber) filter (l_returnflag = 'R') part from lineitem where l_returnflag = 'R' group by 1")
def lead_item(spark, sf):
    # ten units a second and the number, as the SQL counts; of equal lines the first of the table
    at = F.col("l_shipdate").cast("timestamp_ntz") + F.col("l_linenumber") * F.expr("interval '0.1' second")
    lines = t(spark, sf, "lineitem").select("*", at.alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return feed.lead_item(lines.where("l_returnflag = 'R'").withColumnRenamed("l_partkey", "part"), "l_orderkey", ["at", "file", "row"], "part")


@query("""select l_orderkey, l_linenumber, case when s_nationkey % 2 = 0 then l_returnflag end excerpt from lineitem join supplier on l_suppkey = s_suppkey""")
def tier_masking(spark, sf):
    tier = F.when(F.col("s_nationkey") % 2 == 0, "body_and_excerpt").otherwise("link_only")
    joined = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("l_orderkey", "l_linenumber", feed.masked(F.col("l_returnflag"), tier).alias("excerpt"))


@query("""select n_nationkey, 'n_name' field, n_name before, upper(n_name) || '!' "after" from nation where n_regionkey = 1 union all select n_nationkey, 'n_regionkey', n_regionkey::varchar, (n_regionkey + 1)::varchar from nation where n_regionkey = 2""")
def registry_diff(spark, sf):
    old = t(spark, sf, "nation")
    new = old.select("n_nationkey", F.when(F.col("n_regionkey") == 1, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_regionkey") == 2, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    return diffs.unpivot_diff(old, new, "n_nationkey", ["n_name", "n_regionkey"])


@query("""with d as (select doc_id, row_number() over (order by n_chars, doc_id) r from documents where n_chars <= 2000) select documents.doc_id, not coalesce(r <= 100, false) has_text from documents left join d using (doc_id)""")
def retention_null(spark, sf):
    kept = sinks.expire_oldest(t(spark, sf, "documents"), "text", F.col("n_chars"), F.lit(2000), "doc_id", 100)
    return kept.select("doc_id", F.col("text").isNotNull().alias("has_text"))


@query("select o_orderkey, o_custkey from orders where o_orderkey % 3 = 0")
def idempotent_append(spark, sf):
    o = t(spark, sf, "orders")
    return sinks.append_new(o.where("o_orderkey % 3 <> 0"), o, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""select n_nationkey, case when n_nationkey % 2 = 0 then n_name || '*' else n_name end n_name, n_regionkey from nation""")
def upsert_state(spark, sf):
    n = t(spark, sf, "nation")
    incoming = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat("n_name", F.lit("*")).alias("n_name"))
    return sinks.upsert(n, incoming, ["n_nationkey"], ["n_name"])


@query("select o_custkey, arg_max(o_orderkey, o_orderkey) o_orderkey from orders group by 1")
def record_visits(spark, sf):
    return sinks.latest_visit(t(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderkey"])


@query("""with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) select user_id from r where n = 1 and event_type <> 'logout' and value > 20""")
def follows_left(spark, sf):
    return sinks.toggled(t(spark, sf, "events"), ["user_id"], F.struct("ts", "event_id"), (F.col("event_type") != "logout") & (F.col("value") > 20))


@query("select strftime(ts, '%Y-%m-%d') as \"day\", count(*) discovery, count(*) filter (event_type = 'click') recheck from events group by 1")
def request_ledger(spark, sf):
    e = t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).cast("long").alias("discovery"), F.when(F.col("event_type") == "click", 1).otherwise(0).cast("long").alias("recheck"))
    half = F.pmod(F.xxhash64("day", "recheck"), F.lit(2)) == 0
    return sinks.ledger(e.where(half), e.where(~half), "day", ["discovery", "recheck"])


@query("""select l_orderkey, l_linenumber, case when l_suppkey % 10 < 5 then s_nationkey else -1 end nation from lineitem left join supplier on s_suppkey = l_suppkey and l_suppkey % 10 < 5""")
def evidence_repoint(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key"), F.lit(-1).alias("nation"))
    articles = t(spark, sf, "supplier").where("s_suppkey % 10 < 5").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return sinks.repoint(lines, articles, "key", "nation").select("l_orderkey", "l_linenumber", "nation")


@query("""select a.event_id, b.event_id before_id from events a asof join (select user_id, ts, event_id from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts where a.event_type = 'click'
union all select event_id, null from events a where event_type = 'click' and not exists (select 1 from events b where b.event_type = 'purchase' and b.user_id = a.user_id and b.ts <= a.ts)""")
def as_of_last(spark, sf):
    e = t(spark, sf, "events")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bts"), F.col("event_id").alias("before_id"))
    return latest.as_of(e.where("event_type = 'click'"), right, "user_id", "ts", "bts", ["before_id"]).select("event_id", "before_id")


@query("""with d as (select distinct strftime(ts, '%Y-%m-%d') as "day", user_id from events) select user_id, count(*) as n_days from d group by user_id having count(*) > 3""")
def active_days(spark, sf):
    e = t(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").distinct()
    return e.groupBy("user_id").agg(F.count("*").alias("n_days")).where("n_days > 3")


@query("select doc_id from (select doc_id, row_number() over (partition by source order by sha256('seed|' || doc_id), doc_id) r from documents) where r <= 5")
def dormant_sample(spark, sf):
    return ledgers.seeded_sample(t(spark, sf, "documents"), "doc_id", "seed", 5, ["source"]).select("doc_id")


@query("""with m as (select *, quality = toxic as must from labels), r as (select *, row_number() over (partition by must order by sha256('audit|' || doc_id), doc_id) r, count(*) over (partition by must) n from m) select doc_id from r where must or r <= ceil(n * 0.2)""")
def audit_sample(spark, sf):
    return ledgers.audit_sample(t(spark, sf, "labels"), "doc_id", "audit", F.col("quality") != F.col("toxic"), F.lit(False)).select("doc_id")
