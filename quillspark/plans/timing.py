"""Catalogue: slots, bins, rates, budgets and sessions over the stream of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import times
from quillspark.operators import ledgers
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}
KEY = "%Y-%m-%dT%H:%MZ"
ORIGIN = "timestamp '2000-01-01 08:00:00'"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"select strftime(time_bucket(interval 12 hour, ts, {ORIGIN}), '{KEY}') slot, count(*) n, count(distinct user_id) users from events group by 1")
def slot_counts(spark, sf):
    slot = times.slot_key(times.latest_slot(F.col("ts")))
    return t(spark, sf, "events").groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"select event_id, strftime(case when time_bucket(interval 12 hour, ts, {ORIGIN}) = ts then ts else time_bucket(interval 12 hour, ts, {ORIGIN}) + interval 12 hour end, '{KEY}') slot from events")
def arrival_slots(spark, sf):
    return t(spark, sf, "events").select("event_id", times.slot_key(times.arrival_slot(F.col("ts"))).alias("slot"))


@query(f"""with b as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 6 hour)) bin), c as (select time_bucket(interval 6 hour, ts, timestamp '2024-01-01') bin, count(*) n from events where event_type = 'purchase' group by 1)
select strftime(b.bin, '{KEY}') bin, coalesce(n, 0) n from b left join c using (bin)""")
def coverage_bins(spark, sf):
    start, end = (F.to_timestamp(F.lit(d)) for d in ("2024-01-01", "2024-01-31"))
    bins = ledgers.coverage(t(spark, sf, "events").where("event_type = 'purchase'"), "ts", start, end, 6)
    return bins.select(times.slot_key(F.col("bin")).alias("bin"), "n")


@query(f"""with s as (select unnest(generate_series(timestamp '2024-01-01 08:00:00', timestamp '2024-01-30 08:00:00', interval 12 hour)) slot), d as (select distinct time_bucket(interval 12 hour, ts, {ORIGIN}) slot from events where user_id % 30 = 1 and event_type = 'click')
select strftime(slot, '{KEY}') slot from s where slot not in (select slot from d)""")
def missed_slots(spark, sf):
    slots = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit("2024-01-01 08:00:00")), F.to_timestamp(F.lit("2024-01-30 08:00:00")), F.expr("interval 12 hours"))).alias("slot"))
    done = t(spark, sf, "events").where("user_id % 30 = 1 and event_type = 'click'").select(times.latest_slot(F.col("ts")).alias("slot")).distinct()
    return slots.join(done, "slot", "left_anti").select(times.slot_key(F.col("slot")).alias("slot"))


@query("select strftime(ts + interval 9 hour, '%Y-%m-%d') as \"day\", round(sum(round(value * 100)::bigint) / 100.0, 2) spend, count(*) n from events group by 1")
def kst_daily_spend(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    return t(spark, sf, "events").groupBy(times.seoul_date(F.col("ts")).alias("day")).agg(F.round(F.sum(cents) / 100.0, 2).alias("spend"), F.count("*").alias("n"))


@query("""select event_id, row_number() over (partition by user_id, date_trunc('minute', ts) order by ts, event_id) <= 1 and row_number() over (partition by user_id, date_trunc('day', ts + interval 9 hour) order by ts, event_id) <= 2 admitted from events""")
def rate_limit_admission(spark, sf):
    return ledgers.admitted(t(spark, sf, "events"), "user_id", "ts", "event_id", {"minute": 1, "day": 2}).select("event_id", "admitted")


@query("""with e as (select *, round(value * 100)::bigint cost from events) select event_id, (sum(cost) over (partition by event_type order by cost desc, event_id rows unbounded preceding))::bigint spent, sum(cost) over (partition by event_type order by cost desc, event_id rows unbounded preceding) <= 100000 runs from e""")
def budget_prefix_cut(spark, sf):
    e = t(spark, sf, "events").withColumn("cost", F.round(F.col("value") * 100).cast("long"))
    return ledgers.prefix_cut(e, [F.desc("cost"), F.asc("event_id")], "cost", 100_000, ["event_type"]).select("event_id", "spent", "runs")


@query("""with e as (select *, case when lag(ts) over w is null or epoch(ts) - epoch(lag(ts) over w) > 12 * 3600 then 1 else 0 end new from events window w as (partition by user_id order by ts)), r as (select *, sum(new) over (partition by user_id order by ts) run from e)
select user_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') started, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') ended, count(*) n from r group by user_id, run""")
def activity_sessions(spark, sf):
    s = ledgers.sessions(t(spark, sf, "events"), "user_id", "ts", 12)
    return s.select("user_id", *(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in ("started", "ended")), "n")


@query("""select event_id, case when s < 60 then 'now' when s < 3600 then (s // 60)::varchar || ' min' when s < 86400 then (s // 3600)::varchar || ' h' else month(ts + interval 9 hour)::varchar || '-' || day(ts + interval 9 hour)::varchar end label
from (select *, epoch(timestamp '2024-01-31')::bigint - epoch(date_trunc('second', ts))::bigint s from events)""")
def relative_labels(spark, sf):
    return t(spark, sf, "events").select("event_id", times.relative_time(F.col("ts"), F.to_timestamp(F.lit("2024-01-31"))).alias("label"))


@query("""with a as (select doc_id, epoch(timestamp '2024-03-01') - (doc_id % 40) * 86400 - (doc_id % 5) * 3600 c, epoch(timestamp '2024-03-01') - (doc_id % 7) * 86400 l, lang = 'en' dormant from documents),
d as (select *, epoch(timestamp '2024-03-01') - c age, (not dormant) and epoch(timestamp '2024-03-01') - l between 0 and 72 * 3600 active from a),
s as (select *, case when active then case when age >= 60 * 3600 then '60h' when age >= 12 * 3600 then '12h' end else case age::bigint // 86400 when 7 then '7d' when 14 then '14d' when 28 then '28d' end end slot from d),
r as (select *, row_number() over (partition by active, slot order by sha256('2024-03-01|' || slot || '|' || doc_id)) r from s where slot is not null)
select doc_id::varchar article_id, slot from r where active or r <= 40""")
def recheck_plan(spark, sf):
    now = F.to_timestamp(F.lit("2024-03-01"))
    ago = lambda days, hours: F.timestamp_seconds(F.unix_seconds(now) - days * 86400 - hours * 3600)
    d = t(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("article_id"), ago(F.col("doc_id") % 40, F.col("doc_id") % 5).alias("collected_at"), (now + F.expr("interval 1 day")).alias("body_expires_at"), F.lit(False).alias("is_link_only"),
        F.lit("active").alias("lifecycle"), F.lit(False).alias("is_demo"), F.when(F.col("lang") != "en", ago(F.col("doc_id") % 7, F.lit(0))).alias("last_report_at"), F.array().cast("array<string>").alias("done"),
    )
    return ledgers.plan_rechecks(d, now)
