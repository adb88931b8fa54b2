"""Budgets, rates, schedules and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ident import sha
from quillspark.functions.times import window_of
from quillspark.operators.assign import is_active
from quillspark.session import settled

# Hours after which an active article is looked at again, days for a dormant one, dormant ones a day and slot.
ACTIVE_SLOTS = (("60h", 60), ("12h", 12))
DORMANT_SLOTS = (("7d", 7), ("14d", 14), ("28d", 28))
DORMANT_CAP = 40


def admitted(requests: DataFrame, user: str, time: str, ident: str, limits: dict[str, int]) -> DataFrame:
    """requests with `admitted`: among the first of the user in every window (minute, day)."""
    ok = F.lit(True)
    for window, most in limits.items():
        w = Window.partitionBy(user, window_of(F.col(time), window)).orderBy(time, ident)
        ok = ok & (F.row_number().over(w) <= most)
    return requests.withColumn("admitted", ok)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums in an order over all of them: sums within ranges of the order, plus what the ranges before add up to.

    The totals of the ranges are as few as the shuffle has partitions; rows of one key stay in one range.
    """
    ranged = settled(rows.repartitionByRange(*order).withColumns({f"_of{c}": v for c, v in sums.items()}).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_of{c}").alias(c) for c in sums))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in sums))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.join(F.broadcast(offsets), "_range").withColumns({c: F.sum(f"_of{c}").over(w) + F.col(f"_before{c}") for c in sums})
    return summed.drop("_range", *(f"_of{c}" for c in sums), *(f"_before{c}" for c in sums))


def prefix_cut(jobs: DataFrame, order: list[Column], cost: str, cap: float, group: list[str] | None = None) -> DataFrame:
    """jobs with `spent` so far in the order and `runs`: whether it stays within the cap."""
    if group:
        spent = jobs.withColumn("spent", F.sum(cost).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        spent = running(jobs, order, {"spent": F.col(cost)})
    return spent.withColumn("runs", F.col("spent") <= cap)


def plan_rechecks(candidates: DataFrame, now: Column, sampled: dict[str, int] | None = None) -> DataFrame:
    """article_id, slot: articles to look at again.

    candidates: article_id, collected_at, body_expires_at, is_link_only, lifecycle, is_demo, last_report_at, done (array).
    Active stories: the latest slot that is due; dormant ones: on the slot's day, the first DORMANT_CAP by a rank hashed from day, slot and id.
    """
    age = F.unix_seconds(now) - F.unix_seconds("collected_at")
    open_ = candidates.where(~F.col("is_link_only") & ~F.col("is_demo") & (F.col("lifecycle") != "closed") & (F.col("body_expires_at") > now) & (age >= 0))
    active = is_active(F.col("last_report_at"), now)
    due = F.lit(None).cast("string")
    for slot, hours in reversed(ACTIVE_SLOTS):
        due = F.when(age >= hours * 3600, slot).otherwise(due)
    day_slot = F.lit(None).cast("string")
    for slot, day in DORMANT_SLOTS:
        day_slot = F.when(F.floor(age / 86400) == day, slot).otherwise(day_slot)
    marked = open_.withColumn("slot", F.when(active, due).otherwise(day_slot)).withColumn("active", active)
    marked = marked.where(F.col("slot").isNotNull() & ~F.array_contains("done", F.col("slot")))
    rank = sha(F.concat_ws("|", F.date_format(now, "yyyy-MM-dd"), "slot", "article_id"))
    room = F.lit(DORMANT_CAP)
    for slot, n in (sampled or {}).items():
        room = F.when(F.col("slot") == slot, max(0, DORMANT_CAP - n)).otherwise(room)
    w = Window.partitionBy("active", "slot").orderBy(rank, "article_id")
    return marked.withColumn("r", F.row_number().over(w)).where(F.col("active") | (F.col("r") <= room)).select("article_id", "slot")


def seeded_sample(df: DataFrame, key: str, seed: str, n: int, group: list[str] | None = None) -> DataFrame:
    """The first n rows (of each group) by a rank hashed from seed and key."""
    rank = sha(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    if not group:
        return df.withColumn("_rank", rank).orderBy("_rank", key).limit(n).drop("_rank")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(rank, key))).where(F.col("_r") <= n).drop("_r")


def audit_sample(items: DataFrame, key: str, seed: str, agreed: Column, sensitive: Column, share: float = 0.2) -> DataFrame:
    """All that is disputed or sensitive, and a fifth of the rest, rounded up."""
    must = ~agreed | sensitive
    rank = F.row_number().over(Window.partitionBy("_must").orderBy(sha(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key))
    marked = items.withColumn("_must", must)
    marked = marked.withColumn("_r", rank).withColumn("_n", F.count("*").over(Window.partitionBy("_must")))
    return marked.where(F.col("_must") | (F.col("_r") <= F.ceil(F.col("_n") * share))).drop("_must", "_r", "_n")


def coverage(events: DataFrame, time: str, start: Column, end: Column, step_hours: int) -> DataFrame:
    """bin, n: events per bin from start to end, empty bins kept."""
    bins = events.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.make_dt_interval(hours=F.lit(step_hours)))).alias("bin"))
    step = step_hours * 3600
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    counts = events.groupBy(F.timestamp_seconds(at - F.pmod(at - F.unix_seconds(start), F.lit(step))).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sessions(events: DataFrame, key: str, time: str, gap_hours: int) -> DataFrame:
    """key, started, ended, n: runs of events no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(time)
    apart = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    marked = events.withColumn("_new", F.coalesce(apart > gap_hours * 3_600_000_000, F.lit(True)).cast("int"))
    run = marked.withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("_run")
