"""Catalogue: claims, their status and what they rest on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import intervals, matching, status
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}
FLAGS = """(case l_linenumber % 3 when 0 then 'conflict' when 1 then 'single_source' end) prev, l_quantity > 3 verified, l_quantity = 50 undet, (l_partkey % 4)::int sup, (l_suppkey % 7 = 0)::int con, l_discount > 0.08 cor, l_tax > 0.06 res"""


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark, sf):
    c = status.claim_status(
        F.when(F.col("l_linenumber") % 3 == 0, "conflict").when(F.col("l_linenumber") % 3 == 1, "single_source"), F.col("l_quantity") > 3, F.col("l_quantity") == 50, F.col("l_partkey") % 4, (F.col("l_suppkey") % 7 == 0).cast("int"), F.col("l_discount") > 0.08, F.col("l_tax") > 0.06
    )
    return t(spark, sf, "lineitem").withColumn("c", c)


CASE = """case when undet or not verified or sup <= 0 then 1 when con >= 1 or (prev = 'conflict' and not (cor or res)) then 2 when cor then 3 when res and prev = 'conflict' then 4 when sup >= 2 then 5 else 6 end"""


@query(f"select l_orderkey, l_linenumber, {CASE} guard, [null, 'conflict', 'corrected', 'resolved', 'multi_agree', 'single_source'][{CASE}] status from (select *, {FLAGS} from lineitem)")
def claim_status_guards(spark, sf):
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", "c.guard", "c.status")


@query(f"""with s as (select l_orderkey, [null, 'conflict', 'corrected', 'resolved', 'multi_agree', 'single_source'][{CASE}] s from (select *, {FLAGS} from lineitem) where {CASE} > 1)
select l_orderkey, case when bool_or(s = 'conflict') then 'conflict' when bool_or(s = 'corrected') then 'corrected' when bool_or(s = 'resolved') then 'resolved' when bool_or(s = 'single_source') then 'single_source' else 'multi_agree' end status, count(*) filter (s = 'conflict') conflict, count(*) n from s group by 1""")
def story_status_rollup(spark, sf):
    lines = _lines(spark, sf).where("c.publish").select("l_orderkey", F.col("c.status").alias("status"))
    return lines.groupBy("l_orderkey").agg(status.story_status(F.col("status"), F.lit(0)).alias("status"), F.count(F.when(F.col("status") == "conflict", 1)).alias("conflict"), F.count("*").alias("n"))


@query("""select l_orderkey, count(distinct case when s_nationkey % 3 <> 0 then coalesce(case when s_nationkey % 5 = 0 then 'w' || s_nationkey end, 's' || s_suppkey) end) origins from lineitem join supplier on l_suppkey = s_suppkey group by 1""")
def origin_count(spark, sf):
    joined = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    wire = F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit("w"), "s_nationkey"))
    tier = F.when(F.col("s_nationkey") % 3 == 0, "link_only").otherwise("body_and_excerpt")
    return joined.groupBy("l_orderkey").agg(status.origins(wire, F.concat(F.lit("s"), "s_suppkey"), tier).alias("origins"))


def _spans(spark, sf):
    lines = t(spark, sf, "lineitem")
    start = (F.col("l_partkey") % 60).cast("int")
    return lines.select(F.col("l_orderkey").alias("story_id"), (F.col("l_linenumber") % 2).alias("side"), ((F.col("l_linenumber") % 4) / 2).cast("int").alias("claim"), F.lit("reported_fact").alias("claim_type"), (F.col("l_suppkey") % 2).alias("version"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))


@query("""with l as (select l_orderkey s, l_linenumber % 2 side, (l_linenumber % 4) // 2 c, l_suppkey % 2 v, (l_partkey % 60)::int b, (l_partkey % 60 + l_quantity)::int e from lineitem),
u as (select side, s, c, v, min(b) b, max(e) e from (select *, sum(n) over (partition by side, s, c, v order by b, e rows unbounded preceding) i from (select *, case when max(e) over w is null or b > max(e) over w then 1 else 0 end n from l where e > b window w as (partition by side, s, c, v order by b, e rows between unbounded preceding and 1 preceding))) group by side, s, c, v, i),
z as (select side, s, c, v, sum(e - b) z from u group by 1, 2, 3, 4),
x as (select p.s, p.c p, n.c n, p.v, sum(least(p.e, n.e) - greatest(p.b, n.b)) common from u p join u n on p.side = 0 and n.side = 1 and p.s = n.s and p.v = n.v and least(p.e, n.e) > greatest(p.b, n.b) group by 1, 2, 3, 4),
j as (select x.s story_id, x.p, x.n, common / (a.z + b.z - common)::double score, common from x join z a on a.side = 0 and a.s = x.s and a.c = x.p and a.v = x.v join z b on b.side = 1 and b.s = x.s and b.c = x.n and b.v = x.v),
r as (select *, row_number() over (partition by story_id, p, n order by score desc, common desc) k from j) select story_id, p, n, round(score, 9) score, common::bigint anchor from r where k = 1""")
def interval_union_jaccard(spark, sf):
    s = _spans(spark, sf)
    c = intervals.continuity(s.where("side = 0").drop("side"), s.where("side = 1").drop("side"))
    return c.withColumn("score", F.round("score", 9)).withColumn("anchor", F.col("anchor").cast("long"))


@query()
def claim_matching(spark, sf):
    s = _spans(spark, sf)
    return matching.match_claims(intervals.continuity(s.where("side = 0").drop("side"), s.where("side = 1").drop("side")))


@query("""with l as (select l_orderkey story_id, (l_linenumber % 2)::int claim_id, l_linenumber q, case l_returnflag when 'A' then 'supported' when 'R' then 'conflicting' else 'partial' end label from lineitem)
select story_id, claim_id, bool_or(label = 'supported') publish, coalesce(string_agg(q::varchar, ',' order by q) filter (label <> 'partial'), '') kept, count(q) = count(distinct q) valid from l group by 1, 2""")
def gate_support(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "conflicting").otherwise("partial")
    l = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("story_id"), (F.col("l_linenumber") % 2).alias("claim_id"), F.col("l_linenumber").alias("quote_id"), label.alias("label"))  # noqa: E741
    return status.gate_two(l).withColumn("kept", F.array_join(F.col("kept").cast("array<string>"), ","))


@query("""with recursive p as (select a.conv_id claim_id, a.turn a, b.turn b, case when a.role = b.role then 'agree' when a.turn = 0 then 'incompatible' else 'undeterminable' end label from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > a.turn and b.turn <= a.turn + 2),
reach(claim_id, quote, side, depth) as (select claim_id, least(a, b), 0, 0 from p where label = 'incompatible' union all select r.claim_id, case when p.a = r.quote then p.b else p.a end, r.side, r.depth + 1 from reach r join p on p.claim_id = r.claim_id and p.label = 'agree' and (p.a = r.quote or p.b = r.quote) where r.depth < 6)
select claim_id, count(distinct quote) n from (select claim_id, quote from reach union select claim_id, greatest(a, b) from p where label = 'incompatible') group by 1""")
def partition_sides(spark, sf):
    c = t(spark, sf, "conversations")
    b = c.select("conv_id", F.col("turn").alias("b"), F.col("role").alias("rb"))
    pairs = c.join(b, "conv_id").where((F.col("b") > F.col("turn")) & (F.col("b") <= F.col("turn") + 2))
    label = F.when(F.col("role") == F.col("rb"), "agree").when(F.col("turn") == 0, "incompatible").otherwise("undeterminable")
    found = status.sides(pairs.select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("a"), "b", label.alias("label")))
    return found.groupBy("claim_id").agg(F.countDistinct("quote").alias("n"))
