"""Catalogue: metrics of classification and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import evaluation, matching
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with c as (select unnest([0, 1]) cls), s as (select cls, count(*) filter (quality = cls and toxic = cls) tp, count(*) filter (toxic = cls) said, count(*) filter (quality = cls) support from c, labels group by 1)
select cls "class", round(tp / said, 9) "precision", round(tp / support, 9) recall, round(2 * (tp / said) * (tp / support) / nullif(tp / said + tp / support, 0), 9) f1, support::bigint support from s""")
def prf_confusion(spark, sf):
    s = evaluation.class_scores(t(spark, sf, "labels"), [0, 1], "quality", "toxic")
    return s.select(F.col("class").cast("int").alias("class"), *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query("""with n as (select count(*)::double n, avg((quality = toxic)::int) a from labels), c as (select sum((select count(*) from labels where quality = k) * (select count(*) from labels where toxic = k))::double c from (values (0), (1)) x(k))
select n::bigint n, round(a, 9) agreement, round((a - c / (n * n)) / (1 - c / (n * n)), 9) kappa from n, c""")
def kappa_agreement(spark, sf):
    k = evaluation.kappa(t(spark, sf, "labels"), "quality", "toxic")
    return k.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("select event_type, quantile_disc(value, 0.5) p50_disc, quantile_disc(value, 0.95) p95_disc, round(quantile_cont(value, 0.5), 9) p50_cont, round(quantile_cont(value, 0.95), 9) p95_cont from events group by 1")
def percentiles(spark, sf):
    p = evaluation.percentiles(t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return p.select("event_type", "p50_disc", "p95_disc", F.round("p50_cont", 9).alias("p50_cont"), F.round("p95_cont", 9).alias("p95_cont"))


@query("""with a as (select l_orderkey, l_suppkey from lineitem where l_linenumber <= 3), b as (select l_orderkey, l_suppkey from lineitem where l_linenumber >= 2)
select (select count(*) from ((select * from a union select * from b) except (select * from a intersect select * from b))) flipped, (select count(*) from (select * from a union select * from b)) either""")
def flip_counts(spark, sf):
    lines = t(spark, sf, "lineitem")
    return evaluation.flips(lines.where("l_linenumber <= 3"), lines.where("l_linenumber >= 2"), ["l_orderkey", "l_suppkey"])


@query("""with c as (select l_orderkey, l_returnflag, count(*) n, min(l_linenumber) f from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by n desc, f, l_returnflag) r from c) select l_orderkey, l_returnflag from r where r = 1""")
def majority_label(spark, sf):
    return evaluation.majority(t(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


@query("select l_returnflag gold, l_linestatus predicted, count(*)::double n, sum(count(*)) over (partition by l_returnflag)::double n_gold, sum(count(*)) over (partition by l_linestatus)::double n_predicted from lineitem group by 1, 2")
def contingency_table(spark, sf):
    return evaluation.contingency(t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("select event_type, round(sum(case when user_id % 2 = 0 then round(value * 100)::bigint end) / nullif(sum(round(value * 100)::bigint), 0)::double, 9) share from events group by 1")
def weighted_share(spark, sf):
    cents = F.round(F.col("value") * 100).cast("long")
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(evaluation.ratio(F.sum(F.when(F.col("user_id") % 2 == 0, cents)), F.sum(cents)), 9).alias("share"))


@query()
def bootstrap_ci(spark, sf):
    units = t(spark, sf, "labels").select((F.col("doc_id") % 20).alias("packet"), F.col("quality").alias("hit"), F.lit(1).alias("of"))
    return evaluation.bootstrap(units, "packet", "hit", "of", "seed")


@query()
def set_alignment(spark, sf):
    lines = t(spark, sf, "lineitem")
    side = lambda k: lines.where(f"l_linenumber % 2 = {k}").groupBy(F.col("l_orderkey").alias("group"), (F.col("l_linenumber") / 2).cast("int").alias("id")).agg(F.collect_set(F.col("l_partkey") % 3).alias("items"))
    return matching.align_sets(side(0), side(1))
