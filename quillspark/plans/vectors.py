"""Catalogue: neighbours, centroids, assignment and search over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.vector import centroid, cosine
from quillspark.operators import assign, evaluation
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}
#: Looser than the defaults: the test vectors are far from each other.
LOOSE = {"centroid": 0.15, "representative": 0.05, "lead": 0.01}
CENTROIDS = "e as (select vec_id, label, embedding::double[] v from embeddings), c as (select label, list(x order by i) v from (select label, i, avg(x) x from (select label, unnest(v) x, generate_subscripts(v, 1) i from e) group by 1, 2) group by 1)"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query, i.vec_id item, round(list_cosine_similarity(q.v, i.v), 6) similarity from e q join e i on q.vec_id <> i.vec_id),
r as (select *, row_number() over (partition by query order by similarity desc, item) rank from s) select * from r where rank <= 5""")
def knn_top5(spark, sf):
    e = t(spark, sf, "embeddings")
    queries = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return assign.knn(queries, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), 5)


@query(f"with {CENTROIDS} select label, i, round(v[i], 6) x from (select label, v, unnest(range(1, len(v) + 1)) i from c)")
def centroid_by_label(spark, sf):
    c = centroid(t(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


def _candidates(spark, sf):
    e = t(spark, sf, "embeddings")
    stories = centroid(e, "label", "embedding").join(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("representative")), "label")
    joined = e.select("vec_id", "embedding").crossJoin(F.broadcast(stories))  # a row per label: as many as there are active stories
    return joined.select(F.col("vec_id").alias("article"), F.col("label").alias("story"), F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("centroid_similarity"), F.round(cosine(F.col("embedding"), F.col("representative")), 6).alias("representative_similarity"), (F.col("label") % 5 != 0).alias("active"))


@query(f"""with {CENTROIDS}, m as (select label, arg_min(v, vec_id) v from e group by 1), k as (select e.vec_id, c.label, round(list_cosine_similarity(e.v, c.v), 6) s, round(list_cosine_similarity(e.v, m.v), 6) p from e, c join m using (label) where c.label % 5 <> 0),
r as (select *, row_number() over w rn, lead(s) over w nb from k window w as (partition by vec_id order by s desc, label)), d as (select *, case when s < 0.15 then 'centroid_far' when p < 0.05 then 'representative_far' when s - coalesce(nb, -2) < 0.01 then 'no_lead' else 'assigned' end reason from r where rn = 1)
select vec_id article, case when reason = 'assigned' then label end story, reason from d""")
def assignment_decision(spark, sf):
    return assign.decide(_candidates(spark, sf), **LOOSE)


@query("""with e as (select vec_id, label, embedding::double[] v from embeddings) select distinct least(a.vec_id, b.vec_id) a, greatest(a.vec_id, b.vec_id) b, round(list_cosine_similarity(a.v, b.v), 6) similarity from e a join e b on a.label % 3 = b.label % 3 and a.vec_id <> b.vec_id and a.label <> b.label where a.vec_id % 50 = 0 order by similarity desc, a, b limit 30""")
def hard_negative_pairs(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), (F.col("label") % 3).alias("topic"), F.col("label").alias("grp"), F.col("embedding").alias("vector"))
    return assign.hard_negatives(e, 30, stated=F.col("a.item") % 50 == 0, least=-1.0)


@query("""with e as (select vec_id, label, embedding::double[] v from embeddings), q as (select v from e where vec_id = 0), s as (select label story, arg_min(v, vec_id) v from e group by 1),
th as (select story, round(list_cosine_similarity(s.v, q.v), 6) score from s, q), h as (select label story, vec_id claim, round(list_cosine_similarity(e.v, q.v), 6) score from e, q), ch as (select story, score from h order by score desc, claim limit 200),
b as (select story, max(score) score from (select * from th union all select * from ch) group by 1 order by score desc, story limit 10), r as (select *, row_number() over (partition by story order by score desc, claim) r from h)
select b.story, b.score, (select string_agg(claim::varchar, ',' order by r.r) from r where r.story = b.story and r.r <= 3) claims from b""")
def semantic_search(spark, sf):
    e = t(spark, sf, "embeddings")
    query = F.array(*(F.lit(float(x)) for x in e.where("vec_id = 0").first().embedding))  # what a user asks
    stories = e.groupBy(F.col("label").alias("story")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    claims = e.select(F.col("label").alias("story"), F.col("vec_id").alias("claim"), F.col("embedding").alias("vector"))
    return assign.search(query, stories, claims).withColumn("claims", F.array_join(F.col("claims").cast("array<string>"), ","))


def _predicted(spark, sf):
    c = _candidates(spark, sf)
    best = c.groupBy("article").agg(F.max_by("story", F.struct("centroid_similarity", -F.col("story"))).alias("predicted"))
    return best.join(t(spark, sf, "embeddings").select(F.col("vec_id").alias("article"), F.col("label").alias("gold")), "article")


@query(f"""with {CENTROIDS}, k as (select e.vec_id, e.label gold, c.label, round(list_cosine_similarity(e.v, c.v), 6) s from e, c), p as (select gold, label predicted from (select *, row_number() over (partition by vec_id order by s desc, label) r from k) where r = 1),
t as (select gold, predicted, count(*)::double n from p group by 1, 2), a as (select gold, sum(n) ng from t group by 1), b as (select predicted, sum(n) np from t group by 1), j as (select * from t join a using (gold) join b using (predicted)), tot as (select sum(n) total from t),
s as (select (select total from tot) total, sum(n*(n-1)/2) both_, (select sum(ng*(ng-1)/2) from a) ig, (select sum(np*(np-1)/2) from b) ip, sum(n*ln(n)) h, sum(n*ln(ng)) hg, sum(n*ln(np)) hp, sum(n*n/np) p, sum(n*n/ng) r from j)
select round((both_ - ig*ip/(total*(total-1)/2)) / ((ig+ip)/2 - ig*ip/(total*(total-1)/2)), 8) ari, round((h/total - hg/total - hp/total + ln(total)) / ((2*ln(total) - hg/total - hp/total)/2), 8) nmi, round(p/total, 8) bcubed_p, round(r/total, 8) bcubed_r, round(2*p*r/total/(p+r), 8) bcubed_f1 from s""")
def ari_nmi_bcubed(spark, sf):
    scores = evaluation.clustering_scores(_predicted(spark, sf))
    return scores.select(*(F.round(c, 8).alias(c) for c in scores.columns))
