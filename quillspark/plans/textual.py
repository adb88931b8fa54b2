"""Catalogue: text, URLs and exact copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text, url
from quillspark.operators import dedup, diffs, realign, revisions
from quillspark.session import table as t

QUERIES, ORACLES = {}, {}
HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select sha256(text) hash, min(doc_id) first_id, count(*) n_copies from documents group by 1")
def exact_dedup_groups(spark, sf):
    return dedup.exact_groups(t(spark, sf, "documents"), "doc_id", "text")


@query("select doc_id, coalesce(lag(sha256(lang)) over (partition by source order by doc_id) <> sha256(lang), true) is_new_version from documents")
def version_chain(spark, sf):
    d = t(spark, sf, "documents").withColumn("hash", F.sha2("lang", 256))
    return diffs.version_chain(d, "source", ["doc_id"], "hash").select("doc_id", "is_new_version")


@query("""with k as (select doc_id, source, sha256(text) h from documents), f as (select source, h, min(doc_id) m from k group by 1, 2)
select count(distinct 'a-' || left(sha256('u' || m), 16)) n_articles, count(distinct h) n_bodies from f""")
def collected_articles(spark, sf):
    d = t(spark, sf, "documents").select(F.col("source").alias("source_id"), F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.lit("").alias("title"), F.sha2("text", 256).alias("body_hash"), F.col("doc_id").alias("observed_at"))
    known = d.limit(0).withColumn("id", F.lit("")).drop("observed_at")
    found = dedup.identify(d, known)
    return found.agg(F.countDistinct("id").alias("n_articles"), F.countDistinct("body_hash").alias("n_bodies"))


@query(f"select page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {HOST} || {PATH} normalized, {HOST} host from pages")
def url_normalize(spark, sf):
    return t(spark, sf, "pages").select("page_id", url.normalize_url(F.col("url")).alias("normalized"), url.host_of(F.col("url")).alias("host"))


@query(rf"""with h as (select page_id, {HOST} host from pages), r as (select distinct regexp_extract(host, '([^.]+\.[^.]+)$', 1) d from h union select distinct host from h where host like 'blog.%' or host like 'm.%'),
m as (select page_id, d, row_number() over (partition by page_id order by length(d) desc, d) n from h join r on host = d or ends_with(host, '.' || d)) select page_id, d from m where n = 1""")
def domain_suffix_join(spark, sf):
    pages = t(spark, sf, "pages").select("page_id", url.host_of(F.col("url")).alias("host"))
    registry = pages.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("d")).union(pages.where("host like 'blog.%' or host like 'm.%'").select("host")).distinct()
    parts = pages.select("page_id", F.explode(url.host_suffixes(F.col("host"))).alias("d"))
    return parts.join(registry, "d").groupBy("page_id").agg(F.max_by("d", F.struct(F.length("d"), "d")).alias("d"))


@query(r"""select page_id, sha256(regexp_replace(regexp_replace(nfc_normalize(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\r\n?', chr(10), 'g')), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) body from pages""")
def html_text_normalize(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.sha2(text.normalize_body(F.col("html")), 256).alias("body"))


@query(r"""with b as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}')[1:2] terms from benchmark), d as (select doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' body from documents)
select item_id, doc_id from b join d on contains(body, ' ' || terms[1] || ' ') and contains(body, ' ' || terms[2] || ' ')""")
def term_title_match(spark, sf):
    items = t(spark, sf, "benchmark").select("item_id", F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)), 1, 2).alias("terms")).where(F.size("terms") > 0)
    docs = t(spark, sf, "documents").select("doc_id", F.trim(text.normalize_for_match(F.col("text"))).alias("body"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word"))
    first = words.join(items.withColumn("word", F.col("terms")[0]), "word")
    # the second term is an equi-join as well: no text meets a list of terms
    rest = first.select("doc_id", "item_id", F.element_at("terms", -1).alias("word"))
    return rest.join(words, ["doc_id", "word"], "left_semi").select("item_id", "doc_id")


@query(r"""with d as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) k from documents) select a.doc_id, round(coalesce(len(list_intersect(a.k, b.k)) / nullif(len(list_distinct(list_concat(a.k, b.k))), 0), 0), 6) similarity from d a join d b on b.doc_id = a.doc_id + 1""")
def title_token_jaccard(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.title_tokens(F.col("text")).alias("k"))
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("kb"))
    return d.join(b, "doc_id").select("doc_id", F.round(text.jaccard(F.col("k"), F.col("kb")), 6).alias("similarity"))


@query("""with d as (select doc_id, text, case when doc_id % 3 = 0 then text || ' Correction: a name.' when doc_id % 3 = 1 then text else text || ' More.' end now from documents)
select doc_id, case when doc_id % 3 = 0 then 'correction_candidate' when doc_id % 3 = 1 then 'unchanged' else 'text_changed' end judgement from d""")
def recheck_judgement(spark, sf):
    body = F.regexp_replace(F.col("text"), "[<&]", "")
    d = text.with_normalized(t(spark, sf, "documents").select("doc_id", body.alias("text")), "text", F.col("text"))
    now = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " Correction: a name.").when(F.col("doc_id") % 3 == 1, "").otherwise(" More."))
    return text.with_normalized(d, "now", now).select("doc_id", text.judged(F.col("text"), F.col("now")).alias("judgement"))


@query(r"""with w as (select distinct substr(text, i, 20) w from (select text, unnest(range(1, length(text) - 18)) i from benchmark where length(text) >= 20)),
b as (select doc_id, substr(text, k * 1000 + 1, 1019) part from (select doc_id, text, unnest(range(0, (length(text) - 1) // 1000 + 1)) k from documents where length(text) >= 20)),
d as (select doc_id, substr(part, i, 20) w from (select doc_id, part, unnest(range(1, length(part) - 18)) i from b where length(part) >= 20)) select distinct doc_id from d semi join w using (w)""")
def text_leaks(spark, sf):
    docs, private = t(spark, sf, "documents"), t(spark, sf, "benchmark")
    found = revisions.text_leaks(docs.select(F.col("doc_id").alias("id"), "text"), private.select(F.col("item_id").alias("id"), "text"))
    return found.select(F.col("id").alias("doc_id"))


@query()
def sentence_split(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(text.split_sentences(F.col("text"))).alias("n", "s"))
    return d.select("doc_id", "n", "s.start", "s.end")


@query()
def proper_nouns(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_join(text.proper_nouns(F.col("text")), "; ").alias("nouns"))


@query()
def word_diff(spark, sf):
    d = t(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = d.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return d.join(before, ["conv_id", "turn"]).select("conv_id", "turn", text.diff_words(F.col("before"), F.col("text")).alias("diff"))


@query("select doc_id, 10 first, 30 last from documents where length(text) >= 40")
def span_realign(spark, sf):
    d = t(spark, sf, "documents").where(F.char_length("text") >= 40).select("doc_id", "text", F.concat(F.substring("text", 1, 40), F.lit("  "), F.expr("substring(text, 41)")).alias("after"))
    r = realign.realign(F.col("text"), F.col("after"), F.lit(10), F.lit(30))
    return d.select("doc_id", r["start"].alias("first"), r["end"].alias("last"))


_LONG = "select doc_id, text, length(text) n, 10 + doc_id % 40 s from documents where length(text) >= 80"


@query(
    f"select doc_id, case when s + 12 <= 25 then s + 2 when s >= 25 then s + 5 end \"first\", case when s + 12 <= 25 then s + 14 when s >= 25 then s + 17 end \"last\" from ({_LONG})"
)
def span_realign_edits(spark, sf):
    """Spans before, across and behind edits: marks put in at 7, at 25 and five places before the end."""
    parts = "concat(substring(text, 1, 7), '¤¤', substring(text, 8, 18), '¤¤¤', substring(text, 26, n - 30), '¤', substring(text, n - 4))"
    d = t(spark, sf, "documents").where(F.char_length("text") >= 80).select("doc_id", "text", F.char_length("text").alias("n"))
    d = d.select("doc_id", "text", F.expr(parts).alias("after"), (F.lit(10) + F.col("doc_id") % 40).alias("s"))
    r = realign.realign(F.col("text"), F.col("after"), F.col("s"), F.col("s") + 12)
    return d.select("doc_id", r["start"].cast("long").alias("first"), r["end"].cast("long").alias("last"))
