"""Language ID by Bayesian fusion of evidence.

A page's evidence is its visible text, the language its markup declares, and where it is from. The
text's likelihood is that of its character trigrams under each language, learned from at most SAMPLE
documents per language (those with the least hash of their id) and broadcast: BUCKETS numbers per language.
It is tempered, as overlapping trigrams repeat each other's evidence. From the text's posteriors, grouped
aggregates over all pages learn what is declared in pages of each language, and how languages are shared by the
world, address suffix and host; each level is smoothed towards the one above it, and a page's own share
is left out of the levels it is judged by. Posterior: text * declaration * host prior.

A null or empty page has no text, so that the declaration and the host decide; a null url has the empty host; a
missing or unknown declaration is a value like others. Repeated rows count as often as they occur. Where no document has a language
nothing can be told and the language is null.

Hosts are joined by two ways: those of at least HOT of all pages, of which there are at most 1 / HOT, by
broadcast, the others by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, raw_texts

SAMPLE = 1_000
BUCKETS = 1 << 16
TEMPER = 0.1
#: Pages that a level above counts for in the prior of a host, and documents that even shares count for.
PULL = 5.0
HOT = 1 / 1024

_HIDDEN = re.compile(rb"<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>|&[a-zA-Z#0-9]{1,8};")
_NOT_LETTERS = bytes(0x20 if c < 0x41 or 0x5A < c < 0x61 or 0x7A < c < 0x80 else c for c in range(256))


def visible(html: bytes) -> bytes:
    """The text of a page: no scripts, styles, head, comments, tags or entities."""
    return _TAG.sub(b" ", _HIDDEN.sub(b" ", html))


def trigrams(text: bytes) -> np.ndarray:
    """Bucket numbers of the three-byte strings of the lower-cased words, with a space around each."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().translate(_NOT_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text")), strict=True):
            found[lang] = found.get(lang, 0) + np.bincount(trigrams(raw), minlength=BUCKETS)
    for lang, n in found.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of trigram buckets by language."""
    langs = sorted(r[0] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect())
    rows = docs.select(F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = []
    for name in langs:
        least = rows.where(F.col("lang") == name).select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        parts.append(rows.where((F.col("lang") == name) & (F.col("h") <= least)))
    table = np.full((max(1, len(langs)), BUCKETS), 0.5)
    for part in parts:
        for r in part.select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            table[langs.index(r.lang), r.bucket] += r.n
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _likelihoods(shared):  # noqa: ANN001, ANN202
    def of(pages: pa.Array) -> pa.Array:
        logs = shared.value
        out = []
        for html in raw_texts(pages):
            seen = trigrams(visible(html))
            ll = logs[:, seen].sum(1, dtype=np.float64) * TEMPER
            out.append((ll - ll.max()).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(of, "array<double>")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_of(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, lower-cased; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def _normal(logs: Column) -> Column:
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x))
    return F.transform(logs, lambda x: F.exp(x) / total)


def _sums(n: int, by: list[str], rows: DataFrame, prefix: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(f"{prefix}_n"), F.array(*(F.sum(F.col("text")[i]) for i in range(n))).alias(f"{prefix}_sum"))


def _by_host(rows: DataFrame, hosts: DataFrame, key: str, total: int) -> DataFrame:
    """Join one row per key to all rows: hot keys by broadcast (at most 1 / HOT of them), the others shuffled."""
    hot = F.col(f"{key}_n") >= max(1.0, total * HOT)
    often = F.broadcast(hosts.where(hot))
    rare = hosts.where(~hot)
    first = rows.join(often, key, "left")
    there = first.where(F.col(f"{key}_n").isNotNull())
    missing = first.where(F.col(f"{key}_n").isNull()).drop(*(c for c in hosts.columns if c != key)).join(rare, key)
    return there.unionByName(missing)


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host."""
    spark = pages.sparkSession
    langs, logs = learn(docs)
    n = len(langs)
    if not n:
        return pages.select(F.col(page_id).alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), declared_of(F.col(html)).alias("declared"), host_of(F.col(url)).alias("host"))
    likelihood = _likelihoods(spark.sparkContext.broadcast(logs))
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), declared_of(F.col(html)).alias("declared"), likelihood(html).alias("ll"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("text", _normal(F.col("ll")))
    rows = materialize(rows, "lang-pages")
    world = _sums(n, [], rows, "world").first()
    total = world["world_n"] or 0
    even = [(s + PULL / n) / (total + PULL) for s in (world["world_sum"] if total else [0.0] * n)]

    names = F.array(*map(F.lit, langs))
    declared = F.when(F.array_contains(names, F.col("declared")), F.col("declared")).otherwise(F.lit(""))
    counted = {r["declared"]: r["d_sum"] for r in _sums(n, ["declared"], rows.withColumn("declared", declared), "d").collect()}  # at most one row per language
    said = {d: [(s[i] + 1.0) / (world["world_sum"][i] + n + 1.0) for i in range(n)] for d, s in counted.items()}
    weight = F.create_map(*(x for d, w in said.items() for x in (F.lit(d), F.array(*map(F.lit, w))))) if said else F.create_map(F.lit(""), F.array(*[F.lit(1.0)] * n))

    suffixes = _sums(n, ["suffix"], rows, "suffix")
    hosts = _sums(n, ["host", "suffix"], rows, "host").join(suffixes, "suffix").drop("suffix")
    joined = _by_host(rows, hosts, "host", total)

    def smoothed(i: int) -> Column:
        own = F.col("text")[i]
        above = (F.col("suffix_sum")[i] - own + PULL * even[i]) / (F.col("suffix_n") - 1 + PULL)
        return (F.col("host_sum")[i] - own + PULL * above) / (F.col("host_n") - 1 + PULL)

    scores = F.array(*(F.col("ll")[i] + F.log(weight[declared][i]) + F.log(F.greatest(smoothed(i), F.lit(1e-12))) for i in range(n)))
    joined = joined.withColumn("post", _normal(F.transform(scores, lambda x: x - F.array_max(scores))))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return joined.select("page_id", best("post").alias("lang"), F.array_max("post").alias("confidence"), best("text").alias("text_lang"), "declared", "host")


def op5(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    pages, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents"))
    return identify(pages, docs)
