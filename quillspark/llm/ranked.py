"""Ranked search over whole texts: postings by exact impact, score at a time.

A first narrow pass counts documents, terms and the documents of each query term; Spark sums these partial counts. A second
one cuts each partition of documents in shards of a bounded number of bytes. Within a shard the postings of a term are grouped
by exact impact, highest first. For each query whole groups are added to its documents' scores in descending order of impact,
until the bound of what remains (the sum of each term's next impact) is below the k-th score known in the task: no document that
was not met can then enter. The documents that were met and that the bound leaves open get their scores completed from their own
terms. Each task hands on k rows a query at most, and a window limit merges these.

Scores are integers and exact, so neither shards nor tasks change the result. Queries are broadcast in slices of about
``slice_bytes`` of item text; more slices are more passes over the documents, never a larger broadcast.

Null and empty texts have no terms; such a document is not counted and not found, such an item finds nothing. Very long texts
count whole; one longer than a shard is a shard. Repeated rows are documents, or items, of their own. Ties are ranked by doc_id,
null ids last, and those of repeated rows by chance, which doesn't show. Empty tables give an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import CHUNK_BYTES, column_bytes, numbered, raw_texts, slices
from quillspark.llm.decontaminate import words_of

TOP = 20
SLICE_BYTES = 8 << 20
DOCUMENTS, TERMS = -1, -2


@dataclass
class Queries:
    """A slice of the items: numbers of their terms, and of each item its number, distinct terms and how often each occurs."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None
    documents: int = 0
    terms: int = 0

    @classmethod
    def of(cls, texts: list[tuple[int, bytes]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        items = []
        for number, raw in texts:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(raw)]
            if ids:
                items.append((number, *np.unique(np.array(ids, np.int64), return_counts=True)))
        return cls(vocabulary, items)

    def found(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct query terms among the words, and how often each occurs."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        return np.unique(ids[ids >= 0], return_counts=True)

    def weigh(self, counts: dict[int, int]) -> None:
        self.documents, self.terms = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        rare = (math.log((2 * self.documents + 2) / (2 * counts.get(i, 0) + 1)) for i in range(len(self.vocabulary)))
        self.weights = np.array([math.floor(1000 * x) for x in rare], np.int64)

    def impacts(self, ids: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
        norm = 75 + 25 * n * self.documents // self.terms
        return self.weights[ids] * (1_000_000_000 * often // (1000 * often + 12 * norm))


class Shard:
    """Postings of some documents: by document, and by term in groups of exact impact, highest first."""

    def __init__(self, queries: Queries, texts: list[list[bytes]]) -> None:
        ids, impacts = [], []
        for words in texts:
            own, often = queries.found(words)
            impact = queries.impacts(own, often, len(words)) if len(own) else own
            ids.append(own[impact > 0])
            impacts.append(impact[impact > 0])
        self.size = len(texts)
        self.ends = np.cumsum([0, *map(len, ids)])
        self.ids, self.impacts = np.concatenate(ids), np.concatenate(impacts)
        order = np.lexsort((-self.impacts, self.ids))
        term, self.impact = self.ids[order], self.impacts[order]
        self.document = np.repeat(np.arange(self.size), np.diff(self.ends))[order]
        new = np.ones(len(order), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.impact[1:] != self.impact[:-1])
        self.starts = np.append(np.flatnonzero(new), len(order))  # of the groups
        self.falling = -self.impact[self.starts[:-1]]
        self.groups = np.searchsorted(term[self.starts[:-1]], np.arange(len(queries.vocabulary) + 1))  # of the terms
        self.times = np.zeros(len(queries.vocabulary), np.int64)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and full scores of the k best and their ties, if only scores of at least floor count."""
        here = self.groups[terms + 1] > self.groups[terms]
        terms, times = terms[here], times[here]
        scores = np.zeros(self.size, np.int64)
        at, last = self.groups[terms].copy(), self.groups[terms + 1]
        while True:
            bounds = np.array([-self.falling[g] * c if g < e else 0 for g, e, c in zip(at, last, times, strict=True)], np.int64)
            remaining = int(bounds.sum())
            known = np.partition(scores, -k)[-k] if self.size >= k else 0
            least = max(int(known), floor)
            if remaining < least or not remaining:
                break
            cut = int(bounds.max()) * 3 // 4
            for i in np.flatnonzero(bounds > cut):
                lowest = cut // int(times[i]) + 1
                end = at[i] + np.searchsorted(self.falling[at[i] : last[i]], -lowest, "right")
                rows = slice(self.starts[at[i]], self.starts[end])
                scores[self.document[rows]] += times[i] * self.impact[rows]  # a document is there once
                at[i] = end
        open_ = np.flatnonzero((scores > 0) & (scores + remaining >= least))
        if not remaining or not len(open_):
            return self._leading(open_, scores[open_], k)
        self.times[terms] = times
        first, lengths = self.ends[open_], np.diff(self.ends)[open_]
        rows = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        full = np.add.reduceat(self.impacts[rows] * self.times[self.ids[rows]], np.cumsum(lengths) - lengths)
        self.times[terms] = 0
        return self._leading(open_, full, k)

    @staticmethod
    def _leading(documents: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the k best scores, with all ties of the last one."""
        if len(scores) > k:
            lead = scores >= np.partition(scores, -k)[-k]
            return documents[lead], scores[lead]
        return documents, scores


def _counts(shared, text: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        holding = np.zeros(len(queries.vocabulary), np.int64)
        documents = terms = 0
        for batch in batches:
            for raw in raw_texts(batch.column(text)):
                words = words_of(raw)
                documents += bool(words)
                terms += len(words)
                holding[queries.found(words)[0]] += 1
        there = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([DOCUMENTS, TERMS, *there.tolist()], pa.int64()), pa.array([documents, terms, *holding[there].tolist()], pa.int64())], names=["term", "n"])

    return run


def _best(shared, k: int, shard_bytes: int):  # noqa: ANN001, ANN202
    def order(row: tuple) -> tuple:
        return (-row[0], row[1] is None, row[1] if row[1] is not None else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best: dict[int, list[tuple]] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            raws, ids = raw_texts(batch.column("text")), batch.column("doc_id")
            for start, end in slices([], [len(r) for r in raws], shard_bytes):
                shard = Shard(queries, [words_of(r) for r in raws[start:end]])
                for number, terms, times in queries.items:
                    so_far = best.get(number, [])
                    found, scores = shard.top(terms, times, k, so_far[-1][0] if len(so_far) == k else 0)
                    if len(found):
                        new = [(s, ids[start + d].as_py()) for d, s in zip(found.tolist(), scores.tolist(), strict=True)]
                        best[number] = sorted([*so_far, *new], key=order)[:k]
        for number, rows in best.items():
            columns = [pa.array([number] * len(rows), pa.int64()), pa.array([d for _, d in rows], kind), pa.array([s for s, _ in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item: str = "item_id", item_text: str = "text", k: int = TOP, slice_bytes: int = SLICE_BYTES, shard_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = numbered(items.select(F.col(item).alias("item_id"), F.col(item_text).cast("binary").alias("raw")), "item")
    parts = max(1, -(-column_bytes(items, "raw") // slice_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).select("item", "raw").collect()  # at most about slice_bytes
        queries = Queries.of([(r.item, bytes(r.raw or b"")) for r in rows])
        counted = docs.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(queries), "text"), "term long, n long")
        queries.weigh({r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()})  # a row a term of the slice
        one = docs.mapInArrow(_best(spark.sparkContext.broadcast(queries), k, shard_bytes), f"item long, doc_id {kind}, score long")
        found = one if found is None else found.unionByName(one)
    ranks = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return search(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL
), lengths AS (SELECT doc_id, r, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
q AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item, item_id, unnest(terms) AS term FROM (
      SELECT row_number() OVER () AS item, item_id, {_TERMS.format("text")} AS terms FROM benchmark WHERE text IS NOT NULL))
  GROUP BY ALL
), postings AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM lengths)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, docs
), impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS impact
  FROM postings JOIN weights USING (term), totals
), scored AS (
  SELECT item, item_id, r, doc_id, sum(times * impact)::BIGINT AS score FROM q JOIN impacts USING (term) GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
