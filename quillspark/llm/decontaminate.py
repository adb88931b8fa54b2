"""Benchmark decontamination: scan token windows against a broadcast set of test n-grams.

Words are runs of lower-cased ASCII letters, digits and any non-ASCII character. A window is
``window`` consecutive words of an item; a shorter item is one window of its own length. Each
document word gets its number in the benchmark vocabulary (0: not in it), numpy rolls a 64-bit
hash over these numbers, hits in the sorted hash set are verified word by word, and the verified
windows are joined to spans.

Null and empty texts have no words and are never hit. Repeated rows give repeated results. An
empty benchmark hits nothing. Other columns of either table are passed through or ignored.

The windows of a benchmark are broadcast in slices of at most ``slice_bytes`` of item text; more
slices cost further narrow passes over the documents and never a larger broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import column_bytes, raw_texts

WINDOW = 10
SLICE_BYTES = 32 << 20

_KEEP = np.arange(256)
_TABLE = bytes(
    int(c) if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else int(c) + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in _KEEP
)
_BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT_TYPE = "struct<n_words:long,n_hit:long,items:array<string>,spans:array<struct<first:int,last:int>>>"



def words_of(raw: bytes) -> list[bytes]:
    """The words of one UTF-8 text."""
    return raw.translate(_TABLE).split()


def _roll(ids: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of so many ids; ids are passed through a mixer first."""
    n = len(ids) - length + 1
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= _BASE
        out += x[i : i + n]
    return out


@dataclass
class WindowSet:
    """Windows of one slice of the benchmark: vocabulary, and by length the hashes, words and items."""

    vocabulary: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[str]]]]

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int) -> WindowSet:
        vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, raw in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(raw)]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
        by_length = {}
        for n, windows in found.items():
            keys = np.array(list(windows), np.int64).reshape(len(windows), n)
            hashes = np.array([_roll(k, n)[0] for k in keys], np.uint64)
            order = np.argsort(hashes, kind="stable")
            names = [sorted(x) for x in windows.values()]
            by_length[n] = (hashes[order], keys[order], [names[i] for i in order])
        return cls(vocabulary, by_length)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside a window that occurs, and the items of these windows."""
        hit = np.zeros(len(words), bool)
        items: set[str] = set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        for n, (hashes, keys, names) in self.by_length.items():
            if len(ids) < n:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            starts = np.flatnonzero(unknown[n:] == unknown[:-n])
            if not len(starts):
                continue
            rolled = _roll(ids, n)[starts]
            at = np.searchsorted(hashes, rolled)
            for start, h, i in zip(*(x[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == rolled)] for x in (starts, rolled, at)), strict=True):
                while i < len(hashes) and hashes[i] == h:
                    if np.array_equal(keys[i], ids[start : start + n]):
                        hit[start : start + n] = True
                        items.update(names[i])
                        break
                    i += 1
        return hit, items


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanner(shared, first: bool):  # noqa: ANN001, ANN202
    arrow = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def scan(texts: pa.Array, before: pa.Array | None = None) -> pa.Array:
        out = []
        for i, raw in enumerate(raw_texts(texts)):
            words = words_of(raw)
            hit, items = shared.value.scan(words)
            if before is not None:
                was = before[i].as_py()
                for s in was["spans"]:
                    hit[s["first"] : s["last"] + 1] = True
                items |= set(was["items"])
            out.append({"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(hit)})
        return pa.array(out, arrow)

    if first:

        @F.arrow_udf(RESULT_TYPE)
        def run(texts: pa.Array) -> pa.Array:
            return scan(texts)
    else:

        @F.arrow_udf(RESULT_TYPE)
        def run(texts: pa.Array, before: pa.Array) -> pa.Array:
            return scan(texts, before)

    return run




def window_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "hits", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs with a struct column ``into``: n_words, n_hit, items (sorted as strings), spans of words."""
    parts = max(1, -(-column_bytes(benchmark, item_text) // slice_bytes))
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("raw"))
    spark = docs.sparkSession
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(parts)) == part).collect()  # at most about slice_bytes
        shared = spark.sparkContext.broadcast(WindowSet.build([(r.item, bytes(r.raw or b"")) for r in rows], window))
        scan = _scanner(shared, part == 0)
        docs = docs.withColumn(into, scan(text) if part == 0 else scan(text, into))
    return docs


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for raw, cut in zip(raw_texts(texts), spans.to_pylist(), strict=True):
        words = words_of(raw)
        plain, at, bounds = raw.translate(_TABLE), 0, []
        for w in words:
            at = plain.index(w, at)
            bounds.append((at, at := at + len(w)))
        kept, last = [], 0
        for s in cut:
            kept.append(raw[last : bounds[s["first"]][0]])
            last = bounds[s["last"]][1]
        out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def cut_spans(text: str | Column, hits: str) -> Column:
    """The text without the words of its hit spans and what is between these words."""
    return F.when(F.col(f"{hits}.n_hit") > 0, _cut(text, F.col(f"{hits}.spans"))).otherwise(F.col(text) if isinstance(text, str) else text)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def op2(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = window_hits(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), digest(F.col("hits.items")).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))
