"""Ranked search against scoring every document."""

import math
from collections import Counter

import pytest

from plain import words_of
from quillspark.llm import ranked
from llm_rows import documents, prose


def scored(docs, items, k=20):
    bags = [(i, Counter(w := words_of(t or "")), len(w)) for i, t in docs]
    count, total = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = []
    for item, text in items:
        best = []
        for i, bag, n in bags:
            s = 0
            for w, times in Counter(words_of(text or "")).items():
                if bag[w]:
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))
                    s += times * weight * (1_000_000_000 * bag[w] // (1000 * bag[w] + 12 * (75 + 25 * n * count // total)))
            if s > 0:
                best.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, b[3], -b[0]) for r, b in enumerate(sorted(best, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def texts(sample):
    """Common words, groups of copies and the awkward cases."""
    more = [(1000 + i, prose(i % 70, 5 + i % 90, 60) + (" rareword" if i % 40 == 3 else ""), "en", None) for i in range(300)]
    return [*sample, *more]


ITEMS = [(1, prose(3, 60, 60)), (2, prose(9, 12)), (2, "rareword rareword Rareword x"), (3, None), (4, ""), (None, "nowhere"), (5, prose(4, 3, 60)), (6, prose(99, 2000))]


@pytest.mark.parametrize(("k", "chunk", "slice_bytes"), [(20, None, None), (3, 2000, 500), (1, 300, 20000)])
def test_equals_scoring_all(spark, texts, k, chunk, slice_bytes):
    docs = documents(spark, texts).repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, item string")
    got = ranked.search(docs, items, k=k, slice_bytes=slice_bytes or ranked.SLICE_BYTES, shard_bytes=chunk or ranked.CHUNK_BYTES).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == scored([(i, t) for i, t, *_ in texts], ITEMS, k)


def test_stops_before_the_end_and_stays_exact():
    """A shard of many documents: fewer documents are completed than hold a term."""
    docs = [(i, prose(i, 40, 300)) for i in range(600)]
    queries = ranked.Queries.of([(1, docs[7][1].encode())])
    words = [t.lower().encode() for _, t in docs]
    lists = [ranked.words_of(w) for w in words]
    counts = Counter(i for x in lists for i in queries.found(x)[0].tolist())
    queries.weigh({**counts, ranked.DOCUMENTS: 600, ranked.TERMS: sum(map(len, lists))})
    shard = ranked.Shard(queries, lists)
    found, full = shard.top(*queries.items[0][1:], 1, 0)
    assert found.tolist() == [7]
    assert full.tolist() == [r[3] for r in scored(docs, [(1, docs[7][1])], 1)]


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(none, items).collect() == []
    assert ranked.search(documents(spark, [(1, "a b", "en", None)]), items.limit(0)).collect() == []
