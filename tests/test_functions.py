from datetime import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import ident, span, text, times, url, vector
from quillspark.operators import evaluation
from quillspark.operators.matching import match_pairs
from quillspark.operators.realign import realigned


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_sentences():
    body = 'Mr. Smith paid 3.5 dollars in the U.S. today. "Why?" he asked! No end'
    assert [body[s["start"] : s["end"]] for s in text.sentence_spans(body)] == ["Mr. Smith paid 3.5 dollars in the U.S. today.", '"Why?"', "he asked!", "No end"]
    assert text.sentence_spans("") == [] and text.sentence_spans("😀. b")[1] == {"start": 3, "end": 4}


def test_proper_nouns():
    assert text.proper_noun_phrases("Bank of Korea Raises the Rates, says Jerome Powell's aide") == ["Bank of Korea", "Raises", "Rates", "Jerome Powell"]
    assert text.proper_noun_phrases("The new A, b") == []


def test_normalising(spark):
    raw = "<p>a &amp;lt; b</p>\r\n\r\n\r\n\r\né &nbsp;  "
    assert one(spark, text.normalize_body(F.lit(raw)), text.normalize_title(F.lit("  A  B　"))) == ("a &lt; b\n\né", "a b")
    assert one(spark, text.has_terms(F.lit("The Bank-of Korea!"), F.array(F.lit("bank of"), F.lit("korea"))), text.jaccard(text.title_tokens(F.lit("one two three")), text.title_tokens(F.lit("two three four")))) == (True, 0.5)
    assert text.decoded_title("cafÃ© &#8217;​") == "café ’"


def test_rechecks_and_queries(spark):
    assert one(spark, text.recheck_judgement(F.lit("a"), F.lit("a Correction: b")), text.recheck_judgement(F.lit("a"), F.lit(" a ")), text.recheck_judgement(F.lit("a"), F.lit("b"))) == ("correction_candidate", "unchanged", "text_changed")
    assert one(spark, text.search_query(F.lit("  x ")), text.search_query(F.lit("  "))) == ("x", None)


def test_urls(spark):
    assert one(spark, url.normalize_url(F.lit("HTTPS://www.Example.com:8080/A/b/?q=1#x")), url.normalize_url(F.lit("nothing")), url.normalize_url(F.lit("http://a.b:80/"))) == ("https://example.com:8080/A/b", None, "http://a.b")
    assert one(spark, url.image_url(F.lit("https://x.y/a/photo.jpg")), url.image_url(F.lit("https://x.y/site-logo.png")), url.image_url(F.lit("https://x.y/og-image.png")), url.image_url(F.lit("ftp://x.y/a.jpg"))) == ("https://x.y/a/photo.jpg", None, None, None)
    assert one(spark, url.host_suffixes(F.lit("a.b.c")))[0] == ["a.b.c", "b.c", "c"]


def test_times(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    assert one(spark, times.slot_key(times.latest_slot(at("2024-01-01 08:00:00"))), times.slot_key(times.arrival_slot(at("2024-01-01 08:00:01"))), times.slot_key(times.due_slot(at("2024-01-01 08:30:00")))) == ("2024-01-01T08:00Z", "2024-01-01T20:00Z", "2023-12-31T20:00Z")
    assert one(spark, times.compact_time(F.lit("20241301000000")), times.compact_time(F.lit("20240102030405")), times.seoul_date(at("2024-01-01 15:00:00"))) == (None, datetime(2024, 1, 2, 3, 4, 5), "2024-01-02")
    assert one(spark, times.relative_time(at("2024-01-01 00:00:00"), at("2024-01-01 00:00:59")), times.relative_time(at("2023-01-01 00:00:00"), at("2024-01-01 00:00:00"))) == ("now", "2023-1-1")


def test_vectors_and_spans(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, vector.cosine(v(0, 0), v(1, 1)), F.round(vector.cosine(v(1, 0), v(1, 1)), 6)) == (0.0, 0.707107)
    with pytest.raises(Exception, match="different size"):
        one(spark, vector.cosine(v(1), v(1, 2)))
    assert tuple(one(spark, span.utf16_range(F.lit("😀ab"), F.lit(1), F.lit(2)))[0]) == (2, 3) and tuple(one(spark, span.find_span(F.lit("é quote"), F.lit("quote")))[0]) == (2, 7)
    sentences = text.split_sentences(F.lit("One two. Three. Four five."))
    gate = lambda a, b, tier="body_and_excerpt", n=1: span.gate_one(F.lit("One two. Three. Four five."), sentences, F.lit(a), F.lit(b), F.lit(tier), F.lit(n))
    assert one(spark, gate(0, 5), gate(0, 26), gate(5, 99), gate(0, 5, "link_only"), gate(0, 5, n=2)) == (None, "window_exceeded", "span_missing", "link_only_tier", "normalization_mismatch")


def test_identifiers(spark):
    rows = lambda *x: F.array(*(F.struct(F.lit(i).alias("a")) for i in x))
    a, b, c = one(spark, ident.content_hash(rows(1, 2)), ident.content_hash(rows(2, 1)), ident.content_hash(rows(1, 3)))
    assert a == b != c
    assert one(spark, ident.article_id(F.lit("u")))[0].startswith("a-")


def test_matching_rules():
    assert match_pairs([("p1", "n1", 0.9, 50), ("p1", "n2", 0.5, 40)]) == [("n1", "p1", None), ("n2", None, "p1")]
    assert match_pairs([("p1", "n1", 0.9, 50), ("p2", "n1", 0.85, 40)]) == [("n1", None, "p1")]  # no lead
    assert match_pairs([("p1", "n1", 0.9, 10), ("p2", "n1", 0.6, 40)]) == [("n1", None, "p1")]  # a short anchor decides nothing, and holds its rival back
    assert match_pairs([("p1", "n1", 0.9, 10)]) == [("n1", "p1", None)] and match_pairs([("p1", "n1", 0.4, 90)]) == [("n1", None, None)]


def test_realigned_spans():
    assert realigned("one two three", "zero one two three", 4, 7) == (9, 12)
    assert realigned("one two three", "one 2 three", 4, 7) is None and realigned("one two three", "one 2 three", 8, 13) == (6, 11)


def test_generator_is_uniform_and_fixed():
    a = evaluation.mulberry("seed", 2000)
    assert np.array_equal(a, evaluation.mulberry("seed", 2000)) and 0.45 < a.mean() < 0.55 and a.min() >= 0 and a.max() < 1


def test_word_segments_share_a_longest_subsequence():
    def longest(a, b):
        return max((n for n in range(len(a) + 1) if any(list(x) in [list(y) for y in combinations(b, n)] for x in combinations(a, n))), default=0)

    draw = np.random.default_rng(5)
    for _ in range(60):
        a, b = ([str(x) for x in draw.integers(0, 3, draw.integers(0, 7))] for _ in range(2))
        found = text.word_segments(" ".join(a), " ".join(b))
        sides = {k: [w for s in v for w in s["text"].split() if not s["changed"]] for k, v in found.items()}
        assert sides["previous"] == sides["current"] and len(sides["current"]) == longest(a, b)
        assert " ".join(s["text"] for s in found["previous"]).split() == a and " ".join(s["text"] for s in found["current"]).split() == b
    assert text.word_segments("x y", "y x") == {"previous": [{"text": "x", "changed": True}, {"text": "y", "changed": False}], "current": [{"text": "y", "changed": False}, {"text": "x", "changed": True}]}


def test_recheck_normalises_once(spark):
    texts = [("a b", "a b", "unchanged"), ("a b", " a b\r\n", "unchanged"), ("a", "a Correction: b", "correction_candidate"), ("CORRECTED- a", "CORRECTED- a b", "text_changed"), ("a", "corrected- a", "text_changed"), ("a", "CORRECTED- a", "correction_candidate"), ("a", "THIS article has been corrected é", "correction_candidate"), ("a", None, "text_changed"), (None, "a", "text_changed")]
    given = spark.createDataFrame(texts, "before string, raw string, want string")
    df = text.with_normalized(given, "after", F.col("raw")).select("want", text.judged(F.col("before"), F.col("after")).alias("got"), text.recheck_judgement(F.col("before"), F.col("raw")).alias("whole"))
    assert all(r.got == r.whole == r.want for r in df.collect())
    df = df.select("got")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("&quot;") == 1


def test_words_of_names_are_taken_apart_once():
    text._bare.cache_clear()
    assert text.proper_noun_phrases("Bank of England of Rome, and the Bank of of Ana's U.S. Team X") == ["Bank of England", "Rome", "Bank", "Ana", "U.S. Team"]
    assert text._bare.cache_info().hits > 0
