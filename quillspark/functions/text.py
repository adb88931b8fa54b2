"""Text expressions: built-in functions first, Arrow functions where Spark has none (NFC, sentence rules, alignment)."""

from __future__ import annotations

import html
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entities in the order in which they are decoded, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
# Words that mark a corrected article, as regular expressions.
CORRECTION_MARKERS = (
    ("Correction:", "(?i)correction:"),
    ("Corrected:", "(?i)corrected:"),
    ("CORRECTED-", "CORRECTED-"),
    ("This article has been corrected", "(?i)this article has been corrected"),
    ("An earlier version of this article", "(?i)an earlier version of this article"),
)
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "Jr.", "Sr.", "vs.", "etc.", "U.S.", "U.K.", "U.N.", "a.m.", "p.m.")
# Capitalised words that are no names.
NO_NAMES = frozenset(
    "a an the and or but nor so yet as at by for from in into of on onto over to up with without after before amid amidst "
    "despite during until while against about under why how what when where who which this that these those it its he she "
    "they we you his her their our is are was were be been has have had will would can could may might should must not no "
    "new says say said live update updates breaking exclusive analysis opinion explainer watch video".split()
)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
WHITE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _each(function, kind):  # noqa: ANN001, ANN202
    """An Arrow function from one text to one value; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in texts.to_pylist()])

    return F.arrow_udf(run, kind)


def nfc(text: Column) -> Column:
    """Canonical composition; ASCII texts never leave the JVM."""
    composed = _each(lambda x: unicodedata.normalize("NFC", x), T.StringType())
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+$", "")


def strip_markup(text: Column) -> Column:
    """Tags out, then entities, line ends and runs of empty lines: the part of normalising that is built in."""
    text = F.regexp_replace(text, "<[^>]*>", "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(text, "\r\n?", "\n")


def normalize_body(text: Column) -> Column:
    return _finished(strip_markup(text))


def _finished(text: Column) -> Column:
    return strip(F.regexp_replace(nfc(text), "\n{3,}", "\n\n"))


def with_normalized(df: DataFrame, into: str, raw: Column) -> DataFrame:
    """df with normalize_body(raw) in a column, each step a projection of its own, so that none is computed once for every use of it."""
    return df.withColumn(into, strip_markup(raw)).withColumn(into, _finished(F.col(into)))


def normalize_title(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(nfc(text), rf"{WHITE}+", " ")))


def normalize_for_match(text: Column) -> Column:
    """Letters and digits only, single spaces, a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def has_terms(text: Column, terms: Column) -> Column:
    """Whether every term stands in the text on word boundaries."""
    return F.forall(terms, lambda t: F.contains(normalize_for_match(text), F.concat(F.lit(" "), t, F.lit(" "))))


def title_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def new_markers(before: Column, after: Column) -> Column:
    """The labels of the markers that occur more often after than before."""
    grown = [F.when(F.regexp_count(after, F.lit(p)) > F.regexp_count(before, F.lit(p)), F.lit(label)) for label, p in CORRECTION_MARKERS]
    return F.array_compact(F.array(*grown))


def recheck_judgement(before: Column, raw: Column) -> Column:
    """unchanged, correction_candidate or text_changed, by hash and markers of the normalised body."""
    return judged(before, normalize_body(raw))


def judged(before: Column, after: Column) -> Column:
    """recheck_judgement() of a body that is normalised already."""
    marked = F.rlike(after, F.lit("|".join(p if p.startswith("(?i)") else f"(?-i){p}" for _, p in CORRECTION_MARKERS)))
    corrected = F.when(marked, F.size(new_markers(before, after)) > 0)  # markers are counted only where there is one
    return F.when(F.sha2(after, 256) == F.sha2(before, 256), "unchanged").when(corrected, "correction_candidate").otherwise("text_changed")


_END = re.compile(r"[.?!][\"'”’)\]}]*(?=\s|$)")
_ABBREVIATED = re.compile(r"(?:^|[^A-Za-z])(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")$")


def sentence_spans(text: str) -> list[dict[str, int]]:
    """Half-open code-point spans of the sentences."""
    spans, start = [], 0

    def add(end: int) -> None:
        part = text[start:end]
        left = start + len(part) - len(part.lstrip())
        spans.append({"start": left, "end": max(left, start + len(part.rstrip()))})

    for m in _END.finditer(text):
        if text[m.start()] == "." and _ABBREVIATED.search(text, max(0, m.start() - 8), m.start() + 1):
            continue
        add(m.end())
        start = m.end()
    if text[start:].strip():
        add(len(text))
    return spans


def split_sentences(text: Column) -> Column:
    return _each(sentence_spans, SPANS)(text)


def sentence_texts(text: Column) -> Column:
    return F.transform(split_sentences(text), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]))


@lru_cache(1 << 16)
def _bare(raw: str) -> tuple[str, bool, bool]:
    """A word without what surrounds it, whether a phrase ends behind it, and whether it may be of a name. Words come again and again."""
    body = re.sub(r"^[\W_]+", "", raw)
    word = re.sub(r"(?:[^\w.]|_)+$", "", body)
    word = re.sub(r"(?:[^\w.]|_)+$", "", re.sub(r"['’]s$", "", word))
    if word.endswith(".") and "." not in word[:-1]:
        word = word[:-1]
    return word, len(word) < len(body) and not body.endswith("."), _is_name(word)


def _is_name(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and word.lower() not in NO_NAMES


def proper_noun_phrases(title: str, most: int = 3) -> list[str]:
    """Runs of at most three capitalised words, joined over a single "of"; each once, by lower case."""
    words = [_bare(w) for w in unicodedata.normalize("NFC", title).split()]
    phrases: list[list[str]] = [[]]
    for i, (word, ends, name) in enumerate(words):
        if not name and not phrases[-1]:
            continue
        joins = word.lower() == "of" and not ends and phrases[-1] and len(phrases[-1]) + 2 <= most and i + 1 < len(words) and words[i + 1][2]
        if not joins and not name:
            phrases.append([])
            continue
        if len(phrases[-1]) >= most:
            phrases.append([])
        phrases[-1].append(word)
        if ends and not joins:
            phrases.append([])
    found: dict[str, str] = {}
    for p in filter(None, phrases):
        found.setdefault(" ".join(p).lower(), " ".join(p))
    return list(found.values())


def proper_nouns(title: Column) -> Column:
    return _each(proper_noun_phrases, T.ArrayType(T.StringType()))(title)


def match_terms(title: Column) -> Column:
    """Two to four normalised names to look for, single words of three letters at least; null if fewer."""
    terms = F.array_distinct(F.transform(proper_nouns(title), lambda n: F.trim(normalize_for_match(n))))
    terms = F.slice(F.filter(terms, lambda t: F.contains(t, F.lit(" ")) | (F.char_length(t) >= 3)), 1, 4)
    return F.when(F.size(terms) >= 2, terms)


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())]))
_DIFF = T.StructType([T.StructField("previous", _SEGMENTS), T.StructField("current", _SEGMENTS)])


def word_segments(previous: str, current: str) -> dict[str, list[dict]]:
    """Both sides as segments of words that changed or stayed, by a longest common subsequence of the words.

    Where several are longest, words of the previous side are passed over first.
    """
    a, b = previous.split(), current.split()
    width = len(b) + 1
    rows = [array("i", bytes(4 * width))]  # from the last word of a to its first: what a[i:] has in common with b[j:]
    for word in reversed(a):
        below, row = rows[-1], array("i", bytes(4 * width))
        for j in range(width - 2, -1, -1):
            row[j] = below[j + 1] + 1 if word == b[j] else max(below[j], row[j + 1])
        rows.append(row)
    rows.reverse()
    marked: dict[str, list[tuple[bool, str]]] = {"previous": [], "current": []}
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            marked["previous"].append((False, a[i]))
            marked["current"].append((False, b[j]))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            marked["previous"].append((True, a[i]))
            i += 1
        else:
            marked["current"].append((True, b[j]))
            j += 1
    marked["previous"] += [(True, w) for w in a[i:]]
    marked["current"] += [(True, w) for w in b[j:]]
    return {side: [{"text": " ".join(w for _, w in run), "changed": changed} for changed, run in groupby(words, key=itemgetter(0))] for side, words in marked.items()}


def diff_words(previous: Column, current: Column) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([word_segments(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])

    return F.arrow_udf(run, _DIFF)(previous, current)


def embedding_input(title: Column, description: Column, body: Column) -> Column:
    """Title and description, else title and the first 500 code points of the body, else the title."""
    rest = F.coalesce(F.nullif(description, F.lit("")), F.nullif(F.substring(body, 1, 500), F.lit("")))
    return F.concat_ws("\n", title, rest)


def search_query(raw: Column) -> Column:
    """The query composed and trimmed, or null if it is not of 1 to 200 code points."""
    query = strip(nfc(raw))
    return F.when(F.char_length(query).between(1, 200), query)


_WRONG = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]+")


def _repaired(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group()


def decoded_title(raw: str) -> str:
    """Entities decoded, UTF-8 that was read as Latin-1 repaired, zero-width characters out."""
    return re.sub("[\u200b-\u200d\u2060\ufeff]", "", _WRONG.sub(_repaired, html.unescape(raw))).strip()


def decode_title(raw: Column) -> Column:
    return _each(decoded_title, T.StringType())(raw)


# What makes a claim sensitive: figures, dates, and verbs of speech.
SENSITIVE = r"(?i)[0-9]|\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december|today|yesterday|tomorrow)\b|\b(said|says|say|told|announced|claimed|denied|warned)\b"


def is_sensitive(quotes: Column, claim_type: Column) -> Column:
    return (claim_type == "attributed_position") | F.exists(quotes, lambda q: q.rlike(SENSITIVE))
