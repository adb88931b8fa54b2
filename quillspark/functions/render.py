"""Strings for prompts, links and caches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.ident import neutral_order


def numbered(sentences: Column) -> Column:
    """One line per sentence: s1, s2, and so on."""
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("s"), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def quote_of(sentences: Column, ids: Column) -> Column:
    """The text of one sentence, or of two that follow each other, by their 1-based numbers; else null."""
    first, last = F.array_min(ids), F.array_max(ids)
    known = (first >= 1) & (last <= F.size(sentences)) & (last - first == F.size(ids) - 1) & F.size(ids).between(1, 2)
    return F.when(known, F.array_join(F.slice(sentences, first, last - first + 1), " "))


def blinded(items: Column, seed: str, key: Column) -> Column:
    """The items in an order hashed from seed and key, so that their place tells nothing."""
    return F.transform(F.array_sort(F.transform(items, lambda x: F.struct(neutral_order(F.lit(seed), key, x.cast("string")).alias("o"), x.alias("x")))), lambda p: p["x"])


def story_path(slug: Column, revision: Column) -> Column:
    """Path of a story, or of one of its revisions."""
    base = F.concat(F.lit("/stories/"), F.url_encode(slug))
    return F.when(revision.isNull(), base).otherwise(F.concat(base, F.lit("/revisions/"), revision.cast("string")))


def claim_anchor(hash_part: Column) -> Column:
    """The claim in a link's fragment, or null."""
    return F.nullif(F.regexp_extract(hash_part, "^#claim-([A-Za-z0-9-]+)$", 1), F.lit(""))
