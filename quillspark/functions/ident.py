"""Identifiers and canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def article_id(normalized_url: Column) -> Column:
    return F.concat(F.lit("a-"), F.substring(sha(normalized_url), 1, 16))


def version_id(article: Column, body_hash: Column) -> Column:
    return F.concat(F.lit("av-"), F.substring(sha(F.concat(article, F.lit("\n"), body_hash)), 1, 16))


def story_id(first_article: Column) -> Column:
    return F.concat(F.lit("s-"), F.regexp_replace(first_article, "^a-", ""))


def claim_id(story: Column, revision: Column, n: Column) -> Column:
    return F.concat_ws("-", story, F.concat(F.lit("r"), revision.cast("string")), F.concat(F.lit("c"), n.cast("string")))


def claim_revision_id(claim: Column, revision: Column) -> Column:
    return F.concat(claim, F.lit("@rev-"), revision.cast("string"))


def content_hash(rows: Column) -> Column:
    """A hash of an array of structs that does not depend on its order."""
    return sha(F.array_join(F.array_sort(F.transform(rows, lambda r: F.to_json(r))), "\n"))


def content_digest(*columns: str) -> Column:
    """An aggregate over rows of any number: how many there are and two sums of their hashes, whatever their order."""
    row = sha(F.to_json(F.struct(*columns)))
    part = lambda at: F.sum(F.conv(F.substring(row, at, 13), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", F.count("*").cast("string"), part(1), part(14))


def seeded_rank(seed: str, key: Column) -> Column:
    return sha(F.concat_ws("|", F.lit(seed), key.cast("string")))


def neutral_order(*parts: Column) -> Column:
    return sha(F.concat_ws("|", *parts))


def evidence_key(evidence: Column) -> Column:
    """The spans of a claim as one string: version:start-end, sorted. evidence: an array of version, start and end."""
    return F.array_join(F.array_sort(F.transform(evidence, lambda e: F.concat(e["version"].cast("string"), F.lit(":"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string")))), "|")


def only_known(quotes: Column, known: Column) -> Column:
    """Whether a claim has quotes, all of them known."""
    return (F.size(quotes) > 0) & (F.size(F.array_except(quotes, known)) == 0)
