"""Half-open code-point spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_text(body: Column, start: Column, end: Column) -> Column:
    return F.substring(body, start + 1, end - start)


def find_span(body: Column, quote: Column) -> Column:
    """First occurrence, or null."""
    at = F.call_function("instr", body, quote)
    return F.when((at > 0) & (F.char_length(quote) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.char_length(quote)).alias("end")))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_range(body: Column, start: Column, end: Column) -> Column:
    first = utf16_length(F.substring(body, F.lit(1), start))
    return F.struct(first.alias("start"), (first + utf16_length(span_text(body, start, end))).alias("end"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def excerpt_window(sentences: Column, start: Column, end: Column, most: int = 2) -> Column:
    """The span of the sentences that hold start..end, or null if they are none or more than most."""
    held = F.filter(sentences, lambda s: (s["start"] < end) & (start < s["end"]))
    covers = (F.array_min(F.transform(held, lambda s: s["start"])) <= start) & (F.array_max(F.transform(held, lambda s: s["end"])) >= end)
    window = F.struct(F.array_min(F.transform(held, lambda s: s["start"])).alias("start"), F.array_max(F.transform(held, lambda s: s["end"])).alias("end"))
    return F.when(F.size(held).between(1, most) & covers, window)


def gate_one(body: Column, sentences: Column, start: Column, end: Column, tier: Column, version: Column, known_version: int = 1) -> Column:
    """The first failed check of an evidence span, or null if it passes."""
    return (
        F.when(version != known_version, "normalization_mismatch")
        .when(tier == "link_only", "link_only_tier")
        .when((start < 0) | (end <= start) | (end > F.char_length(body)), "span_missing")
        .when(excerpt_window(sentences, start, end).isNull(), "window_exceeded")
    )
