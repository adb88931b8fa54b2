"""Costs of model calls, reservations and counter keys."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.span import utf16_length


def usage_usd(input_tokens: Column, cached_tokens: Column, output_tokens: Column, price: dict[str, float]) -> Column:
    """price: dollars per million of input, cached and output tokens; cached ones are part of the input."""
    return ((input_tokens - cached_tokens) * price["input"] + cached_tokens * price["cached"] + output_tokens * price["output"]) / 1e6


def estimated_tokens(text: Column) -> Column:
    """A bound before the call: a token for every three UTF-16 units."""
    return F.ceil(utf16_length(text) / 3)


def reservation_usd(text: Column, most_output: Column, price: dict[str, float]) -> Column:
    return usage_usd(estimated_tokens(text), F.lit(0), most_output, price)


def counter_key(secret: str, day: Column, client: Column) -> Column:
    """HMAC-SHA256 of day and client: counters of different days can't be linked."""

    def run(days: pa.Array, clients: pa.Array) -> pa.Array:
        pairs = zip(days.to_pylist(), clients.to_pylist(), strict=True)
        return pa.array([None if c is None else hmac.new(secret.encode(), f"{d}|{c}".encode(), hashlib.sha256).hexdigest() for d, c in pairs], pa.string())

    return F.arrow_udf(run, T.StringType())(day, client)


def size_class(n: Column) -> Column:
    """Size of a packet by its articles."""
    return F.when(n <= 1, "single").when(n <= 3, "small").otherwise("large")
