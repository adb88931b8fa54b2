"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of file names that are no photographs.
NO_PHOTO = ("favicon", "logo", "icon", "sprite", "placeholder", "default")
MOST_URL = 2048
_URL = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:[0-9]+)?([^?#]*)"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _URL, n)


def host_of(url: Column) -> Column:
    """Lower case, without www.; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), F.lit(""))


def normalize_url(url: Column) -> Column:
    """Scheme, host without www., a port that isn't the scheme's own, and the path without slashes at its end; null if it is no URL."""
    scheme, port = F.lower(part(url, 1)), part(url, 3)
    usual = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    rest = F.regexp_replace(part(url, 4), "/+$", "")
    return F.when(host_of(url).isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), F.when(usual, "").otherwise(port), rest))


def host_suffixes(host: Column) -> Column:
    """The host and all of its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def image_url(url: Column) -> Column:
    """The trimmed URL if it may be a photograph, else null."""
    url = F.trim(url)
    name = F.lower(F.regexp_extract(part(url, 4), "([^/]*)/*$", 1))
    tokens = F.split(name, "[^a-z0-9]+")
    plain = name.rlike(r"\.(ico|svg)$") | F.arrays_overlap(tokens, F.array(*map(F.lit, NO_PHOTO))) | F.array_join(tokens, " ").rlike(r"(^| )og image( |$)")
    return F.when((F.char_length(url).between(1, MOST_URL)) & F.lower(part(url, 1)).isin("http", "https") & host_of(url).isNotNull() & ~plain, url)
