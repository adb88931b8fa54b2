"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each document becomes a vector of transformed text statistics. Within a stratum (language and
source) the ``KEEP`` share of documents with the least covariance determinant is sought by
concentration: start from medians and median deviations, then again and again take the mean and
covariance of the share that is nearest. Documents beyond a chi-square limit are rejected.

All steps are Spark aggregations over every row: sums by stratum of the vectors and their products,
and the distance at which the share is reached, from mergeable quantile sketches. No stratum is gathered in one task; what
is joined to the documents is one row per stratum, and the join's skew is the adaptive plan's to split.
Strata of fewer than ``LEAST`` documents are pooled by language, and small languages in one rest.

Null and empty texts have no words, fail the base rule and take no part in the fit. A null language or
source is a stratum of its own name. Repeated rows count as often as they occur. An empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import discard, materialize, raw_texts

#: Least documents of a stratum of its own; share of documents that the fit rests on; concentration steps.
LEAST, KEEP, STEPS = 100, 0.75, 4
#: The share of clean documents, were they normal, that the limit would reject.
TAIL = 1e-6
#: The least standard deviation of each transformed statistic: below it differences are of no account.
FLOORS = (0.30, 0.25, 0.05, 0.15, 0.15)
DIMS = tuple(f"x{i}" for i in range(len(FLOORS)))
PAIRS = tuple(combinations_with_replacement(range(len(FLOORS)), 2))

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The median of chi-square with 5 degrees of freedom.
CHI_MEDIAN = 4.351


def _repeats(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    if base == len(words):
        return 0
    pairs = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:  # the product of three would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for i in range(3):
        inside[i : i + n] |= twice
    return int(inside.sum())


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in FIELDS]))
def _measure(texts: pa.Array) -> pa.Array:
    rows = []
    for raw in raw_texts(texts):
        words = raw.split()
        chars = sum(map(len, words)) - (0 if raw.isascii() else len(raw) - len(raw.translate(None, _CONTINUATION)))
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        rows.append((len(words), chars, symbols, len(lines) - len(set(lines)), _repeats(words), len(lines)))
    columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(FIELDS))


def text_statistics(text: str | Column) -> Column:
    """A struct of FIELDS; words are runs of other than ASCII white space."""
    return _measure(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _vector(s: str) -> list[Column]:
    n, chars, symbols, dup, repeat, lines = (F.col(f"{s}.{x}").cast("double") for x in FIELDS)
    ratio = lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1.0)))
    return [F.log(F.greatest(n, F.lit(1.0))), chars / F.greatest(n, F.lit(1.0)), ratio(symbols, chars), ratio(dup, lines), ratio(repeat, n)]


def chi_limit(tail: float = TAIL) -> float:
    """The distance that a share of tail of a 5-dimensional normal exceeds."""
    low, high = 0.0, 500.0
    for _ in range(80):
        x = (low + high) / 2
        beyond = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
        low, high = (x, high) if beyond > tail else (low, x)
    return high


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. under mean and inverse (upper triangle) of the joined state."""
    away = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMS)]
    return sum((F.lit(1.0 if i == j else 2.0) * F.col("inverse")[k] * away[i] * away[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sums per stratum to mean and inverse covariance; the floors keep it regular."""
    p = len(FLOORS)
    for batch in batches:
        means, inverses = [], []
        for row in batch.to_pylist():
            mean = np.array([row[f"m{i}"] for i in range(p)])
            cov = np.diag(np.square(FLOORS))
            for i, j in PAIRS:
                c = row[f"c{i}{j}"] - mean[i] * mean[j]
                cov[i, j] += c
                if i != j:
                    cov[j, i] += c
            inverse = np.linalg.inv(cov)
            means.append(mean.tolist())
            inverses.append([float(inverse[i, j]) for i, j in PAIRS])
        yield pa.RecordBatch.from_arrays([batch.column("stratum"), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], names=["stratum", "mean", "inverse"])


def _moments(points: DataFrame) -> DataFrame:
    sums = points.groupBy("stratum").agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(DIMS)), *(F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"c{i}{j}") for i, j in PAIRS))
    return sums.mapInArrow(_invert, "stratum string, mean array<double>, inverse array<double>")


def strata(points: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, stratum: the group in which documents of a language and source are judged."""
    counts = points.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).over(Window.partitionBy("lang"))
    own, pooled = F.to_json(F.struct("lang", "source")), F.to_json(F.struct(F.lit("pooled").alias("of"), "lang"))
    return counts.select("lang", "source", F.when(F.col("n") >= least, own).when(small >= least, pooled).otherwise(F.lit("rest")).alias("stratum"))


def fit(points: DataFrame) -> DataFrame:
    """stratum, mean, inverse, scale from stratum, x0.., by concentration steps over all points."""
    medians = materialize(points.groupBy("stratum").agg(F.array(*(F.percentile_approx(x, 0.5, 1000) for x in DIMS)).alias("mean")), "mcd-medians")
    spread = [(F.lit(1.4826) * F.percentile_approx(F.abs(F.col(x) - F.col("mean")[i]), 0.5, 1000)).alias(f"s{i}") for i, x in enumerate(DIMS)]
    state = points.join(medians, "stratum").groupBy("stratum").agg(F.first("mean").alias("mean"), *spread)
    diagonal = [1 / (F.col(f"s{i}") * F.col(f"s{i}") + F.lit(FLOORS[i] ** 2)) if i == j else F.lit(0.0) for i, j in PAIRS]
    state = materialize(state.select("stratum", "mean", F.array(*diagonal).alias("inverse")), "mcd-state-0")
    for i in range(STEPS):
        placed = points.join(state, "stratum").select("stratum", *DIMS, _distance().alias("d"))
        reach = placed.groupBy("stratum").agg(F.percentile_approx("d", KEEP, 1000).alias("reach"))
        near = materialize(state.join(reach, "stratum"), f"mcd-reach-{i}")
        before, state = state, materialize(_moments(points.join(near, "stratum").where(_distance() <= F.col("reach")).select("stratum", *DIMS)), f"mcd-state-{i + 1}")
        discard(before)
        discard(near)
    scale = points.join(state, "stratum").groupBy("stratum").agg((F.percentile_approx(_distance(), 0.5, 1000) / CHI_MEDIAN).alias("scale"))
    return state.join(scale, "stratum")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, the statistics s, stratum, distance (null where the base rule fails), base_failed, kept."""
    measured = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_statistics(text).alias("s"))
    measured = measured.select("*", *(c.alias(x) for c, x in zip(_vector("s"), DIMS, strict=True)), base_failed(F.col("s.n_words"), F.col("s.n_repeat_words")).alias("base_failed"))
    measured = materialize(measured, "mcd-measured")
    good = measured.where(~F.col("base_failed"))
    groups = materialize(strata(good), "mcd-strata")
    g = groups.select(F.col("lang").alias("glang"), F.col("source").alias("gsource"), "stratum")
    points = materialize(good.join(g, good.lang.eqNullSafe(g.glang) & good.source.eqNullSafe(g.gsource)).select("stratum", *DIMS), "mcd-points")
    state = materialize(fit(points), "mcd-fit")
    discard(points)
    by_group = g.join(state, "stratum")
    joined = measured.join(by_group, measured.lang.eqNullSafe(by_group.glang) & measured.source.eqNullSafe(by_group.gsource), "left")
    distance = F.when(~F.col("base_failed"), _distance() / F.greatest(F.col("scale"), F.lit(1.0)))
    found = joined.select("doc_id", "s", "stratum", "base_failed", distance.alias("distance"))
    return found.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_limit(), F.lit(True)))


def op8(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs).select("doc_id", *(f"s.{x}" for x in FIELDS[:5]), "base_failed", "kept", "distance")
