"""Metrics of clusterings and classifications."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(hit: Column, of: Column) -> Column:
    return F.try_divide(hit.cast("double"), of.cast("double"))


def contingency(points: DataFrame, gold: str = "gold", predicted: str = "predicted", weight: Column | None = None) -> DataFrame:
    """gold, predicted, n and the margins n_gold, n_predicted, all from one aggregate of the points."""
    cells = points.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("n"))
    a = cells.groupBy("gold").agg(F.sum("n").alias("n_gold"))
    b = cells.groupBy("predicted").agg(F.sum("n").alias("n_predicted"))
    return cells.join(a, "gold").join(b, "predicted")


def clustering_scores(points: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """One row: ari, nmi (arithmetic mean, natural logarithm), B-cubed precision, recall and F1."""
    table = contingency(points, gold, predicted)
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n")
    own = table.agg(
        F.sum(n).alias("total"),
        F.sum(pairs(n)).alias("both"),
        F.sum(pairs(F.col("n_gold")) * n / F.col("n_gold")).alias("in_gold"),
        F.sum(pairs(F.col("n_predicted")) * n / F.col("n_predicted")).alias("in_predicted"),
        F.sum(n * F.log(n)).alias("h"),
        F.sum(n * F.log("n_gold")).alias("h_gold"),
        F.sum(n * F.log("n_predicted")).alias("h_predicted"),
        F.sum(n * n / F.col("n_predicted")).alias("p"),
        F.sum(n * n / F.col("n_gold")).alias("r"),
    )
    t = F.col("total")
    expected = F.col("in_gold") * F.col("in_predicted") / pairs(t)
    highest = (F.col("in_gold") + F.col("in_predicted")) / 2
    entropy = lambda c: F.log(t) - F.col(c) / t
    mutual = F.col("h") / t - F.col("h_gold") / t - F.col("h_predicted") / t + F.log(t)
    p, r = F.col("p") / t, F.col("r") / t
    return own.select(
        F.try_divide(F.col("both") - expected, highest - expected).alias("ari"),
        F.try_divide(mutual, (entropy("h_gold") + entropy("h_predicted")) / 2).alias("nmi"),
        p.alias("bcubed_p"),
        r.alias("bcubed_r"),
        F.try_divide(2 * p * r, p + r).alias("bcubed_f1"),
    )


def class_scores(points: DataFrame, classes: list, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support: null where nothing is to be told."""
    spark = points.sparkSession
    names = F.broadcast(spark.createDataFrame([(c,) for c in classes], ["class"]))
    counts = points.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    c = F.col("class")
    s = names.join(counts, (F.col("gold") == c) | (F.col("predicted") == c), "left").groupBy("class").agg(
        hit((F.col("gold") == c) & (F.col("predicted") == c)).alias("tp"), hit(F.col("predicted") == c).alias("said"), hit(F.col("gold") == c).alias("support")
    )
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    return s.select("class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.when(p.isNotNull() & r.isNotNull(), 0.0)).alias("f1"), "support")


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: n, agreement, kappa (null where chance alone agrees)."""
    table = contingency(pairs, a, b)
    total = pairs.agg(F.count("*").cast("double").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
    chance = table.where("gold = predicted").agg(F.coalesce(F.sum(F.col("n_gold") * F.col("n_predicted")), F.lit(0.0)).alias("chance"))
    joined = total.crossJoin(chance)  # one row each
    expected = F.col("chance") / (F.col("n") * F.col("n"))
    return joined.select(F.col("n").cast("long").alias("n"), "agreement", F.try_divide(F.col("agreement") - expected, 1 - expected).alias("kappa"))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank (name_disc) and interpolated (name_cont) percentiles per key."""
    cols = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"{n}_disc") for n, p in shares.items()]
    cols += [F.expr(f"percentile_cont({p}) within group (order by {value})").alias(f"{n}_cont") for n, p in shares.items()]
    return df.groupBy(*keys).agg(*cols)


def mulberry(seed: str, n: int) -> np.ndarray:
    """n numbers in [0, 1) of a 32-bit generator, seeded by the first eight hex digits of the seed's SHA-256."""
    state = int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16)
    out = np.empty(n)
    mask = 0xFFFFFFFF
    for i in range(n):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (1 | state)) & mask
        t = ((t + (((t ^ (t >> 7)) * (61 | t)) & mask)) & mask) ^ t
        out[i] = ((t ^ (t >> 14)) & mask) / 4294967296
    return out


def bootstrap(units: DataFrame, key: str, hit: str, of: str, seed: str, resamples: int = 1000) -> DataFrame:
    """One row: value, low, high: Σhit/Σof over units, with the 2.5 and 97.5 percentiles of resamples of whole units.

    The table of how often a resample draws a unit grows with units * resamples only; units are evaluation packets, few by their nature.
    """
    names = sorted(r[0] for r in units.select(key).distinct().collect())

    def weigh(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for i in batch.column("id").to_pylist():
                drawn = np.bincount((mulberry(f"{seed}|{i}", len(names)) * len(names)).astype(int), minlength=len(names))
                at = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array([str(names[k]) for k in at]), pa.array(drawn[at], pa.int64())], names=["resample", "_unit", "w"])

    weights = units.sparkSession.range(resamples).mapInArrow(weigh, "resample long, _unit string, w long")
    rows = units.groupBy(F.col(key).cast("string").alias("_unit")).agg(F.sum(hit).alias("hit"), F.sum(of).alias("of"))
    drawn = weights.join(F.broadcast(rows), "_unit").groupBy("resample").agg(ratio(F.sum(F.col("w") * F.col("hit")), F.sum(F.col("w") * F.col("of"))).alias("v"))
    value = rows.agg(ratio(F.sum("hit"), F.sum("of")).alias("value"))
    return value.crossJoin(drawn.agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high")))  # one row each


def flips(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row: pairs in one of the sets only, and in either."""
    a, b = first.select(*keys).distinct().withColumn("_a", F.lit(1)), second.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, keys, "full_outer").agg(F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("flipped"), F.count("*").alias("either"))


def majority(points: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """group, value: the most frequent value, the earliest in ties."""
    counts = points.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"), F.col(value))).alias(value))
