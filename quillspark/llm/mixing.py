"""Mixing sources to target weights by entropy balancing.

Document rates w_d minimise sum(w log w - w) subject to one token constraint per source,
sum(w_d * size_d) = target, and to w_d <= 3. The dual is convex with one multiplier per source, and
its solution tilts rates exponentially: w_d = min(3, exp(lambda_s * size_d / scale_s)). Newton's
iterations, safeguarded by a bracket, run as Spark aggregations over counts of documents by source and size, on
which alone the rates depend. Rates are rounded into copies: the whole part for all, and one more
for the documents whose fraction beats a number hashed from the document; a threshold per source,
found by histograms refined three times, makes the taken words meet the target as closely as one
document can.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; no target is above three times
its source's words, and what is above is shared again by weight (all in window functions over the
table of sources).

A null text has size 0; documents of size 0 are taken 0 times. A null source is a source of its
own. Rows of one id and text are numbered and so are documents of their own: each draws its own
number, null ids too. A very long text counts as a whole, so that its source may miss the target by its size.
An empty table gives an empty result. Other columns are ignored. Nothing but one row per source and round stays small; no source, however
large, is gathered into one task. Should Newton's iterations not meet every target, an error is raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, sieve

#: Most copies of a document, and so most words of a source as a multiple of what it has.
MOST = 3
WEIGHTS = (1, 2, 3)
#: Iterations after which the bracket alone would have met any target.
ROUNDS = 120
BINS, LEVELS = 256, 4


def token_size(text: str | Column) -> Column:
    """The number of runs of other than ASCII white space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, size) per document: source, source_size, target.

    The level at which shares stop growing: sources in order of capacity by weight are full one after
    another, so the first at which the rest by weight would not be full marks the end.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighted = totals.withColumn("weight", (F.lit(WEIGHTS[0]) + (F.row_number().over(order) - 1) % len(WEIGHTS)).cast("double"))
    weighted = weighted.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        weighted.withColumn("full_before", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("share", (F.sum("source_size").over(every) - F.col("full_before")) / F.col("weight_left"))
    )
    share = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "share"))).over(every)
    return filled.withColumn("share", share["share"]).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("share") * F.col("weight")), F.col("cap")).alias("target"))


def _tilts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, scale, tilt: the dual's multipliers after Newton's iterations."""
    classes = materialize(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-classes")
    scale = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    state = targets.join(scale, targets.source.eqNullSafe(scale.source), "left").select(targets.source, "source_size", "target", "scale", "least")
    # min(3, exp(tilt * size / scale)) is 3 for the smallest at high, and all that is taken is below one part in 10**9 at low
    state = state.withColumn("high", F.log(F.lit(float(MOST))) * F.col("scale") / F.col("least")).withColumn("low", -F.lit(45.0) * F.col("scale") / F.col("least"))
    state = materialize(state.withColumn("tilt", F.lit(0.0)).withColumn("left", F.lit(1.0)), "mix-state-0")
    for i in range(ROUNDS):
        s = state.alias("s")
        x = F.col("c.size") / F.col("s.scale")
        raw = F.exp(F.least(F.col("s.tilt") * x, F.lit(2.0)))
        rate = F.least(raw, F.lit(float(MOST)))
        moved = (
            classes.alias("c")
            .join(F.broadcast(s) if _small(state) else s, F.col("c.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("of"))
            .agg(
                F.sum(F.col("c.n") * F.col("c.size") * rate).alias("got"),
                F.sum(F.when(raw < MOST, F.col("c.n") * F.col("c.size") * x * raw).otherwise(0.0)).alias("slope"),
            )
        )
        step = state.join(moved, state.source.eqNullSafe(moved.of), "left").drop("of")
        gap = F.col("got") - F.col("target")
        step = step.withColumn("high", F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))).withColumn("low", F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low")))
        newton = F.col("tilt") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.between(F.col("low"), F.col("high"))
        step = step.withColumn("left", F.coalesce(F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)))
        step = step.withColumn("tilt", F.when(F.col("left") < 1e-9, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        before, state = state, materialize(step.select("source", "source_size", "target", "scale", "least", "high", "low", "tilt", "left"), f"mix-state-{i + 1}")
        discard(before)
        if (state.agg(F.max("left")).first()[0] or 0.0) < 1e-7:
            discard(classes)
            return state
    raise ArithmeticError("the rates of some source do not meet its target")


def _small(state: DataFrame, limit: int = 50_000) -> bool:
    """Whether the table of sources may be broadcast."""
    return state.count() <= limit


def _thresholds(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """source, cut: documents whose key is at most cut get one more copy.

    key is the hashed number minus the fraction, in [-1, 1). At each level the interval that holds
    the threshold is split in BINS parts and the words of each part are summed.
    """
    base = rated.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("base"))
    state = sources.join(base, sources.source.eqNullSafe(base.source), "left").select(sources.source, (F.col("target") - F.coalesce("base", F.lit(0))).alias("need"), F.lit(-1.0).alias("low"), F.lit(2.0).alias("width"))
    for level in range(LEVELS):
        state = materialize(state, f"mix-cut-{level}")
        s = state.alias("s")
        bins = (
            rated.where("more").alias("r")
            .join(F.broadcast(s) if _small(state) else s, F.col("r.source").eqNullSafe(F.col("s.source")))
            .withColumn("bin", F.floor((F.col("r.key") - F.col("s.low")) / F.col("s.width") * BINS))
            .where(F.col("bin").between(0, BINS - 1))
            .groupBy(F.col("s.source").alias("source"), "need", "low", "width", "bin")
            .agg(F.sum("r.size").alias("words"))
        )
        w = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
        last = level == LEVELS - 1
        crossing = F.col("upto") > F.col("need")
        # the last part is taken whole if that comes nearer than leaving it
        chosen = bins.where(crossing).groupBy("source").agg(F.min(F.struct("bin", "words", "before", "upto")).alias("b"))
        took = (F.abs(F.col("b.upto") - F.col("need")) < F.abs(F.col("b.before") - F.col("need"))).cast("int") if last else F.lit(0)
        joined = state.join(chosen, state.source.eqNullSafe(chosen.source), "left").select(state.source, "need", "low", "width", "b")
        at = F.col("low") + (F.col("b.bin") + took) * F.col("width") / BINS
        state = joined.select(
            "source",
            F.when(F.col("b").isNull(), F.col("need")).otherwise(F.col("need") - F.col("b.before")).alias("need"),
            F.when(F.col("b").isNull(), F.col("low") + F.col("width")).otherwise(at).alias("low"),
            F.when(F.col("b").isNull(), F.lit(1e-12)).otherwise(F.col("width") / BINS).alias("width"),
        )
    return state.select("source", F.col("low").alias("cut"))


def _numbered_ties(sized: DataFrame) -> DataFrame:
    """With a number n of each row among the rows of its tie: within each part of the table, after the rows of the parts before."""
    counts = sized.groupBy("tie", "part").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("tie").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where("before > 0").select("tie", "part", "before")  # ties over several parts
    within = sized.withColumn("within", F.row_number().over(Window.partitionBy("tie", "part").orderBy("row")))
    return within.join(before, ["tie", "part"], "left").withColumn("n", F.col("within") + F.coalesce("before", F.lit(0)))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per document (in a table of their own): id, row, source, size, whole, key, more; per source: target, tilt, cut."""
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    sized = docs.select(F.col(doc_id).alias("doc_id"), number.alias("row"), F.col(source).alias("source"), token_size(text).alias("size"), F.xxhash64(doc_id, text).alias("tie"), F.spark_partition_id().alias("part"))
    sized = materialize(sized, "mix-sizes")
    sources = _tilts(sized, source_targets(sized))
    rated = _rated(_numbered_ties(sized), sources)
    rated = materialize(rated, "mix-rated")
    cuts = materialize(_thresholds(rated, sources), "mix-cuts")
    cut = cuts.withColumnRenamed("source", "of")
    plan = sources.join(cut, sources.source.eqNullSafe(cut.of), "left").select("source", "source_size", "target", "tilt", "scale", "cut")
    return rated, plan


def _rated(sized: DataFrame, sources: DataFrame, *keep: str) -> DataFrame:
    s = sources.select(F.col("source").alias("of"), "tilt", "scale")
    rate = F.when(F.col("size") > 0, F.least(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(2.0))), F.lit(float(MOST)))).otherwise(0.0)
    number = F.pmod(F.xxhash64(F.lit("mixing"), "tie", "n"), F.lit(1 << 52)) / float(1 << 52)
    return (
        sized.join(F.broadcast(s) if _small(sources) else s, sized.source.eqNullSafe(s.of))
        .withColumn("rate", rate)
        .withColumn("whole", F.floor(F.col("rate")))
        .withColumn("more", (F.col("size") > 0) & (F.col("whole") < MOST))
        .withColumn("key", number - (F.col("rate") - F.col("whole")))
        .select("doc_id", "row", "source", "size", "n", "rate", "whole", "more", "key", *keep)
    )


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """doc_id, row, source, size, rate, source_size, target, copies for every row of docs.

    row: a column of numbers that tell the rows apart; without one, rows are numbered.
    """
    rated, plan = mixed(docs, doc_id, text, source, row)
    return _copied(rated, plan)


def _copied(rated: DataFrame, plan: DataFrame, *keep: str) -> DataFrame:
    p = plan.select(F.col("source").alias("of"), "source_size", "target", "cut")
    joined = rated.join(F.broadcast(p) if _small(plan) else p, rated.source.eqNullSafe(p.of))
    extra = (F.col("more") & (F.col("key") < F.col("cut"))).cast("long")
    return joined.select("doc_id", "row", "source", "size", "rate", "source_size", "target", (F.col("whole") + extra).alias("copies"), *keep)


def planned(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """As copies(), with the whole row of docs as the struct doc.

    What a row draws follows from the row itself, but for the later ones of a tie, which are joined to their numbers: texts of the others are not shuffled.
    """
    rated, plan = mixed(docs, doc_id, text, source, row)
    later = materialize(rated.where("n > 1").select("row", "n"), "mix-later")
    discard(rated)
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(row).cast("long").alias("row"), F.col(source).alias("source"), token_size(text).alias("size"), F.xxhash64(doc_id, text).alias("tie"))
    first = F.lit(1).cast("long")
    told = sieve(own, "row", later).join(later, "row", "left").withColumn("n", F.coalesce("n", first))
    every = sieve(own, "row", later, "left_anti").withColumn("n", first).unionByName(told)
    return _copied(_rated(every, plan, "doc"), plan, "doc")


def op3(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
