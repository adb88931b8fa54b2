"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Toxic documents go; one document of each near-duplicate class stays; documents with benchmark passages go; personal
data and terms that disclose it are replaced in the text; the rest is mixed by source into copies.

Stages decide by row, not by id: where a stage joins its findings to its documents, rows are numbered first, so that null
and repeated ids and repeated rows lose and gain nothing. Null texts are empty; empty texts are clean of everything and
are taken 0 times by the mix. Texts stay where they are: row numbers are shuffled, and texts only where they change or a bitmap can't tell. Very long texts are treated as wholes. Ties are settled by each operator. Other columns than those of
documents are kept, whatever their names; the mix puts an underscore after its own columns' names where these are taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, mixing, orderminhash, sanitize, toxicity
from quillspark.llm.common import discard, finished, numbered, unused, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half; the model learns from labels outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused("toxicity", docs)
    return docs.withColumn(name, toxicity.toxicity(spark, model, "text")).where(F.col(f"{name}.score") < 0.5).drop(name)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class; documents without words can't be told apart and stay."""
    row = unused("row_number", docs)
    rows = numbered(docs, row)
    gone = orderminhash.near_duplicates(rows, row=row).where("not first and n_words > 0").select(F.col("row").alias(row))
    return without(rows, row, gone).select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    name = unused("hits", docs)
    hits = decontaminate.window_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=name)
    return hits.where(F.col(f"{name}.n_hit") == 0).drop(name)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data generalised to its kind and disclosing terms removed."""
    row, rest = unused("row_number", docs), unused("rest", docs)
    rows = numbered(docs, row)

    def rewritten() -> DataFrame:
        carried = rows.select("doc_id", "text", F.struct(*(c for c in rows.columns if c != "text")).alias(rest))
        found = sanitize.spans_of(carried, key=rest).where(F.size(F.concat("base", "terms")) > 0)
        text = sanitize.sanitized(F.col("text"), F.col("base"), F.col("terms"))
        return found.select(*(text.alias(c) if c == "text" else F.col("key")[c].alias(c) for c in rows.columns))

    changed = finished(rewritten, "pipeline-changed")
    same = without(rows, row, changed).select(*docs.columns)
    return same.unionByName(changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the size, the target of their source and the number of their copies."""
    row = unused("row_number", docs)
    rows = numbered(docs, row)
    plan = mixing.planned(rows, row).where("copies > 0")
    own = {name: unused(name, docs) for name in ("size", "target", "copies")}
    return plan.select(*(F.col("doc")[c].alias(c) for c in docs.columns), *(F.col(k).alias(v) for k, v in own.items()))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
]
#: No stage but decontamination can be put in SQL: the models are trained. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, finished(lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023  called at once
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
