"""Archive of event records: file lists, zipped tab-separated files, link rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text, times, url
from quillspark.sources.news import with_source

N_COLUMNS, MOST_FILES, MOST_STORIES = 27, 96, 20


def file_list(spark: SparkSession, path: str, start: Column, end: Column) -> DataFrame:
    """size, md5, url, at of the files inside the window, each once, the newest MOST_FILES."""
    parts = F.split(F.col("value"), " +")
    rows = spark.read.text(path).where(F.size(parts) == 3).select(parts[0].cast("long").alias("size"), parts[1].alias("md5"), parts[2].alias("url"))
    stamped = rows.withColumn("at", times.compact_time(F.regexp_extract("url", r"/([0-9]{14})\.gkg", 1))).where(F.col("at").between(start, end))
    return stamped.dropDuplicates(["url"]).orderBy(F.desc("at")).limit(MOST_FILES)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                while some := f.readlines(4 << 20):
                    decoded = []
                    for raw in some:
                        try:
                            decoded.append(raw.decode("utf-8").rstrip("\n"))
                        except UnicodeDecodeError:
                            decoded.append(raw.decode("latin-1").rstrip("\n"))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(decoded)), pa.array(decoded)], names=["path", "line"])


def zip_lines(spark: SparkSession, path: str, checksums: DataFrame | None = None) -> DataFrame:
    """path, line of the files' first entries; with checksums(name, md5) only files that fit theirs."""
    files = spark.read.format("binaryFile").load(path)
    if checksums is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("got", F.md5("content")).join(checksums, "name").where("got = md5")
    return files.select("path", "content").mapInArrow(_lines, "path string, line string")


def rows(lines: DataFrame, column: str = "line") -> DataFrame:
    """record_id, observed_at, domain, url, title, image_url of web records with a title."""
    f = F.split(F.col(column), "\t", -1)
    parsed = lines.where(F.size(f) == N_COLUMNS).where(f[2] == "1")
    title = F.regexp_extract(f[26], "<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    out = parsed.select(f[0].alias("record_id"), times.compact_time(f[1]).alias("observed_at"), f[3].alias("domain"), f[4].alias("url"), text.decode_title(title).alias("title"), url.image_url(f[18]).alias("image_url"))
    return out.where(F.col("observed_at").isNotNull() & (F.col("title") != ""))


def links(records: DataFrame, registry: DataFrame) -> DataFrame:
    found = with_source(records, registry, "url", "gdelt:")
    return found.where(~F.col("is_excluded") & F.col("host").isNotNull()).withColumn("normalized_url", url.normalize_url(F.col("url"))).drop("is_excluded")


def story_links(found: DataFrame, stories: DataFrame) -> DataFrame:
    """story, url, first observation of links whose title has all terms of a story inside its window.

    stories: story, terms, start, end. The story's first word is an equi-join with the title's words; terms and window are checked after it.
    """
    keyed = stories.withColumn("word", F.split(F.col("terms")[0], " ")[0])
    words = found.withColumn("matched", text.normalize_for_match(F.col("title"))).withColumn("word", F.explode(F.array_distinct(F.split(F.trim("matched"), " "))))
    hits = words.join(keyed, "word").where(F.col("observed_at").between(F.col("start"), F.col("end")) & F.forall("terms", lambda t: F.contains("matched", F.concat(F.lit(" "), t, F.lit(" ")))))
    return hits.groupBy("story", "normalized_url").agg(F.min("observed_at").alias("observed_at"), F.min_by("title", F.struct("observed_at", "record_id")).alias("title"))
