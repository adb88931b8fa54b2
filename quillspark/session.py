"""Session settings that every entry point shares."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "quillspark", cpus: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the session that is there."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_settled: list[tuple[SparkSession, str]] = []


def settled(df: DataFrame, codec: str | None = None) -> DataFrame:
    """df written once to the folder of spark.checkpoint.dir and read back, so that it is not computed again and lost executors
    don't undo it. Deleted when the driver ends.

    Only on one machine, where the setting is absent as in tests, a temporary folder is made. codec: of the files, if not the session's.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_settled_dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = context._settled_dir = tempfile.mkdtemp(prefix="quillspark-")
    path = f"{at.rstrip('/')}/settled-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _settled:
        if spark.sparkContext._jsc is not None:  # a stopped session leaves its folder to whoever owns it
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
