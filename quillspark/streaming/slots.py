"""Slots and version chains as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.functions import times


def read_events(spark: SparkSession, path: str, name: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", True).parquet(path)


def slot_counts(events: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events per slot; what comes up to an hour late still counts."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", "12 hours", "12 hours", "8 hours")).agg(F.count("*").alias("n")).select(times.slot_key(F.col("window.start")).alias("slot"), "n")


def once(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the overlap of two readings."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_slots(events: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, batch by batch: step takes the batch and its number, by which its writes are made idempotent."""
    return events.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start()


def append_batch(df: DataFrame, batch: int, path: str) -> None:
    """A batch in a folder of its own number: a batch that runs again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


class VersionChain(StatefulProcessor):
    """New versions of articles: rows whose hash is not the last one of their key, whatever batch that came in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for part in rows:
            part = part.sort_values(["observed_s", "hash"])
            before = part.hash.shift()
            before.iloc[0] = last
            last = part.hash.iloc[-1]
            yield part[part.hash != before][["id", "hash", "observed_s"]]
        self.last.update((last,))

    def close(self) -> None: ...


def new_versions(articles: DataFrame) -> DataFrame:
    """id, hash, observed_s of new versions in a stream of (id, hash, observed_s)."""
    return articles.groupBy("id").transformWithStateInPandas(statefulProcessor=VersionChain(), outputStructType="id string, hash string, observed_s long", outputMode="append", timeMode="none")
