"""What the operators of this subpackage share: shared scratch tables and small text helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one encoded chunk or Arrow slice holds at most, unless one text alone is longer.
CHUNK_BYTES = 8 << 20

#: Keys that may be joined by broadcast.
HOT = 1024

#: Bits of a bitmap of hashes, 8 MB.
BITS = 1 << 26

_written: list[tuple[SparkSession, str]] = []
#: Tables written so far within finished().
_meanwhile: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_meanwhile", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset (tests, one machine) a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = getattr(spark.sparkContext, "_quillspark_dir", None)
        if not at:
            at = spark.sparkContext._quillspark_dir = tempfile.mkdtemp(prefix="quillspark-")
    return at.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df into the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    if (meanwhile := _meanwhile.get()) is not None:
        meanwhile.append((spark, path))
    return spark.read.parquet(path)


def finished(build: Callable[[], DataFrame], label: str) -> DataFrame:
    """The table that build() returns, written; all that was written for it meanwhile is deleted."""
    outer, tables = _meanwhile.get(), []
    token = _meanwhile.set(tables)
    try:
        df = build()
        _meanwhile.set(outer)
        return materialize(df, label)
    finally:
        _meanwhile.reset(token)
        for spark, path in tables:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later result reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended before: the folder is the cluster's to clear
            return


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row in a column; written, so that the numbers stay when tasks run again."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the tables has, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_by_size(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose column n has how many rows the key has.

    Keys of at least 1 / HOT of all rows, of which there are at most HOT, are joined by broadcast, the others by a shuffle.
    """
    table = materialize(table, "by-size")
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) >= max(1.0, total / HOT)
    often = F.broadcast(table.where(hot))
    rare = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(often, key).unionByName(rare.join(table.where(~hot), key))


def sieve(df: DataFrame, key: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be in wanted: those that are, and few others; by left_anti those that surely aren't. A bitmap of hashes is broadcast, of BITS at most."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bits = wanted.select(at.alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, place % 8) == 1
    return df.join(F.broadcast(bits), (F.bitmap_bucket_number(at) == F.col("_b")) & is_set, how)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in gone. Only keys are shuffled, and the few rows that a bitmap of hashes can't tell from those in gone."""
    gone = gone.select(key)
    spared = materialize(sieve(rows.select(key), key, gone).join(gone, key, "left_anti"), "spared")
    return sieve(rows, key, gone, "left_anti").unionByName(sieve(rows, key, spared).join(spared, key, "left_semi").select(*rows.columns))


def crc_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")).cast("binary")) % n


def crc_text(value: object) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def raw_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(arrays: list[pa.Array], sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about limit."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def column_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column, as an aggregate."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()[0]


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished phases: Spark drops them once the driver's handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
