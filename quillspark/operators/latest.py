"""Latest, first and as-of rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in the order, which must end with a unique column."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: list[str], by: Column, columns: list[str]) -> DataFrame:
    """One row per key with the columns of its greatest `by`: a partial aggregate, no sort."""
    found = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), by).alias("_row"))
    return found.select(*keys, "_row.*")


def ordered_list(items: Column, order: Column, n: int | None = None) -> Column:
    """The items of a group as an array in the order, the first n of them."""
    found = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), items.alias("x")))), lambda p: p["x"])
    return F.slice(found, 1, n) if n else found


def card(df: DataFrame, key: str, order: str, text: str, origin: str, n: int = 3) -> DataFrame:
    """Per key its latest row, its first n texts in order, and the number of distinct origins."""
    newest = latest(df, [key], F.col(order), [order, text]).withColumnsRenamed({order: "latest_order", text: "latest_text"})
    first = first_per(df, [key], [F.col(order)], n).groupBy(key).agg(ordered_list(F.col(text), F.col(order)).alias("first_texts"))
    counts = df.groupBy(key).agg(F.countDistinct(origin).alias("n_origins"), F.count("*").alias("n_rows"))
    return newest.join(first, key).join(counts, key)


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the key's right row at or before its time (null: none).

    Both sides become one stream per key and time; a last value over it needs one shuffle and no range join.
    """
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_row"))
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_row"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, *(F.col(f"_row.{c}").alias(c) for c in columns))


def last_status(history: DataFrame, current: DataFrame, key: str, order: Column, status: str, value: str) -> DataFrame:
    """Keys not in current whose last status is value: conflicts that are still open."""
    last = history.groupBy(key).agg(F.max_by(status, order).alias(status))
    return last.where(F.col(status) == value).join(current.select(key).distinct(), key, "left_anti")
