"""Assigning articles to stories by vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vector import cosine

# Least similarity to the centroid and to the representative, least lead over the next story, hours of activity.
CENTROID, REPRESENTATIVE, LEAD, ACTIVE_HOURS = 0.80, 0.75, 0.03, 72


def is_active(last_report: Column, now: Column, hours: int = ACTIVE_HOURS) -> Column:
    """Whether the last report is 0 to 72 hours old; neither without one nor with one that lies ahead."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_report.cast("timestamp"))
    return F.coalesce(age.between(0, hours * 3_600_000_000), F.lit(False))


#: Rows of a chunk of queries and of a block of items, at least and (of large tables) at most, and similarities that a task holds at once.
ASKED, ITEMS, MOST, CELLS = 4096, 8192, 16384, 1 << 20
#: Chunks or blocks above which they grow up to MOST rows, since every row goes to as many cells.
MANY = 12
#: Parts of a line of similarities whose maxima bound the k-th greatest.
PARTS = 256
#: What sums in another order may differ by at most.
SLACK = 1e-9


def _grid(asked: DataFrame, items: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides, with equal `on` columns, dealt to cells of about ASKED by ITEMS rows (of large tables up to MOST by MOST) and grouped by
    cell: each pair of rows is in one.

    A cell is of bounded size; a chunk of queries goes to every block of items, and a block to every chunk.
    """
    count = lambda df, n, name: df.groupBy(*on).agg((1 + F.floor(F.count("*") / F.greatest(F.lit(n), F.least(F.lit(MOST), F.count("*") / MANY)))).alias(name))
    many, most = count(asked, ASKED, "_chunks"), count(items, ITEMS, "_blocks")
    sizes = many.join(most, on) if on else many.crossJoin(most)  # one row each
    cells = int(sizes.agg(F.sum(F.col("_chunks") * F.col("_blocks"))).first()[0] or 1)
    meet = lambda df: df.join(F.broadcast(sizes), on) if on else df.crossJoin(F.broadcast(sizes))
    deal, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    left = meet(asked).withColumn("_chunk", deal("_chunks")).withColumn("_block", every("_blocks"))
    right = meet(items).withColumn("_block", deal("_blocks")).withColumn("_chunk", every("_chunks"))
    keys = [*on, "_chunk", "_block"]
    sides = (x.drop("_chunks", "_blocks") for x in (left, right))
    return tuple(x.toDF(*x.columns).repartition(min(cells, 4096), *keys).groupBy(*keys) for x in sides)  # toDF: both sides may be one table


class _Vectors:
    """Rows of doubles and their lengths. A null vector, or one with a null in it, is all zeros, since cosine() is 0 for it."""

    def __init__(self, table: pa.Table) -> None:
        lists = pa.concat_arrays(table.column("vector").chunks) if table.num_rows else pa.array([], table.schema.field("vector").type)
        sizes = pc.unique(pc.list_value_length(lists).drop_null()).to_pylist()
        if len(sizes) > 1:
            raise ValueError("vectors of different size")
        self.width = sizes[0] if sizes else None
        flat = pc.list_flatten(lists)
        values = flat.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, self.width or 1)
        if flat.null_count:
            values = np.where(flat.is_null().to_numpy(zero_copy_only=False).reshape(values.shape).any(1, keepdims=True), 0.0, values)
        self.v = np.zeros((len(lists), self.width or 1))
        if self.width:
            self.v[lists.is_valid().to_numpy(zero_copy_only=False)] = values
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_sums(self.v, self.v))
            self.unit = np.where(self.norm[:, None] == 0, 0.0, self.v / self.norm[:, None])


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of a and b, added from the first element on, as cosine() adds them."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _similar(a: _Vectors, b: _Vectors, i: np.ndarray, j: np.ndarray, decimals: int) -> np.ndarray:
    """Rounded cosine() of the pairs (i, j): the same doubles, rounded half up by their digits as Spark does."""
    out = np.zeros(len(i))
    for low in range(0, len(i), CELLS // 16):
        at = slice(low, low + CELLS // 16)
        of = a.norm[i[at]] * b.norm[j[at]]
        with np.errstate(all="ignore"):
            out[at] = np.where(of == 0, 0.0, _sums(a.v[i[at]], b.v[j[at]]) / of)
    scaled = out * 10.0**decimals
    rounded = np.rint(scaled) / 10.0**decimals + 0.0
    for n in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        rounded[n] = float(Decimal(repr(float(out[n]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)) + 0.0
    return rounded


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers of the values, in their order and the same for all columns."""
    place = {x: n for n, x in enumerate(sorted({x for c in columns for x in c.to_pylist()}))}
    return [np.array([place[x] for x in c.to_pylist()], np.int64) for c in columns]


def _close(left: pa.Table, right: pa.Table) -> Iterator[tuple[_Vectors, _Vectors, int, np.ndarray]]:
    """Similarities, but for the order of their sums, of some rows of the left side after others, with all of the right side."""
    a, b = _Vectors(left), _Vectors(right)
    if left.num_rows and right.num_rows:
        if None not in (a.width, b.width) and a.width != b.width:
            raise ValueError("vectors of different size")
        step = max(1, CELLS // right.num_rows)
        for low in range(0, left.num_rows, step):
            with np.errstate(all="ignore"):
                yield a, b, low, a.unit[low : low + step] @ b.unit.T if a.width == b.width else np.zeros((len(a.v[low : low + step]), len(b.v)))


def _leading(close: np.ndarray, k: int, decimals: int) -> np.ndarray:
    """What can be among the k most similar of each line once rounded. NaN comes first, -inf is no pair."""
    kth = np.partition(close, close.shape[1] - k, axis=1)[:, -k, None] if close.shape[1] > k else -np.inf
    return (close > -np.inf) & (close >= kth - 10.0**-decimals - SLACK) | np.isnan(close)


def _near(left: pa.Table, right: pa.Table, q: np.ndarray, v: np.ndarray, k: int, decimals: int) -> Iterator[tuple]:
    """(a, b, i, j): pairs of lines of both sides that can be among the k most similar of line i; q and v: numbers of the ids.

    Similarities of single precision, whose error is bounded, are held against the k-th greatest of the maxima of parts of a line, which
    the k-th greatest similarity is not below. Short lines and vectors that are not finite go through _leading().
    """
    a, b = _Vectors(left), _Vectors(right)
    order = np.argsort(v, kind="stable")
    first, last = (np.searchsorted(v[order], q, side) for side in ("left", "right"))
    quick = a.width and a.width == b.width and right.num_rows >= 4 * PARTS > 4 * k and np.isfinite(a.unit).all() and np.isfinite(b.unit).all()
    if not quick:
        for a, b, low, close in _close(left, right):
            close[q[low : low + len(close), None] == v] = -np.inf
            i, j = np.nonzero(_leading(close, k, decimals))
            yield a, b, i + low, j
        return
    one, two = a.unit.astype(np.float32), np.ascontiguousarray(b.unit.astype(np.float32).T)
    slack = np.float32(10.0**-decimals + (a.width + 8) * 2.0**-22)
    deep, step = right.num_rows // PARTS, max(1, CELLS // right.num_rows)
    for low in range(0, len(one), step):
        close = one[low : low + step] @ two
        for i in np.flatnonzero(last[low : low + step] > first[low : low + step]):
            close[i, order[first[low + i] : last[low + i]]] = -np.inf
        greatest = close[:, : deep * PARTS].reshape(len(close), deep, PARTS).max(axis=1)
        i, j = np.nonzero(close >= np.maximum(np.partition(greatest, PARTS - k, axis=1)[:, PARTS - k, None] - slack, np.finfo(np.float32).min))
        yield a, b, i + low, j


def knn(queries: DataFrame, items: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """query, item, similarity, rank: the k nearest items of a stated set of queries(query, vector) among items(item, vector).

    Every query meets every item, cell by cell of a grid, by products of matrices; what may lead is summed again in cosine()'s own
    order. A cell keeps its k best of each query, so that what is ranked at the end is queries * blocks * k rows.
    """
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query"), (items, "item"))]

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = _codes(left.column("id"), right.column("id"))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b, i, j in _near(left, right, q, v, k, decimals):
            score = _similar(a, b, i, j, decimals)
            order = np.lexsort((v[j], -np.nan_to_num(score, nan=np.inf), i))
            order = order[np.arange(len(i)) - np.searchsorted(i, i[order]) < k]
            found.append((i[order], j[order], score[order]))
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": left.column("id").take(pa.array(i)), "item": right.column("id").take(pa.array(j)), "similarity": pa.array(score)})

    asked, others = (df.select(F.col(c).alias("id"), "vector").where("id is not null") for df, c in ((queries, "query"), (items, "item")))
    left, right = _grid(asked, others, [])
    best = left.cogroup(right).applyInArrow(near, f"query {kinds[0]}, item {kinds[1]}, similarity double")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))).where(F.col("rank") <= k)


def decide(candidates: DataFrame, centroid: float = CENTROID, representative: float = REPRESENTATIVE, lead: float = LEAD) -> DataFrame:
    """article, story (null: a new one), reason from candidates(article, story, centroid_similarity, representative_similarity, active)."""
    w = Window.partitionBy("article").orderBy(F.desc("centroid_similarity"), "story")
    ranked = candidates.where("active").withColumn("next_best", F.lead("centroid_similarity").over(w)).withColumn("rank", F.row_number().over(w)).where("rank = 1")
    joined = candidates.select("article").distinct().join(ranked, "article", "left")
    reason = (
        F.when(F.col("story").isNull(), "no_candidate")
        .when(F.col("centroid_similarity") < centroid, "centroid_far")
        .when(F.col("representative_similarity") < representative, "representative_far")
        .when(F.col("centroid_similarity") - F.coalesce("next_best", F.lit(-2.0)) < lead, "no_lead")
        .otherwise("assigned")
    )
    return joined.select("article", F.when(reason == "assigned", F.col("story")).alias("story"), reason.alias("reason"))


def hard_negatives(items: DataFrame, n: int = 30, least: float = 0.0, stated: Column | None = None) -> DataFrame:
    """a, b, similarity: the n nearest pairs of one topic from different groups, from items(item, topic, grp, vector).

    stated: a condition on a.* that names the items asked about; without it every item is. All pairs of a topic are met, cell by cell
    as in knn(), and a cell keeps its n best.
    """
    kind, once = items.schema["item"].dataType.simpleString(), stated is not None

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, y), (g, h) = _codes(left.column("id"), right.column("id")), _codes(left.column("grp"), right.column("grp"))
        also = right.column("stated").to_numpy()  # a pair of stated items is met from both sides, and counts once
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for a, b, low, close in _close(left, right):
            one, of = x[low : low + len(close), None], g[low : low + len(close), None]
            close[(of == h) | (one == y) | also & (one > y)] = -np.inf
            line, take = close.reshape(1, -1), n
            while True:
                at = np.nonzero(_leading(line, take, 6)[0])[0]
                i, j = at // len(y) + low, at % len(y)
                i, j, score = (np.concatenate(z) for z in zip(best, (i, j, _similar(a, b, i, j, 6)), strict=True))
                low_id, high_id = np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
                order = np.lexsort((high_id, low_id, -np.nan_to_num(score, nan=np.inf)))
                if once:  # repeated rows
                    key = np.stack((score, low_id, high_id), 1)[order]
                    order = order[np.append(True, (key[1:] != key[:-1]).any(1))[: len(order)]]
                if len(order) >= n or take >= line.shape[1]:
                    break
                take *= 4
            order = order[:n]
            best = i[order], j[order], score[order]
        one, two = left.column("id").take(pa.array(best[0])), right.column("id").take(pa.array(best[1]))
        swap = pa.array(x[best[0]] > y[best[1]], pa.bool_())
        return pa.table({"a": pc.if_else(swap, two, one), "b": pc.if_else(swap, one, two), "similarity": pa.array(best[2])})

    rows = items.select("item", "topic", "grp", "vector").where("item is not null and topic is not null and grp is not null").alias("a")
    rows = rows.withColumn("stated", F.lit(True) if stated is None else F.coalesce(stated, F.lit(False))).withColumnRenamed("item", "id")
    left, right = _grid(rows.where("stated"), rows, ["topic"])
    found = left.cogroup(right).applyInArrow(near, f"a {kind}, b {kind}, similarity double")
    found = found if stated is None else found.distinct()
    return found.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "a", "b").limit(n)


def search(query: Column, stories: DataFrame, claims: DataFrame, each: int = 200, most: int = 10) -> DataFrame:
    """story, score and the ids of its three nearest claims: hits of titles and claims together, the best of each story."""
    title = stories.select("story", F.round(cosine(F.col("vector"), query), 6).alias("score")).orderBy(F.desc("score"), "story").limit(each)
    hits = claims.select("story", "claim", F.round(cosine(F.col("vector"), query), 6).alias("score"))
    near = hits.orderBy(F.desc("score"), "claim").limit(each)
    best = title.select("story", "score").unionByName(near.select("story", "score")).groupBy("story").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "story").limit(most)
    top = hits.join(F.broadcast(best.select("story")), "story").withColumn("r", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("score"), "claim"))).where("r <= 3")
    listed = top.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "claim"))), lambda x: x["claim"]).alias("claims"))
    return best.join(listed, "story", "left")
