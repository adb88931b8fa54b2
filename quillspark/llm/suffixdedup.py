"""Exact removal of repeated byte strings by ranks of strings at growing lengths.

Every byte covered by a string of LENGTH bytes that also starts elsewhere is removed. Equal strings get
equal ranks (hashes), and Spark groups positions by rank at growing lengths, dropping what is unique:

1. SEED bytes. Each LENGTH-byte string is ranked by its least SEED-byte string (leftmost of equals), which equal
   strings have at the same place. Neighbouring strings that share it form one run, so a run, not a
   byte, is a row. Runs whose seed is unique in the corpus are dropped.
2. Whole runs. Runs that are equal byte by byte are repeats; of each kind one stays as a partner.
3. Cells of up to GRID neighbouring strings of what is left, at the same offsets from the seed: cells equal
   in all their bytes are repeats; cells that don't share the bytes common to their strings are dropped.
4. LENGTH bytes: the single strings of the cells that are left.

Ranks are 64-bit hashes, always together with the seed's own, so 128 bits in all. Every grouping is a partial aggregate
and joins leave skew to the adaptive plan; no group is gathered.

Null and empty texts, and texts shorter than LENGTH, lose nothing. Strings never cross texts. Rows with
equal id and text repeat each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, raw_texts, release, slices

LENGTH, SEED, GRID = 200, 24, 8
_POSITION_BITS = 24
_PIECE = 1 << 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _rank(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def seed_ranks(raw: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes from each position on."""
    n = len(raw) - SEED + 1
    wide = raw.astype(np.uint64)
    eight = wide[: len(raw) - 7].copy()
    for i in range(1, 8):
        eight |= wide[i : len(raw) - 7 + i] << np.uint64(8 * i)
    h = np.zeros(n, np.uint64)
    for i in range(0, SEED, 8):
        h = _mix(h + eight[i : i + n])
    return h


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours, from running minima within blocks."""
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(raw: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(start, count, seed position, seed rank) of the runs of LENGTH-byte strings with one seed."""
    every = np.frombuffer(raw, np.uint8)
    for low in range(0, max(0, len(raw) - LENGTH + 1), _PIECE):  # so that positions fit in _POSITION_BITS
        part = every[low : low + _PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        ranks = seed_ranks(part)
        mask = np.uint64((1 << _POSITION_BITS) - 1)
        at = (_least((ranks & ~mask) | np.arange(len(ranks), dtype=np.uint64), LENGTH - SEED + 1) & mask).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.diff(np.append(starts, len(at)))
        seeds = at[starts]
        yield from zip((starts + low).tolist(), counts.tolist(), (seeds + low).tolist(), ranks[seeds].view(np.int64).tolist(), strict=True)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, docs, rows = raw_texts(batch.column("text")), batch.column("doc_id"), batch.column("row")
        for a, b in slices([], [len(t) for t in texts], 1 << 20):
            own, seed, kind, start, count, offset = [], [], [], [], [], []
            for i in range(a, b):
                raw = texts[i]
                for s, n, at, rank in runs_of(raw):
                    own.append(i)
                    seed.append(rank)
                    kind.append(_rank(raw[s : s + n + LENGTH - 1]))
                    start.append(s)
                    count.append(n)
                    offset.append(at - s)
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(kind, pa.int64()), docs.take(take), rows.take(take), pa.array(start, pa.int32()), pa.array(count, pa.int16()), pa.array(offset, pa.int16())], names=["seed", "kind", "doc_id", "row", "start", "n", "off"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs listed for each text."""
    names = ["seed", "single", "doc_id", "row", "start", "n", "off", "bytes"]
    for batch in batches:
        texts, wanted = raw_texts(batch.column("text")), batch.column("wanted").to_pylist()
        docs, rows = batch.column("doc_id"), batch.column("row")
        out, own = [], []
        for i, (raw, list_) in enumerate(zip(texts, wanted, strict=True)):
            for w in list_:
                own.append(i)
                out.append((w["seed"], w["single"], w["start"], w["n"], w["off"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]))
        take = pa.array(own, pa.int64())
        seed, single, start, n, off, cut = zip(*out, strict=True) if out else ([], [], [], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int64()), pa.array(single, pa.bool_()), docs.take(take), rows.take(take), pa.array(start, pa.int32()), pa.array(n, pa.int16()), pa.array(off, pa.int16()), pa.array(cut, pa.binary())], names=names)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell of a run: the rank of all its bytes, and of the bytes that a full cell's strings have in common."""
    for batch in batches:
        d = batch.to_pydict()
        rows: dict[str, list] = {k: [] for k in ("own", "whole", "common", "at", "count")}
        for i, (start, n, off, raw) in enumerate(zip(d["start"], d["n"], d["off"], d["bytes"], strict=True)):
            # a string that starts x bytes before the seed is in cell x // GRID
            for cell in range((off - n + 1) // GRID, off // GRID + 1):
                x1, x0 = min(off, cell * GRID + GRID - 1), max(off - n + 1, cell * GRID)
                label = b"%d,%d,%d:" % (cell, x0, x1)
                first = off - x1
                rows["own"].append(i)
                rows["whole"].append(_rank(label, raw[first : off - x0 + LENGTH]))
                rows["common"].append(_rank(b"%d:" % cell, raw[off - cell * GRID : off - cell * GRID - GRID + 1 + LENGTH]))
                rows["at"].append(start + first)
                rows["count"].append(x1 - x0 + 1)
        take = pa.array(rows["own"], pa.int64())
        kept = [batch.column(k).take(take) for k in ("seed", "single", "doc_id", "row", "start")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(rows["whole"], pa.int64()), pa.array(rows["common"], pa.int64()), pa.array(rows["at"], pa.int32()), pa.array(rows["count"], pa.int16())], names=["seed", "single", "doc_id", "row", "start", "whole", "common", "at", "count"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single strings of the cells listed for each run."""
    for batch in batches:
        d = batch.to_pydict()
        own, rank, at, single = [], [], [], []
        for i, (start, off, raw, cells) in enumerate(zip(d["start"], d["off"], d["bytes"], d["cells"], strict=True)):
            for c in cells:
                for p in range(c["at"], c["at"] + c["count"]):
                    own.append(i)
                    rank.append(_rank(b"%d:" % (start + off - p), raw[p - start : p - start + LENGTH]))
                    at.append(p)
                    single.append(c["single"])
        take = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in ("seed", "doc_id", "row")), pa.array(rank, pa.int64()), pa.array(at, pa.int32()), pa.array(single, pa.bool_())], names=["seed", "doc_id", "row", "rank", "at", "single"])


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.row == b.row)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row, start, n: n neighbouring strings of LENGTH bytes from start on occur elsewhere. docs: doc_id, row, text."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = materialize(docs.where(F.octet_length("text") >= LENGTH).mapInArrow(_runs, f"seed long, kind long, doc_id {kind}, row long, start int, n short, off short"), "suffix-runs")
    seeds = runs.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed")
    shared = materialize(runs.join(seeds, "seed", "left_semi"), "suffix-shared")
    discard(runs)
    release(spark)

    kinds = materialize(shared.groupBy("seed", "kind").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "row", "start", "n", "off")).alias("one")), "suffix-kinds")
    whole = materialize(shared.join(kinds.where("c > 1").select("seed", "kind"), ["seed", "kind"], "left_semi").select("doc_id", "row", "start", "n"), "suffix-whole")
    discard(shared)
    open_ = kinds.groupBy("seed").agg(F.count("*").alias("parts"), F.min("c").alias("least")).where("parts > 1 and least = 1").select("seed")
    left = kinds.join(open_, "seed", "left_semi").select("seed", (F.col("c") == 1).alias("single"), "one.*")
    wanted = left.groupBy("doc_id", "row").agg(F.collect_list(F.struct("seed", "single", "start", "n", "off")).alias("wanted"))  # at most the runs of one text
    with_text = docs.join(wanted.withColumnsRenamed({"doc_id": "wdoc", "row": "wrow"}), F.col("wdoc").eqNullSafe(F.col("doc_id")) & (F.col("wrow") == F.col("row"))).select("doc_id", "row", "text", "wanted")
    cut = materialize(with_text.mapInArrow(_cut_out, f"seed long, single boolean, doc_id {kind}, row long, start int, n short, off short, bytes binary"), "suffix-cut")
    release(spark)

    cells = materialize(cut.mapInArrow(_cells, f"seed long, single boolean, doc_id {kind}, row long, start int, whole long, common long, at int, count short"), "suffix-cells")
    wholes = materialize(cells.groupBy("seed", "whole").agg(F.count("*").alias("c"), F.min("common").alias("common"), F.min(F.struct("doc_id", "row", "start", "at", "count", "single")).alias("one")), "suffix-wholes")
    same = cells.where("single").join(wholes.where("c > 1").select("seed", "whole"), ["seed", "whole"], "left_semi").select("doc_id", "row", F.col("at").alias("start"), F.col("count").alias("n"))
    same = materialize(same, "suffix-same")
    discard(cells)
    edge = wholes.groupBy("seed", "common").agg(F.count("*").alias("parts"), F.min(F.when(F.col("one.single"), F.col("c")).otherwise(2)).alias("least")).where("parts > 1 and least = 1").select("seed", "common")
    last = wholes.join(edge, ["seed", "common"], "left_semi").select("seed", "one.doc_id", "one.row", "one.start", F.struct("one.at", "one.count", ((F.col("c") == 1) & F.col("one.single")).alias("single")).alias("cell"))
    last = last.groupBy("seed", "doc_id", "row", "start").agg(F.collect_list("cell").alias("cells"))
    last = last.withColumnsRenamed({"seed": "s", "doc_id": "d", "row": "r", "start": "f"})
    at_run = (F.col("s") == F.col("seed")) & F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")) & (F.col("f") == F.col("start"))
    listed = cut.join(last, at_run).select("seed", "doc_id", "row", "start", "off", "bytes", "cells")
    strings = materialize(listed.mapInArrow(_strings, f"seed long, doc_id {kind}, row long, rank long, at int, single boolean"), "suffix-strings")
    ranks = strings.groupBy("seed", "rank").agg(F.count("*").alias("c")).where("c > 1").select("seed", "rank")
    single = strings.where("single").join(ranks, ["seed", "rank"], "left_semi").select("doc_id", "row", F.col("at").alias("start"), F.lit(1).cast("short").alias("n"))
    single = materialize(single, "suffix-single")
    for done in (cut, wholes, strings, kinds):
        discard(done)
    release(spark)
    return whole.unionByName(same).unionByName(single)


def _keep(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Bytes, removed bytes, removed runs and the rest of each text."""
    out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
    for raw, list_ in zip(raw_texts(texts), spans.to_pylist(), strict=True):
        kept, last, removed, n = [], 0, 0, 0
        low = high = -1
        for a, b in [*sorted((s["start"], s["start"] + s["n"] - 1 + LENGTH) for s in list_ or ()), (len(raw) + 1, -1)]:
            if a <= high:
                high = max(high, b)
                continue
            if high > 0:
                kept.append(raw[last:low])
                removed, n, last = removed + high - low, n + 1, high
            low, high = a, b
        out["n_bytes"].append(len(raw))
        out["n_removed"].append(removed)
        out["n_spans"].append(n)
        out["kept"].append(b"".join([*kept, raw[last:]]))
    return pa.StructArray.from_arrays([pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()], names=list(out))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs."""
    keep = F.arrow_udf(_keep, "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    spans = repeated_spans(rows).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))  # at most the strings of one text
    spans = spans.withColumnsRenamed({"doc_id": "d", "row": "r"})
    joined = rows.join(spans, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("r") == F.col("row")), "left")
    return joined.select("doc_id", keep("text", "spans").alias("k")).select("doc_id", "k.n_bytes", "k.n_removed", "k.n_spans", "k.kept")


def op9(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
