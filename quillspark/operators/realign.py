"""Spans of one version of a text placed in the next one.

What both versions keep is found by a shortest edit script over code points: common ends first, then the middle by the farthest
reach of each diagonal, all diagonals of a number of edits at once. Beyond MOST_EDITS edits the middle counts as changed. A
span moves only if one kept run holds all of it. Null in any place gives null; empty texts keep nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edits of the middle at most (a fixed value).
MOST_EDITS = 2000

_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: Places that all diagonals run on together before those left run on by blocks.
_TOGETHER = 8


def _points(text: str, end: int) -> np.ndarray:
    """Code points and a mark of the end, which is no code point."""
    return np.append(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.uint32(end))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, by growing blocks."""
    most, at, block = min(len(a), len(b)), 0, 32
    while at < most:
        differ = np.flatnonzero(a[at : min(at + block, most)] != b[at : min(at + block, most)])
        if len(differ):
            return at + int(differ[0])
        at, block = at + block, block * 4
    return most


def _reaches(a: np.ndarray, b: np.ndarray, most: int) -> list[np.ndarray] | None:
    """By number of edits, how far each diagonal (-edits, -edits + 2, .. edits) gets in a; None if more edits are needed.

    a, b: with their end marks, which equal nothing.
    """
    n, m = len(a) - 1, len(b) - 1
    found: list[np.ndarray] = []
    for edits in range(min(most, n + m) + 1):
        k = np.arange(-edits, edits + 1, 2)
        if edits:
            before = found[-1]
            inserted, deleted = np.append(before, -1), np.insert(before + 1, 0, -1)
            x = np.where(deleted > inserted, deleted, inserted)
        else:
            x = np.zeros(1, np.int64)
        live = np.flatnonzero((x < n) & (x - k < m))
        for _ in range(_TOGETHER):
            live = live[a[x[live]] == b[x[live] - k[live]]]
            if not len(live):
                break
            x[live] += 1
        for i in live.tolist():
            x[i] += _common(a[x[i] :], b[x[i] - k[i] :])
        found.append(x)
        if abs(n - m) <= edits and (n - m + edits) % 2 == 0 and x[(n - m + edits) // 2] >= n:
            return found
    return None


def _middle(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Kept runs of a shortest edit script, in order; none if it has more than so many edits."""
    reaches = _reaches(a, b, most)
    runs: list[tuple[int, int, int]] = []
    x, k = len(a) - 1, len(a) - len(b)
    for edits in range(len(reaches or ()) - 1, 0, -1):
        before, i = reaches[edits - 1], (k + edits) // 2
        insert = i == 0 or i < edits and before[i - 1] < before[i]
        came = int(before[i] if insert else before[i - 1])
        start = came if insert else came + 1
        if x > start:
            runs.append((start, start - k, x - start))
        x, k = came, k + 1 if insert else k - 1
    if reaches and x:
        runs.append((0, 0, x))
    return runs[::-1]


def kept_runs(before: str, after: str, most: int = MOST_EDITS) -> list[tuple[int, int, int]]:
    """(start before, start after, length) of what both texts keep, in order."""
    a, b = _points(before, 0xFFFFFFFF), _points(after, 0xFFFFFFFE)
    n, m = len(a) - 1, len(b) - 1
    head = _common(a, b)
    tail = _common(a[head:n][::-1], b[head:m][::-1])
    runs = [(0, 0, head)] if head else []
    if head + tail < min(n, m):
        middle = [np.append(x[head : size - tail], x[-1:]) for x, size in ((a, n), (b, m))]
        runs += [(x + head, y + head, size) for x, y, size in _middle(*middle, most)]
    return [*runs, (n - tail, m - tail, tail)] if tail else runs


def realigned(before: str, after: str, start: int, end: int, runs: list[tuple[int, int, int]] | None = None) -> tuple[int, int] | None:
    """The span in the text after, if one kept run holds all of it. runs: those of the texts, if known."""
    for x, y, n in kept_runs(before, after) if runs is None else runs:
        if x <= start and end <= x + n:
            return y + start - x, y + end - x
    return None


def _each(a: pa.Array, b: pa.Array, s: pa.Array, e: pa.Array) -> pa.Array:
    """realigned() of every row. Texts are taken out of Arrow one pair at a time: a batch has thousands of them."""
    found, last, runs = [], None, []
    for x, y, i, j in zip(a, b, s, e, strict=True):
        x, y, i, j = x.as_py(), y.as_py(), i.as_py(), j.as_py()
        if None in (x, y, i, j):
            found.append(None)
            continue
        if (x, y) != last:  # spans of one pair of texts mostly follow each other
            last, runs = (x, y), kept_runs(x, y)
        found.append(realigned(x, y, i, j, runs))
    return pa.array([None if f is None else {"start": f[0], "end": f[1]} for f in found], pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def realign(before: Column, after: Column, start: Column, end: Column) -> Column:
    return F.arrow_udf(_each, _SPAN)(before, after, start, end)
