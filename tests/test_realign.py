"""Kept runs of a shortest edit script against plain tables."""

import random
import time

import pytest

from quillspark.operators.realign import kept_runs, realigned


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "a😀é"])
def test_runs_keep_a_longest_subsequence(letters):
    r = random.Random(letters)
    for _ in range(150):
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(24))) for _ in range(2))
        runs = kept_runs(a, b)
        assert all(a[x : x + n] == b[y : y + n] and n > 0 for x, y, n in runs)
        assert all(x + n <= x2 and y + n <= y2 for (x, y, n), (x2, y2, _) in zip(runs, runs[1:]))
        assert sum(n for *_, n in runs) == longest(a, b)


@pytest.mark.parametrize("vocabulary", [40, 90, 300])
def test_spans_between_two_edits_stay(vocabulary):
    """Repeated words in the middle, one edit near each end."""
    r = random.Random(vocabulary)
    words = [f"w{r.randrange(vocabulary)}" for _ in range(400)]
    after = [*words[:3], "new", *words[3:396], "other", *words[397:]]
    before, text = " ".join(words), " ".join(after)
    at = 0
    for i, w in enumerate(words):
        if 5 <= i < 394:
            start = before.index(w, at)
            found = realigned(before, text, start, start + len(w))
            assert found == (start + 4, start + 4 + len(w))
        at += len(w) + 1


def test_more_edits_than_allowed_leave_the_ends():
    a, b = "head" + "x" * 30 + "tail", "head" + "y" * 30 + "tail"
    assert kept_runs(a, b) == [(0, 0, 4), (34, 34, 4)] == kept_runs(a, b, most=59)
    c = "head" + "x" * 10 + "-" + "x" * 10 + "tail"
    assert sum(n for *_, n in kept_runs(c, c.replace("-", "+++"), most=4)) == 28
    assert kept_runs("ab-cd-ef", "ab+cd+ef", most=3) == [(0, 0, 2), (6, 6, 2)]
    assert kept_runs("", "") == kept_runs("", "a") == kept_runs("a", "b") == []


def test_unlike_long_texts_end_in_time():
    r = random.Random(3)
    a, b = ("".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60_000)) for _ in range(2))
    start = time.monotonic()
    assert sum(n for *_, n in kept_runs("s" + a, "s" + b)) < 20
    assert time.monotonic() - start < 20


def test_texts_of_a_batch_are_not_held_together():
    import tracemalloc

    import pyarrow as pa

    from quillspark.operators import realign

    n, size = 400, 20_000
    texts = pa.array([f"{i:06d}" + "x" * size for i in range(n)])
    after = pa.array([f"{i:06d}" + "y" + "x" * size for i in range(n)])
    tracemalloc.start()
    spans = realign._each(texts, after, pa.array([10] * n), pa.array([20] * n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == n and spans.null_count == 0 and peak < n * size / 4
