"""Rows for the tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, keys string, row string, score string"


def documents(spark, rows):
    """A table of documents with extra columns whose names clash with those that operators make."""
    full = [(i, t, lang, s, None if t is None else len(t), "x", "x", "x", "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"{r.choice('bcdfgk')}{r.choice('aeiouñé')}{r.choice('lmnrst')}{i}" for i in range(vocabulary)]
    return " ".join(r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(n))
