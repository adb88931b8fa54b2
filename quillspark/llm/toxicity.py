"""Toxicity by multiple-instance learning: noisy-or over sentences.

A sentence's score is logistic in the weights of its words and word beginnings; a document is toxic
unless none of its sentences is: P = 1 - prod(1 - p_s). The weights, none negative and most zero,
are fitted by proximal Adagrad on the
documents' labels alone, so the blame is put on the sentences, and those can be located afterwards.

Fitting takes at most ``sample`` labelled rows outside the held-out fifth, those with the least
hash of their id and text (all, where there are fewer). Their texts are cut into feature numbers
by the executors; the driver sees at most ``sample`` documents. Weights are broadcast: at most
FEATURES of them. Scoring is one narrow pass over whole texts.

Null and empty texts have no sentence and get the score of one sentence without words. A document
id with several label rows is toxic if one says so; null labels are none. Without labels of both
kinds the score is the share of toxic ones (0 where there are none). Repeated rows score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, raw_texts

FOLDS = 5
SAMPLE = 8_000
BITS = 20
FEATURES = 1 << BITS
BEGINNING = 4
EPOCHS = 100
#: Documents whose gradients are worked out at once: what bounds the driver's memory beside the sample itself.
BATCH = 250
#: Features of fewer sampled documents get no weight.
LEAST_DOCS = 3
RATE, DECAY, START = 0.5, 0.05, -5.0
MEMO_WORDS = 200_000

_ENDS = b".!?\n\r"
_TABLE = bytes(
    0x0A if c in _ENDS else c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def sentences_of(raw: bytes) -> list[list[bytes]]:
    """Lower-cased words of the sentences, which end at . ! ? or a line end; those without words are left out."""
    return [words for line in raw.translate(_TABLE).split(b"\n") if (words := line.split())]


def features_of(word: bytes) -> tuple[int, int]:
    """The numbers of a word and of its beginning (by characters)."""
    start = word.decode("utf-8", "ignore")[:BEGINNING].encode()
    return zlib.crc32(word) & (FEATURES - 1), zlib.crc32(b"^" + start) & (FEATURES - 1)


class _Memo(dict):
    """Values by word, made when missing."""

    def __init__(self, make) -> None:  # noqa: ANN001
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):  # noqa: ANN204
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per labelled document: feature numbers of its sentences, and where each sentence ends."""
    memo = _Memo(features_of)
    for batch in batches:
        toxic, numbers, ends = batch.column("toxic"), [], []
        for raw in raw_texts(batch.column("text")):
            own, at = [], []
            for words in sentences_of(raw):
                own.extend(f for w in dict.fromkeys(words) for f in memo[w])
                at.append(len(own))
            numbers.append(np.array(own, np.int32).tobytes())
            ends.append(np.array(at, np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([toxic.cast(pa.int32()), batch.column("h"), pa.array(numbers, pa.binary()), pa.array(ends, pa.binary())], names=["toxic", "h", "numbers", "ends"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights by feature number, and the bias."""
    one = labels.where(F.col(label).isNotNull() & (crc_mod(doc_id, FOLDS) != 0)).groupBy(F.col(doc_id).alias("of")).agg(F.max(label).cast("int").alias("toxic"))
    there = docs.select(F.col(doc_id).alias("of")).distinct()
    chosen = one.join(there, "of", "left_semi").orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = docs.select(F.col(doc_id).alias("of"), F.col(text).alias("text")).join(F.broadcast(chosen), "of")  # at most sample ids
    encoded = rows.select("toxic", "text", F.xxhash64("of", "text").alias("h")).mapInArrow(_encode, "toxic int, h long, numbers binary, ends binary")
    got = encoded.orderBy("h").limit(sample).collect()
    return _train([(r.toxic, np.frombuffer(r.numbers, np.int32), np.frombuffer(r.ends, np.int32)) for r in got])


def _packed(rows: list[tuple[int, np.ndarray, np.ndarray]], place: np.ndarray) -> tuple[np.ndarray, ...]:
    """A batch of documents: labels, places of features, the sentence of each, first sentences of documents, document of each sentence."""
    lengths = np.concatenate([np.diff(r[2], prepend=0) for r in rows])
    columns = place[np.concatenate([r[1] for r in rows])]
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    per_doc = np.array([len(r[2]) for r in rows])
    first = np.concatenate(([0], np.cumsum(per_doc)[:-1]))
    kept = columns >= 0
    return np.array([r[0] for r in rows]), columns[kept], sentence[kept], first, np.repeat(np.arange(len(rows), dtype=np.int32), per_doc)


def _train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    weights = np.zeros(FEATURES, np.float32)
    rows = [r for r in rows if len(r[2])]
    positive = sum(r[0] for r in rows)
    if not rows or positive in (0, len(rows)):
        share = min(max(positive / max(len(rows), 1), 1e-6), 1 - 1e-6)
        return weights, float(np.log(share / (1 - share))) if rows else -14.0
    documents = np.zeros(FEATURES, np.int32)
    for _, numbers, _ in rows:
        documents[np.unique(numbers)] += 1
    seen = np.flatnonzero(documents >= LEAST_DOCS)
    place = np.full(FEATURES, -1, np.int32)
    place[seen] = np.arange(len(seen))
    batches = [_packed(rows[i : i + BATCH], place) for i in range(0, len(rows), BATCH)]
    w, past, bias, bias_past = np.zeros(len(seen)), np.full(len(seen), 1e-8), START, 1e-8
    scale = 100 / len(rows)
    for _ in range(EPOCHS):
        grad, g = np.full(len(seen), -DECAY), 0.0
        for y, columns, sentence, first, doc in batches:
            z = np.clip(np.bincount(sentence, w[columns], len(doc)) + bias, -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.add.reduceat(np.log1p(-p), first)
            some = np.maximum(-np.expm1(none), 1e-12)
            # d log P(label) / dz: for toxic ones p * (1 - P) / P, for others -p
            pull = np.where(y == 1, np.exp(none) / some, -1.0)[doc] * p * scale
            grad += np.bincount(columns, pull[sentence], len(seen))
            g += pull.sum()
        past += grad**2
        w = np.maximum(w + RATE * grad / np.sqrt(past), 0.0)
        bias_past += g * g
        bias += RATE * g / np.sqrt(bias_past)
    weights[seen] = w
    return weights, float(bias)


def _scorer(shared):  # noqa: ANN001, ANN202
    memo: dict[str, _Memo] = {}
    arrow = [pa.field("score", pa.float64()), pa.field("worst", pa.int32()), pa.field("worst_score", pa.float64())]

    @F.arrow_udf("struct<score:double,worst:int,worst_score:double>")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = shared.value
        value = memo.setdefault("w", _Memo(lambda w: sum(float(weights[f]) for f in features_of(w)))).__getitem__
        alone = 1 / (1 + np.exp(-bias))
        scores, worst, high = [], [], []
        for raw in raw_texts(texts):
            sentences = sentences_of(raw)
            if not sentences:
                scores.append(alone)
                worst.append(None)
                high.append(None)
                continue
            z = np.array([sum(map(value, dict.fromkeys(s))) for s in sentences]) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            scores.append(float(-np.expm1(np.log1p(-p).sum())))
            worst.append(int(z.argmax()))
            high.append(float(p.max()))
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((scores, worst, high), arrow, strict=True)], fields=arrow)

    return score


def toxicity(spark: SparkSession, model: tuple[np.ndarray, float], text: str | Column) -> Column:
    """A struct of score, the number of the worst sentence (from 0, among those with words; null: none) and its score."""
    return _scorer(spark.sparkContext.broadcast(model))(text)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    scored = docs.select("doc_id", "text").withColumn("t", toxicity(spark, model, "text"))
    return scored.select("doc_id", (crc_mod("doc_id", FOLDS) == 0).alias("held_out"), "t.score", (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.worst").alias("worst_sentence"))
