"""LM scoring by Brown's class-based bigrams.

P(text) = product over tokens of P(class | class before) * P(word | class), where the token before
the first is the end token. Classes come from exchange clustering: words move, round by round, to
the class that gains most in the likelihood of the class bigrams.

Every training word is clustered. A first clustering gives the start: words of a share of at least HEAD of all
training tokens (at most 1 / HEAD of them, however large the corpus) one by one, the others by their ending in TAILS groups.
Then every word, whatever its count, moves by itself: chunks of documents count the classes beside their words,
buckets of words add these counts up and find each word's best class, and the classes go back to the chunks. One
in TURNS of the buckets moves in a round, since neighbours that move at once disturb each other less. Rounds end when
those of all buckets add less than LEAST to what neighbouring classes tell of each other, after MOVES at the latest; the best classes are kept.
The driver sees the counts of class pairs only.

Smoothing: transitions are drawn to the class frequencies; words are discounted by
n1 / (n1 + 2 n2), and what is taken is given to unseen words, which join the class that most words found once with the
same ending have; all is mixed with the unigram base so that no token is impossible.

Documents are cut once into chunks of about CHUNK bytes of text with a dictionary each; words are
shuffled per chunk and bucket rather than per token, and scores are computed per chunk.

A null text is empty: one token, its end. A null id counts as the empty text when rows are dealt to
training. Repeated rows count as often as they occur. Without training tokens all words are
unknown and get the base score. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import crc_text, discard, materialize, raw_texts, release, slices

FOLDS = 10
HEAD = 1 / 2048
TAILS = 512
CLASSES = 64
ROUNDS = 8
CHUNK = 32 << 20
#: Rounds in which every word moves by itself, shares of the words that take turns, and the least gain of all turns, by what the classes tell.
MOVES, TURNS, LEAST = 6, 2, 0.01
#: Codes of what stands beside a word: the class before, CLASSES and the class after, or the word itself.
SELF = 2 * CLASSES
CODES = SELF + 1
#: Pull of transitions to the class frequencies, share of the base in the mixture.
PULL, MIX = 50.0, 0.02
END = b""


def ending(word: bytes) -> int:
    """The group of a rare word."""
    return zlib.crc32(word[-3:]) % TAILS


def tokens_of(raw: bytes) -> list[bytes]:
    words = raw.lower().split()
    words.append(END)
    return words


def _pack(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), kind)


class _Chunk:
    """Documents of one chunk with their dictionary."""

    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.words: dict[bytes, int] = {END: 0}
        self.docs: list = []
        self.ids: list[np.ndarray] = []

    def add(self, doc: object, raw: bytes) -> None:
        words = self.words
        self.ids.append(np.fromiter((words.setdefault(w, len(words)) for w in tokens_of(raw)), np.uint32))
        self.docs.append(doc)
        self.size += len(raw)

    def batches(self, doc_type: pa.DataType, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row of documents and a row for each bucket of words; words are numbered by bucket, from its start on."""
        words = list(self.words)
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(words), np.uint32)
        number[order] = np.arange(len(words))
        sizes, ids = np.array([len(x) for x in self.ids]), number[np.concatenate(self.ids)]
        held = np.array([crc_text(x) % FOLDS == 0 for x in self.docs])
        counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(words))
        found, starts = np.unique(bucket[order], return_index=True)
        ends = [*starts[1:], len(words)]
        listed = pa.ListArray.from_arrays(pa.array([*starts, len(words)], pa.int32()), pa.array([words[i] for i in order], pa.binary()))
        each = {
            "bucket": pa.array(found, pa.int32()),
            "start": pa.array(starts, pa.int32()),
            "words": listed,
            "n": pa.array([_pack(counts[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
            "total": pa.array([counts[a:b].sum() for a, b in zip(starts, ends, strict=True)], pa.int64()),
        }
        docs = {"docs": pa.array([self.docs], pa.list_(doc_type)), "held": pa.array([held.tolist()], pa.list_(pa.bool_())), "sizes": pa.array([_pack(sizes)], pa.binary()), "ids": pa.array([_pack(ids)], pa.binary())}
        for columns, rows in ((docs, 1), (each, len(found))):
            given = [columns[k] if k in columns else pa.nulls(rows, other[k].type) for other in (docs, each) for k in other]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, self.number), pa.int64()), *given], names=["chunk", *docs, *each])


def _encode(buckets: int):  # noqa: ANN202
    """Rows of documents (numbers of their tokens in the chunk's dictionary) and rows of dictionaries."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        chunk, doc_type = _Chunk(base), pa.int64()
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for doc, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                chunk.add(doc, raw)
                if chunk.size >= CHUNK:
                    yield from chunk.batches(doc_type, buckets)
                    chunk = _Chunk(chunk.number + 1)
        if chunk.docs:
            yield from chunk.batches(doc_type, buckets)

    return encode


PLACES = "bucket int, chunk long, start int, at binary, c binary, ending binary, types long, n1 long, n2 long, heads array<struct<word:binary,c:long,at:int>>, tails array<struct<ending:int,c:long>>"


def _number(least: float):  # noqa: ANN202
    """Words of a bucket: their places in it, counts and endings, by chunk; and a row of sums, with words that occur least times."""

    def number(key, rows):  # noqa: ANN001, ANN202
        coded = pa.concat_arrays([x.flatten() for x in rows.column("words").chunks]).dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        n = np.concatenate([_unpack(x, np.int64) for x in rows.column("n").to_pylist()])
        c = np.bincount(at, n, len(words)).astype(np.int64)
        end = np.fromiter((ending(w) for w in words), np.int16, len(words))
        ends = np.cumsum([len(x) for x in rows.column("words").to_pylist()]).tolist()
        out = [
            {"bucket": bucket, "chunk": chunk, "start": start, "at": _pack(at[a:b].astype(np.int32)), "c": _pack(c[at[a:b]]), "ending": _pack(end[at[a:b]])}
            for bucket, chunk, start, a, b in zip(*(rows.column(k).to_pylist() for k in ("bucket", "chunk", "start")), [0, *ends], ends, strict=False)
        ]
        often = np.flatnonzero(c >= least)
        tails = np.bincount(end, np.where(c >= least, 0, c), TAILS)
        out.append({"bucket": out[0]["bucket"], "types": int((c > 0).sum()), "n1": int((c == 1).sum()), "n2": int((c == 2).sum()), "heads": [{"word": words[i], "c": int(c[i]), "at": int(i)} for i in often], "tails": [{"ending": int(e), "c": int(tails[e])} for e in np.flatnonzero(tails)]})
        kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "start": pa.int32(), "at": pa.binary(), "c": pa.binary(), "ending": pa.binary(), "types": pa.int64(), "n1": pa.int64(), "n2": pa.int64()}
        kinds |= {"heads": pa.list_(pa.struct({"word": pa.binary(), "c": pa.int64(), "at": pa.int32()})), "tails": pa.list_(pa.struct({"ending": pa.int32(), "c": pa.int64()}))}
        return pa.Table.from_pylist(out, pa.schema(list(kinds.items())))

    return number


def _pairs(shared):  # noqa: ANN001, ANN202
    """Counts of neighbouring items in the training documents of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        width = len(head) + TAILS
        found = np.zeros(width * width, np.int64)
        memo: dict[bytes, int] = {}

        def item(word: bytes) -> int:
            if len(memo) > 500_000:
                memo.clear()
            memo[word] = at = head[word] if word in head else len(head) + ending(word)
            return at

        for batch in batches:
            kept, texts = [crc_text(x) % FOLDS != 0 for x in batch.column("doc_id").to_pylist()], raw_texts(batch.column("text"))
            texts = [t for t, k in zip(texts, kept, strict=True) if k]
            for a, b in slices([], [len(t) for t in texts]):
                line: list[int] = [item(END)]
                for raw in texts[a:b]:
                    line.extend(memo[w] if w in memo else item(w) for w in tokens_of(raw))
                ids = np.array(line, np.int64)
                codes, n = np.unique(ids[:-1] * width + ids[1:], return_counts=True)
                found[codes] += n
        codes = np.flatnonzero(found)
        for a in range(0, len(codes), 200_000):
            some = codes[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(some // width, pa.int32()), pa.array(some % width, pa.int32()), pa.array(found[some], pa.int64())], names=["a", "b", "n"])

    return count


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What the classes add to the log likelihood: sum n log n of class pairs, less that of their margins."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def _moves(table: np.ndarray):  # noqa: ANN202
    """For the items of a group: the class that gains most. l, r: pairs with classes before and after, same: with itself."""

    def best(key, rows):  # noqa: ANN001, ANN202
        k = len(table)
        d = rows.to_pydict()
        own: dict[int, list] = {}
        for item, of, side, c, n, same in zip(d["item"], d["of"], d["side"], d["c"], d["n"], d["same"], strict=True):
            got = own.setdefault(item, [of, np.zeros(k), np.zeros(k), 0.0])
            got[1 + side][c] += n
            got[3] = max(got[3], same or 0)
        items, to, gains = [], [], []
        for item, (of, before, after, same) in sorted(own.items()):
            rest = table.astype(float)
            l, r = before.copy(), after.copy()
            l[of] -= same
            r[of] -= same
            rest[:, of] -= l
            rest[of, :] -= r
            rest[of, of] -= same
            rest = np.maximum(rest, 0)
            columns, lines = rest.sum(0), rest.sum(1)
            gain = (_xlogx(rest + l[:, None]) - _xlogx(rest)).sum(0) + (_xlogx(rest + r[None, :]) - _xlogx(rest)).sum(1)
            cell = np.diag(rest)
            gain += _xlogx(cell + l + r + same) - _xlogx(cell + l) - _xlogx(cell + r) + _xlogx(cell)
            # what joins a class adds to its margin; the other classes' margins are the same for every choice but for pairs with itself
            gain -= _xlogx(columns + l.sum() + r + same) - _xlogx(columns + r)
            gain -= _xlogx(lines + r.sum() + l + same) - _xlogx(lines + l)
            choice = int(gain.argmax())
            items.append(item)
            to.append(choice)
            gains.append(float(gain[choice] - gain[of]))
        return pa.table({"item": pa.array(items, pa.int32()), "c": pa.array(to, pa.int32()), "gain": pa.array(gains, pa.float64())})

    return best


def cluster(pairs: DataFrame, totals: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The class of every item, and the counts of class pairs. totals: the items' training tokens."""
    spark = pairs.sparkSession
    classes = max(1, min(classes, len(totals)))
    rank = np.argsort(-totals, kind="stable")
    of = np.empty(len(totals), int)
    of[rank] = np.arange(len(totals)) % classes

    def table_of(assigned: np.ndarray) -> tuple[np.ndarray, DataFrame]:
        class_of = F.broadcast(spark.createDataFrame([(i, int(c)) for i, c in enumerate(assigned)], "i int, c int"))  # one row per item
        joined = pairs.join(class_of.toDF("a", "ca"), "a").join(class_of.toDF("b", "cb"), "b")
        table = np.zeros((classes, classes))
        for r in joined.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect():
            table[r.ca, r.cb] = r.n
        return table, joined

    table, joined = table_of(of)
    best = (likelihood(table), of.copy(), table)
    for i in range(rounds):
        same = F.max(F.when(F.col("a") == F.col("b"), F.col("n")))
        before = joined.groupBy(F.col("b").alias("item"), F.col("cb").alias("of"), F.lit(0).alias("side"), F.col("ca").alias("c")).agg(F.sum("n").alias("n"), same.alias("same"))
        after = joined.groupBy(F.col("a").alias("item"), F.col("ca").alias("of"), F.lit(1).alias("side"), F.col("cb").alias("c")).agg(F.sum("n").alias("n"), same.alias("same"))
        turn = F.pmod(F.xxhash64("item"), F.lit(3)) == i % 3  # neighbours that move at once disturb each other less
        found = before.unionByName(after).where(turn).groupBy(F.col("item") % 64).applyInArrow(_moves(table), "item int, c int, gain double").where("gain > 0").collect()
        if not found:
            if i >= 2:
                break
            continue
        of = of.copy()
        for r in found:
            of[r.item] = r.c
        table, joined = table_of(of)
        if (now := likelihood(table)) > best[0]:
            best = (now, of.copy(), table)
    return best[1], best[2]


def gains(table: np.ndarray, own: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By word and class: what it adds to the likelihood to put the word there, once it is taken out of its own class.

    table: counts of class pairs with all words in their own classes; word (ascending), code, n: what stands beside the words.
    """
    k, every = len(table), np.arange(len(own))
    beside = np.zeros((len(own), CODES))
    beside[word, code] = n
    before, after, same = beside[:, :k], beside[:, CLASSES : CLASSES + k], beside[:, SELF]
    out = np.zeros((len(own), k))
    for side, cells, others in ((0, table, after), (1, table.T, before)):
        some = (code // CLASSES == side) & (code != SELF)
        w, c, m = word[some], code[some] - side * CLASSES, n[some].astype(float)
        if not len(w):
            continue
        rest, each = cells[c].astype(float), np.arange(len(w))
        inner = np.flatnonzero(own[w] == c)
        rest[inner] -= others[w[inner]]
        rest[each, own[w]] -= m
        rest = np.maximum(rest, 0)
        value = _xlogx(rest + m[:, None]) - _xlogx(rest)
        value[each, c] = 0  # pairs within a class: below
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        out[w[starts]] += np.add.reduceat(value, starts)
    inside = np.tile(np.diag(table).astype(float), (len(own), 1))
    both = before + after + same[:, None]
    inside[every, own] -= both[every, own]
    inside = np.maximum(inside, 0)
    out += _xlogx(inside + both) - _xlogx(inside)
    for axis, part in ((0, before), (1, after)):
        margin, m = np.tile(table.sum(axis).astype(float), (len(own), 1)), part.sum(1) + same
        margin[every, own] -= m
        margin = np.maximum(margin, 0)
        out -= _xlogx(margin + m[:, None]) - _xlogx(margin)
    return out


def _start(shared):  # noqa: ANN001, ANN202
    """Words get the class of their own in the first clustering or that of their ending."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, heads = shared.value
        for batch in batches:
            found = []
            for bucket, at, end in zip(*(batch.column(k).to_pylist() for k in ("bucket", "at", "ending")), strict=True):
                places, cls = _unpack(at, np.int32), tails[_unpack(end, np.int16)]
                for place, c in heads.get(bucket, ()):
                    cls[places == place] = c
                found.append(_pack(cls))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("bucket", "chunk", "start", "at")), pa.array(found, pa.binary())], names=["bucket", "chunk", "start", "at", "cls"])

    return start


def _joined(words: pa.Table, column: str, kind: type) -> np.ndarray:
    """A column for all words of a chunk, by their number."""
    parts = sorted(zip(words.column("start").to_pylist(), words.column(column).to_pylist(), strict=True))
    return np.concatenate([_unpack(x, kind) for _, x in parts])


def _count(classes: int, turn: int | None):  # noqa: ANN202
    """What stands beside a chunk's words in buckets whose turn it is, and the chunk's pairs of classes."""

    def count(key, docs, words):  # noqa: ANN001, ANN202
        cls = _joined(words, "cls", np.uint8).astype(np.int64)
        ids, sizes, held = _unpack(docs.column("ids")[0].as_py(), np.uint32), _unpack(docs.column("sizes")[0].as_py(), np.int64), np.array(docs.column("held")[0].as_py())
        line = np.concatenate((ids[-1:], ids[np.repeat(~held, sizes)])).astype(np.int64)  # every document ends with the end
        own = cls[line]
        pairs = np.bincount(own[:-1] * classes + own[1:], minlength=classes * classes)
        numbers = docs.column("chunk")[0].as_py()
        out = [{"chunk": numbers, "pairs": pairs.tolist()}]
        mine = sorted((start, bucket) for start, bucket in zip(words.column("start").to_pylist(), words.column("bucket").to_pylist(), strict=True))
        active = np.zeros(len(cls), bool)
        ends = [*(start for start, _ in mine[1:]), len(cls)]
        ranges = [(bucket, start, end) for (start, bucket), end in zip(mine, ends, strict=True) if turn is not None and bucket % TURNS == turn]
        for _, start, end in ranges:
            active[start:end] = True
        a, b = line[:-1], line[1:]
        alike = a == b
        left, right = active[b], active[a] & ~alike
        keys = np.concatenate(((b * CODES + np.where(alike, SELF, own[:-1]))[left], (a * CODES + CLASSES + own[1:])[right]))
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.diff(first, append=len(keys))
        word, code = np.divmod(keys[first], CODES)
        for bucket, start, end in ranges:
            low, high = np.searchsorted(word, (start, end))
            out.append({"bucket": bucket, "chunk": numbers, "sizes": _pack(np.bincount(word[low:high] - start, minlength=end - start).astype(np.uint16)), "codes": _pack(code[low:high].astype(np.uint8)), "n": _pack(n[low:high].astype(np.uint32))})
        return pa.Table.from_pylist(out, pa.schema({"bucket": pa.int32(), "chunk": pa.int64(), "sizes": pa.binary(), "codes": pa.binary(), "n": pa.binary(), "pairs": pa.list_(pa.int64())}))

    return count


def _move(shared):  # noqa: ANN001, ANN202
    """The words of a bucket in the classes where they gain most.

    Words are looked at one small slice after another, and the counts of class pairs follow the moves. Buckets are drawn by
    hash, so the others that move now do what this one does: its moves count as often as there are such buckets, save those
    of a share of at least HEAD, which stand for themselves only. Without that all words would run to one class.
    """

    def move(key, counts, state):  # noqa: ANN001, ANN202
        table, alike = shared.value
        heavy = table.sum() * HEAD
        at = {chunk: _unpack(x, np.int32) for chunk, x in zip(state.column("chunk").to_pylist(), state.column("at").to_pylist(), strict=True)}
        own = np.zeros(max(int(x.max()) for x in at.values()) + 1, np.int64)
        for places, cls in zip(at.values(), state.column("cls").to_pylist(), strict=True):
            own[places] = _unpack(cls, np.uint8)
        keys, n = [], []
        for chunk, sizes, codes, of in zip(*(counts.column(k).to_pylist() for k in ("chunk", "sizes", "codes", "n")), strict=True):
            keys.append(np.repeat(at[chunk].astype(np.int64), _unpack(sizes, np.uint16)) * CODES + _unpack(codes, np.uint8))
            n.append(_unpack(of, np.uint32))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else n
        word, code = np.divmod(keys[first], CODES)
        sizes = np.bincount(word, minlength=len(own))
        new, ends, seen = own.copy(), np.cumsum(sizes), table.copy()
        for a, b in slices([], (sizes + 1).tolist(), min(len(keys) // 64, 1 << 14)):
            low, high = ends[a] - sizes[a], ends[b - 1]
            w, of, m, was, every = word[low:high] - a, code[low:high], n[low:high], own[a:b], np.arange(b - a)
            gain = gains(seen, was, w, of, m)
            choice = gain.argmax(1)
            better = (gain[every, choice] > gain[every, was] + 1e-9) & (sizes[a:b] > 0)
            new[a:b] = np.where(better, choice, was)
            beside = np.zeros((b - a, CODES))
            beside[w, of] = m
            beside *= np.where(beside[:, :CLASSES].sum(1) < heavy, alike, 1)[:, None]
            to = np.zeros((b - a, len(table)))
            to[every[better], choice[better]] += 1
            to[every[better], was[better]] -= 1
            change = beside[:, :CLASSES].T @ to
            change += to.T @ beside[:, CLASSES:SELF]
            seen = np.maximum(seen + change, 0)
        new = new.astype(np.uint8)
        kept = [state.column(k) for k in ("bucket", "chunk", "start", "at")]
        return pa.table([*kept, pa.array([_pack(new[x]) for x in at.values()], pa.binary())], names=["bucket", "chunk", "start", "at", "cls"])

    return move


def exchange(docs: DataFrame, state: DataFrame, classes: int) -> tuple[DataFrame, np.ndarray]:
    """The classes of all words after rounds of moves, and the counts of class pairs."""
    spark = docs.sparkSession
    best, likes, i = (None, None, -np.inf), [], 0
    while True:
        counts = docs.groupBy("chunk").cogroup(state.select("bucket", "chunk", "start", "cls").groupBy("chunk")).applyInArrow(_count(classes, i % TURNS if i < MOVES else None), "bucket int, chunk long, sizes binary, codes binary, n binary, pairs array<long>")
        counts = materialize(counts, "brown-counts")
        table = np.zeros(classes * classes)
        for r in counts.where("pairs is not null").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            table[r["at"]] = r.n
        table = table.reshape(classes, classes)
        likes.append(likelihood(table))
        if likes[-1] > best[2]:
            if best[0] is not None:
                discard(best[0])
            best = (state, table, likes[-1])
        settled = i >= TURNS and likes[-1] - likes[-1 - TURNS] < LEAST * (likes[-1] + float(_xlogx(table.sum())))
        if i >= MOVES or settled or not table.any():
            discard(counts)
            return best[0], best[1]
        turn = F.col("bucket") % TURNS == i % TURNS
        moving = state.where(turn).select("bucket").distinct().count()
        moved = counts.where("bucket is not null").groupBy("bucket").cogroup(state.where(turn).groupBy("bucket"))
        moved = moved.applyInArrow(_move(spark.sparkContext.broadcast((table, moving))), "bucket int, chunk long, start int, at binary, cls binary")
        state = materialize(state.where(~turn).unionByName(moved), "brown-classes")
        discard(counts)
        release(spark)
        i += 1


def _kinds(key, words):  # noqa: ANN001, ANN202
    """Training words of a bucket by ending and class: how many, and how many found once."""
    at, c, end, cls = (np.concatenate([_unpack(x, t) for x in words.column(k).to_pylist()]) for k, t in (("at", np.int32), ("c", np.int64), ("ending", np.int16), ("cls", np.uint8)))
    first = np.unique(at, return_index=True)[1]
    first = first[c[first] > 0]
    code = end[first].astype(np.int64) * CLASSES + cls[first]
    types, ones = np.bincount(code, minlength=TAILS * CLASSES), np.bincount(code[c[first] == 1], minlength=TAILS * CLASSES)
    some = np.flatnonzero(types)
    return pa.table({"ending": pa.array(some // CLASSES, pa.int32()), "cls": pa.array(some % CLASSES, pa.int32()), "types": pa.array(types[some], pa.int64()), "ones": pa.array(ones[some], pa.int64())})


def _score(shared):  # noqa: ANN001, ANN202
    def score(key, docs, words):  # noqa: ANN001, ANN202
        m = shared.value
        count, end = _joined(words, "c", np.int64), _joined(words, "ending", np.int16)
        cls = np.where(count > 0, _joined(words, "cls", np.uint8), m["unseen"][end])
        base = (count + 0.1) / (m["tokens"] + 0.1 * (m["types"] + 1))
        emit = np.where(count > 0, count - m["discount"][cls], m["rest"][end]) / m["class_tokens"][cls]
        log_base = np.log10(base)
        ids, sizes = _unpack(docs.column("ids")[0].as_py(), np.uint32), _unpack(docs.column("sizes")[0].as_py(), np.int64)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for own_ids in np.split(ids, np.cumsum(sizes)[:-1]):
            own = cls[own_ids]
            p = (1 - MIX) * m["transition"][np.concatenate((own[-1:], own[:-1])), own] * emit[own_ids] + MIX * base[own_ids]
            out["n_tokens"].append(len(own_ids))
            out["n_known"].append(int((count[own_ids] > 0).sum()))
            out["base_score"].append(float(log_base[own_ids].sum()))
            out["score"].append(float(np.log10(p).sum()))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        given = [pa.concat_arrays([x.flatten() for x in docs.column(k).chunks]) for k in ("docs", "held")]
        return pa.table([*given, *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], names=["doc_id", "held_out", *out])

    return score


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = 2 * TURNS * max(2, docs.rdd.getNumPartitions())  # a bucket's words grow no further than a task's texts
    encoded = materialize(docs.mapInArrow(_encode(buckets), f"chunk long, docs array<{kind}>, held array<boolean>, sizes binary, ids binary, bucket int, start int, words array<binary>, n binary, total long"), "brown-chunks")
    tokens = encoded.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    words = encoded.where("bucket is not null").select("bucket", "chunk", "start", "words", "n")
    words = materialize(words.groupBy("bucket").applyInArrow(_number(max(2.0, tokens * HEAD)), PLACES), "brown-words")
    sums, places = words.where("chunk is null"), words.where("chunk is not null").select("bucket", "chunk", "start", "at", "c", "ending")
    types, n1, n2 = sums.agg(*(F.coalesce(F.sum(k), F.lit(0)) for k in ("types", "n1", "n2"))).first()
    head = sums.select("bucket", F.explode("heads").alias("h")).select("bucket", "h.*").orderBy(F.desc("c"), "word").collect()  # at most 1 / HEAD rows
    heads = {bytes(r.word): i for i, r in enumerate(head)}
    totals = np.zeros(len(heads) + TAILS)
    totals[: len(heads)] = [r.c for r in head]
    for r in sums.select(F.explode("tails").alias("t")).groupBy("t.ending").agg(F.sum("t.c").alias("c")).collect():
        totals[len(heads) + r.ending] = r.c

    pairs = docs.mapInArrow(_pairs(spark.sparkContext.broadcast(heads)), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs, "brown-pairs")
    of, _ = cluster(pairs, totals)
    discard(pairs)
    first: dict[int, list] = {}
    for i, r in enumerate(head):
        first.setdefault(r.bucket, []).append((r["at"], int(of[i])))
    start = places.mapInArrow(_start(spark.sparkContext.broadcast((of[len(heads) :].astype(np.uint8), first))), "bucket int, chunk long, start int, at binary, cls binary")
    texts = encoded.where("bucket is null").select("chunk", "docs", "held", "sizes", "ids")
    state, table = exchange(texts.select("chunk", "held", "sizes", "ids"), materialize(start, "brown-classes"), CLASSES)

    found = places.join(state.select("bucket", "chunk", "cls"), ["bucket", "chunk"])
    kinds = np.zeros((2, TAILS, CLASSES))
    for r in found.select("bucket", "at", "c", "ending", "cls").groupBy("bucket").applyInArrow(_kinds, "ending int, cls int, types long, ones long").groupBy("ending", "cls").agg(F.sum("types").alias("types"), F.sum("ones").alias("ones")).collect():  # at most TAILS * CLASSES rows
        kinds[:, r.ending, r.cls] = r.types, r.ones
    model = smoothed(table, kinds, of[len(heads) :], n1 / (n1 + 2 * n2) if n1 else 0.5) | {"tokens": tokens, "types": types}
    result = texts.groupBy("chunk").cogroup(found.select("chunk", "start", "c", "ending", "cls").groupBy("chunk")).applyInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    mixed = F.col("score") if tokens else F.col("base_score")
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", mixed.alias("score"))


def smoothed(table: np.ndarray, kinds: np.ndarray, endings: np.ndarray, discount: float) -> dict:
    """What scoring needs. kinds: training words, and those found once, by ending and class; endings: their classes at the start."""
    k = len(table)
    tokens, (types, ones) = table.sum(0), kinds[:, :, :k]
    unseen = np.where(ones.any(1), ones.argmax(1), np.where(types.any(1), types.argmax(1), np.minimum(endings, k - 1)))
    weight = types.sum(1) + 1.0  # the mass that a class has taken from its words goes to its unseen endings by their words
    taken = discount * types.sum(0) * (np.bincount(unseen, minlength=k) > 0)
    rest = taken[unseen] * weight / np.bincount(unseen, weight, k)[unseen]
    share = tokens / max(tokens.sum(), 1)
    return {
        "unseen": unseen,
        "discount": np.where(taken > 0, discount, 0.0),
        "rest": rest,
        "class_tokens": np.maximum(tokens, 1),
        "transition": (table + PULL * share[None, :]) / (table.sum(1, keepdims=True) + PULL) if tokens.any() else np.zeros_like(table),
    }


def op1(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
