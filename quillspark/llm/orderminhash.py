"""Near-duplicates by order MinHash, candidates verified by banded alignment.

A text is the sequence of its lower-cased words; its items are runs of SHINGLE words, each labelled by how often it
occurred before. For each of SAMPLES hash functions the TAKE least labelled items are kept in text
order and hashed to one key, so texts share keys if they share items in the same order. Two texts that share a key are linked if
their words align with at most 1 - SIMILARITY of the longer one's words edited. Classes are the connected components of links.

With J the labelled similarity of the items of two texts, they share no key with (1 - J^2)^72: texts of which 5 % of the words are
replaced have J 0.63, 10 % 0.42, 15 % 0.28 and 20 % 0.20 (6 % of such pairs share none, the most within the declared range).

Texts with the same words are one class from the start and only one of them is compared. Under each key
the leader is the least text by a hashed order. Pairs are compared in turns, each only with texts of other components than its own:

1. every text with the leader it shares most keys with,
2. with all leaders of its keys, and with every text under keys of at most SMALL texts,
3. under larger keys whose texts are still in several components, with every other text.

So all pairs that share a key are compared unless other links have joined them before. Groups of one class collapse in the first two
steps, whose pairs grow in proportion to the texts. What is left of a larger key is dealt to tasks in cells of CELL texts by as many: in a cell a pair is
looked at only if the key is the one that the pair's hash picks of all that both share, by products of matrices first (words in common bound the edits), then aligned by
bits, one text with many at once. This last step grows with the square of a group of texts that share a passage and are not alike. Pairs
that can't be alike by their lengths or by a bitmap of their words are left out beforehand: each word of one text beyond those of
the other is an edit, and so is each bit.

A text of fewer words than SHINGLE is one item; texts of few words are found only if an item survives the edits. Very long texts
are sketched in blocks and aligned like others, by bits of one band. Null and empty texts have no words and form one class. A null id is a
document like others; the representative of a class is its least id, null only where no other is there. Repeated rows of
an id and text are copies of each other. Ties of the hashed order go to the lesser number. An empty table gives an empty result. Other columns
are ignored. Texts are told apart by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import finished, join_by_size, materialize, raw_texts, release, sieve
from quillspark.llm.components import components, extended
from quillspark.llm.decontaminate import words_of

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, TAKE = 72, 2
#: 64-bit parts of a text's bitmap of words.
BAG = 16
#: Texts of a key that are compared pair by pair.
SMALL = 16
#: Texts of a larger key on each side of a cell, about.
CELL = 1000
#: Pairs that one task aligns, and that one task of cells looks at, about.
ALIGN, LOOKED = 1000, 500_000
#: Pairs with one text that stay together, about.
TOGETHER = 100
#: Columns of a product of matrices.
WIDE = 2048
#: Pairs aligned one by one if there are less for each 64 words, or if a text has more words.
FEW, LONG = 8, 1024
#: Items that are hashed at once.
BLOCK = 4096
MEMO_WORDS = 300_000

_MULTIPLIERS = np.array([int.from_bytes(blake2b(b"order-minhash-%d" % i, digest_size=8).digest(), "little") | 1 for i in range(SAMPLES + 3)], np.uint64)
_SEEDS = np.array([int.from_bytes(blake2b(b"order-%d" % i, digest_size=4).digest(), "little") | 1 for i in range(2 * SAMPLES)], np.uint32)
_ROWS = np.arange(SAMPLES)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Numbers(dict):
    """64-bit numbers of words, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def labelled_items(numbers: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of words, each mixed with the count of equal runs before it."""
    n = max(1, len(numbers) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(numbers))):
        out = _mix(out + numbers[i : i + n])
    plain = np.sort(out)
    if not (plain[1:] == plain[:-1]).any():
        return out
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    before = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    label = np.zeros(n, np.uint64)
    label[order] = before
    return np.where(label > 0, _mix(out + label * _MULTIPLIERS[-1]), out)  # a first occurrence is the same item in every text


def sketch(numbers: np.ndarray) -> np.ndarray:
    """One key per hash function, of the TAKE items with the least hashes in text order."""
    items = labelled_items(numbers)
    take = min(TAKE, len(items))
    short = (items >> np.uint64(32)).astype(np.uint32)
    least, places = [], []
    for low in range(0, len(items), BLOCK):
        h = (short[None, low : low + BLOCK] ^ _SEEDS[:SAMPLES, None]) * _SEEDS[SAMPLES:, None]
        for _ in range(min(take, h.shape[1])):
            at = h.argmin(1)
            least.append(h[_ROWS, at])
            places.append(at + low)
            h[_ROWS, at] = np.iinfo(np.uint32).max
    at = np.array(places).T
    if at.shape[1] > take:
        at = np.take_along_axis(at, np.array(least).T.argsort(1, kind="stable")[:, :take], 1)
    picks = items[np.sort(at, 1)]
    keys = _MULTIPLIERS[:SAMPLES].copy()
    for j in range(take):
        keys = _mix(keys * _MULTIPLIERS[-2] + picks[:, j])
    return keys.view(np.int64)


def bag(numbers: np.ndarray) -> np.ndarray:
    """A bitmap of the distinct words."""
    there = np.zeros(64 * BAG, bool)
    there[(numbers % np.uint64(64 * BAG)).astype(np.int64)] = True
    return np.packbits(there).view(np.int64)


def aligns(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences is at most `most`: few edits in a narrow band first, then all of the band."""
    apart = abs(len(a) - len(b))
    if apart > most:
        return False
    few = max(apart + 8, most // 8)
    return 2 * few < most and _in_bits(a, b, few) is not None or _in_bits(a, b, most) is not None


def _in_bits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The fewest edits, at most `most`, of a path within as many diagonals of the first; None if there is no such path.

    Column by column, the band's differences of neighbouring cells are bits of one integer that moves down a row each time (the
    bit-parallel recurrence of Myers in the banded form of Hyyro). The lengths differ by at most `most`.
    """
    n, m = len(a), len(b)
    width = 2 * most + 1
    full = (1 << width) - 1
    at: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        at[word] = at.get(word, 0) | 1 << (i + most)
    plus, minus, edits = full >> most << most, 0, min(n, most)
    turn, spare = n - most, most + m - (n - most)
    for j, word in enumerate(b.tolist()):
        x = at.get(word, 0) >> j & full
        level = (((x & plus) + plus) ^ plus) | x | minus
        right, left = minus | ~(level | plus) & full, level & plus
        if j < turn:  # down the outermost diagonal until the last row
            edits += 1 - (level >> 2 * most & 1)
            if edits > spare:
                return None
        else:  # then along that row
            k = n - j - 1 + most
            edits += (right >> k & 1) - (left >> k & 1)
        level = (level & full) >> 1
        plus, minus = left & full | ~(level | right) & full, level & right
    return edits if edits <= most else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the sequences align with at most 1 - similarity of the longer one's words edited."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    if not len(a):
        return True
    # words that one has more often than the other need an edit each
    values, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    extra = np.bincount(place[: len(a)], minlength=len(values)) - np.bincount(place[len(a) :], minlength=len(values))
    least = int(max(extra[extra > 0].sum(), -extra[extra < 0].sum()))
    return least <= most and aligns(a, b, most)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: a number of its words (0: none), the keys, the bitmap and the words' own numbers (32 bits)."""
    number = _Numbers()
    for batch in batches:
        node, counts, keys, bags, packed = [], [], [], [], []
        for raw in raw_texts(batch.column("text")):
            words = words_of(raw)
            numbers = number.of(words)
            node.append(int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True) if words else 0)
            counts.append(len(words))
            keys.append(sketch(numbers) if words else None)
            bags.append(bag(numbers) if words else None)
            packed.append(numbers.astype(np.uint32).tobytes())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(node, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, longs), pa.array(bags, longs), pa.array(packed, pa.binary())], names=["doc_id", "row", "node", "n_words", "keys", "bag", "words"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts are alike."""
    for batch in batches:
        same = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(same, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike. texts: node and words."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("shares")).where("shares > 1")  # a leader may have most pairs
    some = F.coalesce("shares", F.lit(1))
    dealt = pairs.join(shares, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), some).cast("int").alias("share"))
    second = texts.withColumnsRenamed({"node": "b", "words": "y"}).join(shares, "b", "left").select("b", "y", F.explode(F.sequence(F.lit(0), some - 1)).alias("share"))
    first = dealt.join(texts.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    first = first.repartition(1 + pairs.count() // ALIGN, "b", "share")  # by pairs, not by bytes: they cost time
    return first.join(second, ["b", "share"]).select("a", "b", "x", "y").mapInArrow(_align, "a long, b long")


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sets share."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    row, column = row[counts[column] > 1], (np.cumsum(counts > 1) - 1)[column[counts[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int((counts > 1).sum()), WIDE):
        a, b = np.searchsorted(column, (low, low + WIDE))
        x = np.zeros((n, WIDE), np.float32)
        x[row[a:b], column[a:b] - low] = 1
        out += x @ x.T
    return out


def _told_apart(words: np.ndarray) -> np.ndarray:
    """The words, each with the count of equal ones before it."""
    ordered = np.sort(words).astype(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    before = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))
    return ordered | before.astype(np.uint64) << np.uint64(32)


def align_many(a: np.ndarray, others: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Which of the sequences are at most so many edits from a: the recurrence of _in_bits without a band, for all of them at once.

    A column of a is in 64-bit parts, each of which costs the same for few others as for many. A pair goes once its edits can't come
    down to the limit in the columns left.
    """
    n, parts = len(a), -(-len(a) // 64)
    if len(others) < FEW * max(1, parts) or max(n, *map(len, others)) > LONG:
        return np.array([aligns(a, b, int(m)) for b, m in zip(others, most, strict=True)], bool)
    lengths = np.array([len(b) for b in others])
    values, place = np.unique(a, return_inverse=True)
    equal = np.zeros((len(values) + 1, parts), np.uint64)  # the last row: words that a lacks
    np.bitwise_or.at(equal, (place, np.arange(n) // 64), np.uint64(1) << (np.arange(n) % 64).astype(np.uint64))
    at = np.full((lengths.max(), len(others)), len(values))
    for k, b in enumerate(others):
        found = np.minimum(np.searchsorted(values, b), len(values) - 1)
        at[: len(b), k] = np.where(values[found] == b, found, len(values))
    one, top, last = np.uint64(1), np.uint64(63), np.uint64((n - 1) % 64)
    out, left, edits = np.zeros(len(others), bool), np.arange(len(others)), np.full(len(others), n)
    plus, minus = np.full((parts, len(others)), ~np.uint64(0)), np.zeros((parts, len(others)), np.uint64)
    for j in range(lengths.max()):
        up, down = np.ones(len(left), np.uint64), np.zeros(len(left), np.uint64)
        seen = equal[at[j, left]]
        for i in range(parts):
            p, x = plus[i], seen[:, i]
            level = x | minus[i]
            x = x | down
            x = (((x & p) + p) ^ p) | x
            right, fall = minus[i] | ~(x | p), p & x
            if i == parts - 1:
                edits = edits + (right >> last & one).astype(np.int64) - (fall >> last & one).astype(np.int64)
            rise, sink = right << one | up, fall << one | down
            up, down = right >> top, fall >> top
            plus[i], minus[i] = sink | ~(level | rise), rise & level
        ended = lengths[left] == j + 1
        if ended.any():
            out[left[ended]] = edits[ended] <= most[left[ended]]
        if j % 16 == 15 or ended.any():
            stay = ~ended & (edits - (lengths[left] - j - 1) <= most[left])
            left, edits, plus, minus = left[stay], edits[stay], plus[:, stay], minus[:, stay]
            if not len(left):
                break
    return out


def _cell(cell: pa.Table) -> pa.Table:
    """Links that join all texts of a cell that pairs of it join. cell: key, node, component, words, keys (the larger ones of the text), part, i, j."""
    key, cross = cell.column("key")[0].as_py(), cell.column("i")[0] != cell.column("j")[0]
    node, of, part = (cell.column(c).to_numpy() for c in ("node", "component", "part"))
    words = [np.frombuffer(w, np.uint32) for w in cell.column("words").to_pylist()]
    n = np.array([len(w) for w in words])
    most = (np.maximum(n[:, None], n[None]) * (1 - SIMILARITY) + 1e-9).astype(np.int64)
    met = np.triu(of[:, None] != of[None], 1) & (abs(n[:, None] - n[None]) <= most)
    if cross:
        met &= part[:, None] != part[None]
    # a pair is looked at under one of the keys that both share, so that a group's pairs are dealt to all of its keys
    keys = [np.array(k, np.int64) for k in cell.column("keys").to_pylist()]
    drawn = _mix(node.view(np.uint64)).astype(np.uint32)
    met &= in_common([k[k < key] for k in keys]) == (drawn[:, None] ^ drawn[None]) % in_common(keys).astype(np.uint32)
    some = np.flatnonzero(met.any(0) | met.any(1))
    if len(some):
        shared = in_common([_told_apart(words[t]) for t in some])
        met[np.ix_(some, some)] &= np.maximum(n[some][:, None], n[some][None]) - shared <= most[np.ix_(some, some)]
    of, links = of.copy(), []
    for a in some:
        others = np.flatnonzero(met[a] & (of != of[a]))
        if len(others):
            for b in others[align_many(words[a], [words[b] for b in others], most[a, others])]:
                if of[b] != of[a]:
                    links.append((int(node[a]), int(node[b])))
                    of[of == of[b]] = of[a]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def met_in_cells(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the texts of each key, of different components. large: key, node, component; texts: node, words.

    A key of many texts is cut into parts, and each two of these are a cell.
    """
    sizes = large.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    large = materialize(large.join(sizes.select("key", "n"), "key"), "omh-large")
    rows, pairs = large.agg(F.count("*"), F.coalesce(F.sum(F.col("n") / 2), F.lit(0.0))).first()
    own = large.groupBy("node").agg(F.collect_set("key").alias("keys"))  # at most SAMPLES
    texts = sieve(texts, "node", own).groupBy("node").agg(F.first("words").alias("words")).join(own, "node")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")
    dealt = large.select("key", "node", "component", part.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    dealt = dealt.select("key", "node", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    cells = dealt.join(texts, "node").repartition(int(1 + max(pairs // LOOKED, rows // CELL)), "key", "i", "j")
    return cells.groupBy("key", "i", "j").applyInArrow(_cell, "a long, b long")


def _fits(a: str, b: str) -> Column:
    """Whether texts of so many words can be alike: each word that one has more is an edit."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _overlap(a: str, b: str, bag_a: str, bag_b: str) -> Column:
    """Whether texts of so many words can be alike by their bitmaps."""
    beyond = lambda x, y: sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(BAG)), F.lit(0))
    return F.greatest(beyond(bag_a, bag_b), beyond(bag_b, bag_a)) <= (1 - SIMILARITY) * F.greatest(a, b) + 1e-6


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that can be alike by lengths and bitmaps. nodes: node, n_words, bag, component."""
    one, two = (nodes.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n_words", "bag", "component"))) for k in "ab")
    fit = (F.col("component_a") != F.col("component_b")) & _fits("n_words_a", "n_words_b") & _overlap("n_words_a", "n_words_b", "bag_a", "bag_b")
    return pairs.join(one, "a").join(two, "b").where(fit).select(*pairs.columns)


def _placed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows with the component of their node, which is the node itself where nothing is linked to it."""
    return rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _linked(sketched: DataFrame) -> DataFrame:
    """node, component of the texts that are linked to another."""
    # one row per distinct word sequence
    nodes = materialize(sketched.where("n_words > 0").groupBy("node").agg(F.first("keys").alias("keys"), F.first("n_words").alias("n_words"), F.first("bag").alias("bag")), "omh-nodes")
    keyed = nodes.select("node", "n_words", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n_words")).alias("least")).where("n > 1")
    shared = materialize(keyed.join(sizes.select("key", "n", F.col("least.node").alias("leader"), F.col("least.n_words").alias("n_leader")), "key"), "omh-shared")
    release(sketched.sparkSession)
    texts = sketched.where("n_words > 0").select("node", "words")

    def compared(pairs: DataFrame, label: str) -> DataFrame:
        """The links among the pairs. Copies of a text are many, but one has its words."""
        wanted = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "omh-wanted")
        words = materialize(sieve(texts, "node", wanted).groupBy("node").agg(F.first("words").alias("words")), f"omh-texts-{label}")
        return materialize(verified(pairs, words), f"omh-links-{label}")

    led = shared.where("node <> leader").where(_fits("n_words", "n_leader")).groupBy(F.col("node").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("keys"))
    led = materialize(_possible(led, nodes.withColumn("component", F.col("node"))), "omh-led")
    nearest = led.groupBy("a").agg(F.max(F.struct("keys", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    joined = materialize(components(compared(materialize(nearest, "omh-nearest"), "nearest")), "omh-components")

    placed = materialize(_placed(nodes.drop("keys"), joined), "omh-placed")
    small = _placed(shared.where(f"n between 3 and {SMALL} and node <> leader"), joined).select("key", "node", "n_words", "component")
    one, two = small.toDF("key", "a", "n_a", "of_a"), small.toDF("key", "b", "n_b", "of_b")
    every = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & _fits("n_a", "n_b"))
    pairs = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(every.select("a", "b"))
    links = compared(materialize(_possible(pairs.distinct(), placed), "omh-pairs"), "more")
    joined = materialize(extended(joined, links), "omh-components")
    links = materialize(met_in_cells(_placed(shared.where(f"n > {SMALL}").select("key", "node"), joined), texts), "omh-links-cells")
    return materialize(extended(joined, links), "omh-components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row, n_words, class_id (the least id of the class), class_size, first (whether the row stands for its class).

    row: a column of numbers that tell the rows apart; without one, rows are numbered.
    """
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    docs = docs.select(F.col(doc_id).alias("doc_id"), number.alias("row"), F.col(text).alias("text"))
    return finished(lambda: _classes(docs), "near-duplicates")


def _classes(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = materialize(docs.mapInArrow(_sketches, f"doc_id {kind}, row long, node long, n_words int, keys array<long>, bag array<long>, words binary"), "omh-sketches")
    joined = _linked(sketched)

    head = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row"))
    of_node = materialize(sketched.groupBy("node").agg(F.count("*").alias("copies"), head.alias("head")), "omh-heads")
    linked = joined.join(of_node, "node")
    classes = linked.groupBy("component").agg(F.min("head").alias("head"), F.sum("copies").alias("class_size"), F.count("*").alias("texts"))
    of_class = join_by_size(linked.select("node", "copies", "component"), classes, "component", "texts").select("node", "copies", "head", "class_size")
    alone = of_node.join(joined, "node", "left_anti").select("node", "copies", "head", F.col("copies").alias("class_size"))
    placed = materialize(of_class.unionByName(alone), "omh-classes")
    rows = join_by_size(sketched.select("doc_id", "row", "n_words", "node"), placed, "node", "copies")
    return rows.select("doc_id", "row", "n_words", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("first"))


def op10(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "class_size")
