"""Token counts by a linear longest-match automaton.

Greedy word pieces: a word is cut into its longest initial piece, then the longest continuation
pieces. Where no initial piece fits, the mark of a word's start is a token of its own, if the vocabulary has it; a
character without a piece counts by its UTF-8 bytes, if the vocabulary has byte pieces. A word that cannot be cut even so is one unknown token. The automaton is a trie over initial pieces
and, below a second root, over continuation pieces. Each node has a failure link and the number of
tokens popped on the way to it, so one pass over the characters gives the length and no piece is
ever built or looked up again.

The vocabulary file is a parameter; the one used here marks initial pieces by U+2581, all others
continue a word. It is read once by the driver and broadcast: its size is that of the file, whatever
the corpus. Distinct words of a batch are cut once and their lengths kept in a bounded memo.

Words are runs of other than ASCII white space. Null and empty texts have 0 words and 0 tokens.
Rows are counted one by one, so repeated rows, ties and other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import raw_texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
INITIAL = "▁"
MEMO_WORDS = 200_000


def read_pieces(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Initial and continuation pieces of a sentence-piece model; control and byte pieces are left out. The bare mark is the initial piece ""."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    initial = [p[1:] for p in pieces if p.startswith(INITIAL) and INITIAL not in p[1:]]
    return initial, [p for p in pieces if INITIAL not in p]


def has_bytes(path: str = VOCABULARY) -> bool:
    """Whether the model has a piece for every byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


@dataclass
class Automaton:
    """Nodes 0 (word start) and 1 (after a piece); children by character, failure link, tokens popped."""

    children: list[dict[str, int]]
    ends: list[bool]
    fail: list[int]
    popped: list[int]
    by_bytes: bool = False

    @classmethod
    def build(cls, initial: list[str], continuation: list[str], by_bytes: bool = False) -> Automaton:
        children: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                at = root
                for ch in piece:
                    if ch not in children[at]:
                        children[at][ch] = len(children)
                        children.append({})
                        ends.append(False)
                        parent.append((at, ch))
                    at = children[at][ch]
                ends[at] = True
        tokens = [1] * len(children)
        if by_bytes:
            # a character that is no piece is one of as many tokens as it has bytes
            for ch in {ch for _, ch in parent[2:]}:
                if ch not in children[1]:
                    children[1][ch] = len(children)
                    children.append({})
                    ends.append(False)
                    parent.append((1, ch))
                    tokens.append(1)
                at = children[1][ch]
                if not ends[at]:
                    ends[at], tokens[at] = True, len(ch.encode())
        fail, popped = [-1] * len(children), [0] * len(children)
        if ends[0]:
            fail[0], popped[0] = 1, 1
        level = [0, 1]
        while level:
            following = []
            for node in level:
                if node > 1:
                    up, ch = parent[node]
                    if ends[node]:
                        fail[node], popped[node] = 1, tokens[node]
                    else:
                        # the longest piece on the way here is popped; its rest goes on from where that leads
                        link, n = fail[up], popped[up]
                        while link >= 0 and ch not in children[link]:
                            n += popped[link]
                            link = fail[link]
                        if link >= 0:
                            fail[node], popped[node] = children[link][ch], n
                following.extend(children[node].values())
            level = following
        return cls(children, ends, fail, popped, by_bytes)

    def length(self, word: str) -> int:
        """The number of pieces of a word, or 0 if it cannot be cut."""
        children, fail, popped = self.children, self.fail, self.popped
        at = n = 0
        for ch in word:
            to = children[at].get(ch)
            while to is None:
                if at == 1 and self.by_bytes:
                    n, to = n + len(ch.encode()), 1
                    break
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = children[at].get(ch)
            at = to
        while at != 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def _counter(shared):  # noqa: ANN001, ANN202
    arrow = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])
    memo: dict[bytes, int] = {}

    @F.arrow_udf("struct<n_words:long,n_tokens:long,n_unknown:long>")
    def count(texts: pa.Array) -> pa.Array:
        length = shared.value.length
        words_of, tokens_of, unknown_of = [], [], []
        for raw in raw_texts(texts):
            words = raw.split()
            for w in {w for w in words if w not in memo}:
                memo[w] = length(w.decode("utf-8", "replace"))
            lengths = [memo[w] for w in words]
            unknown = lengths.count(0)
            words_of.append(len(words))
            tokens_of.append(sum(lengths) + unknown)
            unknown_of.append(unknown)
            if len(memo) > MEMO_WORDS:
                memo.clear()
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (words_of, tokens_of, unknown_of)], fields=list(arrow))

    return count


def token_counts(spark: SparkSession, text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """A struct of n_words, n_tokens (unknown words are one token each) and n_unknown."""
    shared = spark.sparkContext.broadcast(Automaton.build(*read_pieces(vocabulary), has_bytes(vocabulary)))
    return _counter(shared)(text)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.withColumn("n", token_counts(spark, "text")).select("doc_id", "n.n_words", "n.n_tokens", "n.n_unknown")


