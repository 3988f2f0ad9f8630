"""Token counts by dynamic programming shared over a trie.

Distinct pre-tokens are inserted in a trie. The unigram forward score of a prefix, and the
number of tokens of its best segmentation, depend on nothing after the prefix, so they
are computed once for each node, and the count at a terminal node is stored as the
pre-token's. The trie of a slice's new pre-tokens is built and walked depth first, in sorted
order, so that only the nodes of the current path are there at a time; the counts of
terminal nodes stay for later slices, batches and tasks of a worker until there are `most`.
Scores are those that the vocabulary file gives its pieces.

A pre-token is a maximal run of characters other than ASCII white space, with the
word-begin mark in front. A character that no piece covers costs `unknown` and counts
as one token per UTF-8 byte (byte fallback). Of segmentations with equal scores the one with
fewer tokens counts.

Cases: null and empty texts have 0 tokens; repeated rows get equal counts; a null id stays
null; very long texts are counted in slices and very long words along one path of the
trie; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Sink

WORD = re.compile(f"[^{SPACE}]+")
BEGIN = "▁"
#: The path has nodes for so many characters; what a longer word has beyond is walked alone.
DEEPEST = 256


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Normal pieces and scores of a sentencepiece model file, by the public protobuf
    layout: field 1 of the model is a piece with 1 text, 2 score (float32), 3 type."""
    import struct

    with open(path, "rb") as f:
        data = f.read()
    out, at = [], 0
    while at < len(data):
        key, at = read_varint(data, at)
        if key & 7 == 2:
            n, at = read_varint(data, at)
            if key >> 3 == 1:
                inner, text, score, kind, i = data[at : at + n], "", 0.0, 1, 0
                while i < n:
                    k, i = read_varint(inner, i)
                    if k & 7 == 2:
                        m, i = read_varint(inner, i)
                        text = inner[i : i + m].decode() if k >> 3 == 1 else text
                        i += m
                    elif k & 7 == 5:
                        score = struct.unpack_from("<f", inner, i)[0]
                        i += 4
                    else:
                        v, i = read_varint(inner, i)
                        kind = v if k >> 3 == 3 else kind
                if kind == 1:
                    out.append((text, score))
            at += n
        elif key & 7 == 0:
            _, at = read_varint(data, at)
        else:
            at += 4 if key & 7 == 5 else 8
    return out


class Counts:
    """Forward scores over a trie of pre-tokens. A node is (best score up to it, fewest
    tokens, open matches in the trie of the vocabulary); `terminal` has each word's count."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: float | None = None, most: int = 400_000):
        self.unknown = min((s for _, s in pieces), default=0.0) - 10.0 if unknown is None else unknown
        # a vocabulary node: children by character, and its score if it is a piece
        self.vocabulary: list = [{}, None]
        for text, score in pieces:
            node = self.vocabulary
            for c in text:
                node = node[0].setdefault(c, [{}, None])
            node[1] = score
        self.most, self.computed = most, 0
        self.terminal: dict[str, int] = {}
        begun = [(0.0, 0, [(self.vocabulary[0], 0.0, 0)])]
        self.extend(begun, BEGIN)
        self.root = begun[-1]

    def extend(self, path: list[tuple], rest: str, keep: bool = True) -> tuple:
        """The node at the end of rest, below the last of the path, which gets a node for
        each character if they are kept."""
        best, fewest, matches = node = path[-1]
        unknown, words = self.unknown, self.vocabulary[0]
        for c in rest:
            score = best + unknown
            count = fewest + (1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass")))
            still = []
            for children, before, tokens in matches:
                found = children.get(c)
                if found is not None:
                    deeper, piece = found
                    if piece is not None:
                        total = before + piece
                        if total > score or total == score and tokens + 1 < count:
                            score, count = total, tokens + 1
                    if deeper:
                        still.append((deeper, before, tokens))
            still.append((words, score, count))
            best, fewest, matches = node = (score, count, still)
            if keep:
                path.append(node)
        self.computed += len(rest)
        return node

    def of_all(self, words) -> dict[str, int]:
        """Token counts of distinct words; they are there until the next call."""
        if len(self.terminal) > self.most:
            self.terminal = {}
        path, last = [self.root], ""
        for word in sorted(set(words).difference(self.terminal)):
            near, shared = word[:DEEPEST], 0
            most = min(len(near), len(last))
            while shared < most and near[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            node = self.extend(path, near[shared:])
            if len(word) > DEEPEST:
                node = self.extend([node], word[DEEPEST:], keep=False)
            last = near
            self.terminal[word] = node[1]
        return self.terminal

    def of(self, word: str) -> int:
        return self.of_all([word])[word]


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    return Counts(read_pieces(path))


COUNTED = "doc_id long, n_words long, n_tokens long"


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 2_000_000) -> DataFrame:
    """Words and tokens of each whole text: one row per input row, columns of COUNTED.

    Distinct pre-tokens are gathered over slices of about slice_chars characters."""

    def run(batches):
        counts = counts_of(vocabulary)
        sink = Sink(pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())]))

        def settle(keys, split):
            get = counts.of_all(set().union(*split)).__getitem__
            for key, words in zip(keys, split):
                sink.add(key, len(words), sum(map(get, words)))

        for batch in batches:
            keys, split, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                keys.append(key.as_py())
                split.append(WORD.findall(text))
                size += len(text)
                if size >= slice_chars:
                    settle(keys, split)
                    keys, split, size = [], [], 0
                if sink.full():
                    yield sink.take()
            settle(keys, split)
            yield sink.take()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COUNTED)
