"""Best-fit packing of tokenized documents into sequences, with swap-based local search.

Documents become token ids plus one end id; those longer than a sequence are cut into
whole-sequence pieces. The pieces' numbers are written once and dealt round-robin into
shards of a bounded number of pieces, so no key can be hot and a lost task packs its own
shard again. In each shard a best-fit start is improved by local search: moves, one-for-one
and two-for-one exchanges between underfull bins, each of which increases the sum of
squared fills, until bins empty. It ends where the number of bins is the least that the
total allows, or where no exchange is left. A shard that reaches that least number leaves
less than one sequence unused, so shards cost at most one sequence for `shard_pieces` pieces.

Cases: a null or empty text is one end id; repeated rows are packed once each; a null
id stays null; very long texts give many pieces; ties go by the order in the shard; an
empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, map_batches, written

#: Code points below U+0250 by Unicode category, as the vocabulary's splitting rule has them.
_LATIN = [chr(i) for i in range(0x250)]
_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
WORDS = re.compile(
    "[{0}]+|'(?:s|t|re|ve|m|ll|d)|[{1}]|[^{2}{0}{1}]+".format(re.escape(_LETTERS), re.escape(_DIGITS), re.escape(_BLANK))
)
#: Texts with these go through the tokenizer whole: other scripts, the dotted capital I
#: and the control characters on which notions of white space differ.
OTHER = re.compile("[^\x00-ɏ]|[İ\x1c-\x1f]|<\\|(?:startoftext|endoftext)\\|>")


def is_plain(text: str) -> bool:
    """No part of the text needs the whole tokenizer. Characters below U+0100 are always
    normalized, which spares most texts the slower tests."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return OTHER.search(text) is None and unicodedata.is_normalized("NFC", text)
    return not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f")) and ("<|" not in text or OTHER.search(text) is None)


class Ids:
    """Token ids of texts. Pre-tokens are independent of each other, so each distinct one
    is encoded once and its ids kept; beyond `most` kept pre-tokens the store restarts.

    New pre-tokens are encoded many at once, with spaces between them. The last token of
    each bears the vocabulary's end of word, and only that one, so the ids are divided
    there; a group whose ends don't agree with its number is encoded one by one."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, new: list[str], group: int = 2000) -> None:
        for k in range(0, len(new), group):
            words = new[k : k + group]
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
            at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(at) == len(words) and at[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *at[:-1]], at))))
            else:
                for word, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
                    self.known[word] = array("I", e.ids).tobytes()

    def of_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [WORDS.findall(t.lower()) if is_plain(t) else None for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        new = set().union(*(w for w in split if w is not None)).difference(self.known) if split else set()
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [self.whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split)]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def drop_ids() -> None:
    ids_of.cache_clear()


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = bytes(4)


def token_pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, slice_chars: int = 1_000_000) -> DataFrame:
    """Pieces of each document: ids plus the end id 0, cut after every `most` ids."""

    def run(batches):
        ids, sink = ids_of(vocabulary), Sink(PIECES)

        def settle(keys, texts):
            for key, raw in zip(keys, ids.of_all(texts)):
                raw += END
                for piece, at in enumerate(range(0, len(raw), 4 * most)):
                    part = raw[at : at + 4 * most]
                    sink.add(key, piece, at // 4, len(part) // 4, zlib.crc32(part))

        for batch in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                texts.append(text.as_py() or "")
                keys.append(key.as_py())
                size += len(texts[-1])
                if size >= slice_chars:
                    settle(keys, texts)
                    keys, texts, size = [], [], 0
                    if sink.full():
                        yield sink.take()
            settle(keys, texts)
            yield sink.take()

    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(texts, run, PIECES_DDL, drop_ids)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(most + 1)]  # bins by free room
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), most
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            free[room].append(b)
            rooms |= 1 << room
    return bins


class Underfull:
    """Bins with room, by room, with the sizes that they can give back as the bits of
    numbers: `singles[r]` has bit n if a bin of room r may have a piece of size n (and bit
    0: it gives back nothing), `pairs[r]` if two of its pieces may have size n together.
    Bits are never missing; one that no bin bears out is taken away when it is met."""

    def __init__(self, bins: list[list[int]], lengths: list[int], most: int):
        self.lengths, self.most, self.all_bits = lengths, most, (1 << (most + 1)) - 1
        self.bins = {k: list(b) for k, b in enumerate(bins)}
        self.fill = {k: sum(lengths[i] for i in b) for k, b in self.bins.items()}
        self.sums = {k: self.sums_of(b) for k, b in self.bins.items()}
        self.rooms: dict[int, set[int]] = {}
        self.singles, self.pairs = [0] * (most + 1), [0] * (most + 1)
        for k in self.bins:
            self.enter(k)

    def sums_of(self, own: list[int]) -> tuple[int, int]:
        """Sizes of one piece and of two, as bits."""
        one = two = 0
        for i in own:
            two |= one << self.lengths[i]
            one |= 1 << self.lengths[i]
        return one, two & self.all_bits

    def enter(self, k: int) -> None:
        room = self.most - self.fill[k]
        if room:
            self.rooms.setdefault(room, set()).add(k)
            one, two = self.sums[k]
            self.singles[room] |= one | 1
            self.pairs[room] |= two

    def leave(self, k: int) -> None:
        room = self.most - self.fill[k]
        held = self.rooms.get(room)
        if held is not None:
            held.discard(k)
            if not held:
                del self.rooms[room]
                self.singles[room] = self.pairs[room] = 0

    def pieces(self, k: int, size: int, two: bool) -> list[int]:
        """One piece, or two, of this size from a bin."""
        seen: dict[int, int] = {}
        for i in self.bins[k]:
            n = self.lengths[i]
            if not two and n == size:
                return [i]
            if two and size - n in seen:
                return [seen[size - n], i]
            seen[n] = i
        raise KeyError(size)

    def giver(self, room: int, back: int, two: bool) -> int | None:
        """A bin of this room that can give back this size; if there is none, the bit goes."""
        if back == 0:
            return next(iter(self.rooms[room]))
        for k in self.rooms[room]:
            if self.sums[k][two] >> back & 1:
                return k
        held = self.pairs if two else self.singles
        held[room] &= ~(1 << back)
        return None

    def best(self, target: int) -> tuple | None:
        """The exchange that takes most from the target: (taken, receiver, size given, two?,
        size back, two?). The receiver is as full as the target at least, so that the sum of
        squared fills increases."""
        one, two = self.sums[target]
        sizes = [(s, False) for s in bits_of(one)] + [(s, True) for s in bits_of(two & ~one)]
        found, taken = None, 0
        for room in sorted((r for r in self.rooms if r <= self.most - self.fill[target]), reverse=True):
            if room <= taken:
                break
            for size, double in sizes:
                for back_two in (False,) if double else (False, True):
                    bits = (self.pairs if back_two else self.singles)[room]
                    least = max(size - room, 0)
                    while True:  # the smallest size that may come back
                        rest = bits >> least
                        back = least + (rest & -rest).bit_length() - 1
                        if not rest or size - back <= taken:
                            break
                        k = self.giver(room, back, back_two)
                        if k is not None:
                            found, taken = (size - back, k, size, double, back, back_two), size - back
                            break
                        bits = (self.pairs if back_two else self.singles)[room]
                if taken >= room:
                    break
        return found

    def emptied(self, target: int) -> bool:
        """Exchanges from the target until it is empty or there is none; did any occur?"""
        moved = False
        self.leave(target)
        while self.bins[target] and (step := self.best(target)) is not None:
            taken, k, size, double, back, back_two = step
            given = self.pieces(target, size, double)
            returned = self.pieces(k, back, back_two) if back else []
            self.leave(k)
            self.bins[target] = [i for i in self.bins[target] if i not in given] + returned
            self.bins[k] = [i for i in self.bins[k] if i not in returned] + given
            for b, by in ((target, -taken), (k, taken)):
                self.fill[b] += by
                self.sums[b] = self.sums_of(self.bins[b])
            self.enter(k)
            moved = True
        if self.bins[target]:
            self.enter(target)
        else:
            del self.bins[target]
        return moved


def bits_of(x: int) -> list[int]:
    """The places of the bits, the highest first."""
    out = []
    while x:
        out.append(x.bit_length() - 1)
        x ^= 1 << out[-1]
    return out


def local_search(bins: list[list[int]], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Moves and one-for-one and two-for-one exchanges between underfull bins, in passes
    over all of them as targets, the emptiest first, until no bin is left that could be
    saved or a pass finds no exchange. Each exchange increases the sum of squared fills, so
    the search ends at a local optimum."""
    sizes = lengths.tolist()
    fills = [sum(sizes[i] for i in b) for b in bins]
    full = [b for b, n in zip(bins, fills) if n == most]
    state = Underfull([b for b, n in zip(bins, fills) if n < most], sizes, most)
    least = -(-sum(fills) // most) - len(full)
    moved = True
    while moved and len(state.bins) > least:
        moved = False
        for target in sorted(state.bins, key=lambda k: (state.fill[k], k)):
            if target in state.bins and state.fill[target] < most:
                moved |= state.emptied(target)
                if len(state.bins) <= least:
                    break
    return full + list(state.bins.values())


def pack_lengths(lengths, most: int = 2048) -> list[list[int]]:
    """Bins of indices of `lengths`, each of total length at most `most`."""
    lengths = np.asarray(lengths, dtype=np.int64)
    return local_search(best_fit(lengths, most), lengths, most) if len(lengths) else []


PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_pieces(pieces: DataFrame, shards: int, most: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces. Every shard is one partition of a
    round-robin deal; its rows are a few numbers for each piece."""

    def run(batches):
        table = pa.Table.from_batches(batches, schema=PIECES) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        base = TaskContext.get().partitionId() << 32
        for b, members in enumerate(pack_lengths(lengths, most)):
            sequence[members] = base + b
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from table.cast(PACKED).to_batches(max_chunksize=20_000)

    return map_batches(pieces.repartition(shards), run, f"{PIECES_DDL}, sequence_id long, offset long")


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", most: int = 2048, shard_pieces: int = 65_536) -> DataFrame:
    """Packs all documents of a table; one row per piece."""
    pieces = written(token_pieces(df, vocabulary, id_col, text_col, most), "pieces")
    return pack_pieces(pieces, max(1, -(-pieces.count() // shard_pieces)), most)
