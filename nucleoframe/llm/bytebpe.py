"""Byte-level BPE: encoding with vectorised pre-tokenisation, and decoding.

Texts are taken as arrays of UTF-8 bytes, many texts at a time. Each character becomes a
symbol: its class (letter, number, white space, other) and what of the next characters
matters (does a contraction begin, does white space go on). A symbol is a transition
function on eight states; the functions that arise from any number of symbols are a small
monoid, so products of symbols are looked up in a table and, being associative, found by a
scan over blocks of bytes. The state before each byte and its symbol say whether a
pre-token begins there: no pattern is matched. Continuation bytes are the identity.

The resulting slices are merged by the ranks of pairs, once for each distinct slice while
the store of a worker lasts. Each token's offset in the text's bytes is kept, and decoding
puts the bytes of every token at its offset.

The classes of characters are those of the tokenizer library's own engine, which is
asked once in a worker for all code points, so its version of Unicode decides.

Cases: null and empty texts have no tokens and decode to no bytes; repeated rows get equal
ids; a null id stays null; a text of any length is cut into windows at proven boundaries,
and a slice of any length is merged in n log n steps; strings of special tokens are
ordinary text; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: States: what the match that holds the last character is. DONE: it ended; BLANK: one space
#: that the next run takes; TAIL1, TAIL2: a contraction with so many letters to come.
STATES = DONE, LETTERS, NUMBERS, OTHERS, BLANK, SPACES, TAIL1, TAIL2 = tuple(range(8))
#: Symbols of bytes. LAST_BLANK and LAST_SPACE are followed by something else than white space.
INSIDE, LETTER, NUMBER, OTHER, SHORT, LONG, LAST_BLANK, LAST_SPACE, SPACE = range(9)
#: The first characters of texts have symbols of their own, which forget what was before.
FIRST = 8


def moved(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a pre-token begins with it."""
    if symbol == INSIDE:
        return state, False
    if symbol > SPACE:
        return moved(DONE, symbol - FIRST)[0], True
    if symbol == LETTER and state in (TAIL1, TAIL2):
        return (DONE if state == TAIL1 else TAIL1), False
    if symbol in (SHORT, LONG):
        if state not in (OTHERS, BLANK):
            return (TAIL1 if symbol == SHORT else TAIL2), True
        symbol = OTHER
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[symbol]
        return run, state not in (run, BLANK)
    if symbol == SPACE:
        return SPACES, state != SPACES
    return (BLANK if symbol == LAST_BLANK else DONE), True


class Scan:
    """Products of transition functions: every function that symbols can make has a number,
    and a table has the number of each product."""

    def __init__(self):
        symbols = range(SPACE + FIRST + 1)
        functions = [tuple(moved(s, x)[0] for s in STATES) for x in symbols]
        known = {f: i for i, f in reversed(list(enumerate(functions)))}
        listed = list(dict.fromkeys(functions))
        for f in listed:  # grows until it is closed
            for g in functions:
                both = tuple(g[s] for s in f)
                if both not in known:
                    known[both] = -1
                    listed.append(both)
        number = {f: i for i, f in enumerate(listed)}
        self.width = 1 << (len(listed) - 1).bit_length()
        self.element = np.array([number[f] for f in functions], np.uint16)
        product = np.zeros((len(listed), self.width), np.uint16)
        for i, f in enumerate(listed):
            for j, g in enumerate(listed):
                product[i, j] = number[tuple(g[s] for s in f)]
        self.product = product.ravel()
        self.identity = number[tuple(STATES)]
        self.from_done = np.array([f[DONE] for f in listed], np.uint8)
        begins = np.zeros((len(STATES), 32), bool)
        for s in STATES:
            for x in symbols:
                begins[s, x] = moved(s, x)[1]
        self.begins = begins.ravel()

    def prefixes(self, elements: np.ndarray, block: int = 128) -> np.ndarray:
        """The product of all elements up to each one. Blocks are multiplied side by side, and
        the products of whole blocks by another scan."""
        n = len(elements)
        if n <= block:
            return np.array(list(accumulate(elements.tolist(), lambda a, b: int(self.product[a * self.width + b]))), np.uint16)
        rows = -(-n // block)
        held = np.full(rows * block, self.identity, np.uint16)
        held[:n] = elements
        held = np.ascontiguousarray(held.reshape(rows, block).T)
        for j in range(1, block):
            held[j] = self.product.take(held[j - 1] * self.width + held[j])
        before = np.concatenate([[self.identity], self.prefixes(held[-1], block)[:-1]]).astype(np.uint16)
        return np.ascontiguousarray(self.product.take(before * self.width + held).T).ravel()[:n]


@lru_cache(maxsize=1)
def scan() -> Scan:
    return Scan()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or, for white space, SPACE of each code point."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        engine = tiktoken.Encoding(kind, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = engine.decode_bytes(engine.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def code_points(raw: np.ndarray, leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the characters of two bytes and more that begin at `leads`, and their
    bytes; raw has three bytes to spare."""
    a, b, c, d = (raw[leads + i].astype(np.int32) for i in range(4))
    width = 2 + (a >= 0xE0) + (a >= 0xF0)
    two, three, four = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
    return np.where(width == 2, two, np.where(width == 3, three, four)), width


def symbols_of(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each byte but the last three, which are to spare; `first` marks the bytes
    with which texts begin, and the byte behind the last text."""
    n, table = len(raw) - 3, classes()
    of_byte = np.concatenate([table[:128], np.zeros(128, np.uint8)])
    out = of_byte[raw]
    out[n:] = OTHER
    leads = np.flatnonzero(raw[:n] >= 0xC0)
    points, widths = code_points(raw, leads)
    out[leads] = table[points]
    space = out == SPACE
    at = np.flatnonzero(space)
    following = at + 1
    wide = raw[at] >= 0xC0
    following[wide] += widths[np.searchsorted(leads, at[wide])] - 1
    last = ~first[following] & ~space[following]
    out[at[last]] = np.where(raw[at[last]] == 32, LAST_BLANK, LAST_SPACE)
    at = np.flatnonzero(raw[:n] == 39)
    b, c = raw[at + 1], raw[at + 2]
    one = ~first[at + 1] & np.isin(b, list(b"stmd"))
    two = ~first[at + 1] & ~first[at + 2] & (((b == 114) | (b == 118)) & (c == 101) | (b == 108) & (c == 108))
    out[at[one]], out[at[two]] = SHORT, LONG
    out[first] += FIRST
    return out[:n]


def boundaries(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the texts' bytes, which lie one after the other; texts that
    aren't empty begin at `starts`."""
    n, tool = len(raw), scan()
    if not n:
        return np.zeros(0, np.int64)
    spare = np.concatenate([raw, np.zeros(3, np.uint8)])
    first = np.zeros(n + 3, bool)
    first[starts] = first[n] = True
    symbols = symbols_of(spare, first)
    after = tool.prefixes(tool.element[symbols])
    before = np.zeros(n, np.uint8)
    before[1:] = tool.from_done[after[:-1]]
    return np.flatnonzero(tool.begins.take(before.astype(np.intp) * 32 + symbols))


def windows(raw: np.ndarray, size: int):
    """(begin, end, boundaries) of successive parts of one text, cut where a pre-token begins.
    A boundary depends on the bytes before it and on fewer than eight behind."""
    at, wide = 0, size
    while at < len(raw):
        end = min(at + wide, len(raw))
        found = boundaries(raw[at:end], np.zeros(1, np.int64))
        if end < len(raw):
            found = found[found <= end - at - 8]
            if len(found) < 2:
                wide *= 2
                continue
            end = at + int(found[-1])
            found = found[:-1]
        yield at, end, found
        at, wide = end, size


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Slices(dict):
    """The number of each slice met so far. A new one is merged, and its ids, with the offsets
    of their tokens in the slice, are put behind those of the others."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000, most_ids: int = 8_000_000):
        super().__init__()
        self.ranks, self.most, self.most_ids = ranks, most, most_ids
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.ids, self.offsets, self.starts = array("i"), array("i"), array("q", [0])

    def settle(self) -> None:
        """Called between texts: a store that has grown large is begun anew."""
        if len(self) > self.most or len(self.ids) > self.most_ids:
            self.begin()

    def __missing__(self, piece: bytes) -> int:
        number = self[piece] = len(self)
        for at, rank in self.merged(piece):
            self.ids.append(rank)
            self.offsets.append(at)
        self.starts.append(len(self.ids))
        return number

    def merged(self, piece: bytes) -> list[tuple[int, int]]:
        """(offset, id) of the tokens: the adjacent pair of least rank, of equal ones the first,
        is merged until no pair has a rank. Pairs wait in a heap; those that aren't there any
        more are passed over."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [(0, whole)]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(waiting)
        while waiting:
            _, i, end = heappop(waiting)
            j = following[i]
            if not 0 < j < n or following[j] != end:
                continue
            following[i], following[j] = end, 0
            h = before[i]
            if end < n:
                before[end] = i
                r = ranks.get(piece[i : following[end]])
                if r is not None:
                    heappush(waiting, (r, i, following[end]))
            if h >= 0:
                r = ranks.get(piece[h:end])
                if r is not None:
                    heappush(waiting, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append((i, ranks[piece[i : following[i]]]))
            i = following[i]
        return out

    def encoded(self, raw: np.ndarray, found: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets of all tokens of the slices that begin at `found`, and how many tokens
        each slice has."""
        data = raw.tobytes()
        cuts = found.tolist()
        numbers = np.array([self[data[a:b]] for a, b in zip(cuts, [*cuts[1:], len(data)])], np.int64)
        ids, inner, starts = (np.array(x) for x in (self.ids, self.offsets, self.starts))
        counts = starts[numbers + 1] - starts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(starts[numbers] - ends + counts, counts) + np.arange(total)
        return ids[take], inner[take] + np.repeat(found + base, counts), counts


@lru_cache(maxsize=2)
def slices_of(path: str) -> Slices:
    return Slices(read_ranks(path))


ENCODED = "doc_id long, ids array<int>, offsets array<int>"


def encode(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", window_bytes: int = 1 << 20) -> DataFrame:
    """The ids of each whole text and the offset of every token in its UTF-8 bytes: one row
    per input row, columns of ENCODED. `ranks` is a file that all executors see."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32()))])

    def of_texts(store: Slices, keys: list, raw: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        """Several short texts at once, or one of any length."""
        store.settle()
        if len(keys) == 1:
            parts = []
            for a, b, found in windows(raw, window_bytes):
                store.settle()
                parts.append(store.encoded(raw[a:b], found, a)[:2])
            ids, offsets = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
            ends = np.array([0, len(ids)])
        else:
            begins = np.cumsum(lengths) - lengths
            found = boundaries(raw, begins[lengths > 0])
            ids, offsets, counts = store.encoded(raw, found)
            sums = np.concatenate([[0], np.cumsum(counts)])
            firsts = np.searchsorted(found, begins)  # the first slice of each text
            ends = np.concatenate([sums[firsts], [len(ids)]])
            offsets = offsets - np.repeat(begins, np.diff(ends))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v.astype(np.int32))) for v in (ids, offsets)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists], schema=schema)

    def run(batches):
        store = slices_of(ranks)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string()).fill_null("")
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            lengths, first = np.diff(bounds), 0
            while first < len(ids):  # as many texts as a window has room for, one at least
                end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + window_bytes, "right")) - 1)
                yield of_texts(store, ids[first:end], data[bounds[first] : bounds[end]], lengths[first:end])
                first = end

    return df.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, ENCODED)


class Vocabulary:
    """The bytes of all tokens, one after the other."""

    def __init__(self, ranks: dict[bytes, int]):
        listed = sorted((i, t) for t, i in ranks.items())
        self.lengths = np.zeros((listed[-1][0] if listed else -1) + 1, np.int64)
        self.lengths[[i for i, _ in listed]] = [len(t) for _, t in listed]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(t for _, t in listed), np.uint8)

    def decoded(self, ids: np.ndarray, places: np.ndarray, out: np.ndarray, at_once: int = 200_000) -> None:
        """Puts the bytes of each token at its place."""
        for k in range(0, len(ids), at_once):
            own, put = ids[k : k + at_once], places[k : k + at_once]
            n = self.lengths[own]
            ends = np.cumsum(n)
            step = np.arange(int(ends[-1]))
            out[np.repeat(put - ends + n, n) + step] = self.bytes[np.repeat(self.starts[own] - ends + n, n) + step]


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def decode(encoded: DataFrame, ranks: str, most_bytes: int = 16 << 20) -> DataFrame:
    """Frames of encode() with the decoded bytes of each row in a further column `decoded`. Ids
    that the file doesn't have, and offsets that leave gaps, are errors."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("decoded", pa.large_binary())])

    def run(batches):
        words = vocabulary_of(ranks)
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids, offsets = lists.values.to_numpy()[: bounds[-1]], batch.column(2).values.to_numpy()
            shift = int(batch.column(2).offsets[0].as_py()) - int(bounds[0])
            sums = np.concatenate([[0], np.cumsum(words.lengths[ids])])
            bases = sums[bounds]  # where each row's bytes begin, were all put one after the other
            first, rows = 0, batch.num_rows
            while first < rows:
                end = max(first + 1, int(np.searchsorted(bases, bases[first] + most_bytes, "right")) - 1)
                a, b = bounds[first], bounds[end]
                places = offsets[a + shift : b + shift].astype(np.int64) + np.repeat(bases[first:end], np.diff(bounds[first : end + 1]))
                if not np.array_equal(places, sums[a:b]):
                    raise ValueError("offsets and tokens don't agree")
                out = np.zeros(int(bases[end] - bases[first]), np.uint8)
                words.decoded(ids[a:b], places - bases[first], out)
                made = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer((bases[first : end + 1] - bases[first]).astype(np.int64)), pa.py_buffer(out)])
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own.columns, schema)), made.cast(pa.binary())], names=schema.names)
                first = end

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, ENCODED + ", decoded binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256."""
    both = decode(encode(docs, ranks), ranks)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
