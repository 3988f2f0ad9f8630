"""The binning index of block-gzipped files that are sorted by reference and position (BAI for
BAM, TBI for text), by the public formats. Bins of six sizes, from 16 KiB of a reference up,
list the chunks of the file that hold their records; a linear index has, for each 16 KiB, where
the first record that reaches into it begins."""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

from .bgzf import END, BlockWriter, Stream
from .files import opened

#: Fixed values of the formats: bits of a bin's length and the first bin of that length.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0))
#: Positions end here; bins from this number on aren't bins of records.
LAST_POSITION, NO_BIN = 1 << 29, 37450


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds start..end-1."""
    for shift, base in LEVELS:
        if start >> shift == (end - 1) >> shift:
            return base + (start >> shift)
    return 0


def bins_of(start: int, end: int) -> list[int]:
    """All bins that reach into start..end-1."""
    return [b for shift, base in LEVELS for b in range(base + (start >> shift), base + ((end - 1) >> shift) + 1)]


class Index:
    """Chunks by bin and the linear index of each reference, by number."""

    def __init__(self):
        self.bins: dict[int, dict[int, list[list[int]]]] = {}
        self.linear: dict[int, list[int | None]] = {}
        self.unplaced = 0

    def add(self, ref: int, start: int, end: int, begin: int, stop: int) -> None:
        """A record, in the order of the file, and its virtual offsets."""
        if ref < 0 or start < 0 or end > LAST_POSITION:
            self.unplaced += ref < 0
            return
        chunks = self.bins.setdefault(ref, {}).setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = stop
        else:
            chunks.append([begin, stop])
        linear = self.linear.setdefault(ref, [])
        last = (end - 1) >> 14
        linear += [None] * (last + 1 - len(linear))
        for k in range(start >> 14, last + 1):
            if linear[k] is None:
                linear[k] = begin

    def append(self, other: Index, by: int, names: dict[int, int] | None = None) -> None:
        """The index of a part that lies `by` bytes further on, behind all that was added. A part
        that has its own numbers of references comes with their numbers here."""
        moved = lambda v: None if v is None else v + (by << 16)
        for own, bins in other.bins.items():
            ref = own if names is None else names[own]
            mine = self.bins.setdefault(ref, {})
            for b, chunks in bins.items():
                held = mine.setdefault(b, [])
                for begin, stop in chunks:
                    if held and held[-1][1] == moved(begin):
                        held[-1][1] = moved(stop)
                    else:
                        held.append([moved(begin), moved(stop)])
            linear, theirs = self.linear.setdefault(ref, []), other.linear.get(own, [])
            linear += [None] * (len(theirs) - len(linear))
            for k, v in enumerate(theirs):
                if linear[k] is None:
                    linear[k] = moved(v)
        self.unplaced += other.unplaced

    def chunks(self, ref: int, start: int = 0, end: int = LAST_POSITION) -> list[tuple[int, int]]:
        """The ranges of virtual offsets that hold all records of a region, in order and apart."""
        bins, linear = self.bins.get(ref, {}), self.linear.get(ref, [])
        start, end = max(start, 0), min(end, LAST_POSITION)
        if start >= end:
            return []
        # nothing that reaches into the first window begins before what it says, or, if it has no
        # record, before what the next one with a record says
        least = next((v for v in linear[start >> 14 :] if v is not None), None)
        if least is None:
            return []
        wanted = bins_of(start, end) if end - start < LAST_POSITION else list(bins)
        found = sorted((max(a, least), b) for k in wanted for a, b in bins.get(k, ()) if b > least)
        out: list[tuple[int, int]] = []
        for a, b in found:
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def cuts(self, ref: int, begin: int, stop: int, split: int) -> list[tuple[int, int]]:
        """A chunk in parts of about `split` bytes of the file, cut where records begin."""
        if (stop >> 16) - (begin >> 16) <= split:
            return [(begin, stop)]
        places = sorted({v for v in self.linear.get(ref, []) if v is not None})
        out, at = [], begin
        while (stop >> 16) - (at >> 16) > split:
            k = bisect_left(places, at + (split << 16))
            if k == len(places) or places[k] >= stop:
                break
            out.append((at, places[k]))
            at = places[k]
        return [*out, (at, stop)]

    def body(self, n_refs: int) -> bytes:
        """What the formats have in common: each reference's bins and linear index."""
        out = bytearray()
        for ref in range(n_refs):
            bins, linear = self.bins.get(ref, {}), self.linear.get(ref, [])
            out += struct.pack("<i", len(bins))
            for b in sorted(bins):
                out += struct.pack("<Ii", b, len(bins[b]))
                for begin, stop in bins[b]:
                    out += struct.pack("<QQ", begin, stop)
            out += struct.pack("<i", len(linear))
            before, filled = 0, []
            for v in linear:  # a window without records has the offset before it
                before = before if v is None else v
                filled.append(before)
            out += struct.pack(f"<{len(filled)}Q", *filled)
        return bytes(out + struct.pack("<Q", self.unplaced))

    def read_body(self, data: bytes, at: int, n_refs: int) -> Index:
        for ref in range(n_refs):
            (n,) = struct.unpack_from("<i", data, at)
            at += 4
            for _ in range(n):
                b, k = struct.unpack_from("<Ii", data, at)
                values = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
                at += 8 + 16 * k
                if b < NO_BIN:
                    self.bins.setdefault(ref, {})[b] = [list(x) for x in zip(values[::2], values[1::2])]
            (n,) = struct.unpack_from("<i", data, at)
            self.linear[ref] = list(struct.unpack_from(f"<{n}Q", data, at + 4))
            at += 4 + 8 * n
        if len(data) >= at + 8:
            (self.unplaced,) = struct.unpack_from("<Q", data, at)
        return self

    def bai(self, n_refs: int) -> bytes:
        return b"BAI\1" + struct.pack("<i", n_refs) + self.body(n_refs)


def read_bai(path: str) -> Index:
    with opened(path) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is no BAI index")
    return Index().read_body(data, 8, struct.unpack_from("<i", data, 4)[0])


#: Of text: kind (2 is VCF), columns of name, start and end from 1 (0: none), the sign of comment
#: lines, and lines to pass over at the beginning.
VCF = (2, 1, 2, 0, ord("#"), 0)


def write_tbi(path: str, index: Index, names: list[str], layout: tuple = VCF) -> None:
    """The index as a file of blocks."""
    listed = b"".join(n.encode() + b"\0" for n in names)
    whole = b"TBI\1" + struct.pack("<i", len(names)) + struct.pack("<6i", *layout) + struct.pack("<i", len(listed)) + listed + index.body(len(names))
    with open(path, "wb") as f:
        out = BlockWriter(f)
        out.write(whole)
        out.flush()
        f.write(END)


def references(path: str, wanted: set[str] | None = None) -> tuple[tuple, Iterator[tuple[str, Index]]]:
    """The layout of a TBI index, and the name and the index (as reference 0) of each of the wanted references,
    or of all. The file is gone through piece by piece, so no more than one reference is held."""

    def pieces():
        with opened(path) as f:
            stream, at = Stream(f, 0), 0
            size = yield
            while True:
                if not stream.has(at + size):
                    raise ValueError(f"{path} is no TBI index, or ends early")
                data = stream.bytes(at, at + size)
                at += size
                stream.drop(at)
                size = yield data

    held = pieces()
    next(held)
    if held.send(4) != b"TBI\1":
        raise ValueError(f"{path} is no TBI index")
    n, *layout, length = struct.unpack("<8i", held.send(32))
    listed: dict[int, str] = {}

    def names():
        rest, ref = b"", 0
        for k in range(0, length, 1 << 16):
            *whole, rest = (rest + held.send(min(1 << 16, length - k))).split(b"\0")
            for name in map(bytes.decode, whole):
                if wanted is None or name in wanted:
                    listed[ref] = name
                ref += 1

    def found():
        names()
        last = max(listed, default=-1)
        for ref in range(min(n, last + 1)):
            body = [held.send(4)]
            for _ in range(struct.unpack("<i", body[0])[0]):
                body.append(held.send(8))
                body.append(held.send(16 * struct.unpack_from("<i", body[-1], 4)[0]))
            body.append(held.send(4))
            body.append(held.send(8 * struct.unpack("<i", body[-1])[0]))
            if ref in listed:
                yield listed[ref], Index().read_body(b"".join(body), 0, 1)
        held.close()

    return tuple(layout), found()


def read_tbi(path: str) -> tuple[Index, list[str], tuple]:
    """(index, names of the references, layout)."""
    with opened(path) as f:
        stream = Stream(f, 0)
        while stream.has(stream.base + len(stream.held) + 1):
            pass
        data = bytes(stream.held)
    if data[:4] != b"TBI\1":
        raise ValueError(f"{path} is no TBI index")
    n, *layout, length = struct.unpack_from("<8i", data, 4)
    names = data[36 : 36 + length].split(b"\0")[:-1]
    return Index().read_body(data, 36 + length, n), [x.decode() for x in names], tuple(layout)
