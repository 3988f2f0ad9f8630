"""Block gzip (BGZF): gzip members of at most 64 KiB that state their length, so a file can be
read from any block. A virtual offset is a block's place in the file, shifted by 16 bits, and
a place in the block's contents."""

from __future__ import annotations

import os
import shutil
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .files import opened

#: Bytes of contents that a written block has at most.
MOST = 60_000


def block(data: bytes) -> bytes:
    """Contents as one block."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = squeeze.compress(data) + squeeze.flush()
    head = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data))


#: The empty block that ends a file.
END = block(b"")


def block_length(head: bytes) -> int | None:
    """The length of the block that starts with these bytes, or None."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x06\0BC\x02\0":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """Offset and contents of each block from the one that starts at `at`."""
    f.seek(at)
    while len(head := f.read(18)) == 18:
        length = block_length(head)
        if length is None:
            raise ValueError(f"no block at {at}")
        rest = f.read(length - 18)
        yield at, zlib.decompress(rest[:-8], -15)
        at += length


def first_block(f, at: int, size: int) -> int:
    """The offset of the first block at or behind `at`: a block's beginning where another
    one, or the end, follows at the stated length. `size` if there is none."""
    f.seek(at)
    data = f.read((1 << 17) + 18)  # a block is 64 KiB at most
    i = data.find(b"\x1f\x8b\x08\x04")
    while i >= 0:
        length = block_length(data[i : i + 18])
        if length is not None and (at + i + length == size or block_length(data[i + length : i + length + 18]) is not None):
            return at + i
        i = data.find(b"\x1f\x8b\x08\x04", i + 1)
    return size


class Stream:
    """The decompressed bytes behind a block's beginning, with the offsets of their blocks."""

    def __init__(self, f, at: int):
        self.blocks, self.held, self.base, self.marks = blocks(f, at), bytearray(), 0, []

    def has(self, end: int) -> bool:
        """Reads on until the bytes before `end` are held; False where the file ends before."""
        while self.base + len(self.held) < end:
            found = next(self.blocks, None)
            if found is None:
                return False
            if found[1]:
                self.marks.append((self.base + len(self.held), found[0]))
                self.held += found[1]
        return True

    def bytes(self, start: int, end: int) -> bytes:
        return bytes(self.held[start - self.base : end - self.base])

    def place(self, at: int) -> tuple[int, int]:
        """The block's offset and the place in it."""
        while len(self.marks) > 1 and self.marks[1][0] <= at:
            self.marks.pop(0)
        return self.marks[0][1], at - self.marks[0][0]

    def drop(self, start: int) -> None:
        """What lies before `start` isn't needed any more."""
        if start - self.base > 1 << 20:
            del self.held[: start - self.base]
            self.base = start

    def offset(self, at: int) -> int:
        """The virtual offset of a byte; the blocks before its own are forgotten."""
        block, place = self.place(at)
        return block << 16 | place

    def block_of(self, at: int) -> int:
        """The offset of the block that holds a byte."""
        return self.marks[bisect_right(self.marks, (at, 1 << 62)) - 1][1]


class PlainStream(Stream):
    """The bytes of a file without blocks, from one of them on; each is a block of its own."""

    def __init__(self, f, at: int, at_once: int = 1 << 20):
        super().__init__(f, at)
        f.seek(at)
        self.origin, self.blocks = at, ((0, data) for data in iter(lambda: f.read(at_once), b""))

    def offset(self, at: int) -> int:
        return self.origin + at

    def block_of(self, at: int) -> int:
        return self.origin + at


class BlockWriter:
    """Writes bytes as blocks; `tell` is the virtual offset of the next one."""

    def __init__(self, f):
        self.f, self.held, self.at = f, bytearray(), 0

    def tell(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= MOST:
            self._put(MOST)

    def _put(self, n: int) -> None:
        self.at += self.f.write(block(bytes(self.held[:n])))
        del self.held[:n]

    def flush(self) -> None:
        """What is held becomes a block, so that the next byte begins one."""
        if self.held:
            self._put(len(self.held))


def join_parts(spark: SparkSession, head: bytes, parts: list[tuple[str, int]], path: str) -> list[int]:
    """One file of whole blocks: a head, the parts (path and size) in order, and the end block.
    Each part is copied as it is by a task of its own, to its place in the file, so no
    block is inflated and a task that is run again writes the same bytes. Gives the places
    of the parts. The folder must be a file system that all executors mount."""
    places, at = [], len(head)
    for _, size in parts:
        places.append(at)
        at += size
    target = f"{path}.joined"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(target, "wb") as f:
        f.write(head)
        f.seek(at)
        f.write(END)

    def copy(batches):
        for batch in batches:
            for source, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(source, "rb") as a, open(target, "r+b") as b:
                    b.seek(place)
                    shutil.copyfileobj(a, b, 1 << 22)
                    b.flush()
                    os.fsync(b.fileno())
            yield batch

    rows = [(name, place) for (name, size), place in zip(parts, places) if size]
    if rows:
        listed = spark.createDataFrame(rows, "source string, place long").repartition(len(rows), "place")
        listed.mapInArrow(copy, "source string, place long").write.format("noop").mode("overwrite").save()
    os.replace(target, path)
    return places


def starts(path: str) -> list[int]:
    """The offsets of all blocks, by their stated lengths alone."""
    out, at = [], 0
    with opened(path) as f:
        while True:
            f.seek(at)
            length = block_length(f.read(18))
            if length is None:
                return out
            out.append(at)
            at += length
