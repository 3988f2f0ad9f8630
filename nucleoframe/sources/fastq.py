"""FASTQ records by 4-line framing, as a Python data source (format "nucleo_fastq").

Plain and block-gzipped files are read in splits: a split has the records before which a byte
of it lies, and finds the first one by its form (a header with @, and two lines on a line
with +; sequence and qualities are of one length). Other gzip files are one split. As a
stream the source takes files that grow: what isn't a whole record yet waits for the next
batch. Files whose records don't have that form are for read_fastq(), which counts lines."""

from __future__ import annotations

import gzip
import json
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schemas
from .bgzf import PlainStream, Stream, block_length, first_block
from .blocktext import all_lines, paths_of
from .files import listed, opened, size_of
from .text import numbered_lines

#: Fields of a record behind its file and its place.
FIELDS = ("header", "sequence", "plus", "quality")


def begins(lines) -> bool:
    """Do these four lines look like a record?"""
    header, sequence, plus, quality = (x.rstrip(b"\r") for x in lines)
    return header.startswith(b"@") and plus.startswith(b"+") and len(sequence) == len(quality)


def framed(lines: Iterator[tuple[int, int, bytes]], end: int, stop: int, search: bool) -> Iterator[tuple]:
    """(offset, four fields) of the records whose header follows a byte before `end` and that begin
    before `stop`. With `search` the first one is found by its form. Reading ends at the first
    empty header; lines that a last record lacks are empty."""
    if search:
        held: deque = deque(islice(lines, 4), maxlen=4)
        while len(held) == 4 and not begins([x for *_, x in held]):
            more = next(lines, None)
            if more is None:
                return
            held.append(more)
        if len(held) < 4:
            return
        lines = _chained(held, lines)
    while four := list(islice(lines, 4)):
        before, place, header = four[0]
        if before >= end or place >= stop or not header.rstrip(b"\r"):
            return
        fields = [x.rstrip(b"\r").decode("utf-8", "replace") for *_, x in four]
        yield (place, *fields, *[""] * (4 - len(fields)))


def _chained(first, rest):
    yield from first
    yield from rest


def kind_of(path: str) -> str:
    """plain, blocks, or gzip."""
    with opened(path) as f:
        head = f.read(18)
    return "blocks" if block_length(head) is not None else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


LAST = 1 << 62


def records(path: str, kind: str, start: int, end: int = LAST, stop: int = LAST, exact: bool = False) -> Iterator[tuple]:
    """(place, four fields) of a range of a file; with `exact` a record begins at its start. The place in a
    gzip file without blocks is the record's number."""
    with opened(path) as f:
        if kind == "gzip":
            with gzip.open(f) as g:
                number = 0  # such a file is one split, so its records are numbered
                while four := [line.removesuffix(b"\n") for line in islice(g, 4)]:
                    found = list(framed(iter([(-1, number, x) for x in four]), LAST, LAST, False))
                    if not found:
                        return
                    yield from found
                    number += 1
            return
        if kind == "blocks":
            first = first_block(f, start, f.seek(0, 2)) if start else 0
            if first >= end:
                return
            stream = Stream(f, first)
        else:
            stream = PlainStream(f, start)
        search = start > 0 and not exact
        yield from framed(all_lines(stream, 0, search), end, stop, search)


def batches(path: str, rows: Iterator[tuple], at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("rec", pa.int64()), *((n, pa.string()) for n in FIELDS)])
    while held := list(islice(rows, at_once)):
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), *(pa.array(c, f.type) for c, f in zip(zip(*held), list(schema)[1:]))], schema=schema)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self):
        out = []
        for p in self.paths:
            kind = kind_of(p)
            step = LAST if kind == "gzip" else self.split
            out += [InputPartition((p, kind, a, a + step)) for a in range(0, max(size_of(p), 1), step)]
        return out

    def read(self, partition):
        return batches(partition.value[0], records(*partition.value))


def complete(path: str, start: int, size: int, window: int = 1 << 20) -> int:
    """Where the last whole record of a plain file ends, of those behind `start`, where one begins.
    Only the end of what is new is looked at, as much as it takes to find a record."""
    with opened(path) as f:
        while True:
            at = max(start, size - window)
            f.seek(at)
            data = f.read(size - at)
            if at > start:
                lines, place = data.split(b"\n"), 0
                found = None
                for i in range(len(lines) - 4):  # the last one isn't ended
                    if i and begins(lines[i : i + 4]):
                        found = place
                        break
                    place += len(lines[i]) + 1
                if found is None:
                    window *= 4
                    continue
                data, at = data[found:], at + found
            whole = data.count(b"\n") // 4 * 4
            end = 0
            for line in data.split(b"\n")[:whole]:
                end += len(line) + 1
            return at + end


class StreamReader(DataSourceStreamReader):
    """Plain files of a folder, which may grow and may be joined by others. An offset says for each
    file up to where its records were given."""

    def __init__(self, folder: str, pattern: str, split: int):
        self.folder, self.pattern, self.split = folder, pattern, split
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self):
        return {"files": "{}"}

    def latestOffset(self):
        for path in listed(self.folder, self.pattern):
            size = size_of(path)
            before, end = self.known.get(path, (0, 0))
            if size > before:
                self.known[path] = (size, complete(path, end, size))
        return {"files": json.dumps({p: end for p, (_, end) in sorted(self.known.items())})}

    def partitions(self, start, end):
        old, out = json.loads(start["files"]), []
        for path, stop in json.loads(end["files"]).items():
            begun = old.get(path, 0)
            cuts = [*range(begun, stop, self.split), stop]
            out += [InputPartition((path, "plain", a, b, stop, a == begun)) for a, b in zip(cuts, cuts[1:])]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return iter(())
        return batches(partition.value[0], records(*partition.value))

    def commit(self, end):
        """What was given stays in the files."""


class FastqSource(DataSource):
    """Options: paths (file names divided by commas) and split, the bytes of a file in one
    partition; as a stream: path (a folder) and pattern of plain files. Every executor must
    see the files."""

    @classmethod
    def name(cls) -> str:
        return "nucleo_fastq"

    def schema(self) -> str:
        return schemas.FASTQ

    def reader(self, schema):
        return Reader(paths_of(self.options), int(self.options.get("split", 64 << 20)))

    def streamReader(self, schema):
        return StreamReader(self.options["path"], self.options.get("pattern", "*.fastq"), int(self.options.get("split", 64 << 20)))


def read_fastq_files(spark: SparkSession, *paths: str, split: int = 64 << 20) -> DataFrame:
    """FASTQ of well-formed files in splits, without a shuffle; `rec` is a record's place in its file."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("nucleo_fastq").option("paths", ",".join(paths)).option("split", split).load()


def stream_fastq(spark: SparkSession, folder: str, pattern: str = "*.fastq", split: int = 64 << 20) -> DataFrame:
    """A stream of the records of plain files that grow; each record is given once, when its last
    line has ended."""
    spark.dataSource.register(FastqSource)
    return spark.readStream.format("nucleo_fastq").option("path", folder).option("pattern", pattern).option("split", split).load()


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """FASTQ through Spark's own text reader, for files in any store that it knows: lines
    are numbered block by block. Records after the first empty header go."""
    return frame_lines(numbered_lines(spark, path))


def frame_lines(numbered: DataFrame) -> DataFrame:
    """FASTQ records from (file, ord, value). Where a file ends early is found before its
    lines are put together; there is one such row for each file, so it is broadcast."""
    lines = numbered.select("file", F.floor(F.col("ord") / 4).cast("long").alias("rec"), (F.col("ord") % 4).alias("at"), "value")
    ends = lines.where((F.col("at") == 0) & (F.col("value") == "")).groupBy("file").agg(F.min("rec").alias("end"))
    lines = lines.join(F.broadcast(ends), "file", "left").where("end is null or rec < end")
    line = lambda i: F.coalesce(F.max(F.when(F.col("at") == i, F.col("value"))), F.lit(""))
    return lines.groupBy("file", "rec").agg(*[line(i).alias(n) for i, n in enumerate(FIELDS)])


def alignments_to_fastq(alignments: DataFrame) -> DataFrame:
    """Reads of primary records as FASTQ; those on the reverse strand are turned back."""
    reverse = F.col("flag").bitwiseAND(16) != 0
    turned = F.reverse(F.translate("seq", "ACGTNacgtn", "TGCANtgcan"))
    kept = alignments.where(F.col("flag").bitwiseAND(0x900) == 0)
    return kept.select(
        F.lit(None).cast("string").alias("file"), F.col("ord").alias("rec"), F.concat(F.lit("@"), F.col("read_id")).alias("header"),
        F.when(reverse, turned).otherwise(F.col("seq")).alias("sequence"), F.lit("+").alias("plus"), F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("quality"),
    )
