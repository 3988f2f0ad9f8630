"""Block-gzipped text as Python data sources: "nucleo_block_text" reads any such file in splits,
"nucleo_indexed_text" a file with a TBI index, of which only the blocks of a region are read.

A line belongs to the split in which the line before it ends (the first one to the first
split), so each split passes over what is before its first line break and reads on to the
first break behind its end. Lines come as Arrow batches; `ord` is a line's virtual offset."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .bgzf import BlockWriter, Stream, block_length, first_block, join_parts
from .binning import VCF, Index, references
from .files import opened, size_of

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def is_blocked(path: str) -> bool:
    """Is this one file of blocks? False for patterns, folders, and stores that can't be opened here."""
    try:
        with opened(path) as f:
            return block_length(f.read(18)) is not None
    except (OSError, pa.ArrowInvalid):
        return False


def raw_lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that belong to a range of the file's bytes."""
    with opened(path) as f:
        size = f.seek(0, 2)
        first = 0 if start == 0 else first_block(f, start, size)
        if first >= size or first >= end:
            return
        yield from _split(Stream(f, first), 0, end, start > 0)


def all_lines(stream: Stream, at: int, inside: bool) -> Iterator[tuple[int, int, bytes]]:
    """(block, offset, line) of the lines from `at` on: where the byte before the line is, and where
    the line begins. With `inside` the first line began before `at` and isn't given."""
    skip, first = inside, at
    while stream.has(at + 1):
        held_end = stream.base + len(stream.held)
        data = stream.bytes(at, held_end)
        cut = data.rfind(b"\n") + 1
        if not cut and stream.has(held_end + 1):
            continue  # a line longer than what is held
        if not cut:
            cut = len(data)
        if skip:
            head = data.find(b"\n") + 1
            if not head:
                return  # no line begins here
            at, skip = at + head, False
            continue
        begun = at
        for line in data[:cut].split(b"\n")[: None if cut == len(data) and data[-1:] != b"\n" else -1]:
            before = stream.block_of(begun - 1) if begun > first else -1
            yield before, stream.offset(begun), line
            begun += len(line) + 1
        at = begun
        stream.drop(at)


def _split(stream: Stream, at: int, end: int, inside: bool, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, line) from `at` on. The last line is behind a break in a block before `end`, and begins
    before the virtual offset `stop`."""
    for before, place, line in all_lines(stream, at, inside):
        if before >= end or stop is not None and place >= stop:
            return
        yield place, line


def broken(place: int, line: bytes) -> list[tuple[int, bytes]]:
    """A line without its carriage return; one within the line divides it, as Spark's reader has it."""
    if b"\r" not in line:
        return [(place, line)]
    out = []
    for part in (line[:-1] if line.endswith(b"\r") else line).split(b"\r"):
        out.append((place, part))
        place += len(part) + 1
    return out


def as_text(lines: list[bytes]) -> pa.Array:
    held = pa.array(lines, pa.binary())
    try:
        return held.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last field is the line, in batches of about `most` bytes of lines."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 16
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    *others, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(others, schema)), as_text(list(lines))], schema=schema)


def ranges(paths: list[str], split: int) -> list[tuple[str, int, int]]:
    return [(p, a, a + split) for p in paths for a in range(0, max(size_of(p), 1), split)]


class TextReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self):
        return [InputPartition(x) for x in ranges(self.paths, self.split)]

    def read(self, partition):
        path = partition.value[0]
        rows = ((path, at, x) for line in raw_lines(*partition.value) for at, x in broken(*line))
        return batches(rows, pa.schema([("file", pa.string()), ("ord", pa.int64()), ("value", pa.string())]))


def paths_of(options: dict) -> list[str]:
    return [p for p in options.get("paths", options.get("path", "")).split(",") if p]


class BlockText(DataSource):
    """Options: paths (divided by commas) and split (the bytes of a file in one partition)."""

    @classmethod
    def name(cls) -> str:
        return "nucleo_block_text"

    def schema(self) -> str:
        return "file string, ord long, value string"

    def reader(self, schema):
        return TextReader(paths_of(self.options), int(self.options.get("split", 64 << 20)))


def read_block_text(spark: SparkSession, *paths: str, split: int = 64 << 20) -> DataFrame:
    """(file, ord, value) of block-gzipped files, as many partitions as there are splits."""
    spark.dataSource.register(BlockText)
    return spark.read.format("nucleo_block_text").option("paths", ",".join(paths)).option("split", split).load()


class Region:
    """Names and a range of positions (both ends included) that filters leave."""

    def __init__(self, names: set[str] | None = None, first: int | None = None, last: int | None = None):
        self.names, self.first, self.last = names, first, last

    def narrow(self, f, name: str, pos: str) -> None:
        """Takes in one filter, if it is about the two columns."""
        if f.attribute == (name,) and isinstance(f, (EqualTo, In)):
            these = set(f.value) if isinstance(f, In) else {f.value}
            self.names = these if self.names is None else self.names & these
        elif f.attribute == (pos,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.first = least if self.first is None else max(self.first, least)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.last = most if self.last is None else min(self.last, most)

    def push(self, filters, name: str, pos: str):
        """Takes in what it can; Spark applies all of them again."""
        for f in filters:
            if getattr(f, "attribute", None) in ((name,), (pos,)):
                self.narrow(f, name, pos)
            yield f


class IndexedReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, region: Region):
        self.paths, self.split, self.region = paths, split, region

    def pushFilters(self, filters):
        return self.region.push(filters, "name", "pos")

    def partitions(self):
        """Ranges of virtual offsets of the wanted names' chunks; of all names without a filter."""
        out, region = [], self.region
        first = 0 if region.first is None else max(region.first - 1, 0)
        last = (1 << 29) if region.last is None else region.last
        for path in self.paths:
            layout, found = references(f"{path}.tbi", region.names)
            for name, index in found:
                for chunk in index.chunks(0, first, last):
                    out += [InputPartition((path, layout, name, *part)) for part in index.cuts(0, *chunk, self.split)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return iter(())
        schema = pa.schema([("name", pa.string()), ("pos", pa.int64()), ("ord", pa.int64()), ("value", pa.string())])
        return batches(self.rows(*partition.value), schema)

    def rows(self, path: str, layout: tuple, name: str, begin: int, stop: int) -> Iterator[tuple]:
        _, at_name, at_pos, _, mark, _ = layout
        low, high = self.region.first, self.region.last
        with opened(path) as f:
            for at, line in _split(Stream(f, begin >> 16), begin & 0xFFFF, 1 << 62, False, stop):
                line = line.removesuffix(b"\r")
                fields = line.split(b"\t", max(at_name, at_pos))
                if line[:1] == bytes([mark]) or len(fields) < max(at_name, at_pos) or fields[at_name - 1].decode() != name:
                    continue
                pos = int(fields[at_pos - 1])
                if (low is None or pos >= low) and (high is None or pos <= high):
                    yield name, pos, at, line


class IndexedText(DataSource):
    """Options: paths, each with an index at the same name and .tbi, and split. Filters on `name` and
    `pos` say which blocks are read."""

    @classmethod
    def name(cls) -> str:
        return "nucleo_indexed_text"

    def schema(self) -> str:
        return "name string, pos long, ord long, value string"

    def reader(self, schema):
        return IndexedReader(paths_of(self.options), int(self.options.get("split", 64 << 20)), Region())


def read_indexed_text(spark: SparkSession, *paths: str, split: int = 64 << 20) -> DataFrame:
    """(name, pos, ord, value) of the record lines of indexed files. Conditions on name and pos
    are looked up in the index, and no other blocks than theirs are read."""
    spark.dataSource.register(IndexedText)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("nucleo_indexed_text").option("paths", ",".join(paths)).option("split", split).load()


def placed(df: DataFrame, names: list[str], column: str) -> DataFrame:
    """The rows with `place`, that of their name in a header's list, from 1; NULL for one that isn't listed."""
    first = {n: i for i, n in reversed(list(enumerate(names, 1)))}
    listed = df.sparkSession.createDataFrame(list(first.items()), f"`{column}` string, place long")
    return df.join(F.broadcast(listed), column, "left")


def split_of(path: str, parts: int = 64, least: int = 100_000, most: int = 64 << 20) -> int:
    """The bytes of a split: `parts` splits of a file, but no smaller or larger ones than these."""
    return min(max(size_of(path) // parts, least), most)


def write_indexed_text(lines: DataFrame, path: str, names: list[str] | None, header: list[str], layout: tuple = VCF, descending: bool = False, contigs_at: int | None = None) -> int:
    """One block-gzipped file of (name, pos, ref_length, value), in order of `names`, pos and
    value, below the header lines, and its index; gives the number of lines. Without `names` they are those of
    the lines, in order, or, with `descending`, from the last to the first, and no list of them reaches the
    driver; the header line of this number (contigs_at) is then behind a line ##contig for each name.

    Spark sorts by ranges, and each task writes its blocks and, name by name, the index of its part. Where the parts
    lie in the file is then known, and a second pass moves their indexes, a task for each. The parts
    of both files are joined as they are; the driver has a row for each part. The folder must be a
    file system that all executors mount; names that aren't listed are an error."""
    spark, parts = lines.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    os.makedirs(parts)
    order: list[Column] = [F.col("pos"), F.col("value")]
    if names is None:
        known: Column = F.coalesce("name", F.raise_error(F.lit("no such name: null")).cast("string"))
        dealt = lines.select(known.alias("name"), F.col("pos").cast("long").alias("pos"), F.col("ref_length").cast("long").alias("ref_length"), "value", F.lit(0).cast("long").alias("place"))
        order = [F.desc("name") if descending else F.col("name"), *order]
    else:
        known = F.coalesce("place", F.raise_error(F.concat(F.lit("no such name: "), F.coalesce("name", F.lit("null")))).cast("long"))
        dealt = placed(lines, names, "name").select("name", F.col("pos").cast("long").alias("pos"), F.col("ref_length").cast("long").alias("ref_length"), "value", known.alias("place"))
        order = [F.col("place"), *order]
    dealt = dealt.orderBy(*order).select("name", "pos", "ref_length", "value", "place")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        file, n, refs, length = f"{parts}/{task.partitionId():05d}-{task.taskAttemptId()}", 0, 0, 0
        first, name, at, index = None, None, 0, Index()
        with open(file, "wb") as f, open(f"{file}.marks", "wb") as m, open(f"{file}.names", "wb") as a, open(f"{file}.contigs", "wb") as c:
            out, marks, listed, contigs = (BlockWriter(x) for x in (f, m, a, c))

            def done():
                text, body = name.encode(), index.body(1)[:-8]
                marks.write(struct.pack(MARK, len(text), len(body), at) + text + body)

            for batch in batches:
                for ref, pos, ref_length, value, place in zip(*(c.to_pylist() for c in batch.columns)):
                    if ref != name:
                        if refs:
                            done()
                            # whether the first name of a part is new is known when there are all parts
                            listed.write(ref.encode() + b"\0")
                            contigs.write(contig_line(ref))
                        else:
                            first = ref
                        name, at, index, refs, length = ref, place, Index(), refs + 1, length + len(ref.encode()) + 1
                    begin = out.tell()
                    out.write(value.encode() + b"\n")
                    index.add(0, pos - 1, pos - 1 + max(ref_length or 1, 1), begin, out.tell())
                    n += 1
            if refs:
                done()
            for x in (out, marks, listed, contigs):
                x.flush()
        if n:
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": file, "n": n, "refs": refs, "length": length, "first": first, "last": name, "place": at}])

    made = sorted(dealt.mapInArrow(write, PART).collect())
    fresh = [not k or made[k - 1].last != r.first for k, r in enumerate(made)]  # the part's first name isn't that of the part before

    def small(name: str, data: bytes) -> tuple[str, int]:
        with open(f"{parts}/{name}", "wb") as f:
            out = BlockWriter(f)
            out.write(data)
            out.flush()
        return with_size(f"{parts}/{name}")

    def by_name(suffix: str, of) -> list[tuple[str, int]]:
        """What tasks wrote of their names, with that of each part's first name before it."""
        return [p for k, r in enumerate(made) for p in ([small(f"{k}.first{suffix}", of(r.first))] if fresh[k] else []) + [with_size(f"{r.file}{suffix}")]]

    cut = len(header) if contigs_at is None or names is not None else contigs_at
    top, below = ("".join(f"{x}\n" for x in part).encode() for part in (header[:cut], header[cut:]))
    lead = [small("head", top), *(by_name(".contigs", contig_line) if cut < len(header) else []), small("below", below)]
    places = join_parts(spark, b"", [*lead, *(with_size(r.file) for r in made)], path)[len(lead) :]

    moved = []
    for k, r in enumerate(made):
        more = []  # the parts on which the last name goes on
        for j in range(k + 1, len(made) if fresh[k] or r.refs > 1 else 0):
            if made[j].first != r.last:
                break
            more.append((made[j].file, places[j]))
            if made[j].refs > 1:
                break
        moved.append((r.file, places[k], not fresh[k], made[k - 1].place if k else 0, more))

    def move(batches):
        for batch in batches:
            for file, place, skip, before, more in zip(*(c.to_pylist() for c in batch.columns)):
                with open(f"{file}.tbi", "wb") as f:
                    out, entries = BlockWriter(f), part_index(file)
                    if skip:  # a part before has it
                        next(entries)
                    held = next(entries, None)
                    while held is not None:
                        (_, at, own), following = held, next(entries, None)
                        whole = Index()
                        whole.append(own, place)
                        for other, where in ((x["file"], x["at"]) for x in more if following is None):
                            whole.append(next(part_index(other))[2], where)
                        out.write(NO_RECORDS * (at - before - 1))  # names that are listed but have no lines
                        out.write(whole.body(1)[:-8])
                        before, held = at, following
                    out.flush()
            yield batch

    if moved:
        kind = "file string, place long, skip boolean, before long, more array<struct<file:string,at:long>>"
        spark.createDataFrame(moved, kind).repartition(len(moved), "place").mapInArrow(move, kind).write.format("noop").mode("overwrite").save()
    if names is None:
        count = sum(r.refs - (not new) for r, new in zip(made, fresh))
        length = sum(r.length - (0 if new else len(r.first.encode()) + 1) for r, new in zip(made, fresh))
        listed, gap = by_name(".names", lambda x: x.encode() + b"\0"), b""
    else:
        text = b"".join(n.encode() + b"\0" for n in names)
        count, length, listed = len(names), len(text), [small("names", text)]
        gap = NO_RECORDS * (len(names) - (made[-1].place if made else 0))
    head = small("index-head", b"TBI\1" + struct.pack("<8i", count, *layout, length))
    join_parts(spark, b"", [head, *listed, *(with_size(f"{r.file}.tbi") for r in made), small("index-tail", gap + struct.pack("<Q", 0))], f"{path}.tbi")
    for name in os.listdir(parts):
        os.remove(f"{parts}/{name}")
    os.rmdir(parts)
    return sum(r.n for r in made)


#: Before a name's index in a part's file: the lengths of the name and of the index, and the name's place in a list, or 0.
MARK = "<iiq"
#: The index of a name without records.
NO_RECORDS = struct.pack("<ii", 0, 0)
#: A written part: its lines, its names and their bytes, and the place of the last one.
PART = "part long, file string, n long, refs long, length long, first string, last string, place long"


def with_size(file: str) -> tuple[str, int]:
    return file, os.path.getsize(file)


def contig_line(name: str) -> bytes:
    return f"##contig=<ID={name}>\n".encode()


def part_index(file: str) -> Iterator[tuple[str, int, Index]]:
    """(name, place, index) of the names of a part, one after the other."""
    with open(f"{file}.marks", "rb") as f:
        stream, at = Stream(f, 0), 0
        while stream.has(at + struct.calcsize(MARK)):
            name, body, place = struct.unpack(MARK, stream.bytes(at, at + struct.calcsize(MARK)))
            at += struct.calcsize(MARK)
            stream.has(at + name + body)
            yield stream.bytes(at, at + name).decode(), place, Index().read_body(stream.bytes(at + name, at + name + body), 0, 1)
            at += name + body
            stream.drop(at)
