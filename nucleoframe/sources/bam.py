"""BAM as a Python data source (format "nucleo_bam"), by the public format alone.

BGZF is a series of gzip members (blocks) that state their length. A file is divided into
ranges of bytes, one partition each: a partition has the records that start in the blocks
that start in its range. The first one is found by the fields of a record: references,
positions, name, CIGAR and lengths must be possible, and so must the records behind it.
Records are decoded as a stream, and only those columns that the option `columns` names; rows
come as Arrow batches. Of an indexed file only the blocks of the wanted references are read."""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schemas
from .bgzf import END, BlockWriter, Stream, first_block, join_parts
from .binning import LAST_POSITION, Index, bin_of, read_bai
from .blocktext import PUSHDOWN, Region
from .files import opened, size_of

#: Fixed values of the format: letters of the packed sequence.
BASES = "=ACMGRSVTWYHKDBN"
#: CIGAR operators that move along the reference (M, D, N, =, X).
REFERENCE_OPS = frozenset((0, 2, 3, 7, 8))
#: Scores as printed characters.
SHIFTED = bytes((q + 33) & 255 for q in range(256))
_NUMBERS = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}


def read_tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Optional fields as text, and their types by the format's letters (B with its own)."""
    tags, types, at = {}, {}, 0
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), data[at + 2 : at + 3]
        types[tag] = kind.decode()
        at += 3
        if kind == b"A":
            tags[tag] = chr(data[at])
            at += 1
        elif kind in (b"Z", b"H"):
            end = data.index(b"\0", at)
            tags[tag] = data[at:end].decode()
            at = end + 1
        elif kind == b"B":
            code, (count,) = _NUMBERS[data[at : at + 1]], struct.unpack_from("<I", data, at + 1)
            types[tag] += data[at : at + 1].decode()
            values = struct.unpack_from(f"<{count}{code[1]}", data, at + 5)
            tags[tag] = ",".join(map(str, values))
            at += 5 + count * struct.calcsize(code)
        else:
            code = _NUMBERS[kind]
            tags[tag] = str(struct.unpack_from(code, data, at)[0])
            at += struct.calcsize(code)
    return tags, types


def tag_bytes(tag: str, value: str, kind: str) -> bytes:
    """An optional field; without a type it is text."""
    head = tag.encode() + kind[:1].encode()
    if kind == "A":
        return head + value.encode()
    if kind in ("Z", "H"):
        return head + value.encode() + b"\0"
    number = float if kind[-1] == "f" else int
    if kind[0] == "B":
        values = [number(v) for v in value.split(",") if v]
        return head + kind[1].encode() + struct.pack(f"<I{len(values)}{_NUMBERS[kind[1].encode()][1]}", len(values), *values)
    return head + struct.pack(_NUMBERS[kind.encode()], number(value))


def read_header(f) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the references."""
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", f.read(4))
    text = f.read(n).rstrip(b"\0").decode()
    (count,) = struct.unpack("<i", f.read(4))
    refs = []
    for _ in range(count):
        (n,) = struct.unpack("<i", f.read(4))
        name = f.read(n)[:-1].decode()
        refs.append((name, struct.unpack("<i", f.read(4))[0]))
    return text, refs


def decode(data: bytes, refs: list[tuple[str, int]], columns: list[str]) -> tuple:
    """The wanted columns of a record; what none of them needs isn't decoded."""
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, template = struct.unpack_from("<iiBBHHHiiii", data)
    at_cigar = 32 + n_name
    at_seq = at_cigar + 4 * n_cigar
    at_qual = at_seq + (n_seq + 1) // 2
    known, mate_known, out = ref >= 0, mate >= 0, []
    cigar = tags = None
    for c in columns:
        if c in ("cigar", "ref_length") and cigar is None:
            cigar = struct.unpack_from(f"<{n_cigar}I", data, at_cigar)
        if c in ("tags", "tag_types") and tags is None:
            tags = read_tags(data[at_qual + n_seq :])
        if c == "read_id":
            value = data[32 : 32 + n_name - 1].decode()
        elif c == "flag":
            value = flag
        elif c == "ref_name":
            value = refs[ref][0] if known else None
        elif c == "ref_start":
            value = pos if known else None
        elif c == "ref_length":
            value = sum([v >> 4 for v in cigar if v & 15 in REFERENCE_OPS]) if cigar else None
        elif c == "mapq":
            value = mapq
        elif c == "cigar":
            value = [{"op": v & 15, "len": v >> 4} for v in cigar] or None
        elif c == "seq":
            value = data[at_seq:at_qual].hex().translate(LETTERS)[:n_seq] or None
        elif c == "qual":
            qual = data[at_qual : at_qual + n_seq]
            value = None if not qual or qual[0] == 255 else qual.translate(SHIFTED).decode("latin-1")
        elif c == "tags":
            value = tags[0]
        elif c == "tag_types":
            value = tags[1]
        elif c == "mate_ref_name":
            value = refs[mate][0] if mate_known else None
        elif c == "mate_start":
            value = mate_pos if mate_known else None
        elif c == "template_length":
            value = template
        else:
            value = None
        out.append(value)
    return tuple(out)


class Records(Stream):
    """The stream of a BAM file's records."""

    def possible(self, at: int, refs: list[tuple[str, int]]) -> int | None:
        """Where the next record would start if one starts here, or None if none can."""
        if not self.has(at + 36):
            return None
        n, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", self.bytes(at, at + 36))
        if not (32 <= n <= 1 << 26 and n_name > 0 and n_seq >= 0 and n >= 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq):
            return None
        for r, p in ((ref, pos), (mate, mate_pos)):
            if not (-1 <= r < len(refs) and -1 <= p and (r < 0 or p < max(refs[r][1], 1))):
                return None
        if not self.has(at + 36 + n_name + 4 * n_cigar):
            return None
        name = self.bytes(at + 36, at + 36 + n_name)
        ops = self.bytes(at + 36 + n_name, at + 36 + n_name + 4 * n_cigar)[::4]
        if name[-1] or not all(33 <= c <= 126 for c in name[:-1]) or any(c & 15 > 8 for c in ops):
            return None
        return at + 4 + n

    def first_record(self, refs: list[tuple[str, int]], end: int) -> int | None:
        """The first record's beginning in the blocks before `end`: five possible records in
        a row, or as many as the file has."""
        at = self.base
        while self.has(at + 1) and self.block_of(at) < end:
            following, seen = at, 0
            while seen < 5 and following is not None and self.has(following + 1):
                following, seen = self.possible(following, refs), seen + 1
            if following is not None:
                return at
            at += 1
        return None


def header_of(f) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, references, and where the first record starts in the stream."""
    stream, at = Records(f, 0), 0

    class Whole:
        def read(self, n: int) -> bytes:
            nonlocal at
            stream.has(at + n)
            at += n
            return stream.bytes(at - n, at)

    return *read_header(Whole()), at


def records(path: str, start: int, end: int, columns: list[str]) -> Iterator[tuple]:
    """The wanted columns of the records that start in the blocks between two offsets; `ord`
    is a record's virtual offset (that of its block, and the place in it)."""
    with opened(path) as f:
        size = f.seek(0, 2)
        _, refs, at = header_of(f)
        if start == 0:
            stream = Records(f, 0)
        else:
            stream = Records(f, first_block(f, start, size))
            at = stream.first_record(refs, end)
            if at is None:
                return
        yield from walk(stream, at, refs, columns, end << 16)


def chunk_records(path: str, begin: int, stop: int, columns: list[str]) -> Iterator[tuple]:
    """The wanted columns of the records between two virtual offsets, the first of which is a record's."""
    with opened(path) as f:
        _, refs, _ = header_of(f)
        yield from walk(Records(f, begin >> 16), begin & 0xFFFF, refs, columns, stop)


def walk(stream: Records, at: int, refs: list[tuple[str, int]], columns: list[str], stop: int) -> Iterator[tuple]:
    number = columns.index("ord") if "ord" in columns else -1
    while stream.has(at + 4):
        block, place = stream.place(at)
        if block << 16 | place >= stop:
            return
        (n,) = struct.unpack("<i", stream.bytes(at, at + 4))
        if not stream.has(at + 4 + n):
            raise ValueError("the file ends inside a record")
        row = decode(stream.bytes(at + 4, at + 4 + n), refs, columns)
        yield row if number < 0 else (*row[:number], block << 16 | place, *row[number + 1 :])
        at += 4 + n
        stream.drop(at)


def whole_reads(path: str, start: int, end: int, columns: list[str]) -> Iterator[tuple]:
    """As records(), for a file in which the records of a read follow each other, with all records
    of a read in one range: that in which the record before its first one is. The first read
    of a range belongs to the range before, and the last one is read to its end."""
    wanted = [*columns, "ord", "read_id"]
    last, skip, inside = None, start > 0, None
    for row in records(path, start, 1 << 47, wanted):
        block, name = row[-2] >> 16, row[-1]
        if skip and last in (None, name):
            last = name
            inside = block
            continue
        if name != last and inside is not None and inside >= end:
            return  # the record before is behind the range
        skip, last, inside = False, name, block
        yield row[:-2]


#: Rows of a batch.
AT_ONCE = 4096


def as_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, AT_ONCE)):
        columns = [[v and list(v.items()) for v in c] if pa.types.is_map(f.type) else c for c, f in zip(zip(*held), schema)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Reader(DataSourceReader):
    """Whole files in splits or, where filters name references and a file has an index beside it,
    the chunks of the index that hold them."""

    def __init__(self, paths: list[str], schema: StructType, split: int, grouped: bool):
        self.paths, self.schema, self.split, self.grouped, self.region = paths, schema, split, grouped, Region()

    def pushFilters(self, filters):
        return self.region.push(filters, "ref_name", "ref_start")

    def partitions(self):
        out, region = [], self.region
        for path in self.paths:
            index = None if region.names is None or self.grouped else index_of(path)
            if index is None:
                out += [InputPartition((path, start, start + self.split, False)) for start in range(0, max(size_of(path), 1), self.split)]
                continue
            with opened(path) as f:
                names = [name for name, _ in header_of(f)[1]]
            first, last = region.first or 0, LAST_POSITION if region.last is None else region.last + 1
            for ref, name in enumerate(names):
                if name in region.names:
                    for chunk in index.chunks(ref, first, last):
                        out += [InputPartition((path, *part, True)) for part in index.cuts(ref, *chunk, self.split)]
        return out or [InputPartition(None)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.value is None:
            return iter(())
        *place, chunk = partition.value
        how = chunk_records if chunk else whole_reads if self.grouped else records
        return as_batches(how(*place, self.schema.names), to_arrow_schema(self.schema))


def index_of(path: str) -> Index | None:
    try:
        return read_bai(f"{path}.bai")
    except FileNotFoundError:
        return None


#: Letters of sequences as the hex digits of their codes; others are N.
DIGITS = bytes(b"0123456789abcdef"[BASES.index(chr(c).upper()) if c < 128 and chr(c).upper() in BASES else 15] for c in range(256))
LETTERS = str.maketrans("0123456789abcdef", BASES)
LOWERED = bytes((c - 33) & 255 for c in range(256))
FIXED = struct.Struct("<iiiBBHHHiiii")
small_tag = lru_cache(maxsize=4096)(tag_bytes)


def packed_sequence(seq: str) -> bytes:
    digits = seq.encode("latin-1", "replace").translate(DIGITS)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def packed_quality(qual: str) -> bytes:
    data = qual.encode("latin-1")
    if min(data) < 33:
        raise ValueError(f"{qual!r} has a quality below 0")
    return data.translate(LOWERED)


def encoded(batch: pa.RecordBatch, refs: dict[str, int]) -> Iterator[tuple[bytes, int, int, int]]:
    """(bytes, number of the reference, start, end) of each record of a batch with all columns. Tags
    have their types, text where none is given; mate fields that aren't there are those of a
    record without a mate. Lists and maps are taken apart as flat columns, which is most of the time."""
    flat = {c: batch.column(c).to_pylist() for c in ("read_id", "flag", "ref_name", "ref_start", "ref_length", "mapq", "seq", "qual", "mate_ref_name", "mate_start", "template_length")}

    def bounds(column):
        at, there = column.offsets.to_pylist(), column.is_valid().to_pylist()
        return [(a, b) if t else (0, 0) for a, b, t in zip(at, at[1:], there)]

    cigar, tags, types = (batch.column(c) for c in ("cigar", "tags", "tag_types"))
    op, size = (np.asarray(cigar.values.field(k).fill_null(0), np.uint32) for k in ("op", "len"))
    ops = (size << 4 | op).astype("<u4").tobytes()
    keys, values = tags.keys.to_pylist(), tags.items.to_pylist()
    typed, kinds = types.keys.to_pylist(), types.items.to_pylist()
    for name, flag, ref_name, start, length, mapq, seq, qual, mate, mate_start, template, (c0, c1), (t0, t1), (k0, k1) in zip(*flat.values(), bounds(cigar), bounds(tags), bounds(types)):
        name, seq = name.encode() + b"\0", seq or ""
        packed = packed_sequence(seq) + (packed_quality(qual) if qual else b"\xff" * len(seq))
        if t1 > t0:
            kind = dict(zip(typed[k0:k1], kinds[k0:k1]))
            packed += b"".join([(small_tag if len(v) < 64 else tag_bytes)(k, v, kind.get(k) or "Z") for k, v in zip(keys[t0:t1], values[t0:t1])])
        ref, start = refs.get(ref_name, -1), -1 if start is None else start
        end = start + max(1, length or 1)
        body = name + ops[4 * c0 : 4 * c1] + packed
        head = FIXED.pack(
            32 + len(body), ref, start, len(name), mapq or 0, bin_of(start, end) if start >= 0 else 4680, c1 - c0, flag or 0, len(seq),
            refs.get(mate, -1), -1 if mate_start is None else mate_start, template or 0,
        )
        yield head + body, ref, start, end


def head_bytes(header: str, refs: list[tuple[str, int]]) -> bytes:
    """What is before the records."""
    text = header.encode()
    out = bytearray(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs)))
    for name, length in refs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return bytes(out)


def references(header: str) -> list[tuple[str, int]]:
    """(name, length) of the header's @SQ lines."""
    found = []
    for line in header.splitlines():
        if line.startswith("@SQ"):
            fields = dict(x.split(":", 1) for x in line.split("\t")[1:])
            found.append((fields["SN"], int(fields["LN"])))
    return found


def write_batches(path: str, header: str, refs: list[tuple[str, int]], batches) -> int:
    """Writes BGZF blocks; gives the number of records."""
    numbers, n = {name: i for i, (name, _) in enumerate(refs)}, 0
    with open(path, "wb") as f:
        out = BlockWriter(f)
        out.write(head_bytes(header, refs))
        for batch in batches:
            for data, *_ in encoded(batch, numbers):
                out.write(data)
                n += 1
        out.flush()
        f.write(END)
    return n


TEXTS = pa.map_(pa.string(), pa.string())
COLUMN_TYPES = {
    "flag": pa.int32(), "ref_start": pa.int64(), "ref_length": pa.int32(), "mapq": pa.int32(), "cigar": pa.list_(pa.struct([("op", pa.int32()), ("len", pa.int32())])),
    "tags": TEXTS, "tag_types": TEXTS, "mate_start": pa.int64(), "template_length": pa.int32(),
}


def write_file(path: str, header: str, refs: list[tuple[str, int]], records) -> int:
    """The same of records as dictionaries, whose fields may be missing."""
    schema = pa.schema([(c, COLUMN_TYPES.get(c, pa.string())) for c in schemas.ALIGNMENT_COLUMNS if c != "ord"])
    whole = ({c: list(v.items()) if isinstance(v, dict) else v for c, v in r.items()} for r in records)

    def batches():
        while held := list(islice(whole, AT_ONCE)):
            yield pa.RecordBatch.from_pylist(held, schema)

    return write_batches(path, header, refs, batches())


class Writer(DataSourceArrowWriter):
    """One BAM file for each partition. Options: path (a folder in a store that all
    executors share as a file system), header (SAM header text with @SQ lines)."""

    def __init__(self, path: str, header: str):
        self.path, self.header = path, header

    def write(self, iterator):
        from pyspark import TaskContext

        refs = references(self.header)
        os.makedirs(self.path, exist_ok=True)
        part = TaskContext.get().partitionId()
        # a task that is run again writes the same name, and the finished file is moved in at once
        name = f"{self.path}/part-{part:05d}.bam"
        write_batches(f"{name}.{TaskContext.get().taskAttemptId()}", self.header, refs, iterator)
        os.replace(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        return WriterCommitMessage()


class BamSource(DataSource):
    """Options: paths (divided by commas), columns (those to decode into rows), split (the
    bytes of a file in one partition) and whole_reads (the records of a read follow each other
    in the files, and shall be in one partition)."""

    @classmethod
    def name(cls) -> str:
        return "nucleo_bam"

    def schema(self) -> str:
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or schemas.ALIGNMENT_COLUMNS
        return ", ".join(f"{c} {schemas.ALIGNMENT_COLUMNS[c]}" for c in wanted)

    def reader(self, schema):
        paths = [p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p]
        return Reader(paths, schema, int(self.options.get("split", 64 << 20)), self.options.get("whole_reads", "false") == "true")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], self.options.get("header", "@HD\tVN:1.6\n"))


def header_text(path: str) -> str:
    """The header of a file, which is all that is read of it."""
    with opened(path) as f:
        return header_of(f)[0]


def whole_header(path: str) -> str:
    """The header with a line for each reference that only the binary list names, for writing BAM."""
    with opened(path) as f:
        text, refs, _ = header_of(f)
    known = {name for name, _ in references(text)}
    missing = "".join(f"@SQ\tSN:{name}\tLN:{length}\n" for name, length in refs if name not in known)
    return (text if not missing or text.endswith("\n") or not text else text + "\n") + missing


def sort_order(path: str) -> str | None:
    """The sort order that the header states."""
    for line in header_text(path).splitlines():
        if line.startswith("@HD"):
            return dict(x.split(":", 1) for x in line.split("\t")[1:]).get("SO")
    return None


def read_bam(spark: SparkSession, *paths: str, columns: list[str] | None = None, split: int = 64 << 20, whole_reads: bool = False) -> DataFrame:
    """Records of files. A condition on ref_name (and ref_start) of a file that has an index beside it (.bai)
    reads only the blocks that the index names. With whole_reads the records of a read, which
    follow each other in the file, are in one partition."""
    spark.dataSource.register(BamSource)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("nucleo_bam").option("paths", ",".join(paths)).option("columns", ",".join(columns or []))
    return reader.option("split", split).option("whole_reads", str(whole_reads).lower()).load()


def read_region(spark: SparkSession, path: str, ref: str, start: int = 0, end: int = LAST_POSITION, columns: list[str] | None = None) -> DataFrame:
    """The records of an indexed file that reach into start..end-1 of a reference. The longest
    record before the region isn't known, so positions are cut only by what the index has."""
    held = list(dict.fromkeys([*(columns or schemas.ALIGNMENT_COLUMNS), "ref_name", "ref_start", "ref_length"]))
    spark.dataSource.register(RegionSource)
    found = spark.read.format("nucleo_bam_region").option("path", path).option("columns", ",".join(held)).option("ref", ref).option("start", start).option("end", end).load()
    reaches = F.col("ref_start") + F.greatest(F.coalesce("ref_length", F.lit(1)), F.lit(1)) > start
    found = found.where((F.col("ref_name") == ref) & (F.col("ref_start") < end) & reaches)
    return found.select(*(columns or schemas.ALIGNMENT_COLUMNS))


class RegionReader(Reader):
    """The chunks of one region; the index must be there."""

    def __init__(self, path: str, schema: StructType, split: int, ref: str, start: int, end: int):
        super().__init__([path], schema, split, False)
        self.place = (ref, start, end)

    #: The region comes with the options.
    pushFilters = DataSourceReader.pushFilters

    def partitions(self):
        (path,), (ref, start, end) = self.paths, self.place
        with opened(path) as f:
            names = [name for name, _ in header_of(f)[1]]
        if ref not in names:
            return [InputPartition(None)]
        index, number = read_bai(f"{path}.bai"), names.index(ref)
        out = [InputPartition((path, *part, True)) for chunk in index.chunks(number, start, end) for part in index.cuts(number, *chunk, self.split)]
        return out or [InputPartition(None)]


class RegionSource(BamSource):
    """Options: path (with an index beside it), columns, split, ref, start and end."""

    @classmethod
    def name(cls) -> str:
        return "nucleo_bam_region"

    def reader(self, schema):
        o = self.options
        return RegionReader(o["path"], schema, int(o.get("split", 64 << 20)), o["ref"], int(o.get("start", 0)), int(o.get("end", LAST_POSITION)))


def coordinate_sorted(alignments: DataFrame, header: str) -> DataFrame:
    """Records by reference, in the header's order, and start; those without a reference last.
    Spark deals them out by ranges, so part files of write_bam() follow each other."""
    names = [name for name, _ in references(header)]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.col("ref_name"))
    return alignments.orderBy(F.when(rank > 0, rank).asc_nulls_last(), "ref_start", "ord")


def whole_columns(alignments: DataFrame) -> DataFrame:
    """All columns of alignments; those that aren't there are missing values."""
    have = set(alignments.columns)
    return alignments.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in schemas.ALIGNMENT_COLUMNS.items()])


def write_sorted_bam(alignments: DataFrame, path: str, header: str) -> int:
    """One BAM file, sorted by coordinate, and its index (.bai); gives the number of records.
    Each task writes the blocks of its range and the index of its part, whose size is that of
    the references; the parts are joined as they are, behind one header and before one end
    block. The folder must be a file system that all executors mount."""
    spark, parts, refs = alignments.sparkSession, f"{path}.parts-{uuid.uuid4().hex}", references(header)
    os.makedirs(parts)
    numbers = {name: i for i, (name, _) in enumerate(refs)}

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, index, n = f"{parts}/{task.partitionId():05d}-{task.taskAttemptId()}", Index(), 0
        with open(name, "wb") as f:
            out = BlockWriter(f)
            for batch in batches:
                for data, ref, start, end in encoded(batch, numbers):
                    begin = out.tell()
                    out.write(data)
                    index.add(ref, start, end, begin, out.tell())
                    n += 1
            out.flush()
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": name, "size": os.path.getsize(name), "n": n, "marks": index.body(len(refs))}])

    dealt = coordinate_sorted(whole_columns(alignments), header)
    made = sorted(dealt.mapInArrow(write, "part long, file string, size long, n long, marks binary").collect())
    head = io.BytesIO()
    out = BlockWriter(head)
    out.write(head_bytes(header, refs))
    out.flush()
    places = join_parts(spark, head.getvalue(), [(r.file, r.size) for r in made], path)
    whole = Index()
    for r, at in zip(made, places):
        whole.append(Index().read_body(bytes(r.marks), 0, len(refs)), at)
    with open(f"{path}.bai", "wb") as f:
        f.write(whole.bai(len(refs)))
    for name in os.listdir(parts):
        os.remove(f"{parts}/{name}")
    os.rmdir(parts)
    return sum(r.n for r in made)


def write_bam(alignments: DataFrame, path: str, header: str) -> None:
    """One BAM file for each partition, with this header. Columns that aren't there are
    missing values of the records."""
    alignments.sparkSession.dataSource.register(BamSource)
    whole_columns(alignments).write.format("nucleo_bam").option("path", path).option("header", header).mode("append").save()
