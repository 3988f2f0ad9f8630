"""Media columns: ISO base media containers as binary columns.

`media_tracks` walks the nested boxes of each container, decodes the sample tables
(stts, stsc, stsz/stz2, stco/co64, stss) and gives codec, duration and the byte range
of every key frame. Payload bytes in mdat are never decoded: only box headers and
sample tables are read. `text_as_media` writes texts losslessly as 8-bit samples into
such a container and reads them back through the decoded sample table.

Samples of movie fragments (trex, tfhd and trun boxes) follow those of the sample tables.

Cases: a null media value gives no tracks; a truncated or malformed container gives a
row whose `error` says what is wrong, however deeply its boxes are nested; tracks without
stss have only sync samples, as the format defines; user data boxes aren't walked;
repeated rows give equal rows; a null id stays null; very long texts are stored whole; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, rows

#: Fixed values of the ISO base media file format: boxes that only hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}

#: One sample of the stored text is a row of 64 eight-bit grey pixels.
UNIT = 64
#: Samples in a chunk; the first of each chunk is marked as a sync sample.
CHUNK = 64
RATE = 25


class Malformed(ValueError):
    pass


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Type, start, body start and end of each box in data[start:end]."""
    while start < end:
        if end - start < 8:
            raise Malformed(f"box header cut at {start}")
        length, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if length == 1:
            if end - start < 16:
                raise Malformed(f"box header cut at {start}")
            (length,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif length == 0:
            length = end - start
        if kind == b"uuid":
            body += 16
        if length < body - start or start + length > end:
            raise Malformed(f"box {kind.decode('latin-1')} at {start} has length {length}")
        yield kind, start, body, start + length
        start += length


def numbers(data: memoryview, at: int, end: int, count: int, code: str) -> tuple:
    """count big-endian numbers of a full box's table."""
    if count * struct.calcsize(">" + code) > end - at:
        raise Malformed("a sample table is longer than its box")
    return struct.unpack_from(f">{count * len(code)}{code[0]}", data, at)


def decode_table(data: memoryview, kind: bytes, at: int, end: int, track: dict) -> None:
    """Reads what one leaf box says about a track."""
    head = lambda n: data[at : at + n] if end - at >= n else _cut(kind)
    if kind == b"tkhd":
        wide = head(24)[0] == 1
        (track["track_id"],) = struct.unpack_from(">I", data, at + (20 if wide else 12))
    elif kind == b"mdhd":
        wide = head(24)[0] == 1
        track["timescale"], track["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
    elif kind == b"hdlr":
        track["handler"] = bytes(head(12)[8:12]).decode("latin-1")
    elif kind == b"stsd":
        (count,) = struct.unpack_from(">I", head(8), 4)
        track["codecs"] = [bytes(k).decode("latin-1") for k, *_ in boxes(data, at + 8, end)][:count]
    elif kind == b"stsz":
        size, count = struct.unpack_from(">II", head(12), 4)
        track["sizes"] = (size, count) if size else numbers(data, at + 12, end, count, "I")
        track["uniform"] = bool(size)
    elif kind == b"stz2":
        bits, count = head(12)[7], struct.unpack_from(">I", head(12), 8)[0]
        if bits == 4:
            packed = bytes(data[at + 12 : end])
            track["sizes"] = tuple(x for b in packed for x in (b >> 4, b & 15))[:count]
        else:
            track["sizes"] = numbers(data, at + 12, end, count, "B" if bits == 8 else "H")
        track["uniform"] = False
    elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
        (count,) = struct.unpack_from(">I", head(8), 4)
        code = {b"stts": "II", b"stsc": "III", b"stss": "I", b"stco": "I", b"co64": "Q"}[kind]
        track["stco" if kind == b"co64" else kind.decode()] = numbers(data, at + 8, end, count, code)


def _cut(kind: bytes):
    raise Malformed(f"box {kind.decode('latin-1')} is cut")


#: Fixed values of the format: flags of tfhd and trun, and the sample flag of a non-sync sample.
BASE, INDEX, DURATION, SIZE, FLAGS, FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
RUN_OFFSET, RUN_FIRST, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NON_SYNC = 0x10000


class Fields:
    """Big-endian numbers of a box, one after the other."""

    def __init__(self, data: memoryview, kind: bytes, at: int, end: int):
        self.data, self.kind, self.at, self.end = data, kind, at, end

    def take(self, code: str = "I") -> int:
        size = struct.calcsize(">" + code)
        if self.at + size > self.end:
            _cut(self.kind)
        (value,) = struct.unpack_from(">" + code, self.data, self.at)
        self.at += size
        return value


class Movie:
    """What the boxes of a container say: tracks, defaults of fragments, and their runs."""

    def __init__(self, data: memoryview):
        self.data, self.tracks, self.defaults, self.runs = data, [], {}, []
        self.moof = self.next = 0
        self.head: dict = {}

    def walk(self) -> "Movie":
        """Walks nested boxes, with the open ones on a stack."""
        stack = [boxes(self.data, 0, len(self.data))]
        while stack:
            found = next(stack[-1], None)
            if found is None:
                stack.pop()
                continue
            kind, start, at, stop = found
            if kind == b"trak":
                self.tracks.append({})
            elif kind == b"moof":
                self.moof = self.next = start
            elif kind == b"traf":
                self.head = {}
            if kind in CONTAINERS:
                stack.append(boxes(self.data, at, stop))
            elif kind in (b"trex", b"tfhd", b"trun"):
                getattr(self, kind.decode())(Fields(self.data, kind, at, stop))
            elif self.tracks:
                decode_table(self.data, kind, at, stop, self.tracks[-1])
        return self

    def trex(self, box: Fields) -> None:
        _, track, _, duration, size, flags = (box.take() for _ in range(6))
        self.defaults[track] = {"duration": duration, "size": size, "flags": flags}

    def tfhd(self, box: Fields) -> None:
        flags = box.take() & 0xFFFFFF
        track = box.take()
        self.head = {"track": track} | self.defaults.get(track, {"duration": 0, "size": 0, "flags": 0})
        base = box.take("Q") if flags & BASE else self.moof if flags & FROM_MOOF else self.next
        if flags & INDEX:
            box.take()
        for flag, name in ((DURATION, "duration"), (SIZE, "size"), (FLAGS, "flags")):
            if flags & flag:
                self.head[name] = box.take()
        self.head["base"] = self.next = base

    def trun(self, box: Fields) -> None:
        if "track" not in self.head:
            raise Malformed("a run without its header")
        flags, head = box.take() & 0xFFFFFF, self.head
        count = box.take()
        at = head["base"] + box.take("i") if flags & RUN_OFFSET else self.next
        first = box.take() if flags & RUN_FIRST else None
        own = [f for f in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_SHIFT) if flags & f]
        if 4 * len(own) * count > box.end - box.at:
            raise Malformed("a run is longer than its box")
        if not own and count > len(self.data):
            raise Malformed("a run has more samples than the file bytes")
        for i in range(count):
            said = {f: box.take() for f in own}
            size, bits = said.get(RUN_SIZE, head["size"]), said.get(RUN_FLAGS, head["flags"])
            if i == 0 and first is not None:
                bits = first
            self.runs.append((head["track"], at, size, not bits & NON_SYNC, said.get(RUN_DURATION, head["duration"])))
            at += size
        self.next = at


def sample_ranges(track: dict) -> Iterator[tuple[int, int]]:
    """Offset and size of each sample, from the chunk and size tables."""
    offsets, runs, sizes = track.get("stco", ()), track.get("stsc", ()), track.get("sizes", (0, 0))
    uniform = track.get("uniform", True)
    total = sizes[1] if uniform else len(sizes)
    sample, run = 0, 0
    for chunk, offset in enumerate(offsets, 1):
        while 3 * (run + 1) < len(runs) and runs[3 * (run + 1)] <= chunk:
            run += 1
        if not runs:
            raise Malformed("stsc is missing")
        for _ in range(min(runs[3 * run + 1], total - sample)):
            length = sizes[0] if uniform else sizes[sample]
            yield offset, length
            offset += length
            sample += 1
    if sample < total:
        raise Malformed(f"chunks hold {sample} of {total} samples")


def read_tracks(media: bytes) -> list[dict]:
    """Tracks of a container: id, handler, codec, timescale, duration, n_samples,
    n_bytes and keyframes as (offset, length)."""
    movie = Movie(memoryview(media)).walk()
    fragments: dict[int, list] = {}
    for track, *run in movie.runs:
        fragments.setdefault(track, []).append(run)
    if not set(fragments) <= {t.get("track_id") for t in movie.tracks}:
        raise Malformed("a fragment of an unknown track")
    found = []
    for track in movie.tracks:
        sync = set(track["stss"]) if "stss" in track else None
        own = fragments.get(track.get("track_id"), [])
        samples = ((o, n, sync is None or i in sync) for i, (o, n) in enumerate(sample_ranges(track), 1))
        keys, count, volume = [], 0, 0
        for count, (offset, length, key) in enumerate(chain(samples, ((o, n, k) for o, n, k, _ in own)), 1):
            if offset < 0 or offset + length > len(media):
                raise Malformed(f"sample {count} ends beyond the file")
            volume += length
            if key:
                keys.append((offset, length))
        deltas = track.get("stts", ())
        ticks = sum(n * d for n, d in zip(deltas[::2], deltas[1::2])) + sum(d for *_, d in own)
        found.append(
            {
                "track_id": track.get("track_id"), "handler": track.get("handler"), "codec": ",".join(track.get("codecs", [])),
                "timescale": track.get("timescale"), "duration": track.get("duration") or (ticks if own else track.get("duration")), "ticks": ticks,
                "n_samples": count, "n_bytes": volume, "keyframes": keys, "track": track,
            }
        )
    return found


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, b"\0\0\0\0", *parts)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and UTF-8 bytes, padded with 0 to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def write_container(payload: bytes) -> bytes:
    """A container with one grey 8-bit raw video track of 64-pixel rows."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    matrix = u(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", UNIT, 1), u(0x480000, 0x480000, 0),
        struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1),
    )
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)] if chunks > 1 else [(1, n, 1)]
    sync = range(1, n + 1, CHUNK)

    def moov(base: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", u(1), entry),
            full(b"stts", u(1, n, 1)),
            full(b"stss", u(len(sync), *sync)),
            full(b"stsc", u(len(runs)), *(u(*r) for r in runs)),
            full(b"stsz", u(UNIT, n)),
            full(b"co64", u(chunks), struct.pack(f">{chunks}Q", *(base + UNIT * CHUNK * i for i in range(chunks)))),
        )
        return box(
            b"moov",
            full(b"mvhd", u(0, 0, RATE, n, 0x10000), struct.pack(">H", 0x100), bytes(10), matrix, bytes(24), u(2)),
            box(
                b"trak",
                full(b"tkhd", u(0, 0, 1, 0, n), bytes(8), bytes(8), matrix, u(UNIT << 16, 1 << 16)),
                box(
                    b"mdia",
                    full(b"mdhd", u(0, 0, RATE, n), struct.pack(">HH", 0x55C4, 0)),
                    full(b"hdlr", u(0), b"vide", bytes(12), b"text\0"),
                    box(
                        b"minf",
                        full(b"vmhd", bytes(8)),
                        box(b"dinf", full(b"dref", u(1), full(b"url "))),
                        table,
                    ),
                ),
            ),
        )

    first = box(b"ftyp", b"isom", u(0x200), b"isomiso2")
    base = len(first) + len(moov(0)) + 16
    return b"".join([first, moov(base), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload])


def stored_payload(media: bytes, track: dict) -> bytes:
    """The samples of a track in decoding order, merged over adjoining ranges."""
    view, out, begin, end = memoryview(media), [], 0, 0
    for offset, length in sample_ranges(track):
        if offset != end:
            out.append(view[begin:end])
            begin = offset
        end = offset + length
    return b"".join([*out, view[begin:end]])


def feature_of(track: dict) -> str:
    keys = ",".join(f"{o}+{n}" for o, n in track["keyframes"])
    return f"codec={track['codec']};timescale={track['timescale']};duration={track['duration']};samples={track['n_samples']};keyframes={len(track['keyframes'])};ranges={keys}"


TRACKS = "id long, track_id long, handler string, codec string, timescale long, duration long, seconds double, n_samples long, n_bytes long, keyframes array<struct<start:long,length:long>>, error string"


def media_tracks(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per track of each container (columns of TRACKS); a container that can't
    be read gives one row with `error`; a null one gives none."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(TRACKS))

    def read(batches):
        sink = Sink(schema)
        for key, media in rows(batches):
            if media is None:
                continue
            try:
                for t in read_tracks(bytes(media)):
                    seconds = t["duration"] / t["timescale"] if t["timescale"] and t["duration"] is not None else None
                    keys = [{"start": o, "length": n} for o, n in t["keyframes"]]
                    sink.add(key, t["track_id"], t["handler"], t["codec"], t["timescale"], t["duration"], seconds, t["n_samples"], t["n_bytes"], keys, None, weight=16 * len(keys))
            except (Malformed, struct.error, KeyError) as e:
                sink.add(key, *[None] * 9, str(e))
            if sink.full():
                yield sink.take()
        yield sink.take()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(read, TRACKS)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text (null: empty) in a container and reads it back.

    Columns of STORED: the payload figures come from the bytes read back through the
    decoded sample table. Equal texts give equal values; one row per input row."""

    def store(batches):
        names = [(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in STORED.split(", ")]
        sink = Sink(pa.schema(names))
        for key, text in rows(batches):
            n, payload = payload_of(text)
            media = write_container(payload)
            (track,) = read_tracks(media)
            back = stored_payload(media, track["track"])
            sink.add(
                key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), feature_of(track),
            )
            if sink.full():
                yield sink.take()
        yield sink.take()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, STORED)


def oracle_sql() -> str:
    """DuckDB SQL for text_as_media(): the container is put together from hexadecimal digits.
    A part is a pair of SQL expressions, its digits and its size in bytes."""

    def number(x, width: int = 4) -> tuple[str, str]:
        return f"format('{{:0{2 * width}x}}', CAST({x} AS BIGINT))", str(width)

    def fixed(raw: bytes) -> tuple[str, str]:
        return f"'{raw.hex()}'", str(len(raw))

    def joined(parts) -> tuple[str, str]:
        return " || ".join(p[0] for p in parts), "(" + " + ".join(p[1] for p in parts) + ")"

    def boxed(kind: bytes, *parts) -> tuple[str, str]:
        digits, size = joined(parts)
        return f"{number(f'8 + {size}')[0]} || '{kind.hex()}' || {digits}", f"(8 + {size})"

    def whole(kind: bytes, *parts) -> tuple[str, str]:
        return boxed(kind, fixed(bytes(4)), *parts)

    def listed(each: str, count: str, width: int) -> tuple[str, str]:
        return f"coalesce(array_to_string(list_transform(range({count}), lambda i: {number(each, width)[0]}), ''), '')", f"({width} * {count})"

    u = lambda *x: fixed(struct.pack(f">{len(x)}I", *x))
    matrix, rate = u(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000), u(RATE)
    n, chunks = number("n"), number("chunks")
    entry = boxed(b"raw ", fixed(bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HH", UNIT, 1) + struct.pack(">3I", 0x480000, 0x480000, 0) + struct.pack(">H", 1) + bytes(32) + struct.pack(">Hh", 40, -1)))
    one, more = u(1, CHUNK, 1), joined([u(1, CHUNK, 1), chunks, number(f"n % {CHUNK}"), u(1)])
    few = joined([u(1), n, u(1)])
    runs = (f"CASE WHEN n % {CHUNK} = 0 THEN {one[0]} WHEN chunks > 1 THEN {more[0]} ELSE {few[0]} END", "(12 * runs)")
    table = boxed(
        b"stbl", whole(b"stsd", u(1), entry), whole(b"stts", u(1), n, u(1)), whole(b"stss", chunks, listed(f"1 + {CHUNK} * i", "chunks", 4)),
        whole(b"stsc", number("runs"), runs), whole(b"stsz", u(UNIT), n), whole(b"co64", chunks, listed(f"base + {UNIT * CHUNK} * i", "chunks", 8)),
    )
    moov = boxed(
        b"moov", whole(b"mvhd", u(0, 0), rate, n, u(0x10000), fixed(struct.pack(">H", 0x100) + bytes(10)), matrix, fixed(bytes(24)), u(2)),
        boxed(
            b"trak", whole(b"tkhd", u(0, 0, 1, 0), n, fixed(bytes(16)), matrix, u(UNIT << 16, 1 << 16)),
            boxed(
                b"mdia", whole(b"mdhd", u(0, 0), rate, n, fixed(struct.pack(">HH", 0x55C4, 0))), whole(b"hdlr", u(0), fixed(b"vide" + bytes(12) + b"text\0")),
                boxed(b"minf", whole(b"vmhd", fixed(bytes(8))), boxed(b"dinf", whole(b"dref", u(1), whole(b"url ", fixed(b"")))), table),
            ),
        ),
    )
    first = boxed(b"ftyp", fixed(b"isom" + struct.pack(">I", 0x200) + b"isomiso2"))
    head = joined([first, moov, u(1), fixed(b"mdat"), number("16 + payload_bytes", 8)])
    steps = []
    for c in range(16):  # a digit at a time of the checksum
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    keys = f"array_to_string(list_transform(range(chunks), lambda i: CAST(base + {UNIT * CHUNK} * i AS VARCHAR) || '+{UNIT}'), ',')"
    return f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS raw FROM documents),
p AS (SELECT doc_id, len(raw) // 2 AS n_bytes, raw || repeat('0', CASE WHEN raw = '' THEN {2 * UNIT} ELSE (-len(raw)) % {2 * UNIT} + CASE WHEN len(raw) % {2 * UNIT} > 0 THEN {2 * UNIT} ELSE 0 END END) AS pad FROM t),
c AS (SELECT *, len(pad) // 2 AS payload_bytes, len(pad) // {2 * UNIT} AS n, (len(pad) // {2 * UNIT} + {CHUNK - 1}) // {CHUNK} AS chunks FROM p),
r AS (SELECT *, CASE WHEN n % {CHUNK} > 0 AND chunks > 1 THEN 2 ELSE 1 END AS runs FROM c),
b AS (SELECT *, {first[1]} + {moov[1]} + 16 AS base FROM r),
m AS (SELECT *, {head[0]} || pad AS media, list_transform(range(128), lambda i: instr('0123456789abcdef', substr(pad, len(pad) - 127 + i + CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END, 1)) - 1) AS digits FROM b)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(unhex(pad)) AS payload_sha256,
  xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda a, x: xor(a >> 4, ({steps}::BIGINT[])[1 + (xor(a, x) & 15)])), 4294967295::BIGINT) AS tail_crc32,
  CAST(len(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'codec=raw ;timescale={RATE};duration=' || n || ';samples=' || n || ';keyframes=' || chunks || ';ranges=' || {keys} AS feature
FROM m"""
