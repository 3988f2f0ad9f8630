"""Suffix-array deduplication: byte strings of a fixed length that also start in an
earlier document, found by bucket-pointer refinement of sampled suffixes.

A bucket identifier names all suffixes with the same first q bytes. Identifiers of
longer prefixes are made from those already known, as in bucket-pointer refinement: the
bucket of 2q bytes at p is named by the q-byte buckets at p and at the later offset
p + q, and each level reuses the level before (1, 2, 4, 8, 16, then 24, 32 and 50
bytes). Names depend on content alone, so equal buckets get equal names on every
executor, and buckets are refined only while they hold more than one document:

1. Of each 50-byte string one suffix represents its bucket: that with the least 24-byte
   identifier inside (equal strings choose equally). Consecutive strings with the same
   representative form a run. Runs whose 24-byte bucket occurs in one document leave.
2. The others are refined by the identifier of the whole run, made from the 32-byte
   identifiers at later offsets. A run that a smaller document has is covered.
3. Where a 24-byte bucket has split in step 2, the first document of each part refines
   every string of the run to its 50-byte identifier, from 32-byte identifiers at
   offsets 0 and 18.

Texts are packed once into compressed units of some megabytes, in a table bucketed by
unit in the shared warehouse. Each step sends sorted identifiers, combined for each
unit, to their hash bucket, and gets one bit for each back; only these bits are joined
with the units. So a passage in a third of all documents is one entry for each unit.

Result: exactly the bytes covered by a `width`-byte string that also starts in a
document with a smaller id. Identifiers have 64 bits and are compared only inside equal
24-byte buckets, which are named by 64 others.

Cases: null and empty texts keep nothing and have no spans; documents shorter than
`width` lose nothing; repeated rows of one id don't cover each other; a null id counts
as larger than all others (rows with the largest long count as rows of a null id do, and
keep their id); a very long text is a unit of its own; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH, GRAM = 50, 24
_SPAN = WIDTH - GRAM + 1  # 24-byte buckets in a 50-byte string
_SLICE = 1 << 16
_random = np.random.default_rng(1_000_003)
_BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _random.integers(0, 2**63, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_LAST = np.iinfo(np.int64).max


def mixed(x: np.ndarray, level: int) -> np.ndarray:
    x = x ^ (x >> _HALF)
    x *= _ODD[level]
    x ^= x >> _HALF
    return x


def refined(first: np.ndarray, later: np.ndarray, level: int) -> np.ndarray:
    """Names of longer buckets from the names at an offset and at a later one."""
    return mixed(first * _ODD[level] + later, level)


class Unit:
    """The runs of the documents of one unit."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes, keep_names: bool):
        self.ids, self.lengths = ids, lengths
        self.starts = np.cumsum(lengths) - lengths
        self.data = np.frombuffer(data, dtype=np.uint8)
        n = len(self.data)
        valid = np.zeros(n + 1, dtype=bool)
        for start, length in zip(self.starts.tolist(), lengths.tolist()):
            if length >= WIDTH:
                valid[start : start + length - WIDTH + 1] = True
        self.names32 = np.zeros(n, dtype=np.uint64) if keep_names else None
        parts = [self.slice_runs(a, valid[a : min(a + _SLICE, n)]) for a in range(0, n, _SLICE)]
        empty = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64))
        self.start, self.count, self.bucket, self.run = (np.concatenate(x) for x in zip(empty, *parts))
        self.doc = ids[np.searchsorted(self.starts, self.start, side="right") - 1] if len(self.start) else np.empty(0, dtype=np.int64)

    def slice_runs(self, a: int, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, number of strings, 24-byte bucket and run identifier of the runs whose
        strings start in a slice. A run cut at a slice's end is two runs."""
        s = len(valid)
        x = self.data[a : a + s + WIDTH - 1]
        x = np.concatenate([x, np.zeros(s + WIDTH - 1 - len(x), dtype=np.uint8)])
        one = _BYTE[x]
        two = one[:-1] * _ODD[10] + one[1:]
        four = refined(two[:-2], two[2:], 1)
        eight = refined(four[:-4], four[4:], 2)
        sixteen = refined(eight[:-8], eight[8:], 3)
        gram = refined(sixteen[:-8], eight[16:], 4)
        name32 = refined(sixteen[:-16], sixteen[16:], 5)
        if self.names32 is not None:
            part = self.names32[a : a + len(name32)]
            part[:] = name32[: len(part)]
        least = gram
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: s], least[_SPAN - 16 : _SPAN - 16 + s])
        at = np.flatnonzero(valid)
        if not len(at):
            return at, at, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        start = at[first]
        if count.max() > _SPAN:  # equal buckets side by side: runs of bounded length
            parts = -(-count // _SPAN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + nth * _SPAN
            count = np.minimum(np.repeat(count, parts) - nth * _SPAN, _SPAN)
        run = refined(refined(name32[start], name32[start + 18], 6), name32[start + count + 17] + count.astype(np.uint64), 7)
        return start + a, count, least[start], run

    def string_names(self, at: np.ndarray) -> np.ndarray:
        """50-byte identifiers of the strings that start at these places."""
        return refined(self.names32[at], self.names32[at + 18], 8)


def packed(df: DataFrame, id_col: str, text_col: str, unit_bytes: int) -> DataFrame:
    """(unit, n, ids, unknown, lengths, data): whole texts, packed and compressed; `unknown`
    has a byte for each id, 1 for a null one."""
    from pyspark import TaskContext

    schema = pa.schema([("unit", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("unknown", pa.binary()), ("lengths", pa.binary()), ("data", pa.binary())])

    def run(batches):
        ids, unknown, texts, size, made = [], bytearray(), [], 0, TaskContext.get().partitionId() << 28
        squeeze = zstandard.ZstdCompressor(level=1)

        def unit():
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            row = [made, size, np.array(ids, dtype=np.int64).tobytes(), bytes(unknown), lengths.tobytes(), squeeze.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key = key.as_py()
                ids.append(_LAST if key is None else key)
                unknown.append(key is None)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= unit_bytes or len(ids) >= 50_000:
                    yield unit()
                    ids, unknown, texts, size, made = [], bytearray(), [], 0, made + 1
        if ids:
            yield unit()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "unit long, n long, ids binary, unknown binary, lengths binary, data binary"
    )


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(names, 9) >> _HALF) % np.uint64(buckets)


def combined(names: np.ndarray, more: np.ndarray | None, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorts pairs of names; gives the first index, the least and greatest document of
    each distinct pair, and the pair of each input entry."""
    order = np.lexsort((names,) if more is None else (more, names))
    n = names[order]
    new = np.ones(len(n), dtype=bool)
    new[1:] = n[1:] != n[:-1]
    if more is not None:
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    first = np.flatnonzero(new)
    pair = np.empty(len(n), dtype=np.int64)
    pair[order] = np.cumsum(new) - 1
    if not len(n):
        return first, doc, doc, pair
    return order[first], np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first), pair


class Refinement:
    """What a unit knows after each step, from the bits that came back."""

    def __init__(self, row: dict, buckets: int, step: int):
        data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=row["n"]) if row["n"] else b""
        ids, lengths = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["lengths"], dtype=np.int64)
        self.unknown = row["unknown"]
        self.unit, self.buckets = Unit(ids, lengths, data, keep_names=step >= 3), buckets
        self.bits: dict[int, dict[int, bytes]] = {}
        for r in row.get("replies") or []:
            self.bits.setdefault(r["kind"], {})[r["bucket"]] = r["bits"]
        u = self.unit
        # step 1: 24-byte buckets by a short name, with the hash bucket in front
        key = mixed(u.bucket, 9)
        short = ((key >> _HALF) % np.uint64(buckets)) << _HALF | key & _LOW
        first, low, high, self.of_short = combined(short, None, u.doc)
        self.short, self.local = short[first], low != high
        if step < 2:
            return
        shared = self.local | self.answer(1, self.short >> _HALF)
        # step 2: runs of shared buckets
        self.chosen = np.flatnonzero(shared[self.of_short])
        a, b, doc = u.bucket[self.chosen], u.run[self.chosen], u.doc[self.chosen]
        first, self.low, _, self.of_run = combined(a, b, doc)
        self.a, self.b = a[first], b[first]
        self.run_hash = bucket_of(self.a + self.b * _ODD[11], buckets)
        # the parts of each bucket in this unit: named, or 0 for more than one
        begin = np.flatnonzero(np.append(True, self.a[1:] != self.a[:-1])) if len(self.a) else np.empty(0, dtype=np.int64)
        parts = np.diff(np.append(begin, len(self.a)))
        self.whole, self.part = self.a[begin], np.where(parts > 1, np.uint64(0), self.b[begin] | np.uint64(1))
        self.whole_hash, self.of_whole = bucket_of(self.whole, buckets), np.repeat(np.arange(len(begin)), parts)
        if step < 3:
            return
        self.covered = self.answer(2, self.run_hash)
        split = (self.part == 0) | self.answer(3, self.whole_hash)
        # step 3: strings of the first document of a part
        open_run = (split[self.of_whole] & ~self.covered)[self.of_run] & (doc == self.low[self.of_run])
        picked = self.chosen[open_run]
        count = u.count[picked]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.at = np.repeat(u.start[picked], count) + nth
        self.at_doc = np.repeat(u.doc[picked], count)
        whole, name = np.repeat(u.bucket[picked], count), u.string_names(self.at)
        first, self.string_low, _, self.of_string = combined(whole, name, self.at_doc)
        self.c, self.d = whole[first], name[first]
        self.string_hash = bucket_of(self.c + self.d * _ODD[11], buckets)

    def answer(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """The bits that came back, in the order of the entries."""
        out = np.zeros(len(hashes), dtype=bool)
        order = np.argsort(hashes, kind="stable")
        groups, counts = np.unique(hashes, return_counts=True)
        at = 0
        for h, n in zip(groups.tolist(), counts.tolist()):
            out[order[at : at + n]] = np.unpackbits(np.frombuffer(self.bits[kind][h], dtype=np.uint8), count=n)
            at += n
        return out

    def questions(self, step: int) -> Iterator[tuple[int, int, bytes]]:
        """kind, hash bucket and entries (columns one after the other)."""
        if step == 1:
            sent = [(1, self.short >> _HALF, [(self.short & _LOW).astype(np.uint32)])]
        elif step == 2:
            sent = [(2, self.run_hash, [self.a, self.b, self.low]), (3, self.whole_hash, [self.whole, self.part])]
        else:
            sent = [(4, self.string_hash, [self.c, self.d, self.string_low])]
        for kind, hashes, columns in sent:
            order = np.argsort(hashes, kind="stable")
            groups, begin = np.unique(hashes[order], return_index=True)
            for h, a, b in zip(groups.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
                yield kind, int(h), b"".join(c[order[a:b]].tobytes() for c in columns)

    def results(self) -> Iterator[tuple[int, int, int, int, str]]:
        """Id, bytes, removed bytes, spans and digest of the kept bytes of each document."""
        u = self.unit
        runs = self.covered[self.of_run] | (u.doc[self.chosen] > self.low[self.of_run])
        picked = self.chosen[runs]
        strings = self.at[self.answer(4, self.string_hash)[self.of_string] | (self.at_doc > self.string_low[self.of_string])]
        edge = np.zeros(len(u.data) + 1, dtype=np.int64)
        np.add.at(edge, u.start[picked], 1)
        np.add.at(edge, u.start[picked] + u.count[picked] + WIDTH - 1, -1)
        np.add.at(edge, strings, 1)
        np.add.at(edge, strings + WIDTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for key, unknown, start, length in zip(u.ids.tolist(), self.unknown, u.starts.tolist(), u.lengths.tolist()):
            mask, data = gone[start : start + length], u.data[start : start + length]
            removed = int(mask.sum())
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            kept = data[~mask] if removed else data
            yield (None if unknown else key), length, removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()


def replies_of(kind: int, entries: list[bytes]) -> list[bytes]:
    """One bit for each entry of each unit. Kind 1: another unit has the name. Kinds 2
    and 4: a unit has the pair with a smaller document. Kind 3: units differ in the part."""
    if kind == 1:
        sizes = [len(e) // 4 for e in entries]
        names = np.concatenate([np.frombuffer(e, dtype=np.uint32) for e in entries])
        order = np.argsort(names, kind="stable")
        n = names[order]
        same = np.zeros(len(n) + 1, dtype=bool)
        same[1:-1] = n[1:] == n[:-1]
        yes = np.empty(len(n), dtype=bool)
        yes[order] = same[1:] | same[:-1]
    elif kind == 3:
        sizes = [len(e) // 16 for e in entries]
        names = np.concatenate([np.frombuffer(e, dtype=np.uint64, count=s) for e, s in zip(entries, sizes)])
        parts = np.concatenate([np.frombuffer(e, dtype=np.uint64, offset=8 * s) for e, s in zip(entries, sizes)])
        first, low, high, of = combined(names, None, parts)
        yes = ((low != high) | (low == 0))[of]
    else:
        sizes = [len(e) // 24 for e in entries]
        names, more = (np.concatenate([np.frombuffer(e, dtype=np.uint64, offset=8 * s * k, count=s) for e, s in zip(entries, sizes)]) for k in (0, 1))
        doc = np.concatenate([np.frombuffer(e, dtype=np.int64, offset=16 * s) for e, s in zip(entries, sizes)])
        _, low, _, of = combined(names, more, doc)
        yes = doc > low[of]
    ends = np.cumsum(sizes)
    return [np.packbits(yes[e - s : e]).tobytes() for s, e in zip(sizes, ends)]


ASKED = "kind int, bucket long, unit long, entries binary"
ANSWERED = "unit long, kind int, bucket long, bits binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = 4 << 20, bucket_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: columns of RESULT. Units lie in as many buckets as the session
    has shuffle partitions, and in more where the input's files (by the planner's estimate)
    have more than `task_bytes` for each, so that a task's share doesn't grow with the input."""
    spark = df.sparkSession
    table = f"suffix_units_{uuid.uuid4().hex}"
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if estimate < 1 << 60:  # beyond that the planner knows nothing
        parts = max(parts, min(estimate // task_bytes, 100_000))
    packed(df, id_col, text_col, unit_bytes).repartition(parts, "unit").write.bucketBy(parts, "unit").format("parquet").saveAsTable(table)
    units = spark.table(table)
    buckets = max(1, -(-(units.agg(F.sum("n")).first()[0] or 0) // bucket_bytes))

    def joined(replies: list[DataFrame]) -> DataFrame:
        if not replies:
            return units
        union = replies[0]
        for r in replies[1:]:
            union = union.union(r)
        by_unit = union.groupBy("unit").agg(F.collect_list(F.struct("kind", "bucket", "bits")).alias("replies"))
        return units.join(by_unit, "unit", "left")

    def asked(step: int, replies: list[DataFrame]) -> DataFrame:
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("unit", pa.int64()), ("entries", pa.binary())])

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    sent = list(Refinement(row, buckets, step).questions(step))
                    for at in range(0, len(sent), 1000):
                        kinds, hashes, entries = zip(*sent[at : at + 1000])
                        columns = [pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array([row["unit"]] * len(kinds), pa.int64()), pa.array(entries, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return joined(replies).mapInArrow(run, ASKED)

    def answered(questions: DataFrame) -> DataFrame:
        schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary())])

        def run(table: pa.Table) -> pa.Table:
            kind = table.column("kind")[0].as_py()
            bits = replies_of(kind, table.column("entries").to_pylist())
            return pa.Table.from_arrays([table.column("unit"), table.column("kind"), table.column("bucket"), pa.array(bits, pa.binary())], schema=schema)

        return written(questions.groupBy("kind", "bucket").applyInArrow(run, ANSWERED), "suffix-bits")

    def finished(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                columns = list(zip(*Refinement(row, buckets, 3).results()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    try:
        replies: list[DataFrame] = []
        for step in (1, 2, 3):
            replies.append(answered(asked(step, replies)))
        return written(joined(replies).mapInArrow(finished, RESULT), "suffix-result")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


#: DuckDB SQL for remove_repeats(): every 50-byte string of every document, in hexadecimal
#: digits, cut from blocks so that no long text is walked for each of them.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
blocks AS (SELECT k, doc_id, b * 250 AS base, substr(h, 500 * b + 1, 598) AS part FROM (SELECT k, doc_id, h, unnest(range(0, greatest((len(h) // 2 - 49 + 249) // 250, 0))) AS b FROM d)),
every AS (SELECT k, doc_id, base + i AS pos, substr(part, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, len(part) // 2 - 49)) AS i FROM blocks)),
many AS MATERIALIZED (SELECT hash(s) AS x FROM every GROUP BY x HAVING count(*) > 1),
p AS MATERIALIZED (SELECT * FROM every WHERE hash(s) IN (SELECT x FROM many)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING count(*) > 1),
c AS (SELECT k, pos FROM p JOIN f USING (s) WHERE first < doc_id OR (doc_id IS NULL AND first IS NOT NULL)),
n AS (SELECT k, pos, CASE WHEN pos > lag(pos, 1, -100) OVER (PARTITION BY k ORDER BY pos) + 50 THEN 1 ELSE 0 END AS new FROM c),
g AS (SELECT k, pos, sum(new) OVER (PARTITION BY k ORDER BY pos) AS span FROM n),
s AS (SELECT k, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY k, span),
r AS (SELECT s.k, a, b, substr(h, 2 * lag(b, 1, 0) OVER (PARTITION BY s.k ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY s.k ORDER BY a))) AS before FROM s JOIN d ON d.k = s.k),
e AS (SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(before, '' ORDER BY a) AS kept, max(b) AS last FROM r GROUP BY k)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN e USING (k)"""
