"""Compression of vectors to short codes: each of 16 parts is named by its nearest codebook entry.

Components become integers, floor(256 x). The nearest entry is found coarse to fine: vectors
and entries are cut into blocks, 1, 2, 4 and so on, and what the blocks' means and the norm of
what they leave over (the residual) say is a lower bound of the distance, by the inequality of
Cauchy and Schwarz. An entry stays as long as its bound, rounded downwards, isn't above the
exact distance of the entry that seemed nearest; entries that stay to the end get exact integer
distances. No entry that is nearest, or as near, is lost.

Codebooks begin as the parts of the 64 rows with the least ids and are refined in rounds: tasks
sum up the parts of each entry, the shuffle adds these sums, and only the sums of entries, whose
number is fixed, reach the driver. All sums are exact, in digits of 32 bits.

Cases: rows whose vector is null or holds a null or a number that isn't finite are left out.
Rows of an id are all coded; the least of their vectors is the one that may begin a codebook.
Null ids come after all others and stay null. Vectors are filled up with zeros to the length of the longest,
and that to a multiple of 16; an empty vector is all zeros. With fewer than 64 ids, codebooks
are smaller. Components of any finite size are exact; an error beyond a long is the largest
long. An empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, quoted, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Integers up to this size are worked on as 64-bit numbers: the squares of a part's bounds fit
#: for parts of 256 components. Larger ones are Python's integers, without bounds.
SMALL = 1 << 22
LONGEST = (1 << 63) - 1
DIGIT = 32


def kept_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have a vector that counts, all components, and the rows' bounds in them."""
    column = column.cast(pa.list_(pa.float64()))
    bounds = column.offsets.to_numpy().astype(np.int64)
    numbers = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(there & (bad[bounds[1:]] == bad[bounds[:-1]])), numbers, bounds


def integer(x: float) -> int:
    """floor(256 x), exactly; a product that leaves the range of doubles is an integer before."""
    return int(x) * 256 if abs(x) > 2.0**60 else math.floor(x * 256)


def matrix(kept: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """The vectors as rows of integers: int64 if all are small, else Python's integers."""
    lengths = bounds[kept + 1] - bounds[kept]
    rows = np.zeros((len(kept), width))
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rows[np.repeat(np.arange(len(kept)), lengths), at] = numbers[np.repeat(bounds[kept], lengths) + at]
    if not rows.size or np.abs(rows).max() < SMALL / 256:
        return np.floor(rows * 256).astype(np.int64)
    return np.array([[integer(x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


class Book:
    """The entries of one part, with their block sums and residuals at each level."""

    def __init__(self, entries: list[list[int]]):
        big = max((abs(x) for e in entries for x in e), default=0) >= SMALL
        self.entries = np.array(entries, dtype=object if big else np.int64)
        width = self.entries.shape[1]
        self.levels = []
        blocks = 1
        while not big and width <= 256 and blocks < width:
            cuts = np.array([k * width // blocks for k in range(blocks)])
            self.levels.append((cuts, np.diff(np.append(cuts, width)), *self.blocks(self.entries, cuts)))
            blocks *= 2

    @staticmethod
    def blocks(rows: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block sums, and from below and from above the norm of what the means leave over."""
        sums = np.add.reduceat(rows, cuts, axis=1)
        sizes = np.diff(np.append(cuts, rows.shape[1]))
        square = (rows * rows).sum(axis=1).astype(float)
        rest, slack = square - (sums * sums / sizes).sum(axis=1), square * 1e-12
        return sums, np.sqrt(np.maximum(rest - slack, 0)), np.sqrt(np.maximum(rest + slack, 0))

    def bound(self, own: tuple, level: tuple, rows=None, entries=None) -> np.ndarray:
        """Lower bounds of the distances: of all rows to all entries, or of pairs."""
        sizes, (sums, low, high), (sums2, low2, high2) = level[1], own, level[2:]
        if rows is None:
            apart = sums[:, None, :] - sums2[None, :, :]
            rest = np.maximum(low[:, None] - high2[None, :], low2[None, :] - high[:, None])
        else:
            apart = sums[rows] - sums2[entries]
            rest = np.maximum(low[rows] - high2[entries], low2[entries] - high[rows])
        return ((apart * apart / sizes).sum(axis=-1) + np.maximum(rest, 0) ** 2) * (1 - 1e-12)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and exact squared distance of each row's nearest entry, the first of those as
        near, and how many exact distances that took."""
        if not self.levels or rows.dtype == object:
            found = [min((sum((x - y) ** 2 for x, y in zip(row, e)), k) for k, e in enumerate(self.entries.tolist())) for row in rows.tolist()]
            return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found], dtype=object), len(found) * len(self.entries)
        every = np.arange(len(rows))

        def exact(row, entry):
            apart = rows[row] - self.entries[entry]
            return (apart * apart).sum(axis=1)

        def first_least(row, entry, values):
            """Of each row's pairs, which lie together, the first of least value, and that value;
            no row loses all its pairs."""
            least = np.minimum.reduceat(values, np.searchsorted(row, every)) if len(rows) else values
            at = np.flatnonzero(values == least[row])
            return entry[at[np.searchsorted(row[at], every)]], least

        for k, level in enumerate(self.levels):
            own = self.blocks(rows, level[0])
            if k == 0:
                low = self.bound(own, level)
                most = exact(every, low.argmin(axis=1))
                row, entry = np.nonzero(low <= most[:, None])
            else:  # the entry that seems nearest now may have a shorter distance
                low = self.bound(own, level, row, entry)
                most = np.minimum(most, exact(every, first_least(row, entry, low)[0]))
                near = low <= most[row]
                row, entry = row[near], entry[near]
        return *first_least(row, entry, exact(row, entry)), len(row)


def digits(value: int) -> list[tuple[int, int]]:
    """(place, digit) of an integer in base 2 ** DIGIT; digits have its sign."""
    sign, value, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if value & ((1 << DIGIT) - 1):
            out.append((place, sign * (value & ((1 << DIGIT) - 1))))
        value >>= DIGIT
        place += 1
    return out


def seeds(vectors: DataFrame, entries: int) -> tuple[list[list[float]], int]:
    """The vectors of the least ids and the length of the longest of all. Each task gives the
    least rows of its own."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float64())), ("longest", pa.int64())])

    def run(batches):
        least: dict = {}
        longest = -1
        for batch in batches:
            kept, numbers, bounds = kept_vectors(batch.column(1))
            if not len(kept):
                continue
            longest = max(longest, int((bounds[kept + 1] - bounds[kept]).max()))
            ids = [(x is None, x) for x in batch.column(0).take(pa.array(kept)).to_pylist()]
            worst = max(least) if len(least) >= entries else None
            for key, i in zip(ids, kept):
                if worst is None or key <= worst:
                    own = (numbers[bounds[i] : bounds[i + 1]] + 0.0).tolist()
                    least[key] = min(least.get(key, own), own)
                    if len(least) > entries:
                        del least[max(least)]
                    worst = max(least) if len(least) >= entries else None
        sink = Sink(schema)
        for (_, x), own in least.items():
            sink.add(x, own, longest)
        yield sink.take()

    found = vectors.select("vec_id", "vector").mapInArrow(run, "id long, vector array<double>, longest long")
    by_id = written(found.groupBy("id").agg(F.min("vector").alias("vector"), F.max("longest").alias("longest")), "seeds")
    rows = by_id.orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()
    return [r.vector for r in rows], by_id.agg(F.max("longest")).first()[0] or 0


def assignments(vectors: DataFrame, books: list[list[list[int]]], width: int, schema: pa.Schema, ddl: str, give, end=None) -> DataFrame:
    """The nearest entries of all parts, in each task: give(sink, state, batch, kept rows, rows of integers,
    indices, distances) for every batch and end(sink, state) behind the last."""

    def run(batches):
        tools, sink, state, step = [Book(b) for b in books], Sink(schema), {}, width // len(books)
        for batch in batches:
            all_kept, numbers, bounds = kept_vectors(batch.column(1))
            for k in range(0, len(all_kept), 4096):
                kept = all_kept[k : k + 4096]
                rows = matrix(kept, numbers, bounds, width)
                both = [tool.nearest(rows[:, p * step : (p + 1) * step]) for p, tool in enumerate(tools)]
                give(sink, state, batch, kept, rows, [b[0] for b in both], [b[1] for b in both])
                if sink.full():
                    yield sink.take()
        if end is not None:
            for _ in end(sink, state):
                yield sink.take()
        yield sink.take()

    return vectors.mapInArrow(run, ddl)


def refined(vectors: DataFrame, books: list[list[list[int]]], width: int) -> list[list[list[int]]]:
    """The codebooks after one round. Entries that no part is nearest to stay."""
    step = width // len(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("digit", pa.int32()), ("total", pa.int64())])

    def give(sink, state, batch, kept, rows, indices, distances):
        for p, index in enumerate(indices):
            order = np.argsort(index, kind="stable")
            used, firsts, counts = np.unique(index[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(rows[order, p * step : (p + 1) * step], firsts, axis=0) if len(used) else []
            for e, total, n in zip(used.tolist(), sums, counts.tolist()):
                held = state.setdefault((p, e), [0] * (step + 1))
                state[p, e] = [a + b for a, b in zip(held, [n, *total.tolist()])]

    def end(sink, state):
        for (p, e), totals in state.items():
            for place, total in enumerate(totals):  # the first is the number of parts
                for at, digit in digits(total):
                    sink.add(p, e, place, at, digit)
            if sink.full():
                yield

    ddl = "part int, entry int, place int, digit int, total long"
    found = assignments(vectors, books, width, schema, ddl, give, end).groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total"))
    sums: dict = {}
    for r in found.collect():  # bounded by the codebooks' size
        own = sums.setdefault((r.part, r.entry), [0] * (step + 1))
        own[r.place] += r.total << (DIGIT * r.digit)
    out = [[list(e) for e in book] for book in books]
    for (p, e), (n, *totals) in sums.items():
        out[p][e] = [t // n for t in totals]
    return out


CODED = "vec_id long, label string, code string, error long"


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[list[int]]]]:
    """(frame, codebooks): the frame has CODED for every row that counts (label as text), and
    the codebooks are entries by part."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits")
    held = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).alias("vector"), F.col(quoted(label_col)).cast("string").alias("label"))
    first, longest = seeds(held, entries)
    width = max(-(-longest // parts), 1) * parts
    whole = [[integer(x) for x in v] + [0] * (width - len(v)) for v in first] or [[0] * width]
    step = width // parts
    books = [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)]
    for _ in range(rounds):
        books = refined(held, books, width)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def give(sink, state, batch, kept, rows, indices, distances):
        codes = np.stack(indices, axis=1).astype(np.uint8)
        errors = sum(distances[1:], distances[0].astype(object))
        take = pa.array(kept)
        ids, labels = batch.column(0).take(take).to_pylist(), batch.column(2).take(take).to_pylist()
        for i, (key, label) in enumerate(zip(ids, labels)):
            sink.add(key, label, codes[i].tobytes().hex(), min(int(errors[i]), LONGEST))

    return assignments(held, books, width, schema, CODED, give), books


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows of CODED with the sum of the errors of their label in `label_error`. The sums are
    written, so Spark sends them to all tasks only if their files are small; a large set of labels
    is joined by shuffle, where adaptive execution splits hot labels."""
    coded = written(coded, "codes")
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    sums = written(sums.select(F.col("label").alias("of"), F.least("s", F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"]), "left").drop("of")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row that counts."""
    coded, books = compress(vectors)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    return f"""{name} AS (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS best
  FROM parts p JOIN {book} b ON p.part = b.part GROUP BY p.vec_id, p.part)"""


def _refined(name: str, book: str, assigned: str) -> str:
    return f"""{name}_sums AS (
  SELECT part, best.e AS entry, i, sum(x[i]) AS s, count(*) AS n
  FROM {assigned}, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM parts))) AS i) GROUP BY ALL),
{name}_new AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS c FROM {name}_sums GROUP BY part, entry),
{name} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM {book} b LEFT JOIN {name}_new n ON b.part = n.part AND b.entry = n.entry)"""


#: Brute force: every part against every entry, on tables whose ids and vectors are there once and of one length.
ORACLE_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM vectors, (SELECT unnest(generate_series(0, 15)) AS part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM vectors ORDER BY vec_id LIMIT 64)),
book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM parts JOIN first USING (vec_id)),
{_assigned("near0", "book0")},
{_refined("book1", "book0", "near0")},
{_assigned("near1", "book1")},
{_refined("book2", "book1", "near1")},
{_assigned("near2", "book2")},
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(best.e AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near2 GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(text, ',' ORDER BY part, entry)) AS h FROM (SELECT part, entry, array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), ',') AS text FROM book2))
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM coded c JOIN vectors v USING (vec_id)
"""
