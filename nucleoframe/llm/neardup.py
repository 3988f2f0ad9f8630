"""Near-duplicate documents by an LSH forest of MinHash signatures.

Each document is the set of its distinct five-word shingles. Documents with equal sets
form a class at once. For the classes, every tree of the forest is a sorted order of
one part of the MinHash signature. Candidates are each entry's next neighbours in that
order with a longest common prefix of at least `least_depth` values, and the least
document of its region. A region is a common prefix; its depth is adaptive: where a
region has more than `region` members they are divided by one more value, down to the
full depth, and keep a link to the least member at every depth on the way. So the
number of candidates is linear in the entries, however large a region is.

Candidates are confirmed on full sets: first each document's most frequent candidate,
then every candidate whose ends are not yet in one component. An exact remainder follows:
in every region of depth `least_depth` that still holds several components, each pair
of members of different components is compared. Sizes, and sketches of the parities of
hash buckets, refute a pair only where its similarity is surely too low; what they leave
is confirmed on full sets. So every pair of a region is confirmed, refuted or joined
already, however the entries are partitioned. With 16 trees and depth 3 a pair of
similarity 0.75 shares no region with probability 0.0002, one of 0.8 with 0.00001.

Cases: fewer than five words: the whole sequence is the one shingle; no words (null,
empty, blank): an empty set, linked with nothing; repeated rows get equal values, and rows
that share an id are linked as one document is; a row without an id keeps component null
and is kept; of candidates met equally often the one with the least id is taken first;
very long texts make large sets, which are held one batch at a time; an empty table gives
no rows; extra columns are ignored, whatever their names. Keys that many rows share
(regions, centres of stars, documents of many pairs, sets of many copies) are dealt to
several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, Sink, map_batches, rows, written
from .graph import components, evenly, joined_components, share_of

TREES, DEPTH = 16, 6
#: Values of the prefix that makes a region.
LEAST_DEPTH = 3
#: Members of a region that are compared in one piece, on either side.
PIECE = 256
#: Bits of the shortest and the longest sketch.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 15
#: Multiplier of the rolling combination and of the final mix (odd 64-bit constants).
_M, _F1, _F2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _F1
    h = (h ^ (h >> _S)) * _F2
    return h ^ (h >> _S)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z are lower-cased."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), dtype=np.uint64, count=len(split))
    n = min(words, len(h))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for i in range(1, n):
        out = mixed(out * _M) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


_random = np.random.default_rng(20_240_607)
_A = _random.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def signature(found: np.ndarray) -> bytes:
    """MinHash values (32 bits each, big-endian so that bytes sort as numbers)."""
    least = np.full(len(_A), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048, None] * _A
        part += _B
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


SIGNED = "doc_id long, n_shingles long, set_id binary, signature binary"


def signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Set size, 128-bit id of the set and signature of each document."""

    def run(batches):
        sink = Sink(pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary())]), most_bytes=BATCH_BYTES)
        for key, text in rows(batches):
            found = shingle_set(text)
            if len(found):
                sink.add(key, len(found), xxhash.xxh3_128_digest(found.tobytes()), signature(found), weight=4 * len(_A))
            else:
                sink.add(key, 0, None, None)
            if sink.full():
                yield sink.take()
        yield sink.take()

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SIGNED)


def full_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found): the sorted shingle hashes as bytes."""

    def run(batches):
        sink = Sink(pa.schema([("id", pa.int64()), ("found", pa.binary())]), most_bytes=BATCH_BYTES)
        for key, text in rows(batches):
            found = shingle_set(text)
            sink.add(key, found.tobytes(), weight=found.nbytes)
            if sink.full():
                yield sink.take()
        yield sink.take()

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, found binary")


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the sizes of hash buckets, as bits: where two sets' sketches differ, at
    least one hash is in one of the sets only. There are 8 bits for a hash or more, up to MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(8 * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def halved(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows) of half the length; a bucket's parity is that of its two parts."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def forest_entries(classes: DataFrame, least_depth: int = LEAST_DEPTH, save=written) -> DataFrame:
    """(id, key, n, least, region): entries of the trees that share a region with another, its
    size and least id."""
    width = 4 * DEPTH
    entries = classes.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "signature").select(
        "id", F.concat(F.char(F.col("tree") + 65).cast("binary"), F.expr(f"substring(signature, tree * {width} + 1, {width})")).alias("key")
    )

    # only what meets another entry goes on, and is sorted
    return save(members(entries, least_depth, share_of(classes, TREES * classes.count())), "forest")


def members(found: DataFrame, depth: int, share: int) -> DataFrame:
    """Entries that share their prefix of this depth, with their region's size and least id;
    a large region is dealt to several tasks."""
    keyed = found.withColumn("h", F.xxhash64(F.substring("key", 1, 1 + 4 * depth)))
    regions = keyed.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    return evenly(keyed, regions, "h", share, ["id"]).select("id", "key", "n", "least", F.col("h").alias("region"))


def forest_candidates(inside: DataFrame, least_depth: int = LEAST_DEPTH, region: int = 32, neighbours: int = 3, save=written) -> DataFrame:
    """(a, b, n): candidate pairs of class ids, a < b, and how often they were met. Each depth is
    saved: it is read several times by the next, whose plan would hold as many copies of it."""
    share = share_of(inside, inside.count())
    stars = [inside.select("id", "least")]
    large = inside
    for depth in range(least_depth + 1, DEPTH + 1):
        large = save(members(large.where(F.col("n") > region).select("id", "key"), depth, share), "deeper")
        stars.append(large.select("id", "least"))
    star = stars[0]
    for more in stars[1:]:
        star = star.union(more)
    pairs = star.select(F.col("least").alias("a"), F.col("id").alias("b")).where("a != b")

    def beside(batches):
        """Neighbours in the sorted order of a range of the forest."""
        sink, last = Sink(pa.schema([("a", pa.int64()), ("b", pa.int64())])), []
        for key, doc in rows(batches):
            for other, other_doc in last:
                if other_doc != doc and key[: 1 + 4 * least_depth] == other[: 1 + 4 * least_depth]:
                    sink.add(min(doc, other_doc), max(doc, other_doc))
            last = [*last[-neighbours + 1 :], (key, doc)]
            if sink.full():
                yield sink.take()
        yield sink.take()

    order = inside.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return pairs.union(map_batches(order, beside, "a long, b long")).groupBy("a", "b").agg(F.count("*").alias("n"))


def candidate_sets(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, save=written) -> DataFrame:
    """(id, found): full sets of the documents that occur in a pair, made once. The ids
    grow with the corpus, so they are dealt out with the texts and never broadcast."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = one.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id", "text"])
    return save(full_sets(held, "id", "text"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The saved pairs (a, b) whose full sets have 100 * intersection >= percent * union. A
    document of many pairs is dealt to several tasks, with its set."""
    held, share = pairs.select("a", "b"), share_of(pairs, pairs.count())
    for side, other, found in (("a", "b", "x"), ("b", "a", "y")):
        one = sets.select(F.col("id").alias(side), F.col("found").alias(found))
        held = evenly(held, one, side, share, [other], pairs.groupBy(side).agg(F.count("*").alias("n")))
    held = held.select("a", "b", "x", "y")

    def run(batches):
        sink = Sink(pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for a, b, x, y in rows([batch]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    sink.add(a, b)
            yield sink.take()

    return map_batches(held, run, "a long, b long")


def pieces(inside: DataFrame, labels: DataFrame, save=written) -> DataFrame:
    """(region, i, j, minor, id, of): the comparisons that are left in regions of several
    components, dealt out in pieces. In a piece each minor member (not of the region's
    largest component) meets every member of another component; `of` is the component."""
    # a region of two is settled by the link to its least member
    placed = inside.where("n > 2").select("region", "id", "n").join(labels.withColumnRenamed("component", "of"), "id", "left")
    placed = placed.select("region", "id", "n", F.coalesce("of", "id").alias("of"))
    counts = placed.groupBy("region", "of").agg(F.count("*").alias("n"))
    still = counts.groupBy("region").agg(F.sum("n").alias("n"), F.max_by("of", F.struct("n", -F.col("of"))).alias("main"), F.max("n").alias("most")).where("most < n")
    parts = lambda n: F.ceil(n / PIECE).cast("int")
    still = still.select("region", "main", "n", parts(F.col("n")).alias("all_parts"), parts(F.col("n") - F.col("most")).alias("minor_parts"))
    member = evenly(placed.drop("n"), still, "region", share_of(inside, inside.count()), ["id"]).drop("n")
    member = save(member, "still")

    def dealt(minor: bool) -> DataFrame:
        own, other = ("minor_parts", "all_parts") if minor else ("all_parts", "minor_parts")
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias("mine")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("each")
        out = (member.where("of != main") if minor else member).select("region", "id", "of", mine, each)
        i, j = ("mine", "each") if minor else ("each", "mine")
        return out.select("region", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(minor).alias("minor"), "id", "of")

    return dealt(True).union(dealt(False))


def sketches(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, size, bits): size and sketch of the ids' sets."""

    def run(batches):
        sink = Sink(pa.schema([("id", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())]), most_bytes=BATCH_BYTES)
        for key, found in rows(batches):
            found = np.frombuffer(found, dtype=np.uint64)
            bits = sketch(found)
            sink.add(key, len(found), bits.tobytes(), weight=bits.nbytes)
            if sink.full():
                yield sink.take()
        yield sink.take()

    return map_batches(sets.join(ids.hint("shuffle_hash"), "id", "left_semi").select("id", "found"), run, "id long, size long, bits binary")


def unrefuted(minor: list, whole: list, percent: int = 75) -> set[tuple[int, int]]:
    """Pairs of a piece's members (id, of, size, bits), of different components, that size and
    sketch don't refute: a difference of d is too large if (100 + percent) * d > (100 - percent) * (x + y)."""
    by_length: dict[int, list] = {}
    for m in whole:
        by_length.setdefault(len(m[3]) // 8, []).append(m)
    held = {}
    for length, ms in by_length.items():
        ids, of, size = (np.array([m[k] for m in ms], dtype=np.int64) for k in range(3))
        held[length] = ids, of, size, np.frombuffer(b"".join(m[3] for m in ms), dtype=np.uint64).reshape(len(ms), length)
    out = set()
    for key, of_key, n, bits in minor:
        bits = np.frombuffer(bits, dtype=np.uint64)
        for ids, of, size, table in held.values():
            at = np.flatnonzero((of != of_key) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
            if not len(at):
                continue
            x, y = bits, table[at]
            while len(x) > y.shape[1]:
                x = halved(x)
            while len(x) < y.shape[1]:
                y = halved(y)
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            for other in ids[at[(100 + percent) * differ <= (100 - percent) * (size[at] + n)]].tolist():
                out.add((min(key, other), max(key, other)))
    return out


def remaining(inside: DataFrame, labels: DataFrame, sets: DataFrame, save=written) -> DataFrame:
    """(a, b): pairs of a region between two components that only full sets can tell."""
    dealt = save(pieces(inside, labels, save), "pieces")
    known = save(sketches(sets, dealt.select("id").distinct()), "sketches")
    keys = ["region", "i", "j"]

    def run(batches):
        sink, now, sides = Sink(pa.schema([("a", pa.int64()), ("b", pa.int64())])), None, ([], [])
        for region, i, j, minor, *member in rows(batches):
            if (region, i, j) != now:
                for pair in unrefuted(*sides):
                    sink.add(*pair)
                now, sides = (region, i, j), ([], [])
                if sink.full():
                    yield sink.take()
            sides[0 if minor else 1].append(member)
        for pair in unrefuted(*sides):
            sink.add(*pair)
        yield sink.take()

    held = dealt.join(known, "id").select(*keys, "minor", "id", "of", "size", "bits")
    return map_batches(held.repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id and kept. The result is
    written; all other copies are deleted."""
    scratch = Scratch(docs.sparkSession, "near")
    try:
        return written(_near_duplicates(docs, id_col, text_col, scratch.written), "near-result")
    finally:
        scratch.drop()


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, save) -> DataFrame:
    signs = save(signed(docs, id_col, text_col), "signatures")
    known = signs.where("set_id is not null and doc_id is not null")
    classes = save(known.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("n")), "classes")
    inside = forest_entries(classes.select("id", "signature"), save=save)
    found = save(forest_candidates(inside, save=save), "candidates")

    # first each document's most frequent candidate, so that few pairs need both sets
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = both.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    best = save(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    sets = candidate_sets(found, docs, id_col, text_col, save)
    labels = save(components(confirmed(best, sets), "a", "b", save), "labels")

    # then whatever still lies between two components
    def label(side: str):
        return labels.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))

    rest = found.join(best, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    rest = save(rest.where("not coalesce(of_a, a) <=> coalesce(of_b, b)").select("a", "b"), "rest")
    if not rest.isEmpty():
        labels = save(joined_components(labels, confirmed(rest, sets), save), "labels")

    # and whatever else lies between two components of a region
    last = save(remaining(inside, labels, sets, save), "remaining")
    if not last.isEmpty():
        labels = save(joined_components(labels, confirmed(last, sets), save), "labels")

    named = classes.select("set_id", "id").join(labels, "id", "left").select("set_id", F.coalesce("component", "id").alias("component"))
    rows_of = signs.select("doc_id", "n_shingles", "set_id").where("set_id is not null")
    joined = evenly(rows_of, named, "set_id", share_of(signs, signs.count()), ["doc_id"], classes.select("set_id", "n"), "left")
    out = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = out.union(signs.where("set_id is null").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for near_duplicates(): all pairs that share a shingle, and reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS x FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, w.doc_id) AS component_id, coalesce(c.least, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id"""
