"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Fixed masks ignore selected token positions. The hashes of what they pick from the
benchmark are joined with those of the documents. Around each hit the aligned tokens of
document and item are compared one by one, in every window near it: a span of the item
and `reach` more tokens on each side. A window counts if at least `share` of its tokens
are equal, or all of its span. Every way to place the unequal tokens of such a window
leaves one of MASKS whole somewhere (the tests try them all), so no window that counts is
without a seed; for a lower share than theirs or a longer reach the mask is a run of
seed_length() tokens. Tokens that an end of the document cuts off are unequal. A document
is contaminated if a window counts.

Tokens are maximal runs of letters and digits in lower case. An item of fewer tokens than
the span counts where all of them occur one after the other; one of one or two tokens,
where it is the whole document. Items shorter than a mask have masks of their own length.

Only hashes and places are joined; the tokens around a hit come from chunks of bounded
length. Where the benchmark's seeds and chunks are at most `broadcast_bytes`, by a bound
from its characters, they are broadcast. Beyond that hashes and places are shuffled, with
`salts` copies of the benchmark's, so that no common seed is in one task (what is still
uneven is split by adaptive execution), and the chunks of hits, and no others, are fetched
afterwards.

Cases: null and empty texts and items are clean; rows that share an id, null too, give one
row, and one of them decides for it; repeated items count once; an empty table on either
side gives no hits; very long texts are cut into chunks; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Fixed masks: 1 is hashed, 0 is ignored.
MASKS = ("11101", "100111")
SPAN = 12
#: Seeds that begin in one chunk of a text.
CHUNK = 64


def tokens(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_length(share: float, reach: int) -> int:
    """The longest run of equal tokens that every window which counts has: unequal tokens
    divide a window into one part more than there are of them."""
    least = SPAN
    for length in range(SPAN, SPAN + 2 * reach + 1):
        equal = next(e for e in range(length + 1) if e >= length * share)
        least = min(least, -(-equal // (length - equal + 1)))
    return max(least, 1)


def masks_for(share: float, reach: int) -> tuple[str, ...]:
    """Masks of which every window that counts holds one."""
    return MASKS if share >= 0.75 and reach <= 4 else ("1" * seed_length(share, reach),)


def chunked(text: Column, margin: int, span: int) -> Column:
    """A text's tokens as overlapping chunks of bounded length, so that a row never holds
    a whole document: {chunk, total, base, n, part}. Seeds start at base .. base + n - 1 of
    part, which has `margin` more tokens on both sides wherever the text has them."""

    def of(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - 1, F.lit(0)), F.lit(CHUNK)), lambda _: F.size(t) > 0)
        return F.transform(
            starts,
            lambda s: F.struct(
                s.alias("chunk"),
                F.size(t).alias("total"),
                F.least(s, F.lit(margin)).alias("base"),
                F.least(F.lit(CHUNK), F.size(t) - s).alias("n"),
                F.slice(t, F.greatest(s - margin, F.lit(0)) + 1, F.least(s, F.lit(margin)) + CHUNK + span - 1 + margin).alias("part"),
            ),
        )

    # the tokens are bound once, as the only item of an array
    return F.flatten(F.transform(F.array(tokens(text)), of))


def chunks(df: DataFrame, keys: list[str], side: str, margin: int, span: int) -> DataFrame:
    """(keys, <side>_chunk, total, base, n, <side>): the chunks of each text."""
    # the outer form keeps the optimizer from making the chunks twice, for a filter on them
    found = df.select(*keys, F.explode_outer(chunked(F.col("text"), margin, span)).alias("c")).where("c is not null")
    return found.select(*keys, F.col("c.chunk").alias(f"{side}_chunk"), "c.total", "c.base", "c.n", F.col("c.part").alias(side))


def seeds(found: DataFrame, side: str, carried: list[str], masks: tuple[str, ...], whole: tuple[int, ...], own: bool) -> DataFrame:
    """(carried, <side>_at, key): one row for each mask at each place where it fits. Texts
    of a length in `whole` have a mask of their length; for one or two tokens it only fits
    a text of that length, and if `own`, for any."""
    at = F.col(f"{side}_at")

    def key(mask: str, fits: Column) -> Column:
        picked = [F.get(F.col(side), at + i) for i, used in enumerate(mask) if used == "1"]
        return F.when(fits & (at + len(mask) <= F.size(side)), F.xxhash64(F.lit(mask), *picked))

    made = [key(m, F.lit(True)) for m in masks]
    made += [key("1" * n, (F.col("total") == n) if own or n < 3 else F.lit(True)) for n in whole]
    placed = found.select(*carried, side, "total", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias(f"{side}_at"))
    if len(made) == 1:
        return placed.select(*carried, at, made[0].alias("key")).where("key is not null")
    return placed.select(*carried, at, F.explode(F.array(*made)).alias("key")).where("key is not null")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equal join in which nulls are equal; the keys are those of the left side."""
    renamed = right.withColumnsRenamed({k: f"__{i}" for i, k in enumerate(keys)})
    both = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, both).drop(*[f"__{i}" for i in range(len(keys))])


def hits(docs: DataFrame, items: DataFrame, keys: list[str], share: float, reach: int, broadcast_bytes: int, salts: int) -> DataFrame:
    """(keys, item_id, equal): the hits that count, with the largest number of equal tokens
    in a window around them. docs has the keys and text, items has item_id and text."""
    masks = masks_for(share, reach)
    shortest, span = min(map(len, masks)), max(map(len, masks))
    margin = SPAN - shortest + 2 * reach
    total = F.size(tokens(F.col("text")))
    said = items.agg(F.sum(F.length("text") + 1), F.collect_set(F.when((total > 0) & (total < shortest), total))).first()
    characters, whole = said[0] or 0, tuple(sorted(said[1]))
    item_keys = ["item_id", "item_chunk"]
    bench = chunks(items, ["item_id"], "item", margin, span).distinct()
    marks = seeds(bench, "item", item_keys, masks, whole, own=True).distinct()
    parts = bench.select(*item_keys, "item")
    texts = chunks(docs, keys, "doc", margin, span)
    # a token has a character and one between it and the next: so many tokens at most, with
    # 64 bytes for each entry of a hashed table, and 20 for each token of the chunks
    if characters / 2 * (64 * len(masks) + 20) <= broadcast_bytes:
        met = seeds(texts, "doc", [*keys, "doc"], masks, whole, own=False).join(F.broadcast(marks), "key")
        met = same(met, F.broadcast(parts), item_keys)
    else:
        # rows that share their keys are told apart by their texts, and equal ones are one; the
        # salts deal a frequent key, and adaptive execution splits what is still uneven
        mark = "_".join(["text_mark", *keys])  # none of the keys
        texts = chunks(docs.withColumn(mark, F.xxhash64("text")), [*keys, mark], "doc", margin, span)
        places = [*keys, mark, "doc_chunk"]
        salted = seeds(texts, "doc", places + ["doc"], masks, whole, own=False).drop("doc")
        salted = salted.withColumn("salt", F.pmod(F.xxhash64(*places), F.lit(salts)).cast("int"))
        copies = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = written(salted.join(copies, ["key", "salt"]).drop("key", "salt").distinct(), "seed-hits")
        # of all chunks only those with a hit are sent: Spark broadcasts the places if their files are small
        near = met.select(*places).distinct().withColumnsRenamed({k: f"__{i}" for i, k in enumerate(places)})
        both = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(places)]
        fetched = texts.select(*places, "doc").join(near, both, "left_semi").dropDuplicates(places)
        met = same(same(met, parts, item_keys), fetched, places)
    # the item's tokens in all windows that hold the seed, and the document's tokens beside them
    size, seed_at = F.size("item"), F.col("item_at")
    first = F.greatest(seed_at - margin, F.lit(0))
    last = F.least(seed_at + shortest + margin, size)
    offset = F.col("doc_at") - seed_at

    def beside(i: Column) -> Column:
        return F.get(F.col("item"), i) == F.get(F.col("doc"), i + offset)

    enough = F.least(size, F.lit(SPAN)) * min(share, 1.0)
    met = met.where(F.size(F.filter(F.sequence(first, last - 1), beside)) >= enough)

    def count(equal: Column, start: Column, end: Column) -> Column:
        return F.size(F.filter(F.slice(equal, start - first + 1, end - start), lambda x: x))

    def window(equal: Column, at: Column) -> Column:
        start, end = F.greatest(at - reach, F.lit(0)), F.least(at + SPAN + reach, size)
        found = count(equal, start, end)
        return F.when((found >= (end - start) * share) | (count(equal, at, at + SPAN) == SPAN), found)

    def best(equal: Column) -> Column:
        spans = F.sequence(F.greatest(seed_at + shortest - SPAN - reach, F.lit(0)), F.least(seed_at + reach, size - SPAN))
        every = count(equal, first, last)
        return F.when(size < SPAN, F.when(every == size, every)).otherwise(F.array_max(F.transform(spans, lambda at: window(equal, at))))

    equal = F.transform(F.sequence(first, last - 1), lambda i: F.coalesce(beside(i), F.lit(False)))
    return met.select(*keys, "item_id", F.get(F.transform(F.array(equal), best), F.lit(0)).alias("equal")).where("equal is not null")


def leaks(docs: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("doc_id",), share: float = 0.75, reach: int = 4, broadcast_bytes: int = 64 << 20, salts: int = 16) -> DataFrame:
    """(keys, items, best): contaminated documents, the items they hold, sorted, and
    the largest number of equal tokens in a window. docs has the keys and text."""
    texts = docs.select(*keys, F.col("text").cast("string").alias("text"))
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found = hits(texts, bench, list(keys), share, reach, broadcast_bytes, salts)
    return found.groupBy(*keys).agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("equal").alias("best"))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per id: doc_id, contaminated, kept (its opposite), n_items, item_ids (the
    sorted ids joined by commas) and best_overlap."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = texts.select("doc_id").distinct()
    found = leaks(texts, items, **how)
    bad = F.col("items").isNotNull()
    return ids.join(found, ids["doc_id"].eqNullSafe(found["doc_id"]), "left").select(
        ids["doc_id"], bad.alias("contaminated"), (~bad).alias("kept"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), F.lit("")).alias("item_ids"),
        F.coalesce("best", F.lit(0)).cast("long").alias("best_overlap"),
    )


#: DuckDB SQL for decontaminate() with its default parameters, without masks: 9 equal tokens
#: of 12, 12 of 16 or 15 of 20 leave a run of three, so all alignments with one are compared
#: in all of the item's windows.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, p, w[p] AS x, w[p + 1] AS y, w[p + 2] AS z FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
bp AS (SELECT item_id, p, w[p] AS x, w[p + 1] AS y, w[p + 2] AS z FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS p FROM b WHERE len(w) >= 3)),
met AS (SELECT DISTINCT doc_id, item_id, dp.p - bp.p AS shift FROM dp JOIN bp USING (x, y, z)),
same AS (SELECT doc_id, item_id, len(b.w) AS n,
    list_transform(range(1, len(b.w) + 1), lambda i: CASE WHEN i + shift >= 1 AND i + shift <= len(d.w) AND b.w[i] = d.w[i + shift] THEN 1 ELSE 0 END) AS e
  FROM met JOIN d USING (doc_id) JOIN b USING (item_id)),
span AS (SELECT doc_id, item_id, n, e, unnest(range(1, n - 10)) AS q FROM same WHERE n >= 12),
win AS (SELECT doc_id, item_id, least(q + 15, n) - greatest(q - 4, 1) + 1 AS size,
    list_sum(e[greatest(q - 4, 1):least(q + 15, n)]) AS e, list_sum(e[q:q + 11]) AS run FROM span),
bad AS (
  SELECT doc_id, item_id, max(e) AS e FROM win WHERE e >= size * 0.75 OR run = 12 GROUP BY 1, 2
  UNION ALL SELECT doc_id, item_id, max(n) FROM same WHERE n < 12 AND list_sum(e) = n GROUP BY 1, 2
  UNION ALL SELECT doc_id, item_id, max(len(b.w)) FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND 2 GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids, max(e) AS e FROM bad GROUP BY 1)
SELECT d.doc_id, g.n IS NOT NULL AS contaminated, g.n IS NULL AS kept, coalesce(g.n, 0) AS n_items, coalesce(ids, '') AS item_ids, CAST(coalesce(g.e, 0) AS BIGINT) AS best_overlap
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN g USING (doc_id)"""
