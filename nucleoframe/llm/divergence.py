"""Audit of how the sources of a language differ in the words they use.

Terms are counted by (language, source) inside the tasks first. Terms of enough documents of a
language are its vocabulary; they are dealt by hash into chunks of about `chunk` terms and
numbered in their chunk, so a group's counts in a chunk are one packed vector. Groups are
dealt by hash into blocks, and each vector is replicated to the tiles (block by block) that its
block is in. A task walks a tile's chunks in order, keeping the vectors of one chunk at a
time, and adds up the submatrix of distances of the tile's pairs; long vocabularies are also
cut into segments of chunks, whose submatrices are added by the shuffle. No task holds a
vocabulary or all groups, and no pair of groups is computed twice.

Shares are exact integers: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), with N the counts of
all V terms of the vocabulary.

Cases: null text, language and source are empty texts; repeated rows count each time; a
language without vocabulary has pairs of value 0, and a group without terms shares of counts
of 0; a language of one source has no pairs; ties go by the item's UTF-8; texts of any length
are read whole; counts beyond 64-bit products are worked on as Python's integers or decimals;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Sink, rows, written

SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of terms: A-Z become a-z, other ASCII bytes are gaps, and the rest stays.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up. Every (lang, source)
    that occurs has a row with an empty term, whose `docs` are its documents."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        sink, held, size = Sink(schema), {}, 0

        def drain():
            for (lang, source), (counts, documents) in held.items():
                for term, n in counts.items():
                    sink.add(lang, source, term.decode("utf-8", "replace"), n, documents[term])
                    if sink.full():
                        yield sink.take()
            held.clear()

        for text, lang, source in rows(batches):
            counts, documents = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            own = Counter((text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split())
            size -= len(counts)
            counts.update(own)
            documents.update(own.keys())
            documents[b""] += 1
            counts[b""] += 0
            size += len(counts)
            if size >= most:
                yield from drain()
                size = 0
        yield from drain()
        yield sink.take()

    texts = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    found = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """p of a count, as an exact long. `total` and `terms` aren't both 0."""
    scaled = (count + PRIOR).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = total.cast("decimal(28,0)") + terms.cast("decimal(28,0)") * PRIOR
    return F.lit(1) + F.call_function("div", scaled, whole)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of many counts."""
    whole = total + PRIOR * terms
    if max(whole, int(counts.max(initial=0)) + PRIOR) < (1 << 63) // SCALE:
        return 1 + (counts + PRIOR) * SCALE // whole
    return np.array([1 + SCALE * (c + PRIOR) // whole for c in counts.tolist()], np.int64)


class Audit:
    """The written tables of one audit: `counts` by group and term, `terms` of the vocabularies
    with their places, `groups` with totals and `langs`."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, chunk: int = 2048, block: int = 16, segment: int = 64):
        self.chunk, self.block, self.segment = chunk, block, segment
        all_counts = written(term_counts(docs), "term-counts")
        groups = all_counts.where("term = ''").select("lang", "source")
        found = all_counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        found = written(found.select("lang", "term", "lang_n"), "kept-terms")
        langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(found.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        langs = langs.select("lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        self.langs = written(langs.withColumns({"chunks": F.ceil(F.greatest("terms", F.lit(1)) / chunk).cast("int"), "blocks": F.ceil(F.col("sources") / block).cast("int")}), "langs")
        place = Window.partitionBy("lang", "chunk").orderBy("term")
        dealt = found.join(self.langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
        self.terms = written(dealt.select("lang", "chunk", "term", "lang_n", (F.row_number().over(place) - 1).alias("place")), "terms")
        kept = all_counts.where("term != ''").select("lang", "source", "term", "n").join(self.terms, ["lang", "term"])
        self.counts = written(kept, "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = groups.join(totals, ["lang", "source"], "left").join(self.langs, "lang")
        self.groups = written(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "lang_total", "chunks", "blocks", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")), "groups")

    def vectors(self) -> DataFrame:
        """One packed vector for each group and chunk: places and counts of the terms it has."""
        packed = self.counts.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))
        packed = packed.select("lang", "source", "chunk", F.col("v.place").alias("places"), F.col("v.n").alias("counts"))
        widths = self.terms.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
        grid = self.groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return grid.join(widths, ["lang", "chunk"], "left").join(packed, ["lang", "source", "chunk"], "left").withColumn("width", F.coalesce("width", F.lit(0)))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of all ordered pairs of sources of a language."""
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        tiles = self.vectors().withColumn("other", other).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other"), "segment": F.floor(F.col("chunk") / self.segment).cast("int")})
        keys = ["lang", "bi", "bj", "segment"]
        dealt = tiles.repartition(*keys).sortWithinPartitions(*keys, "chunk", "source")
        dealt = dealt.select(*keys, "chunk", "source", "block", "width", "total", "terms", "places", "counts")
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

        def run(batches):
            sink = Sink(schema)
            for (lang, bi, bj, _), tile in groupby(rows(batches), lambda r: r[:4]):
                sums = None
                for _, own in groupby(tile, lambda r: r[4]):
                    own = list(own)
                    names, side = [r[5] for r in own], np.array([r[6] for r in own])
                    width, vectors = own[0][7], np.zeros((len(own), own[0][7]), np.int64)
                    for k, (*_, total, terms, places, counts) in enumerate(own):
                        if width:
                            dense = np.zeros(width, np.int64)
                            dense[places or []] = counts or []
                            vectors[k] = shares(dense, total, terms)
                    if sums is None:
                        sums = np.zeros((len(own), len(own)), np.int64)
                    for k in range(len(own)):  # the pairs of the tile, each once
                        behind = slice(k + 1, None) if bi == bj else np.flatnonzero(side == bj) if side[k] == bi else slice(0, 0)
                        sums[k, behind] += np.abs(vectors[behind] - vectors[k]).sum(axis=1)
                for k, name in enumerate(names):
                    for m, item in enumerate(names):
                        if (m > k) if bi == bj else (side[k] == bi and side[m] == bj):
                            sink.add(lang, name, item, int(sums[k, m]))
                            sink.add(lang, item, name, int(sums[k, m]))
                    if sink.full():
                        yield sink.take()
            yield sink.take()

        found = dealt.mapInArrow(run, "lang string, source string, item string, value long")
        return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def excesses(self) -> DataFrame:
        """(lang, source, item, value): terms that a group has and whose share is above that of
        its language."""
        p = share(F.col("n"), F.col("total"), F.col("terms"))
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
        both = self.counts.join(self.groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
        return both.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def divergence(docs: DataFrame, top_terms: int = 50, **how) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the `top_terms` terms by excess.
    Spark keeps only these of each task's terms before it shuffles them."""
    audit = Audit(docs, **how)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.withColumns({"part": F.lit(part), "rank": F.row_number().over(order)})
    pairs, terms = ranked(audit.pairs(), "pair"), ranked(audit.excesses(), "term").where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).union(terms.select(columns))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, CAST(sum(c) AS HUGEINT) + 5 * CAST(count(*) AS HUGEINT) AS whole FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(c) AS n FROM counted GROUP BY ALL),
wholes AS (
  SELECT lang, source, CAST(coalesce(n, 0) AS HUGEINT) + 5 * (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS whole FROM groups g LEFT JOIN totals USING (lang, source)),
dense AS (
  SELECT w.lang, w.source, k.term, coalesce(c.c, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.c, 0) AS HUGEINT) + 5)) // w.whole AS p,
    1 + (1000000000 * (CAST(k.c AS HUGEINT) + 5)) // l.whole AS q
  FROM wholes w JOIN kept k ON w.lang = k.lang JOIN langs l ON l.lang = w.lang LEFT JOIN counted c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
