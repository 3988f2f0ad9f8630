"""Registered queries of the engine's operators over the proxies, each with the DuckDB
SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from ..functions import scalar
from ..operators import barcodes, cells, correlation, lengths, mutrate, quality, reactivity, reads, sweep, windows
from ..sources import fastq as fastq_source
from ..sources import text, vcf
from ..session import shared_path
from . import pipelines
from .proxies import proxy, with_proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *proxies: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            # ties go to even on both sides
            ORACLE_SQL[key] = (with_proxies(sql, *proxies) if proxies else sql).replace("round(", "round_even(")
        return f

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Float results rounded, so that the order of summation can't show."""
    return df.withColumns({c: scalar.round_like_numpy(c, digits) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(lines: DataFrame, name: str, codec: str = "none") -> str:
    """The path of lines written as text to the shared folder, for the file readers."""
    path = shared_path(lines.sparkSession, name)
    lines.select("value").write.option("compression", codec).text(path)
    return path


# ---- windows ---------------------------------------------------------------

WINDOWS_SQL = """
WITH a AS (SELECT gene, min(pos) AS anchor, max(pos) AS last FROM position GROUP BY gene),
w AS (SELECT gene, unnest(range(anchor, last + 1, {step})) AS win FROM a),
s AS (SELECT w.gene, w.win, CAST(sum(coverage) AS BIGINT) AS coverage, CAST(sum(mutant) AS BIGINT) AS mutant
      FROM w JOIN position p ON p.gene = w.gene AND p.pos BETWEEN w.win AND w.win + {len} - 1 WHERE mutrate <= 0.2 GROUP BY 1, 2)
SELECT gene, win, coverage, mutant, round(CAST(mutant AS DOUBLE) / coverage, 5) AS mutrate, win + {len} - 1 AS win_end FROM s WHERE coverage >= 200"""

for _name, _len, _step in (("bulk_windows_fixed", 10, 10), ("bulk_windows_sliding", 10, 3), ("bulk_windows_gapped", 5, 20)):

    @query(WINDOWS_SQL.format(len=_len, step=_step), "position", name=_name)
    def _windows(spark, sf_dir, win_len=_len, step=_step):
        return windows.bulk_windows(proxy(spark, sf_dir, "position"), win_len, step)


CELL_SQL = """
WITH a AS (SELECT gene, min(pos) AS anchor FROM cell_position {where} GROUP BY gene),
k AS (SELECT c.gene, anchor + ((pos - anchor) // 10) * 10 AS win, cell, dp, ad FROM cell_position c JOIN a USING (gene)
      WHERE dp IS NOT NULL AND ad IS NOT NULL AND coalesce(CAST(ad AS DOUBLE) / nullif(dp, 0), 0) <= 0.2),
s AS (SELECT gene, win, cell, CAST(sum(dp) AS BIGINT) AS dp, CAST(sum(ad) AS BIGINT) AS ad FROM k GROUP BY 1, 2, 3)
SELECT gene, win, win + 9 AS win_end, cell, dp, ad, round(CAST(ad AS DOUBLE) / dp, 5) AS mr FROM s WHERE dp >= 200"""


@query(CELL_SQL.format(where=""), "cell_position")
def cell_windows(spark, sf_dir):
    return windows.cell_windows(proxy(spark, sf_dir, "cell_position"))


@query(CELL_SQL.format(where="WHERE dp IS NOT NULL AND ad IS NOT NULL"), "cell_position")
def cell_windows_legacy_anchor(spark, sf_dir):
    return windows.cell_windows(proxy(spark, sf_dir, "cell_position"), legacy_anchor=True)


@query(CELL_SQL.format(where="").replace("SELECT gene, win, win + 9 AS win_end, cell, dp, ad, round(CAST(ad AS DOUBLE) / dp, 5) AS mr FROM s WHERE dp >= 200", "SELECT gene, win, win + 9 AS win_end, count(*) AS n_cells, CAST(sum(dp) AS BIGINT) AS dp FROM s WHERE dp >= 200 GROUP BY 1, 2"), "cell_position")
def window_any_cell(spark, sf_dir):
    return windows.any_cell_windows(windows.cell_windows(proxy(spark, sf_dir, "cell_position")))


@query("""
SELECT gene, pos, CAST(coverage AS BIGINT) AS coverage, CAST(mutant AS BIGINT) AS mutant, round(CAST(mutant AS DOUBLE) / coverage, 5) AS mutrate FROM (
  SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY pos) AS rn, sum(coverage) OVER w AS coverage, sum(mutant) OVER w AS mutant
  FROM position WINDOW w AS (PARTITION BY gene ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) x
WHERE rn >= 10 AND (rn - 10) % 5 = 0""", "position")
def row_rolling(spark, sf_dir):
    return windows.row_rolling(proxy(spark, sf_dir, "position"), 10, 5)


PADDED_SQL = """WITH r AS (SELECT gene, coverage, mutant, {number} AS k, {rows} AS m FROM position),
both_ends AS (SELECT * FROM r UNION ALL SELECT gene, coverage, mutant, 0, m FROM r WHERE k = 1),
g AS (SELECT gene, max(m) + 10 - max(m) % 10 AS last FROM r GROUP BY gene),
ends AS (SELECT gene, unnest(generate_series(1, last // 5)) * 5 AS win FROM g)
SELECT e.gene, e.win, CAST(sum(b.coverage) AS BIGINT) AS coverage, CAST(sum(b.mutant) AS BIGINT) AS mutant, round(CAST(sum(b.mutant) AS DOUBLE) / nullif(sum(b.coverage), 0), 5) AS mutrate
FROM ends e JOIN both_ends b ON e.gene = b.gene AND b.k BETWEEN e.win - 9 AND e.win GROUP BY 1, 2 HAVING sum(b.coverage) >= 3000"""


@query(PADDED_SQL.format(number="row_number() OVER (PARTITION BY gene ORDER BY pos)", rows="count(*) OVER (PARTITION BY gene)"), "position")
def padded_rolling(spark, sf_dir):
    return windows.padded_rolling(proxy(spark, sf_dir, "position"), 10, 5, 3000)


@query(PADDED_SQL.format(number="pos - min(pos) OVER (PARTITION BY gene) + 1", rows="max(pos) OVER (PARTITION BY gene) - min(pos) OVER (PARTITION BY gene) + 1").replace("3000", "600"), "position")
def padded_rolling_dense(spark, sf_dir):
    """Gaps between positions count as empty rows."""
    return windows.padded_rolling(proxy(spark, sf_dir, "position"), 10, 5, 600, dense=True)


# ---- mutation rates --------------------------------------------------------

COUNTS = """SELECT concat_ws(' ', concat('>g', CAST(l_suppkey AS {s})), CAST(l_partkey AS {s}), CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'A' END, CAST(a + c AS {s}), concat('=:0:0'), concat('A:', CAST(a AS {s}), ':1'), concat('C:', CAST(c AS {s}), ':1'), concat('A:', CAST(c % 2 AS {s}), ':1'), 'G:0:0',
  concat('+AC:', CAST(c % 3 AS {s}), ':1'), concat('+ACGT:', CAST(c % 5 AS {s}), ':1'), concat('-A:', CAST(a % 4 AS {s}), ':1'), concat('-ACGTA:', CAST(a % 7 AS {s}), ':1')) AS value
FROM (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, CAST(sum(CAST(l_discount * 100 AS BIGINT)) AS BIGINT) AS c FROM {t} GROUP BY l_suppkey, l_partkey) x"""


def count_lines(spark, sf_dir):
    return spark.sql(COUNTS.replace("{s}", "STRING").replace("{t}", "{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


MUTRATE_SQL = """
WITH x AS (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS a, CAST(sum(CAST(l_discount * 100 AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY l_suppkey, l_partkey),
m AS (SELECT 'g' || l_suppkey AS gene, l_partkey AS pos, a, c, a + c AS depth, a + c + c % 3 + c % 5 AS coverage, a + c + c % 3 - a % 7 AS adj_coverage, c - c % 2 + c % 3 - a % 7 AS mutant FROM x)
SELECT gene, pos, pos + 1 AS "end", round(CAST(mutant AS DOUBLE) / nullif(coverage, 0), 8) AS mutrate, coverage, adj_coverage, mutant, depth, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'A' END AS refnt,
  '=:0;A:' || a || ';C:' || c || ';A:' || (c % 2) || ';G:0' || CASE WHEN c % 3 > 0 THEN ';+:' || (c % 3) ELSE '' END || CASE WHEN a % 4 > 0 THEN ';-:' || (a % 4) ELSE '' END
    || CASE WHEN c % 5 > 0 THEN ';+++:' || (c % 5) ELSE '' END || CASE WHEN a % 7 > 0 THEN ';---:' || (a % 7) ELSE '' END AS detail FROM m"""


@query(MUTRATE_SQL)
def mutrate_from_counts(spark, sf_dir):
    return mutrate.mutation_rates(text.parse_counts(count_lines(spark, sf_dir)))


GENE_COUNTS = "SELECT concat_ws('\t', CAST(s_suppkey AS {s}), concat(CASE WHEN s_suppkey % 3 = 0 THEN 'h' ELSE 'g' END, CAST(s_suppkey AS {s})), '1', '9', '+', CAST(s_suppkey % 7 + 100 AS {s}), CAST(s_suppkey * 1000 AS {s})) AS value, s_suppkey AS ord FROM {t}"


def gene_counts(spark, sf_dir):
    raw = spark.sql(GENE_COUNTS.replace("{s}", "STRING").replace("{t}", "{supplier}"), supplier=table(spark, sf_dir, "supplier"))
    again = raw.select(F.replace("value", F.lit("+"), F.lit("-")).alias("value"), (F.col("ord") + 1_000_000).alias("ord")).where("ord % 2 = 0")
    return text.parse_gene_counts(raw.union(again))


GENES_CTE = """g AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'h' ELSE 'g' END || s_suppkey AS gene, s_suppkey % 7 + 100 AS length, s_suppkey * 1000 AS reads,
  (SELECT CAST(sum(s_suppkey * 1000 * (1 + CAST((s_suppkey + 1000000) % 2 = 0 AS BIGINT))) AS BIGINT) FROM supplier) AS total_reads FROM supplier)"""


@query(f"WITH {GENES_CTE} SELECT gene, length, reads, total_reads FROM g")
def featurecounts_total(spark, sf_dir):
    return gene_counts(spark, sf_dir)


NORMALIZED_SQL = MUTRATE_SQL.replace("WITH x AS", f"WITH {GENES_CTE}, x AS").split("SELECT gene, pos, pos + 1")[0] + """,
n AS (SELECT m.gene, pos, coverage, g.reads AS g_readcount, depth / (total_reads / 1e6) AS normalized_cov FROM m LEFT JOIN g ON g.gene = m.gene)"""


@query(NORMALIZED_SQL + " SELECT gene, pos, coverage, g_readcount, round(normalized_cov, 6) AS normalized_cov FROM n")
def normalized_cov(spark, sf_dir):
    positions = mutrate.mutation_rates(text.parse_counts(count_lines(spark, sf_dir)))
    out = mutrate.with_gene_counts(positions, gene_counts(spark, sf_dir), digits=None)
    return rounded(out, "normalized_cov").select("gene", "pos", "coverage", "g_readcount", "normalized_cov")


@query(NORMALIZED_SQL + " SELECT gene, pos, coverage FROM n WHERE coverage >= 30 AND (normalized_cov IS NULL OR round(normalized_cov, 8) >= 8)")
def position_filter(spark, sf_dir):
    positions = mutrate.mutation_rates(text.parse_counts(count_lines(spark, sf_dir)))
    return mutrate.position_filter(mutrate.with_gene_counts(positions, gene_counts(spark, sf_dir)), 30, 8).select("gene", "pos", "coverage")


@query("SELECT gene, round(coalesce(avg(mutrate), 0), 8) AS mean FROM position GROUP BY gene", "position")
def rounded_mean(spark, sf_dir):
    return mutrate.rounded_mean(proxy(spark, sf_dir, "position"), "mutrate", ["gene"])


@query(WINDOWS_SQL.format(len=10, step=10).replace("200", "60").replace("FROM position", "FROM p0").replace("JOIN position", "JOIN p0").replace("WITH a AS", MUTRATE_SQL.split("SELECT gene, pos, pos + 1")[0] + ", p0 AS (SELECT gene, pos, coverage, mutant, CAST(mutant AS DOUBLE) / nullif(coverage, 0) AS mutrate FROM m), a AS"))
def bulk_pipeline(spark, sf_dir):
    return pipelines.bulk_profile(text.parse_counts(count_lines(spark, sf_dir)), coverage_threshold=60)


# ---- cells -----------------------------------------------------------------


@query("SELECT cell_window.* FROM cell_window JOIN metadata USING (cell) WHERE leiden IN ('BUILDING', 'MACHINERY') AND n_windows >= 1000 AND nation = 3", "cell_window", "metadata")
def cell_meta_filter(spark, sf_dir):
    filters = {"leiden": ["BUILDING", "MACHINERY"], "n_windows": (1000, None), "nation": 3}
    return cells.filter_by_cells(proxy(spark, sf_dir, "cell_window"), proxy(spark, sf_dir, "metadata"), filters).select("gene", "win", "cell", "dp", "mr")


@query("""WITH k AS (SELECT * FROM cell_window WHERE dp >= 2500)
SELECT (SELECT count(*) FROM metadata WHERE cell NOT IN (SELECT cell FROM k)) AS empty_cells,
  (SELECT count(*) FROM (SELECT DISTINCT gene, win FROM cell_window EXCEPT SELECT DISTINCT gene, win FROM k)) AS empty_positions""", "cell_window", "metadata")
def all_na_dims(spark, sf_dir):
    whole = proxy(spark, sf_dir, "cell_window")
    return cells.empty_dimensions(whole.where("dp >= 2500"), whole, proxy(spark, sf_dir, "metadata"))


@query("SELECT * FROM cell_window WHERE dp >= 1000 AND mr <= 0.2", "cell_window")
def threshold_compact(spark, sf_dir):
    return cells.threshold_filter(proxy(spark, sf_dir, "cell_window"), 1000, 0.2)


@query("""WITH k AS (SELECT * FROM cell_window WHERE dp >= 1000 AND mr <= 0.2)
SELECT 'position' AS axis, gene || '.' || win AS name, CAST(row_number() OVER (ORDER BY gene, win) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT gene, win FROM k)
UNION ALL SELECT 'cell', cell, CAST(row_number() OVER (ORDER BY cell) - 1 AS BIGINT) FROM (SELECT DISTINCT cell FROM k)""", "cell_window")
def threshold_dimensions(spark, sf_dir):
    rows, cols = cells.dimensions(cells.threshold_filter(proxy(spark, sf_dir, "cell_window"), 1000, 0.2))
    a = rows.select(F.lit("position").alias("axis"), scalar.dotted_key("gene", "win").alias("name"), F.col("row").cast("long").alias("idx"))
    return a.union(cols.select(F.lit("cell"), "cell", F.col("col").cast("long")))


BULK_SQL = """SELECT leiden AS cluster, gene, win, min(dp) AS coverage, round(avg(mr), 9) AS mutrate, CAST(NULL AS BIGINT) AS mutant, 'dmso_' || leiden AS sample
FROM cell_window JOIN metadata USING (cell) {where} GROUP BY leiden, gene, win"""


@query(BULK_SQL.format(where=""), "cell_window", "metadata")
def cluster_pseudobulk(spark, sf_dir):
    return rounded(cells.cluster_pseudobulk(proxy(spark, sf_dir, "cell_window"), proxy(spark, sf_dir, "metadata")), "mutrate", digits=9)


@query(f"WITH b AS ({BULK_SQL.format(where='WHERE dp >= 1000 AND mr <= 0.2')}) SELECT sample, count(*) AS n, CAST(sum(coverage) AS BIGINT) AS coverage FROM b GROUP BY sample", "cell_window", "metadata")
def cluster_pipeline(spark, sf_dir):
    out = cells.cluster_pipeline(proxy(spark, sf_dir, "cell_window"), proxy(spark, sf_dir, "metadata"), 1000, 0.2)
    return out.groupBy("sample").agg(F.count("*").alias("n"), F.sum("coverage").alias("coverage"))


@query("""SELECT count(DISTINCT gene) AS n_genes, count(DISTINCT (gene, win)) AS n_positions, count(DISTINCT cell) AS n_cells, count(*) AS n_entries, min(dp) AS min_coverage, max(dp) AS max_coverage,
  round(avg(dp), 6) AS mean_coverage, min(mr) AS min_rate, max(mr) AS max_rate, round(avg(mr), 6) AS mean_rate,
  round((1 - CAST(count(*) AS DOUBLE) / (count(DISTINCT (gene, win)) * count(DISTINCT cell))) * 100, 6) AS sparsity, count(DISTINCT (gene, win)) * count(DISTINCT cell) * 8 AS dense_bytes,
  round((1 - count(*) * 16.0 / (count(DISTINCT (gene, win)) * count(DISTINCT cell) * 8)) * 100, 6) AS memory_saved FROM cell_window""", "cell_window")
def matrix_stats(spark, sf_dir):
    return rounded(cells.matrix_stats(proxy(spark, sf_dir, "cell_window")), "mean_coverage", "mean_rate", "sparsity", "memory_saved")


# ---- reads -----------------------------------------------------------------

STATS_CTE = """k AS (SELECT * FROM alignments WHERE ref_name IS NOT NULL AND ref_length >= {m}),
rc AS (SELECT read_id, ref_name, count(*) AS n, min(ord) AS first FROM k GROUP BY 1, 2),
st AS (SELECT read_id, CAST(sum(n) AS BIGINT) AS alignment_count, CAST(count(*) AS INTEGER) AS unique_transcript_count, count(*) = 1 AS is_uniquely_mapped, arg_max(ref_name, n * 1000000000000 - first) AS max_transcript,
  max(n) AS max_count, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS BIGINT) AS max_ratio, string_agg(ref_name, ',' ORDER BY first) AS unique_transcripts FROM rc GROUP BY read_id)"""
STATS = f"WITH {STATS_CTE.format(m=0)}"


def alignments(spark, sf_dir):
    return proxy(spark, sf_dir, "alignments")


def stats_of(spark, sf_dir, lists=False):
    return reads.read_stats(alignments(spark, sf_dir), lists=lists)


@query(f"WITH {STATS_CTE.format(m=10)} SELECT st.* EXCLUDE (max_ratio), round(max_ratio, 6) AS max_ratio, (SELECT string_agg(ref_name, ',' ORDER BY ord) FROM k WHERE k.read_id = st.read_id) AS all_transcripts FROM st", "alignments")
def read_multimap(spark, sf_dir):
    out = reads.read_stats(alignments(spark, sf_dir), 10)
    return rounded(out, "max_ratio").withColumns({c: F.array_join(c, ",") for c in ("unique_transcripts", "all_transcripts")})


@query(f"""{STATS} SELECT count(*) AS total_reads, count(*) FILTER (WHERE alignment_count = 1) AS single, count(*) FILTER (WHERE alignment_count > 1) AS multi, count(*) FILTER (WHERE is_uniquely_mapped) AS "unique",
  round(avg(max_ratio), 6) AS mean_ratio, round(min(max_ratio), 6) AS min_ratio, max(max_ratio) AS max_ratio, count(*) FILTER (WHERE max_ratio = 1) AS ratio_1, count(*) FILTER (WHERE max_ratio >= 0.8 AND max_ratio < 1) AS ratio_08,
  count(*) FILTER (WHERE max_ratio >= 0.5 AND max_ratio < 0.8) AS ratio_05, count(*) FILTER (WHERE max_ratio > 0 AND max_ratio < 0.5) AS ratio_low,
  round(count(*) FILTER (WHERE alignment_count = 1) * 100.0 / count(*), 6) AS single_percent, round(count(*) FILTER (WHERE alignment_count > 1) * 100.0 / count(*), 6) AS multi_percent,
  round(count(*) FILTER (WHERE is_uniquely_mapped) * 100.0 / count(*), 6) AS unique_percent FROM st""", "alignments")
def read_stats_summary(spark, sf_dir):
    return rounded(reads.stats_summary(stats_of(spark, sf_dir)), "mean_ratio", "min_ratio", "single_percent", "multi_percent", "unique_percent")


@query(f"""{STATS} SELECT count(max_ratio) AS n, round(avg(max_ratio), 6) AS mean, round(median(max_ratio), 6) AS median, round(stddev_pop(max_ratio), 6) AS std, round(min(max_ratio), 6) AS min, max(max_ratio) AS max,
  {", ".join(f"round(quantile_cont(max_ratio, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90, 95, 99))} FROM st""", "alignments")
def ratio_percentiles(spark, sf_dir):
    out = reads.ratio_percentiles(stats_of(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c not in ("n", "max")])


@query(f"{STATS} SELECT alignment_count, count(*) AS n FROM st GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", "alignments")
def alignment_hist_top10(spark, sf_dir):
    return reads.top_counts(reads.alignment_histogram(stats_of(spark, sf_dir)))


@query("""WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE ref_name IS NULL) AS unmapped, count(*) FILTER (WHERE ref_name IS NOT NULL AND ref_length < 20) AS filtered FROM alignments)
SELECT total, unmapped, filtered, total - unmapped - filtered AS passed, round(unmapped * 100.0 / total, 6) AS unmapped_percent, round(filtered * 100.0 / total, 6) AS filtered_percent,
  round((total - unmapped - filtered) * 100.0 / total, 6) AS passed_percent FROM c""", "alignments")
def min_length_counters(spark, sf_dir):
    return rounded(reads.processing_counters(alignments(spark, sf_dir), 20), "unmapped_percent", "filtered_percent", "passed_percent")


@query(f"{STATS} SELECT * FROM alignments WHERE (flag & 2304) = 0 AND read_id IN (SELECT read_id FROM st WHERE is_uniquely_mapped)", "alignments")
def unique_primary_reads(spark, sf_dir):
    df = alignments(spark, sf_dir)
    return reads.unique_primary(df, reads.read_stats(df, lists=False)).select("ord", "read_id", "flag", "ref_name", "ref_length")


@query(f"""{STATS} SELECT round(max_ratio, 6) AS value, count(*) AS n, round(sum(count(*)) OVER (ORDER BY max_ratio) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM st GROUP BY max_ratio""", "alignments")
def ecdf(spark, sf_dir):
    return rounded(reads.ecdf(stats_of(spark, sf_dir)), "value", "percent")


@query(f"{STATS} SELECT CAST(least(floor(max_ratio * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM st GROUP BY 1", "alignments")
def ratio_hist50(spark, sf_dir):
    return reads.histogram(stats_of(spark, sf_dir), "max_ratio", 50, 0.0, 1.0)


@query(f"""{STATS} SELECT CASE WHEN max_ratio = 1 THEN '=1' WHEN max_ratio >= 0.8 THEN '[0.8,1)' WHEN max_ratio >= 0.5 THEN '[0.5,0.8)' ELSE '(0,0.5)' END AS bucket, count(*) AS n, min(alignment_count) AS min,
  quantile_cont(alignment_count, 0.25) AS q1, quantile_cont(alignment_count, 0.5) AS median, quantile_cont(alignment_count, 0.75) AS q3, max(alignment_count) AS max FROM st GROUP BY 1""", "alignments")
def box_by_dominance(spark, sf_dir):
    return reads.box_by_bucket(stats_of(spark, sf_dir))


@query("""WITH h AS (SELECT read_id, ord FROM alignments ORDER BY ord LIMIT 10000), c AS (SELECT coalesce(lag(read_id) OVER (ORDER BY ord) <> read_id, true) AS fresh FROM h)
SELECT count(*) AS checked, count(*) FILTER (WHERE fresh) AS changes, count(*) > 100 AND count(*) FILTER (WHERE fresh) > 0.5 * count(*) AS looks_sorted FROM c""", "alignments")
def sort_order_probe(spark, sf_dir):
    return reads.name_order_probe(alignments(spark, sf_dir))


@query(f"{STATS} SELECT read_id, alignment_count, unique_transcript_count, CASE WHEN is_uniquely_mapped THEN 'Yes' ELSE 'No' END AS is_uniquely_mapped, max_transcript, max_count, printf('%.4f', max_ratio) AS max_ratio, unique_transcripts FROM st", "alignments")
def read_table(spark, sf_dir):
    return sinks.read_table(stats_of(spark, sf_dir, lists=True))


# ---- barcodes --------------------------------------------------------------

PARTS = "p AS (SELECT ord, read_id, string_split(read_id, '_') AS x FROM names), b AS (SELECT ord, read_id, CASE WHEN len(x) >= 3 THEN x[-2] END AS barcode, CASE WHEN len(x) >= 3 THEN x[-1] END AS umi FROM p)"


def tagged(spark, sf_dir):
    empty = F.create_map().cast("map<string,string>")
    old = F.create_map(F.lit("CB"), F.lit("old"), F.lit("NM"), F.lit("1"))
    return proxy(spark, sf_dir, "names").withColumn("tags", F.when(F.col("ord") % 2 == 0, old).otherwise(empty))


@query(f"WITH {PARTS} SELECT ord, barcode, umi FROM b", "names")
def barcode_parse(spark, sf_dir):
    return proxy(spark, sf_dir, "names").select("ord", F.inline(F.array(scalar.read_name_parts("read_id"))))


@query(f"WITH {PARTS} SELECT barcode, umi, count(*) AS n FROM b WHERE barcode <> '' AND umi <> '' GROUP BY 1, 2", "names")
def barcode_umi_counts(spark, sf_dir):
    return barcodes.barcode_umi_counts(proxy(spark, sf_dir, "names"))


@query(f"WITH {PARTS}, t AS (SELECT *, coalesce(barcode <> '' AND umi <> '', false) AS ok FROM b) SELECT count(*) FILTER (WHERE ok) AS with_tags, count(*) FILTER (WHERE NOT ok) AS without_tags, count(DISTINCT barcode) FILTER (WHERE ok) AS barcodes, count(DISTINCT umi) FILTER (WHERE ok) AS umis FROM t", "names")
def barcode_totals(spark, sf_dir):
    return barcodes.barcode_totals(proxy(spark, sf_dir, "names"))


TAGS = f"WITH {PARTS}, t AS (SELECT ord, read_id, CASE WHEN barcode <> '' AND umi <> '' THEN barcode WHEN ord % 2 = 0 THEN 'old' END AS cb, CASE WHEN barcode <> '' AND umi <> '' THEN umi END AS um FROM b)"


@query(f"{TAGS} SELECT cb AS barcode, min(ord) AS first FROM t WHERE cb IS NOT NULL GROUP BY 1", "names")
def barcode_distinct(spark, sf_dir):
    return barcodes.barcode_list(barcodes.add_barcode_tags(tagged(spark, sf_dir)), unique_only=True)


@query(f"{TAGS} SELECT ord, cb, um, CASE WHEN ord % 2 = 0 THEN '1' END AS nm, CASE WHEN ord % 5 <> 0 THEN 'T' || (ord % 9) ELSE '*' END AS xt FROM t", "names")
def tag_projection(spark, sf_dir):
    named = tagged(spark, sf_dir).withColumn("ref_name", F.when(F.col("ord") % 5 != 0, F.concat(F.lit("T"), (F.col("ord") % 9).cast("string"))))
    out = barcodes.add_gene_tag(barcodes.add_barcode_tags(named))
    return out.select("ord", *[F.try_element_at("tags", F.lit(t)).alias(t.lower()) for t in ("CB", "UM", "NM", "XT")])


@query(f"{TAGS} SELECT ord, read_id, cb AS barcode, um AS umi FROM t WHERE cb IS NOT NULL AND um IS NOT NULL ORDER BY ord LIMIT 10", "names")
def validate_tags_head(spark, sf_dir):
    return barcodes.validate_tags(barcodes.add_barcode_tags(tagged(spark, sf_dir)))


# ---- read quality ----------------------------------------------------------

MEANQ = """q AS (SELECT *, CASE WHEN length(quality) > 60 THEN substr(quality, 61) ELSE quality END AS t FROM fastq),
m AS (SELECT * EXCLUDE (t), CASE WHEN length(quality) = 0 THEN 0.0 ELSE -10 * log10(list_sum(list_transform(string_split(t, ''), lambda c: pow(10.0, -(ascii(c) - 33) / 10.0))) / length(t)) END AS mean_q FROM q)"""


@query(f"WITH {MEANQ} SELECT rec, round(mean_q, 6) AS mean_q FROM m", "fastq")
def fastq_mean_q(spark, sf_dir):
    return rounded(quality.with_mean_q(proxy(spark, sf_dir, "fastq")), "mean_q").select("rec", "mean_q")


@query(f"WITH {MEANQ} SELECT CASE WHEN mean_q > 10 THEN 'pass' ELSE 'fail' END AS verdict, condition, count(*) AS n FROM m GROUP BY 1, 2", "fastq")
def fastq_pass_fail(spark, sf_dir):
    return quality.quality_verdict(proxy(spark, sf_dir, "fastq")).groupBy("verdict", "condition").agg(F.count("*").alias("n"))


@query("SELECT event_id AS rec, '@' || event_id AS header, event_type AS sequence, '+' AS plus, repeat('I', CAST(user_id % 5 AS INTEGER) + 1) AS quality FROM events")
def fastq_framing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    four = F.array(F.concat(F.lit("@"), F.col("event_id").cast("string")), F.col("event_type"), F.lit("+"), F.repeat(F.lit("I"), (F.col("user_id") % 5).cast("int") + 1))
    lines = e.select(F.lit("f").alias("file"), F.posexplode(four).alias("i", "value"), "event_id").select("file", (F.col("event_id") * 4 + F.col("i")).alias("ord"), "value")
    return fastq_source.frame_lines(lines).drop("file")


CONDITIONS_SQL = """SELECT condition, CAST(coalesce(sum(n_bytes) FILTER (WHERE verdict = 'pass'), 0) AS BIGINT) AS pass_bytes, CAST(coalesce(sum(n_bytes) FILTER (WHERE verdict = 'fail'), 0) AS BIGINT) AS fail_bytes,
  CAST(coalesce(sum({r}) FILTER (WHERE verdict = 'pass'), 0) AS BIGINT) AS pass_reads, CAST(coalesce(sum({r}) FILTER (WHERE verdict = 'fail'), 0) AS BIGINT) AS fail_reads,
  floor(coalesce(sum({r}) FILTER (WHERE verdict = 'pass'), 0) * 10000 / sum({r})) / 100.0 AS pass_percent FROM files WHERE condition IS NOT NULL GROUP BY ROLLUP (condition)"""


@query(CONDITIONS_SQL.format(r="n_lines // 4"), "files")
def condition_stats(spark, sf_dir):
    return quality.condition_stats(proxy(spark, sf_dir, "files"))


@query(CONDITIONS_SQL.format(r="n_bytes // 1000"), "files")
def condition_stats_fast(spark, sf_dir):
    return quality.condition_stats(proxy(spark, sf_dir, "files"), fast=True)


# ---- lengths ---------------------------------------------------------------

CIGARS = "SELECT concat(CAST(l_suppkey % 9 + 1 AS {s}), 'S', CAST(CAST(l_quantity AS INT) AS {s}), 'M', CAST(l_linenumber AS {s}), 'I', CAST(l_partkey % 5 + 1 AS {s}), 'D', CAST(l_linenumber % 3 + 1 AS {s}), '=') AS cigar FROM {lineitem}"


@query("SELECT CAST(CAST(l_quantity AS INTEGER) + l_linenumber + l_linenumber % 3 + 1 AS BIGINT) AS length, count(*) AS n FROM lineitem GROUP BY 1")
def cigar_mapped_length(spark, sf_dir):
    df = spark.sql(CIGARS.replace("{s}", "STRING"), lineitem=table(spark, sf_dir, "lineitem"))
    return df.groupBy(scalar.cigar_text_mapped_length("cigar").alias("length")).agg(F.count("*").alias("n"))


DISTRIBUTION = """d AS (SELECT 'raw' AS kind, length, n FROM lengths UNION ALL SELECT 'mapped', CAST(l_quantity AS BIGINT) + l_linenumber, count(*) FROM lineitem GROUP BY 2)"""


def distribution(spark, sf_dir):
    op = lambda code, length: F.struct(F.lit(code).alias("op"), length.cast("int").alias("len"))
    cigar = F.array(op(0, F.col("l_quantity")), op(2, F.lit(5)), op(1, F.col("l_linenumber")))
    mapped = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("flag"), cigar.alias("cigar"))
    raw = proxy(spark, sf_dir, "lengths").select(F.concat_ws(" ", F.lit("RL"), F.col("length").cast("string"), F.col("n").cast("string")).alias("value"))
    return lengths.length_distribution(text.parse_length_lines(raw), lengths.mapped_lengths(mapped))


@query(f"WITH {DISTRIBUTION} SELECT kind, CAST(length AS BIGINT) AS length, n FROM d", "lengths")
def length_distribution(spark, sf_dir):
    return distribution(spark, sf_dir)


@query(f"""WITH {DISTRIBUTION}, e AS (SELECT kind, length, unnest(range(n)) FROM d)
SELECT kind, count(*) AS n, round(avg(length), 6) AS mean, round(median(length), 6) AS median, round(stddev_pop(length), 6) AS std, CAST(min(length) AS BIGINT) AS min, CAST(max(length) AS BIGINT) AS max,
  round(quantile_cont(length, 0.05), 6) AS q5, round(quantile_cont(length, 0.25), 6) AS q25, round(quantile_cont(length, 0.75), 6) AS q75, round(quantile_cont(length, 0.95), 6) AS q95,
  (SELECT CAST(length AS BIGINT) FROM d WHERE d.kind = e.kind ORDER BY n DESC, length LIMIT 1) AS mode, CAST(max(length) - min(length) AS BIGINT) AS "range", round(stddev_pop(length) * 100 / avg(length), 6) AS cv_percent FROM e GROUP BY kind""", "lengths")
def length_summary(spark, sf_dir):
    return rounded(lengths.length_summary(distribution(spark, sf_dir)), "mean", "median", "std", "q5", "q25", "q75", "q95", "cv_percent")


# ---- reactivity ------------------------------------------------------------

JOINED = """s AS (SELECT * FROM sides WHERE side = 'A' AND mutrate IS NOT NULL), c AS (SELECT * FROM sides WHERE side = 'R' AND mutrate IS NOT NULL),
j AS (SELECT gene, pos, sample, s.mutrate AS mutrate_signal, c.mutrate AS mutrate_control, s.mutrate - c.mutrate AS reactivity, s.coverage AS coverage_signal, c.coverage AS coverage_control FROM s JOIN c USING (gene, pos, sample))"""
SHOWN = "gene, pos, sample, round(mutrate_signal, 6) AS mutrate_signal, round(mutrate_control, 6) AS mutrate_control, round(reactivity, 6) AS reactivity, coverage_signal, coverage_control"


def sides_of(spark, sf_dir):
    df = proxy(spark, sf_dir, "sides")
    return df.where("side = 'A'"), df.where("side = 'R'")


def joined(spark, sf_dir):
    return reactivity.calculate_reactivity(*sides_of(spark, sf_dir), sample_col="sample")


@query(f"""WITH {JOINED} SELECT (SELECT count(*) FROM sides WHERE side = 'A') AS signal_rows, (SELECT count(*) FROM sides WHERE side = 'A' AND mutrate IS NULL) AS signal_without_rate,
  (SELECT count(*) FROM sides WHERE side = 'R') AS control_rows, (SELECT count(*) FROM sides WHERE side = 'R' AND mutrate IS NULL) AS control_without_rate,
  (SELECT count(*) FROM s ANTI JOIN c USING (gene, pos, sample)) AS signal_alone, (SELECT count(*) FROM c ANTI JOIN s USING (gene, pos, sample)) AS control_alone, (SELECT count(*) FROM j) AS joined_rows""", "sides")
def reactivity_dropped(spark, sf_dir):
    """What the join leaves out, and why."""
    return reactivity.dropped_rows(*sides_of(spark, sf_dir), sample_col="sample")


RATES = ("mutrate_signal", "mutrate_control", "reactivity")


@query(f"WITH {JOINED} SELECT {SHOWN} FROM j", "sides")
def reactivity_join(spark, sf_dir):
    return rounded(joined(spark, sf_dir), *RATES)


CLIPPED = """p AS (SELECT sample, quantile_cont(reactivity, 0.05) AS lo, quantile_cont(reactivity, 0.95) AS hi FROM j GROUP BY sample)
SELECT {shown}, round(CASE WHEN lo = hi THEN reactivity ELSE greatest(0, least(1, (reactivity - lo) / (hi - lo))) END, 6) AS normalized_reactivity FROM j JOIN p USING (sample)"""


@query(f"WITH {JOINED}, {CLIPPED.format(shown=SHOWN)}", "sides")
def reactivity_clip_norm(spark, sf_dir):
    return rounded(reactivity.clip_scale(joined(spark, sf_dir), by=("sample",)), *RATES, "normalized_reactivity")


def gene_norm_sql(by: str, source: str = "j") -> str:
    return f"""a AS (SELECT {by}, greatest(CASE WHEN count(*) >= 500 THEN quantile_cont(reactivity, 0.99) ELSE quantile_cont(reactivity, 0.95) END, 1.5 * (quantile_cont(reactivity, 0.75) - quantile_cont(reactivity, 0.25))) AS cap FROM {source} GROUP BY ALL),
k AS (SELECT {source}.* FROM {source} JOIN a USING ({by}) WHERE reactivity < cap), t AS (SELECT {by}, quantile_cont(reactivity, 0.9) AS p90 FROM k GROUP BY ALL),
dv AS (SELECT {by}, avg(reactivity) AS divisor FROM k JOIN t USING ({by}) WHERE reactivity > p90 GROUP BY ALL)"""


NORMALIZED = f"SELECT {SHOWN}, round(reactivity / nullif(divisor, 0), 4) AS normalized_reactivity FROM j LEFT JOIN dv USING"


def shown_norm(df):
    return rounded(rounded(df, *RATES), "normalized_reactivity", digits=4)


def column_norm_sql(c: str) -> str:
    """Divisors dv_<c> of a column by gene."""
    return f"""a_{c} AS (SELECT gene, greatest(CASE WHEN count(*) >= 500 THEN quantile_cont({c}, 0.99) ELSE quantile_cont({c}, 0.95) END, 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))) AS cap FROM j GROUP BY ALL),
k_{c} AS (SELECT j.* FROM j JOIN a_{c} USING (gene) WHERE {c} < cap), t_{c} AS (SELECT gene, quantile_cont({c}, 0.9) AS p90 FROM k_{c} GROUP BY ALL),
dv_{c} AS (SELECT gene, avg({c}) AS divisor FROM k_{c} JOIN t_{c} USING (gene) WHERE {c} > p90 GROUP BY ALL)"""


@query(f"""WITH {JOINED}, {column_norm_sql('mutrate_signal')}, {column_norm_sql('mutrate_control')}
SELECT gene, pos, sample, round(mutrate_signal / nullif(s1.divisor, 0), 4) AS mutrate_signal_normalized, round(mutrate_control / nullif(s2.divisor, 0), 4) AS mutrate_control_normalized
FROM j LEFT JOIN dv_mutrate_signal s1 USING (gene) LEFT JOIN dv_mutrate_control s2 USING (gene)""", "sides")
def normalized_columns(spark, sf_dir):
    """All numeric columns but the keys are found and normalized by gene."""
    df = joined(spark, sf_dir).select("gene", "pos", "sample", "mutrate_signal", "mutrate_control")
    names = ["mutrate_signal_normalized", "mutrate_control_normalized"]
    return rounded(reactivity.normalize_by_gene(df, keys=("pos",)), *names, digits=4).select("gene", "pos", "sample", *names)


@query(f"WITH {JOINED}, {gene_norm_sql('gene')} {NORMALIZED} (gene)", "sides")
def reactivity_gene_norm(spark, sf_dir):
    return shown_norm(reactivity.normalize_by_gene(joined(spark, sf_dir), ["reactivity"]))


@query(f"WITH {JOINED}, {gene_norm_sql('sample, gene')} {NORMALIZED} (sample, gene)", "sides")
def reactivity_pipeline(spark, sf_dir):
    return shown_norm(reactivity.normalized_reactivity(*sides_of(spark, sf_dir), sample_col="sample"))


@query(f"""WITH {JOINED}, r AS (SELECT gene, reactivity, row_number() OVER (PARTITION BY gene ORDER BY reactivity) AS rn, count(*) OVER (PARTITION BY gene) AS n FROM j),
l AS (SELECT gene, min(reactivity) FILTER (WHERE rn = floor(0.05 * n) + 1) AS lo, min(reactivity) FILTER (WHERE rn = n - floor(0.1 * n)) AS hi FROM r GROUP BY gene)
SELECT gene, pos, sample, round(least(greatest(reactivity, lo), hi), 6) AS reactivity FROM j JOIN l USING (gene)""", "sides")
def winsorize_gene(spark, sf_dir):
    out = reactivity.winsorize(joined(spark, sf_dir), "reactivity", ("gene",), 0.05, 0.1)
    return rounded(out, "reactivity").select("gene", "pos", "sample", "reactivity")


# ---- correlation -----------------------------------------------------------

EVENT_TYPES = "m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1, 2), full_users AS (SELECT user_id FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events))"


@query(f"""WITH {EVENT_TYPES} SELECT x.event_type AS a, y.event_type AS b, round(corr(x.v, y.v), 6) AS r, count(*) AS n FROM m x JOIN m y USING (user_id)
WHERE user_id IN (SELECT user_id FROM full_users) AND x.event_type <= y.event_type GROUP BY 1, 2""")
def pivot_pearson(spark, sf_dir):
    return rounded(correlation.pivot_pearson(table(spark, sf_dir, "events"), "user_id", "event_type", "value"), "r")


@query("""WITH m AS (SELECT l_orderkey % 40 AS i, concat('s', CAST(l_suppkey AS VARCHAR)) AS g, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
whole AS (SELECT i FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT l_suppkey) FROM lineitem))
SELECT x.g AS a, y.g AS b, round(corr(x.v, y.v), 6) AS r, count(*) AS n FROM m x JOIN m y USING (i) WHERE i IN (SELECT i FROM whole) AND x.g <= y.g GROUP BY 1, 2""")
def pivot_pearson_wide(spark, sf_dir):
    """As many groups as there are suppliers, in one pass."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).alias("i"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("g"), "l_quantity")
    return rounded(correlation.pivot_pearson(rows, "i", "g", "l_quantity"), "r")


# Ward's method by centroids, one merge a step; clusters are numbered as they arise.
WARD_SQL = f"""WITH RECURSIVE {EVENT_TYPES},
r AS (SELECT x.event_type AS a, y.event_type AS b, corr(x.v, y.v) AS r FROM m x JOIN m y USING (user_id) WHERE user_id IN (SELECT user_id FROM full_users) GROUP BY 1, 2),
leaves AS (SELECT row_number() OVER (ORDER BY a) - 1 AS id, 1 AS size, list(r ORDER BY b) AS c FROM r GROUP BY a),
steps AS (
  SELECT -1 AS step, (SELECT count(*) FROM leaves) AS fresh, (SELECT list(struct_pack(id := id, size := size, c := c) ORDER BY id) FROM leaves) AS held,
    CAST(NULL AS STRUCT(d DOUBLE, a BIGINT, b BIGINT, size BIGINT)) AS merged
  UNION ALL
  SELECT step + 1, fresh + 1,
    list_append(list_filter(held, lambda x: x.id <> best.a AND x.id <> best.b), struct_pack(id := CAST(fresh AS BIGINT), size := CAST(best.size AS INTEGER), c := best.c)),
    struct_pack(d := sqrt(best.d), a := CAST(best.a AS BIGINT), b := CAST(best.b AS BIGINT), size := CAST(best.size AS BIGINT))
  FROM (
    SELECT step, fresh, held, list_sort(flatten(list_transform(held, lambda x: list_transform(list_filter(held, lambda y: y.id > x.id), lambda y: struct_pack(
      d := 2.0 * x.size * y.size / (x.size + y.size) * list_sum(list_transform(list_zip(x.c, y.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
      a := x.id, b := y.id, size := x.size + y.size, c := list_transform(list_zip(x.c, y.c), lambda z: (z[1] * x.size + z[2] * y.size) / (x.size + y.size)))))))[1] AS best
    FROM steps WHERE len(held) > 1) s)
SELECT CAST(step AS INTEGER) AS step, CAST(merged.a AS INTEGER) AS "left", CAST(merged.b AS INTEGER) AS "right", round(merged.d, 6) AS height, CAST(merged.size AS INTEGER) AS size, CAST(NULL AS VARCHAR) AS name
FROM steps WHERE step >= 0
UNION ALL SELECT -1, NULL, NULL, NULL, 1, event_type FROM (SELECT DISTINCT event_type FROM events)"""


@query(WARD_SQL)
def cluster_map(spark, sf_dir):
    """The merges of the samples' correlations."""
    pairs = correlation.pivot_pearson(table(spark, sf_dir, "events"), "user_id", "event_type", "value")
    return rounded(correlation.cluster_map(pairs).drop("place"), "height")


_METRICS = ("exact_rate", "multiple_rate", "overall_rate")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM runs" for a in _METRICS for b in _METRICS if a <= b), "runs")
def pairwise_corr(spark, sf_dir):
    return rounded(correlation.pairwise(proxy(spark, sf_dir, "runs"), list(_METRICS)), "r")


# ---- sweeps ----------------------------------------------------------------


GRID_SQL = """(VALUES ('very-sensitive-local'), ('very-sensitive'), ('sensitive-local'), ('sensitive')) t_s(sensitivity) CROSS JOIN (VALUES ('3,1'), ('6,2')) t_m(mp)
  CROSS JOIN (VALUES ('5,1'), ('5,3')) t_d(rdg) CROSS JOIN (VALUES ('5,1'), ('5,3')) t_f(rfg)"""


@query(f"SELECT * FROM {GRID_SQL}")
def sweep_grid(spark, sf_dir):
    return sweep.grid(spark)


@query(f"SELECT 'bowtie_' || sensitivity || '_mp_' || replace(mp, ',', '-') || '_rdg_' || replace(rdg, ',', '-') || '_rfg_' || replace(rfg, ',', '-') AS name, 'bowtie-' || sensitivity AS sensitivity, mp, rdg, rfg FROM {GRID_SQL}")
def param_codec(spark, sf_dir):
    named = sweep.grid(spark).select(sweep.encode_name(*[F.col(c) for c in sweep.GRID]).alias("name"))
    return named.select("name", *[c.alias(n) for n, c in sweep.decode_name(F.col("name")).items()])


LOG = """SELECT concat('d', CAST(o_orderkey % 100 AS {s})) AS directory, concat('s', CAST(o_orderkey AS {s})) AS stem, concat(CAST(n AS {s}), ' reads; of these:\n    ', CAST(n - a - b AS {s}), ' (1.00%) aligned 0 times\n    ', CAST(a AS {s}),
  ' (2.00%) aligned exactly 1 time\n    ', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(CAST(b AS {s}), ' (3.00%) aligned >1 times\n') END, CASE WHEN o_orderkey % 4 <> 0 THEN concat(CAST(a % 100 AS {s}), '.25% overall alignment rate\n') ELSE '' END) AS value
FROM (SELECT o_orderkey, o_orderkey % 1000 AS n, (o_orderkey % 1000) // 2 AS a, (o_orderkey % 1000) // 3 AS b FROM {t}) x"""
LOG_CTE = "x AS (SELECT o_orderkey, o_orderkey % 1000 AS n, (o_orderkey % 1000) // 2 AS a, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000) // 3 END AS b FROM orders)"
LOG_COLUMNS = """'d' || (o_orderkey % 100) AS directory, 's' || o_orderkey AS stem, n AS total_reads, a AS aligned_exactly_1, b AS aligned_multiple, CAST(NULL AS BIGINT) AS unaligned, CASE WHEN o_orderkey % 4 <> 0 THEN a % 100 + 0.25 END::DOUBLE AS overall_rate,
  CASE WHEN b IS NOT NULL THEN round(CAST(a AS DOUBLE) * 100 / nullif(n, 0), 6) END AS exact_rate, round(CAST(b AS DOUBLE) * 100 / nullif(n, 0), 6) AS multiple_rate, round(CAST(a + b AS DOUBLE) * 100 / nullif(n, 0), 6) AS calculated_rate"""


def parsed_logs(spark, sf_dir):
    raw = spark.sql(LOG.replace("{s}", "STRING").replace("//", "div").replace("{t}", "{orders}"), orders=table(spark, sf_dir, "orders"))
    out = raw.select("directory", "stem", *[c.alias(n) for n, c in sweep.parse_log(F.col("value")).items()])
    return rounded(out, "exact_rate", "multiple_rate", "calculated_rate")


@query(f"WITH {LOG_CTE} SELECT {LOG_COLUMNS} FROM x")
def log_regex(spark, sf_dir):
    return parsed_logs(spark, sf_dir)


@query(f"WITH {LOG_CTE} SELECT {LOG_COLUMNS}, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS mean FROM x JOIN orders USING (o_orderkey)")  # the others' summaries lie elsewhere
def log_summary_join(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    elsewhere = F.when(key % 3 == 0, "d").otherwise("other/d")
    summaries = o.select(F.concat(elsewhere, (key % 100).cast("string")).alias("directory"), F.concat(F.lit("s"), key.cast("string")).alias("stem"), F.col("o_totalprice").alias("mean"))
    return sweep.join_summaries(parsed_logs(spark, sf_dir), summaries)


GROUP_SQL = " UNION ALL ".join(f"SELECT '{p}' AS parameter, {p} AS value, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, count({m}) AS n FROM runs GROUP BY {p}" for p in ("sensitivity", "mp", "rdg", "rfg") for m in ("overall_rate", "exact_rate", "multiple_rate") if p != "mp" or m == "overall_rate")


@query(GROUP_SQL, "runs")
def sweep_group_stats(spark, sf_dir):
    return rounded(sweep.group_stats(proxy(spark, sf_dir, "runs")), "mean", "std")


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 6) AS mean, round(median({m}), 6) AS median, round(max({m}), 6) AS max, round(min({m}), 6) AS min FROM runs" for m in sweep.METRICS), "runs")
def sweep_metric_summary(spark, sf_dir):
    return rounded(sweep.metric_summary(proxy(spark, sf_dir, "runs")), "mean", "median", "max", "min")


@query("SELECT sensitivity, round(avg(overall_rate) FILTER (WHERE mp = 'm0'), 6) AS m0, round(avg(overall_rate) FILTER (WHERE mp = 'm1'), 6) AS m1 FROM runs GROUP BY 1", "runs")
def sweep_pivot(spark, sf_dir):
    return rounded(sweep.pivot_mean(proxy(spark, sf_dir, "runs"), "sensitivity", "mp", "overall_rate", ["m0", "m1"]), "m0", "m1")


@query("SELECT * FROM runs WHERE overall_rate IS NOT NULL ORDER BY overall_rate DESC, directory, stem LIMIT 1", "runs")
def best_combo(spark, sf_dir):
    return sweep.best_run(proxy(spark, sf_dir, "runs"))


# ---- VCF and structure text ------------------------------------------------

CELLS = [f"c{i}" for i in range(1, 8)]


def vcf_lines(spark, sf_dir) -> DataFrame:
    """A cell VCF from the cell_position proxy: a missing cell is .:.:.:.:.:. , every
    second position has only three values in ALL."""
    df = proxy(spark, sf_dir, "cell_position")
    every = F.concat_ws(",", F.col("dp").cast("string"), F.col("ad").cast("string"), F.lit("1"), F.when(F.col("pos") % 2 == 0, "2"))
    value = F.when(F.col("dp").isNotNull(), F.concat_ws(":", F.lit("0/1"), F.col("ad").cast("string"), F.col("dp").cast("string"), F.lit("0"), F.lit("."), every))
    named = F.map_from_entries(F.collect_list(F.struct("cell", F.coalesce(value, F.lit(".:.:.:.:.:.")).alias("t"))))
    rows = df.groupBy("gene", "pos").agg(named.alias("m"))
    texts = F.transform(F.array(*[F.lit(c) for c in CELLS]), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(".:.:.:.:.:.")))
    head = [F.col("gene"), F.col("pos").cast("string"), *[F.lit(x) for x in (".", "A", "G", ".", "PASS", "AD=1;DP=2", "GT:AD:DP:OTH:PL:ALL")]]
    return rows.select(F.concat_ws("\t", *head, F.array_join(texts, "\t")).alias("value"))


VCF_SQL = """WITH k AS (SELECT gene, pos, cell, CAST(substr(cell, 2) AS INTEGER) - 1 AS cell_idx, dp + ad + 1 + CASE WHEN pos % 2 = 0 THEN 2 ELSE 0 END AS coverage, dp - ad AS ref FROM cell_position WHERE dp IS NOT NULL {more})
SELECT gene, pos, 'A' AS ref, cell, cell_idx, coverage, round(CAST(coverage - ref AS DOUBLE) / coverage, 6) AS mutrate FROM k"""


@query(VCF_SQL.format(more=""), "cell_position")
def vcf_cell_parse_dense(spark, sf_dir):
    return rounded(vcf.parse_cells_dense(vcf_lines(spark, sf_dir), CELLS), "mutrate")


@query(VCF_SQL.format(more="AND pos % 2 = 0"), "cell_position")
def vcf_cell_parse_sparse(spark, sf_dir):
    return rounded(vcf.parse_cells_sparse(vcf_lines(spark, sf_dir), CELLS), "mutrate")


@query(CELL_SQL.format(where=""), "cell_position")
def vcf_to_cell_windows(spark, sf_dir):
    return windows.cell_windows(vcf.parse_cell_positions(vcf_lines(spark, sf_dir), CELLS))


BASE_SQL = """WITH b AS (SELECT 'g' || l_suppkey AS gene, l_partkey AS pos, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS dp, CAST(max(l_linenumber) AS BIGINT) AS ad, CAST(max(l_linenumber) * 2 AS BIGINT) AS oth FROM lineitem GROUP BY l_suppkey, l_partkey)
SELECT gene, pos, 'C' AS ref, {c} AS coverage, round(CAST({a} AS DOUBLE) / ({c}), 6) AS mutrate FROM b WHERE {c} >= 40"""


def base_lines(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("dp"), F.max("l_linenumber").alias("ad"))
    info = F.concat(F.lit("AD="), F.col("ad").cast("string"), F.lit(";FLAG;DP="), F.col("dp").cast("string"), F.lit(";OTH="), (F.col("ad") * 2).cast("string"))
    return df.select(F.concat_ws("\t", F.concat(F.lit("g"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"), *[F.lit(x) for x in (".", "C", ".", ".", "PASS")], info).alias("value"))


@query(BASE_SQL.format(c="dp", a="ad"))
def base_vcf_info(spark, sf_dir):
    return rounded(vcf.parse_base(base_lines(spark, sf_dir), min_coverage=40), "mutrate")


@query(BASE_SQL.format(c="(dp + oth)", a="(ad + oth)"))
def base_vcf_info_with_other(spark, sf_dir):
    return rounded(vcf.parse_base(base_lines(spark, sf_dir), True, 40), "mutrate")


def window_lines(spark, sf_dir):
    found = windows.cell_windows(proxy(spark, sf_dir, "cell_position"))
    return sinks.window_vcf_lines(found, CELLS).select("value")


ROUND_TRIP = f"w AS (SELECT gene, win, win_end, 'N' AS ref, cell, dp, mr FROM ({CELL_SQL.format(where='')}) z)"


@query(f"WITH {ROUND_TRIP} SELECT * FROM w", "cell_position")
def window_vcf_roundtrip(spark, sf_dir):
    return vcf.parse_windows(window_lines(spark, sf_dir), CELLS)


@query("SELECT prefix, '((' || min(n_nationkey) || '))' AS dot_bracket FROM nation JOIN (VALUES ('NATION_1'), ('NATION_23'), ('NATION_7 x')) t(prefix) ON starts_with(n_name || ' x', prefix) GROUP BY prefix")
def dot_bracket_lookup(spark, sf_dir):
    """The first header that begins with the name: NATION_1 is the prefix of others too."""
    n = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    three = F.array(F.concat(F.lit(">"), F.col("n_name"), F.lit(" x")), F.concat(F.lit("(("), F.col("n_nationkey").cast("string")), F.lit("))"))
    path = staged(n.select(F.explode(three).alias("value")), "structures")
    found = [text.dot_bracket(text.numbered_lines(spark, path), p).withColumn("prefix", F.lit(p)) for p in ("NATION_1", "NATION_23", "NATION_7 x")]
    return reduce(DataFrame.unionByName, found)


@query("SELECT gene || '.' || pos AS key, gene, pos FROM position", "position")
def dotted_keys(spark, sf_dir):
    keyed = proxy(spark, sf_dir, "position").select(scalar.dotted_key("gene", "pos").alias("key"))
    gene, pos = scalar.split_dotted("key")
    return keyed.select("key", gene.alias("gene"), pos.alias("pos"))


@query("""SELECT p.cluster, p.gene, p.win, p.coverage, p.sample, round(p.mutrate, 9) AS mutrate FROM (SELECT leiden AS cluster, gene, win, min(dp) AS coverage, avg(mr) AS mutrate, 'dmso_' || leiden AS sample
  FROM (""" + CELL_SQL.format(where="") + """) w JOIN metadata USING (cell) WHERE dp >= 200 AND mr <= 0.2 GROUP BY leiden, gene, win) p""", "cell_position", "metadata")
def single_cell_pipeline(spark, sf_dir):
    meta = proxy(spark, sf_dir, "metadata")
    out = pipelines.single_cell_profile(proxy(spark, sf_dir, "cell_position"), meta, meta)
    return rounded(out, "mutrate", digits=9).drop("mutant")


from . import filequeries  # noqa: E402, F401
