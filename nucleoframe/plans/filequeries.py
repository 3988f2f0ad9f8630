"""Registered queries that go through files: proxies are written by the sinks (or as plain
text) to the shared folder and read again by the sources."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks
from ..operators import barcodes, correlation, lengths, mutrate, quality, ranks, reactivity, reads, sweep, windows
from ..session import shared_path, written
from ..sources import bam, blocktext, fastq, files, text, vcf
from ..sources.files import sized
from ..streaming import online
from .proxies import proxy
from .queries import CELL_SQL, CELLS, GROUP_SQL, JOINED, MUTRATE_SQL, ROUND_TRIP, VCF_SQL, count_lines, joined, query, rounded, staged, table, vcf_lines

M_CTE = MUTRATE_SQL.split("SELECT gene, pos, pos + 1")[0]


def text_lines(spark, sf_dir, name: str, columns: list[str]) -> DataFrame:
    """A proxy's columns as tab-separated lines; NULL is NA."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return proxy(spark, sf_dir, name).select(F.concat_ws("\t", *cells).alias("value"))


def headed(spark, head: list[str], body: DataFrame) -> DataFrame:
    """(ord, value): lines with others before them."""
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "ord int, value string")
    return first.union(body.select(F.lit(0).alias("ord"), "value"))


@query(M_CTE + """ SELECT gene, pos, pos + 1 AS "end", gene || '.' || pos AS gene_position, round(CAST(mutant AS DOUBLE) / nullif(coverage, 0), 8) AS mutrate, '.' AS strand, coverage, adj_coverage, mutant,
  CAST(NULL AS DOUBLE) AS normalized_cov, CAST(NULL AS BIGINT) AS g_readcount, CASE WHEN pos % 2 = 0 THEN 'a' ELSE 'A' END AS refnt FROM m""")
def position_table_file(spark, sf_dir):
    """Count file to position table, written as TSV and read again."""
    path = shared_path(spark, "positions")
    positions = mutrate.mutation_rates(text.read_counts(spark, staged(count_lines(spark, sf_dir), "counts", "gzip")))
    sinks.write_tsv(mutrate.position_table(positions), path)
    return text.read_positions(spark, path).drop("detail")


WINDOW_FILE_SQL = "SELECT gene, pos AS win, coverage, mutant, round(mutrate, 6) AS mutrate, pos + 9 AS win_end, 'x_' || side AS sample FROM position JOIN (VALUES ('one'), ('two')) t(side) ON (side = 'one') = (pos % 2 = 0) WHERE coverage >= 500"


@query(WINDOW_FILE_SQL, "position")
def window_files(spark, sf_dir):
    """Window tables of a folder, several files of each sample, with the coverage filter; a file
    that is no gzip is skipped."""
    folder, parts = shared_path(spark, "windows"), shared_path(spark, "window-parts")
    shown = proxy(spark, sf_dir, "position").withColumn("win_end", F.col("pos") + 9).select("gene", F.col("pos").alias("win"), "coverage", "mutant", "mutrate", "win_end")
    side = F.when(F.col("win") % 2 == 0, "one").otherwise("two").alias("side")
    sinks.write_tsv(shown.select("*", side).repartition(max(4, sized(shown))), parts, header=True, by=["side"])
    files.gather(spark, parts, folder, lambda value, k: f"{value}-{k}_counts_mutrate.10nt.csv.gz")
    files.write_single(spark.createDataFrame([("no gzip",)], "value string"), folder, "odd_counts_mutrate.10nt.csv.gz")
    found = text.read_window_files(spark, folder, prefix="x_", coverage_threshold=500)
    return rounded(found.withColumn("sample", F.regexp_replace("sample", "-[0-9]+$", "")), "mutrate")


@query("SELECT gene, pos, round(mutrate, 6) AS mutrate, coverage, mutant, CASE WHEN pos % 2 = 0 THEN 'named' ELSE 'plain' END AS sample FROM position WHERE coverage >= 500 AND mutrate <= 0.05", "position")
def position_files(spark, sf_dir):
    """Position tables with and without a header, several files of each; a file without the
    columns is left out."""
    folder, df = shared_path(spark, "position-files"), proxy(spark, sf_dir, "position")
    df = df.repartition(max(3, sized(df)))
    for name, header, rows in (
        ("named", True, df.where("pos % 2 = 0").select("pos", "gene", "mutrate", "coverage", "mutant")),
        ("plain", False, mutrate.position_table(df.where("pos % 2 = 1").withColumns({"end": F.col("pos") + 1, "adj_coverage": F.col("coverage"), "refnt": F.lit("a"), "detail": F.lit("A:1")}))),
    ):
        parts = shared_path(spark, "position-parts")
        sinks.write_tsv(rows.withColumn("side", F.lit(name)), parts, header=header, by=["side"])
        files.gather(spark, parts, folder, lambda value, k: f"{value}-{k}_mutrate.txt.gz")
    files.write_single(spark.createDataFrame([("gene\tother",), ("g1\t2",)], "value string"), folder, "odd_mutrate.txt")
    found = text.read_position_files(spark, folder, coverage_threshold=500, mutrate_threshold=0.05)
    return rounded(found.withColumn("sample", F.regexp_replace("sample", "-[0-9]+$", "")), "mutrate")


@query("SELECT 'T' || c_custkey AS name, c_custkey % 7 * 10 + 4 AS length FROM customer")
def fasta_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "customer").repartition(3)
    key = F.col("c_custkey")
    body = F.transform(F.sequence(F.lit(1), (key % 7).cast("int") + 1), lambda i: F.when(i <= key % 7, "ACGTACGTAC").otherwise("ACG "))
    rows = F.concat(F.array(F.concat(F.lit(">T"), key.cast("string"), F.lit(" described"))), body, F.array(F.lit("A\r")))
    return text.read_fasta_lengths(spark, staged(c.select(F.explode(rows).alias("value")), "fasta"))


@query(f"WITH {ROUND_TRIP} SELECT row_number() OVER (ORDER BY gene DESC, win) AS place, gene, win, win_end, CAST(sum(dp) AS BIGINT) AS dp, count(*) AS n FROM w GROUP BY gene, win, win_end", "cell_position")
def window_file_order(spark, sf_dir):
    """One block-gzipped window VCF file: the place of each record, with contigs in the given order."""
    found = windows.cell_windows(proxy(spark, sf_dir, "cell_position")).where(F.col("cell").isin(CELLS))
    path = f"{shared_path(spark, 'window-file').removeprefix('file:')}/windows.vcf.gz"
    sinks.write_window_file(found, CELLS, None, path, descending=True)
    lines = blocktext.read_block_text(spark, path, split=blocktext.split_of(path)).where(~F.col("value").startswith("#"))
    parsed = vcf.parse_windows(lines, vcf.block_cells(path)).groupBy("gene", "win", "win_end").agg(F.sum("dp").alias("dp"), F.count("*").alias("n"))
    # a record's place comes from where its line lies in the file
    p = F.split("value", "\t")
    at = lines.select(p[0].alias("gene"), p[1].cast("long").alias("win"), "ord", F.lit(1).cast("long").alias("one"))
    places = ranks.running(at, "ord", n="one").select("gene", "win", F.col("upto").alias("place"))
    return parsed.join(places, ["gene", "win"]).select("place", "gene", "win", "win_end", "dp", "n")


@query(f"WITH {ROUND_TRIP} SELECT gene, win, CAST(sum(dp) * 2 AS BIGINT) AS dp FROM w GROUP BY 1, 2", "cell_position")
def paired_union(spark, sf_dir):
    """Two window VCF files of the same cells, written and read as a pair."""
    a, b = window_files_of(spark, sf_dir, 2)
    return vcf.read_paired_windows(spark, a, b).groupBy("gene", "win").agg(F.sum("dp").alias("dp"))


@query(f"WITH {ROUND_TRIP} SELECT sample, cell, CAST(sum(dp) * 2 AS BIGINT) AS dp, count(*) * 2 AS n FROM w, (VALUES ('x'), ('y')) s(sample) GROUP BY 1, 2", "cell_position")
def multi_sample_union(spark, sf_dir):
    a, b = window_files_of(spark, sf_dir, 2)
    both = vcf.read_samples(spark, {"x": (a, b), "y": (b, a)})
    return both.groupBy("sample", "cell").agg(F.sum("dp").alias("dp"), F.count("*").alias("n"))


def window_files_of(spark, sf_dir, n: int) -> list[str]:
    found = windows.cell_windows(proxy(spark, sf_dir, "cell_position")).where(F.col("cell").isin(CELLS))
    genes = [r.gene for r in found.select("gene").distinct().orderBy("gene").collect()]
    paths = [shared_path(spark, "window-vcf") for _ in range(n)]
    for path in paths:
        sinks.write_window_vcf(found, CELLS, genes, path)
    return paths


VCF_HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=g1>", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *CELLS])]


def indexed_vcf(spark, sf_dir) -> str:
    """The cells' lines as one block-gzipped VCF file, sorted, with its index; the path."""
    path = f"{shared_path(spark, 'indexed').removeprefix('file:')}/cells.vcf.gz"
    lines = vcf_lines(spark, sf_dir)
    p = F.split("value", "\t")
    blocktext.write_indexed_text(lines.select(p[0].alias("name"), p[1].cast("long").alias("pos"), F.length(p[3]).alias("ref_length"), "value"), path, None, VCF_HEAD)
    return path


@query(VCF_SQL.format(more="AND pos % 2 = 0"), "cell_position")
def cells_file(spark, sf_dir):
    """A block-gzipped cell VCF file, read in splits of a hundred kilobytes and more."""
    path = indexed_vcf(spark, sf_dir)
    return rounded(vcf.parse_cells_sparse(blocktext.read_block_text(spark, path, split=blocktext.split_of(path)), CELLS), "mutrate")


REGION_SQL = "SELECT gene, pos, 'A' AS ref, cell, CAST(substr(cell, 2) AS INTEGER) - 1 AS cell_idx, CAST(dp AS INTEGER) AS dp, CAST(ad AS INTEGER) AS ad FROM cell_position WHERE gene = 'g7' AND pos BETWEEN 10 AND 1500 AND dp IS NOT NULL"


@query(REGION_SQL, "cell_position")
def region_scan(spark, sf_dir):
    """One gene's positions from the Parquet copy; other genes' folders aren't read."""
    store = shared_path(spark, "by-gene")
    vcf.store_by_gene(vcf.parse_cell_positions(vcf_lines(spark, sf_dir), CELLS), store)
    return vcf.read_region(spark, store, "g7", 10, 1500).where("cell is not null")


@query(REGION_SQL, "cell_position")
def indexed_region_scan(spark, sf_dir):
    """The same from the indexed VCF file itself; only the region's blocks are read."""
    return vcf.read_indexed_region(spark, indexed_vcf(spark, sf_dir), "g7", 10, 1500).where("cell is not null")


def whole_alignments(spark, sf_dir) -> DataFrame:
    """The alignments with all columns of a BAM record."""
    known = F.col("ref_name").isNotNull()
    return proxy(spark, sf_dir, "alignments").select(
        "ord", "read_id", "flag", "ref_name", F.when(known, F.col("ord") % 5000).alias("ref_start"), "ref_length", (F.col("ord") % 60).cast("int").alias("mapq"),
        F.array(F.struct(F.lit(0).alias("op"), F.col("ref_length").alias("len"))).alias("cigar"), F.lit("ACACACAC").alias("seq"), F.lit("IIIIIIII").alias("qual"),
        F.create_map(F.lit("NM"), (F.col("ord") % 11).cast("string"), F.lit("RG"), F.lit("x")).alias("tags"), F.create_map(F.lit("NM"), F.lit("C")).alias("tag_types"),
        F.when(known, F.col("ref_name")).alias("mate_ref_name"), F.when(known, F.col("ord") % 7).alias("mate_start"), (F.col("ord") % 900).cast("int").alias("template_length"),
    )


BAM_SQL = "SELECT read_id, flag, ref_name, CASE WHEN ref_name IS NOT NULL THEN ord % 5000 END AS ref_start, ref_length, ord % 60 AS mapq, CAST(ord % 11 AS VARCHAR) AS nm, CASE WHEN ref_name IS NOT NULL THEN ord % 7 END AS mate_start, CAST(ord % 900 AS INTEGER) AS template_length, repeat('AC', 4) AS seq, flag & 2304 = 0 AS first FROM alignments"


@query(BAM_SQL, "alignments")
def bam_round_trip(spark, sf_dir):
    """Alignments sorted by coordinate, written as BAM with typed tags and mates, and read."""
    path = shared_path(spark, "bam")
    bam.write_bam(bam.coordinate_sorted(whole_alignments(spark, sf_dir), bam_header()), path.removeprefix("file:"), bam_header())
    wanted = ["read_id", "flag", "ref_name", "ref_start", "ref_length", "mapq", "tags", "tag_types", "mate_start", "template_length", "seq"]
    back = bam.read_bam(spark, *files.matching(spark, f"{path}/*.bam"), columns=wanted)
    first = (F.col("flag").bitwiseAND(2304) == 0).alias("first")
    return back.where("tag_types['NM'] = 'C'").select("read_id", "flag", "ref_name", "ref_start", "ref_length", F.col("mapq").cast("long").alias("mapq"), F.col("tags")["NM"].alias("nm"), "mate_start", "template_length", "seq", first)


def sorted_bam(spark, sf_dir) -> str:
    """The alignments as one sorted BAM file with its index; the path."""
    path = f"{shared_path(spark, 'sorted').removeprefix('file:')}/all.bam"
    bam.write_sorted_bam(whole_alignments(spark, sf_dir), path, bam_header())
    return path


@query("SELECT row_number() OVER (ORDER BY ref_name NULLS LAST, CASE WHEN ref_name IS NOT NULL THEN ord % 5000 END NULLS LAST, ord) AS place, ord, read_id, ref_name FROM (SELECT ord, read_id, ref_name, ref_length FROM alignments) a", "alignments")
def sorted_bam_order(spark, sf_dir):
    """The place of each record in one sorted file, read in splits: the ordinal is what the file gives."""
    df = whole_alignments(spark, sf_dir).withColumns({"tags": F.create_map(F.lit("XO"), F.col("ord").cast("string")), "tag_types": F.create_map(F.lit("XO"), F.lit("Z"))})
    path = f"{shared_path(spark, 'sorted').removeprefix('file:')}/all.bam"
    bam.write_sorted_bam(df, path, bam_header())
    back = bam.read_bam(spark, path, columns=["ord", "read_id", "ref_name", "tags"], split=blocktext.split_of(path, least=200_000))
    ranked = ranks.running(back.withColumn("n", F.lit(1).cast("long")), "ord")
    return ranked.select(F.col("upto").alias("place"), F.col("tags")["XO"].cast("long").alias("ord"), "read_id", "ref_name")


@query(f"SELECT * FROM ({BAM_SQL.split(', ref_length, ')[0]}, ref_length FROM alignments) x WHERE ref_name = 'T3' AND ref_start < 2600 AND ref_start + greatest(coalesce(ref_length, 1), 1) > 2000", "alignments")
def bam_region(spark, sf_dir):
    """What reaches into a region of an indexed BAM file; other blocks aren't read."""
    return bam.read_region(spark, sorted_bam(spark, sf_dir), "T3", 2000, 2600, ["read_id", "flag", "ref_name", "ref_start", "ref_length"])


@query("SELECT ref_name, count(*) AS n, CAST(sum(ref_start) AS BIGINT) AS starts FROM (SELECT ref_name, ord % 5000 AS ref_start FROM alignments) a WHERE ref_name IN ('T1', 'T8') AND ref_start >= 4000 GROUP BY ref_name", "alignments")
def bam_pushed_filters(spark, sf_dir):
    """Conditions of a query are looked up in the index."""
    found = bam.read_bam(spark, sorted_bam(spark, sf_dir), columns=["ref_name", "ref_start"]).where(F.col("ref_name").isin("T1", "T8") & (F.col("ref_start") >= 4000))
    return found.groupBy("ref_name").agg(F.count("*").alias("n"), F.sum("ref_start").alias("starts"))


@query("""WITH c AS (SELECT read_id, ref_name, count(*) AS n, min(ord) AS first FROM alignments WHERE ref_name IS NOT NULL GROUP BY 1, 2)
SELECT read_id, CAST(sum(n) AS BIGINT) AS alignment_count, CAST(count(*) AS INTEGER) AS unique_transcript_count, count(*) = 1 AS is_uniquely_mapped, arg_min(ref_name, (-n, first)) AS max_transcript,
  CAST(max(n) AS BIGINT) AS max_count, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS max_ratio FROM c GROUP BY read_id""", "alignments")
def folded_reads(spark, sf_dir):
    """Read statistics of a BAM file in which a read's records follow each other, by one pass over
    its splits."""
    path = shared_path(spark, "by-name")
    by_name = whole_alignments(spark, sf_dir).repartitionByRange("read_id").sortWithinPartitions("read_id", "ord")
    bam.write_bam(by_name, path.removeprefix("file:"), bam_header().replace("coordinate", "queryname"))
    made = files.matching(spark, f"{path}/*.bam")
    split = max(blocktext.split_of(p, parts=4, least=20_000) for p in made)
    back = bam.read_bam(spark, *made, columns=["read_id", "ref_name", "ref_length"], split=split, whole_reads=True)
    return rounded(reads.fold_reads(back), "max_ratio")


def bam_header() -> str:
    return "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:T{i}\tLN:100000\n" for i in range(10))


@query("SELECT condition, header, quality FROM fastq WHERE condition IS NOT NULL", "fastq")
def fastq_files(spark, sf_dir):
    """FASTQ written by condition and verdict, found by folder, merged by condition and framed
    again. Files without a condition in their path aren't merged."""
    base = shared_path(spark, "fastq")
    judged = quality.quality_verdict(proxy(spark, sf_dir, "fastq").withColumns({"sequence": F.lit("ACGT"), "plus": F.lit("+")}))
    named = judged.withColumn("side", F.concat_ws("_", F.coalesce("condition", F.lit("other")), "verdict"))
    sinks.write_fastq_split(named.repartition(max(3, sized(named))), f"{base}/parts", ["side"])
    files.gather(spark, f"{base}/parts", f"{base}/in", lambda value, k: f"{value.split('_')[0]}_run{k}_{value.split('_')[1]}.fastq.gz")
    sinks.merge_by_condition(spark, text.find_fastq(spark, f"{base}/in"), f"{base}/out")
    parts = []
    for path in files.matching(spark, f"{base}/out/condition=*/verdict=*"):
        condition = path.split("condition=")[1].split("/")[0]
        parts.append(fastq.read_fastq(spark, path).select(F.lit(condition).alias("condition"), "header", "quality"))
    return reduce(DataFrame.unionByName, parts)


@query("SELECT read_id, CASE WHEN flag & 16 > 0 THEN 'GTGTN' ELSE 'NACAC' END AS sequence, CASE WHEN flag & 16 > 0 THEN '!IIII' ELSE 'IIII!' END AS quality FROM alignments WHERE flag & 2304 = 0", "alignments")
def bam_to_fastq(spark, sf_dir):
    df = proxy(spark, sf_dir, "alignments").withColumns({"seq": F.lit("NACAC"), "qual": F.lit("IIII!")})
    return fastq.alignments_to_fastq(df).select(F.substr("header", F.lit(2)).alias("read_id"), "sequence", "quality")


@query("SELECT 'bowtie_sensitive_mp_3-1_rdg_5-3_rfg_5-1' AS directory, 's' || n_nationkey AS stem, 'bowtie-sensitive' AS sensitivity, '3,1' AS mp, '5,3' AS rdg, '5,1' AS rfg, CAST(n_nationkey + 7 AS BIGINT) AS total_reads, n_regionkey + 0.5::DOUBLE AS overall_rate, CAST(n_nationkey % 9 AS DOUBLE) AS mean FROM nation")
def sweep_tree(spark, sf_dir):
    """A sweep's folder: a log and a summary for each run, joined by folder and stem."""
    base = shared_path(spark, "sweep")
    folder = f"{base}/bowtie_sensitive_mp_3-1_rdg_5-3_rfg_5-1"
    for r in table(spark, sf_dir, "nation").collect():  # a file is a run, and runs are few
        log = f"{r.n_nationkey + 7} reads; of these:\n{r.n_regionkey}.50% overall alignment rate"
        files.write_single(spark.createDataFrame([(log,)], "value string"), folder, f"s{r.n_nationkey}.log")
        summary = f"type,total_reads,mean,median,std,min,max,q25,q75\nraw,1,{r.n_nationkey % 9},2,3,4,5,6,7"
        files.write_single(spark.createDataFrame([(summary,)], "value string"), folder, f"s{r.n_nationkey}_summary_statistics.csv")
    runs = sweep.join_summaries(text.read_logs(spark, base), text.read_summaries(spark, base).select("directory", "stem", "mean"))
    return runs.select("directory", "stem", "sensitivity", "mp", "rdg", "rfg", "total_reads", "overall_rate", "mean")


@query("""SELECT x.directory, count(*) AS rank FROM runs x JOIN runs y ON (y.overall_rate > x.overall_rate OR (y.overall_rate = x.overall_rate AND y.directory <= x.directory)) GROUP BY x.directory""", "runs")
def runs_by_rate(spark, sf_dir):
    """The listing of all runs by descending rate, with its place."""
    ordered = sweep.ranked_runs(proxy(spark, sf_dir, "runs")).select("directory")
    lines = placed_lines(spark, staged(ordered.withColumnRenamed("directory", "value"), "ranked"))
    return lines.select(F.col("value").alias("directory"), F.col("place").alias("rank"))


@query(GROUP_SQL, "runs")
def sweep_file(spark, sf_dir):
    """The statistics by parameter as the report has them, written and read."""
    path = shared_path(spark, "sweep-stats")
    sinks.write_tsv(rounded(sweep.group_stats(proxy(spark, sf_dir, "runs")), "mean", "std"), path, header=True, single=True)
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema="parameter string, value string, metric string, mean double, std double, n long")


def placed_lines(spark, path: str) -> DataFrame:
    """(place, value): the lines of a folder's part files, which follow each other by name, from 1."""
    numbered = text.numbered_lines(spark, path)
    parts = ranks.running(numbered.groupBy("file").agg(F.count("*").alias("n")), "file")
    before = parts.select("file", (F.col("upto") - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), "file").select((F.col("before") + F.col("ord") + 1).alias("place"), "value")


@query("""WITH c AS (
  SELECT string_split(read_id, '_')[-2] AS barcode, string_split(read_id, '_')[-1] AS umi FROM names WHERE len(string_split(read_id, '_')) >= 3),
g AS (SELECT barcode, umi, count(*) AS n FROM c WHERE barcode <> '' AND umi <> '' GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY barcode, umi) AS place, barcode, umi, n FROM g""", "names")
def barcode_file(spark, sf_dir):
    """The list of barcodes as it is written: in order, over several parts."""
    path = shared_path(spark, "barcodes")
    counts = barcodes.barcode_umi_counts(proxy(spark, sf_dir, "names")).orderBy("barcode", "umi")
    sinks.write_tsv(counts, path)
    p = F.split("value", "\t")
    return placed_lines(spark, path).select("place", p[0].alias("barcode"), p[1].alias("umi"), p[2].cast("long").alias("n"))


@query("SELECT row_number() OVER (ORDER BY kind, length) AS place, kind, length, n FROM (SELECT 'raw' AS kind, length, n FROM lengths UNION ALL SELECT 'mapped', CAST(ref_length AS BIGINT), count(*) FROM alignments WHERE flag & 4 = 0 GROUP BY 2) x", "lengths", "alignments")
def length_file(spark, sf_dir):
    """The distribution of raw and mapped lengths as it is written, sorted."""
    path = shared_path(spark, "lengths")
    mapped = proxy(spark, sf_dir, "alignments").where(F.col("flag").bitwiseAND(4) == 0).select(F.col("ref_length").alias("length"))
    sinks.write_tsv(lengths.length_distribution(proxy(spark, sf_dir, "lengths"), mapped).orderBy("kind", "length"), path)
    p = F.split("value", "\t")
    return placed_lines(spark, path).select("place", p[0].alias("kind"), p[1].cast("long").alias("length"), p[2].cast("long").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM runs" for a in ("exact_rate", "multiple_rate", "overall_rate") for b in ("exact_rate", "multiple_rate", "overall_rate") if a <= b), "runs")
def numeric_correlation(spark, sf_dir):
    """All numeric columns against each other."""
    return rounded(correlation.pairwise(proxy(spark, sf_dir, "runs")), "r")


@query(f"""WITH {JOINED}, r AS (SELECT reactivity, row_number() OVER (ORDER BY reactivity) AS rn, count(*) OVER () AS n FROM j),
l AS (SELECT min(reactivity) FILTER (WHERE rn = floor(0.05 * n) + 1) AS lo, min(reactivity) FILTER (WHERE rn = n - floor(0.1 * n)) AS hi FROM r)
SELECT gene, pos, sample, round(least(greatest(reactivity, lo), hi), 6) AS reactivity FROM j, l""", "sides")
def winsorize_transcriptome(spark, sf_dir):
    out = reactivity.winsorize(joined(spark, sf_dir), "reactivity", (), 0.05, 0.1)
    return rounded(out.select("gene", "pos", "sample", "reactivity"), "reactivity")


@query("SELECT read_id, CAST(count(*) AS BIGINT) AS alignment_count, string_agg(ref_name, ',' ORDER BY ord) AS all_transcripts FROM alignments WHERE ref_name IS NOT NULL GROUP BY read_id", "alignments")
def read_table_file(spark, sf_dir):
    """The older per-read layout with every alignment's transcript, written and read."""
    path = shared_path(spark, "reads")
    sinks.write_tsv(sinks.read_table(reads.read_stats(proxy(spark, sf_dir, "alignments")), every=True), path, header=True)
    back = spark.read.option("header", True).csv(path, sep="\t")
    return back.select("read_id", F.col("alignment_count").cast("long").alias("alignment_count"), "all_transcripts")


@query("SELECT read_id, min(ref_name) AS transcript FROM alignments WHERE ref_name IS NOT NULL GROUP BY read_id HAVING count(DISTINCT ref_name) = 1", "alignments")
def unique_read_table(spark, sf_dir):
    return sinks.unique_read_table(reads.read_stats(proxy(spark, sf_dir, "alignments")))


def streamed(spark, df: DataFrame, build, mode: str, name: str, ordered: str | None = None) -> DataFrame:
    """The result of a query over the frame's rows as a stream: two batches, of as many files as the input has parts. With
    `ordered` the batches are ranges of that column: the second one comes when the first is done."""
    source, out, parts = shared_path(spark, f"{name}-in"), shared_path(spark, f"{name}-out"), sized(df)
    if ordered is None:
        df.repartition(2 * parts).write.parquet(source)
        halves, most = [None], parts
    else:
        df = written(df, f"{name}-rows")
        half = df.approxQuantile(ordered, [0.5], 0.01)[0]
        halves, most = [df.where(F.col(ordered) <= half), df.where(F.col(ordered) > half)], 1 << 20
    for rows in halves:
        if rows is not None:
            rows.repartition(parts).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", most).parquet(source))
        if mode == "append":
            run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        else:

            def keep(batch: DataFrame, _: int) -> None:
                batch.write.mode("overwrite").parquet(out)

            run = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE ref_name IS NULL) AS unmapped, count(*) FILTER (WHERE ref_name IS NOT NULL AND ref_length < 10) AS filtered FROM alignments", "alignments")
def streamed_counters(spark, sf_dir):
    return streamed(spark, proxy(spark, sf_dir, "alignments"), lambda s: online.online_counters(s, 10), "complete", "counters")


def timed(spark, sf_dir) -> DataFrame:
    """The alignments in order of read, as a stream sorted by name has them, at one second each, and
    one that is long after all of them."""
    df = proxy(spark, sf_dir, "alignments")
    last = df.select(F.max("ord").alias("ord")).select((F.col("ord") * 2 + 10**8).alias("ord"), F.lit("the end").alias("read_id"), F.lit(0).alias("flag"), F.lit("T0").alias("ref_name"), F.lit(1).alias("ref_length"))
    return df.unionByName(last).withColumn("at", F.timestamp_seconds(F.col("ord") + 86_400))


@query("""WITH c AS (SELECT read_id, ref_name, count(*) AS n, min(ord) AS first FROM alignments WHERE ref_name IS NOT NULL GROUP BY 1, 2)
SELECT read_id, CAST(sum(n) AS BIGINT) AS alignment_count, CAST(count(*) AS INTEGER) AS unique_transcript_count, arg_min(ref_name, (-n, first)) AS max_transcript, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS max_ratio FROM c GROUP BY read_id""", "alignments")
def streamed_reads(spark, sf_dir):
    """Each read once, when the stream has gone on; its state is dropped then."""
    out = streamed(spark, timed(spark, sf_dir), lambda s: online.online_reads(s, "at", gap_ms=20_000), "append", "fold", ordered="ord")
    return rounded(out.where("read_id != 'the end'").select("read_id", "alignment_count", "unique_transcript_count", "max_transcript", "max_ratio"), "max_ratio")


@query("""WITH c AS (SELECT ord // 10 AS o, read_id, ref_name, count(*) AS n FROM alignments WHERE ref_name IS NOT NULL GROUP BY 1, 2, 3),
s AS (SELECT read_id, sum(n) AS alignments, count(*) AS refs, max(n) / sum(n) AS ratio FROM c GROUP BY 1)
SELECT count(*) AS total_reads, count(*) FILTER (WHERE alignments = 1) AS single, count(*) FILTER (WHERE refs = 1) AS "unique", round(avg(ratio), 6) AS mean_ratio, round(min(ratio), 6) AS min_ratio, count(*) FILTER (WHERE ratio >= 0.5 AND ratio < 0.8) AS ratio_05 FROM s""", "alignments")
def streamed_summary(spark, sf_dir):
    """The summary of all reads of a window of time, by two stateful operators one behind the other."""
    whole = proxy(spark, sf_dir, "alignments").agg(F.max("ord")).first()[0] or 0
    days = max(1000, whole // 86_400 + 3)  # windows begin at 1970, so the first one holds all alignments
    out = streamed(spark, timed(spark, sf_dir), lambda s: online.online_summary(s, "at", delay="1 minute", window=f"{days} days"), "append", "summary", ordered="ord")
    return rounded(out.where("window.start < timestamp'1971-01-01'").select("total_reads", "single", "unique", "mean_ratio", "min_ratio", "ratio_05"), "mean_ratio", "min_ratio")


@query("SELECT header, substr('ACGT', 1, length(quality)) AS sequence, quality FROM fastq", "fastq")
def streamed_fastq_files(spark, sf_dir):
    """A stream of FASTQ files that grow between two runs, cut inside a record."""
    whole, folder, out = shared_path(spark, "fastq-whole"), shared_path(spark, "fastq-growing").removeprefix("file:"), shared_path(spark, "fastq-records")
    four = F.concat_ws("\n", "header", F.rpad(F.lit("ACGT"), F.length("quality"), "A"), F.lit("+"), "quality").alias("value")
    proxy(spark, sf_dir, "fastq").select(four).repartition(4).write.text(whole)
    names = files.matching(spark, f"{whole}/part-*")
    os.makedirs(folder, exist_ok=True)

    def grow(share: float) -> None:
        """Each file has so much of its bytes more, in a task of its own."""

        def copy(batches):
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    target = f"{folder}/{os.path.basename(name)}.fastq"
                    with files.opened(name) as a, open(target, "ab") as b:
                        size = a.seek(0, 2)
                        a.seek(b.tell())
                        b.write(a.read(int(size * share) - b.tell()))
                yield batch

        spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(copy, "name string").write.format("noop").mode("overwrite").save()

    for share in (0.4, 0.7, 1.0):
        grow(share)
        records = fastq.stream_fastq(spark, folder, split=100_000)
        run = records.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out).select("header", F.substr("sequence", F.lit(1), F.lit(4)).alias("sequence"), "quality")


@query("SELECT read_id, count(*) AS alignment_count, CAST(count(DISTINCT ref_name) AS INTEGER) AS transcripts FROM alignments WHERE ref_name IS NOT NULL GROUP BY read_id", "alignments")
def streamed_read_counts(spark, sf_dir):
    return streamed(spark, proxy(spark, sf_dir, "alignments"), online.online_alignment_counts, "complete", "read-counts")


@query(MUTRATE_SQL)
def streamed_rates(spark, sf_dir):
    return streamed(spark, count_lines(spark, sf_dir), online.streamed_mutation_rates, "append", "rates")


@query("SELECT length, n, 'raw' AS kind FROM lengths", "lengths")
def length_tables(spark, sf_dir):
    """Length lines of a statistics file, written as text and read again."""
    lines = proxy(spark, sf_dir, "lengths").select(F.concat_ws("\t", F.lit("RL"), F.col("length").cast("string"), F.col("n").cast("string")).alias("value"))
    other = spark.createDataFrame([("SN\tsum\t3",), ("# RL comment",)], "value string")
    path = staged(lines.unionByName(other), "stats")
    return text.read_raw_lengths(spark, path).select("length", "n", F.lit("raw").alias("kind"))
