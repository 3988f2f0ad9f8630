"""Command line: python -m nucleoframe TOOL ... . Outputs are folders of part files."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import sinks
from .operators import barcodes, correlation, lengths, mutrate, quality, reads, sweep, windows
from .session import session
from .sources import bam, fastq, text, vcf


def run_mutrate(spark, a) -> None:
    positions = mutrate.mutation_rates(text.read_counts(spark, a.input), a.ins_len, a.del_len, a.ref_symbol)
    if a.counts:
        positions = mutrate.with_gene_counts(positions, text.read_gene_counts(spark, a.counts))
        positions = mutrate.position_filter(positions, a.coverage, a.gene_coverage)
    else:
        positions = positions.where(F.col("coverage") >= a.coverage)
    out = mutrate.position_table(positions)
    sinks.print_tsv(out) if a.output == "-" else sinks.write_tsv(out, a.output)


def run_windows(spark, a) -> None:
    found = windows.bulk_windows(text.read_positions(spark, a.input), a.window, a.step, a.coverage_threshold, a.mutrate_threshold)
    sinks.write_tsv(found.orderBy("gene", "win"), a.output, header=True)


def run_cell_windows(spark, a) -> None:
    cells, contigs = vcf.read_header(spark, a.input)
    found = windows.cell_windows(vcf.read_cell_positions(spark, a.input), a.window, a.step, a.coverage_threshold, a.mutrate_threshold, a.legacy_anchor)
    if a.output.endswith(".vcf.gz"):  # one file with its index
        sinks.write_window_file(found, cells, contigs, a.output)
    else:
        sinks.write_window_vcf(found, cells, contigs, a.output)


def write_records(records, a, path: str) -> None:
    """BAM part files, or SAM text, with the first input's header."""
    header = bam.header_text(a.bam[0]) if a.sam else bam.whole_header(a.bam[0])
    sinks.write_sam(records, header, path) if a.sam else bam.write_bam(records, path, header)


def run_read_stats(spark, a) -> None:
    whole = bam.read_bam(spark, *a.bam)
    stats = reads.read_stats(whole, a.min_length)
    sinks.write_tsv(sinks.read_table(stats, a.all_transcripts), f"{a.output}/reads", header=True)
    sinks.write_tsv(reads.top_counts(reads.alignment_histogram(stats)), f"{a.output}/top_counts", header=True, single=True)
    if a.extract_unique or a.full_analysis:
        write_records(reads.unique_primary(whole, stats), a, f"{a.output}/unique")
        sinks.write_tsv(sinks.unique_read_table(stats), f"{a.output}/unique_reads", header=True)
    print(sinks.report("Alignments", reads.processing_counters(whole, a.min_length)))
    print(sinks.report("Reads", reads.stats_summary(stats)))
    print(sinks.report("Dominance ratio", reads.ratio_percentiles(stats)))


def run_barcodes(spark, a) -> None:
    whole = bam.read_bam(spark, *a.bam)
    if a.action == "add_tags":
        write_records(barcodes.add_barcode_tags(whole), a, a.output)
        print(sinks.report("Tags", barcodes.barcode_totals(whole)))
    elif a.action == "extract_list":
        sinks.write_tsv(barcodes.barcode_umi_counts(whole).orderBy("barcode", "umi"), a.output, header=True)
    elif a.action == "extract_barcodes":
        barcodes.barcode_list(whole, a.unique).orderBy("first").select("barcode").write.text(a.output)
    else:
        barcodes.validate_tags(whole, num_examples=a.examples).show(a.examples, truncate=False)


def run_gene_tag(spark, a) -> None:
    write_records(barcodes.add_gene_tag(bam.read_bam(spark, *a.bam)), a, a.output)


def run_sort(spark, a) -> None:
    header = bam.whole_header(a.bam[0])
    whole = bam.read_bam(spark, *a.bam)
    if a.output.endswith(".bam"):  # one file with its index
        bam.write_sorted_bam(whole, a.output, header)
    else:
        bam.write_bam(bam.coordinate_sorted(whole, header), a.output, header)


def run_fastq_filter(spark, a) -> None:
    source = fastq.alignments_to_fastq(bam.read_bam(spark, a.input)) if a.input.endswith(".bam") else fastq.read_fastq(spark, a.input)
    sinks.write_fastq_split(quality.quality_verdict(source, a.least), a.output)


def run_fastq_stats(spark, a) -> None:
    files = text.find_fastq(spark, a.folder)
    if not a.fast:
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_{pass,fail}.fastq.gz").text(a.folder)
        counted = lines.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_lines"))
        files = files.join(counted, "path", "left")
    else:
        files = files.withColumn("n_lines", F.lit(None).cast("long"))
    print(sinks.sequencing_report(quality.condition_stats(files, a.fast)))


def run_lengths(spark, a) -> None:
    whole = lengths.length_distribution(text.read_raw_lengths(spark, a.stats), lengths.mapped_lengths(bam.read_bam(spark, a.bam, columns=["flag", "cigar"])))
    sinks.write_tsv(whole.orderBy("kind", "length"), f"{a.output}/distribution", header=True, single=True)
    sinks.write_tsv(lengths.length_summary(whole), f"{a.output}/summary", header=True, single=True)


def run_sweep_report(spark, a) -> None:
    runs = text.read_logs(spark, a.folder)
    sinks.write_tsv(runs, f"{a.output}/runs", header=True, single=True)
    groups = sweep.group_stats(runs)
    sinks.write_tsv(groups, f"{a.output}/group_stats", header=True, single=True)
    sinks.write_tsv(sweep.ranked_runs(runs), f"{a.output}/ranked", header=True, single=True)
    sinks.write_tsv(correlation.pairwise(runs), f"{a.output}/correlation", header=True, single=True)
    print(sinks.sweep_text(sweep.metric_summary(runs), groups, sweep.best_run(runs)))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("nucleoframe", description=__doc__)
    loud = top.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_const", dest="log", const="INFO")
    loud.add_argument("-q", "--quiet", action="store_const", dest="log", const="ERROR")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name, run, *args):
        p = tools.add_parser(name)
        p.set_defaults(run=run)
        for names, how in args:
            p.add_argument(*names.split(), **how)
        return p

    put, take = ("-o --output", {"required": True}), ("-i --input", {"required": True})
    sizes = [
        ("-w --window", {"type": int, "default": 10}), ("-s --step", {"type": int, "default": 10}),
        ("--coverage-threshold", {"type": int, "default": 200}), ("--mutrate-threshold", {"type": float, "default": 0.2}),
    ]
    many = ("bam", {"nargs": "+"})
    tool(
        "mutrate", run_mutrate, take, put, ("-c --coverage", {"type": int, "default": -1}), ("-gc --gene-coverage", {"type": float, "default": 10}), ("-e --counts", {}),
        ("-ins_len --ins-len", {"type": int, "default": 3}), ("-del_len --del-len", {"type": int, "default": 3}), ("-ref_symbol --ref-symbol", {"action": "store_true"}),
    )
    tool("windows", run_windows, take, put, *sizes)
    tool("cell-windows", run_cell_windows, take, put, *sizes, ("--legacy-anchor", {"action": "store_true"}))
    flag = {"action": "store_true"}
    sam = ("--sam", flag)
    tool("read-stats", run_read_stats, many, put, ("-m --min-length", {"type": int, "default": 0}), ("--extract-unique", flag), ("--full-analysis", flag), ("--all-transcripts", flag), sam)
    tool("barcodes", run_barcodes, ("action", {"choices": ["add_tags", "extract_list", "extract_barcodes", "validate"]}), many, ("-o --output", {}), ("--unique", flag), ("--examples", {"type": int, "default": 10}), sam)
    tool("gene-tag", run_gene_tag, many, put, sam)
    tool("sort", run_sort, many, put)
    tool("fastq-filter", run_fastq_filter, take, put, ("--least", {"type": float, "default": 10.0}))
    tool("fastq-stats", run_fastq_stats, ("folder", {}), ("--fast", flag))
    tool("lengths", run_lengths, ("stats", {}), ("bam", {}), put)
    tool("sweep-report", run_sweep_report, ("folder", {}), put)
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    if getattr(a, "min_length", 0) < 0:
        raise SystemExit("min-length must not be negative")
    spark = spark or session()
    if a.log:
        spark.sparkContext.setLogLevel(a.log)
    a.run(spark, a)
