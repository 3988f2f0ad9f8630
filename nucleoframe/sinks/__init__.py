"""Sinks: tables as text, window VCF, per-read tables, FASTQ and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.blocktext import placed, write_indexed_text


def write_tsv(df: DataFrame, path: str, header: bool = False, single: bool = False, compression: str = "gzip", by=()) -> None:
    """Tab-separated text; NULL is NA; arrays are joined by commas. With `by` there is a folder for each
    value of these columns."""
    flat = df.select(*[F.array_join(f.name, ",").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema])
    (flat.coalesce(1) if single else flat).write.partitionBy(*by).option("header", header).option("compression", compression).csv(path, sep="\t", nullValue="NA")


def number_text(x: Column) -> Column:
    """A rate as plain decimal text (Spark would print 1.0E-5)."""
    text = F.regexp_replace(F.format_string("%.5f", x), r"0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def window_vcf_lines(windows: DataFrame, cells: list[str]) -> DataFrame:
    """(gene, win, value): record lines of a window VCF; missing cells are .:.:. . The
    cells of one window are gathered into a map; windows have at most len(cells) of them."""
    text = F.concat_ws(":", F.col("dp").cast("string"), F.col("ad").cast("string"), number_text(F.col("mr")))
    rows = windows.groupBy("gene", "win", "win_end").agg(F.map_from_entries(F.collect_list(F.struct("cell", text.alias("t")))).alias("m"))
    row = F.transform(F.array(*[F.lit(c) for c in cells]), lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(".:.:.")))
    value = F.concat_ws(
        "\t", "gene", F.col("win").cast("string"), F.lit("."), F.lit("N"), F.lit("."), F.lit("."), F.lit("PASS"),
        F.concat(F.lit("WIN_END="), F.col("win_end").cast("string")), F.lit("DP:AD:MR"), F.array_join(row, "\t"),
    )
    return rows.select("gene", "win", value.alias("value"))


def window_vcf_header(cells: list[str], contigs: list[str]) -> list[str]:
    return [
        "##fileformat=VCFv4.2",
        *[f"##contig=<ID={c}>" for c in contigs],
        '##INFO=<ID=WIN_END,Number=1,Type=Integer,Description="last position of the window">',
        '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">',
        '##FORMAT=<ID=AD,Number=1,Type=Integer,Description="mutant depth">',
        '##FORMAT=<ID=MR,Number=1,Type=Float,Description="mutation rate">',
        "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *cells]),
    ]


def write_window_vcf(windows: DataFrame, cells: list[str], contigs: list[str], path: str) -> None:
    """A folder of text parts in order of contig and position, the header in the first."""
    spark: SparkSession = windows.sparkSession
    body = placed(window_vcf_lines(windows, cells), contigs, "gene").select(F.coalesce("place", F.lit(0)).cast("long").alias("a"), F.col("win").alias("b"), "value")
    head = spark.createDataFrame([(-1, i, x) for i, x in enumerate(window_vcf_header(cells, contigs))], "a long, b long, value string")
    head.union(body).orderBy("a", "b").select("value").write.text(path, compression="gzip")


def write_window_file(windows: DataFrame, cells: list[str], contigs: list[str] | None, path: str, descending: bool = False) -> int:
    """One block-gzipped window VCF file (which any gzip reader takes), the header first and records
    in order of contig and position, with its TBI index; gives the number of records. Without `contigs`
    they are the windows' genes in order (or descending), which don't reach the driver."""
    reach = F.split(F.col("value"), "\t")[7]
    lines = window_vcf_lines(windows, cells).select(F.col("gene").alias("name"), F.col("win").alias("pos"), "value")
    length = F.regexp_extract(reach, r"WIN_END=(\d+)", 1).try_cast("long") - F.col("pos") + 1
    return write_indexed_text(lines.withColumn("ref_length", F.coalesce(length, F.lit(1))), path, contigs, window_vcf_header(cells, contigs or []), descending=descending, contigs_at=1)


def read_table(stats: DataFrame, every: bool = False) -> DataFrame:
    """Per-read rows as text columns: flags as Yes/No, ratios to four places; with `every`,
    the older layout, which also lists the transcript of every alignment."""
    yes = F.when(F.col("is_uniquely_mapped"), "Yes").otherwise("No")
    listed = ["unique_transcripts", *(["all_transcripts"] if every else [])]
    return stats.select(
        "read_id", "alignment_count", "unique_transcript_count", yes.alias("is_uniquely_mapped"), "max_transcript", "max_count",
        F.format_string("%.4f", "max_ratio").alias("max_ratio"), *[F.array_join(c, ",").alias(c) for c in listed],
    )


def unique_read_table(stats: DataFrame) -> DataFrame:
    """(read_id, transcript) of the reads that map to one transcript."""
    return stats.where("is_uniquely_mapped").select("read_id", F.col("max_transcript").alias("transcript"))


def print_tsv(df: DataFrame) -> None:
    """Rows as tab-separated text on standard output, one partition at a time; NULL is NA."""
    for r in df.toLocalIterator():
        print("\t".join("NA" if v is None else str(v) for v in r))


def write_sam(alignments: DataFrame, header: str, path: str) -> None:
    """SAM text in order of the records, the header's lines first."""
    spark: SparkSession = alignments.sparkSession
    lines = [(i - len(header), x) for i, x in enumerate(header.splitlines())]
    head = spark.createDataFrame(lines, "ord long, value string")
    head.union(sam_lines(alignments).select(F.col("ord").cast("long"), "value")).orderBy("ord").select("value").write.text(path, compression="gzip")


def sam_lines(alignments: DataFrame) -> DataFrame:
    """Records as SAM text, without a header; tags have their types, text without one."""
    ops = F.array(*[F.lit(c) for c in "MIDNSHP=X"])
    have = lambda c, kind: F.col(c) if c in alignments.columns else F.lit(None).cast(kind)
    cigar = F.coalesce(F.array_join(F.transform("cigar", lambda c: F.concat(c["len"].cast("string"), F.get(ops, c["op"]))), ""), F.lit("*"))
    types = F.coalesce(have("tag_types", "map<string,string>"), F.create_map().cast("map<string,string>"))

    def tag(e: Column) -> Column:
        kind = F.coalesce(F.try_element_at(types, e["key"]), F.lit("Z"))
        listed = F.concat(F.lit(":B:"), F.substring(kind, 2, 1), F.when(e["value"] != "", F.concat(F.lit(","), e["value"])).otherwise(""))
        plain = F.concat(F.lit(":"), F.when(kind.rlike("^[cCsSiI]$"), "i").otherwise(kind), F.lit(":"), e["value"])
        return F.concat(e["key"], F.when(kind.startswith("B"), listed).otherwise(plain))

    tags = F.transform(F.array_sort(F.map_entries("tags")), tag)
    mate = have("mate_ref_name", "string")
    plain = F.concat_ws(
        "\t", "read_id", F.col("flag").cast("string"), F.coalesce("ref_name", F.lit("*")), F.coalesce(F.col("ref_start") + 1, F.lit(0)).cast("string"),
        F.coalesce("mapq", F.lit(0)).cast("string"), cigar, F.when(mate == F.col("ref_name"), "=").otherwise(F.coalesce(mate, F.lit("*"))),
        F.coalesce(have("mate_start", "long") + 1, F.lit(0)).cast("string"), F.coalesce(have("template_length", "int"), F.lit(0)).cast("string"),
        F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")),
    )
    return alignments.select("ord", F.when(F.size("tags") > 0, F.concat(plain, F.lit("\t"), F.array_join(tags, "\t"))).otherwise(plain).alias("value"))


def write_fastq_split(verdicts: DataFrame, path: str, by=("verdict",)) -> None:
    """FASTQ text in one folder per verdict, or per value of other columns, in one pass."""
    value = F.concat_ws("\n", "header", "sequence", "plus", "quality")
    verdicts.select(*by, value.alias("value")).write.partitionBy(*by).text(path, compression="gzip")


def merge_by_condition(spark: SparkSession, files: DataFrame, path: str) -> None:
    """The lines of found files, in one folder per condition and verdict, in one pass. A file is one
    task, as gzip has it, and its lines stay together. Only the list of files reaches the driver."""
    found = files.where("condition is not null").select("path", "condition", "verdict").collect()
    if not found:
        return
    of = spark.createDataFrame(found, "path string, condition string, verdict string")  # a row for each file
    raw = spark.read.text([r.path for r in found]).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    same = F.regexp_replace("file", "^file:/+", "/") == F.regexp_replace("path", "^file:/+", "/")
    named = raw.join(F.broadcast(of), same)
    # sorted as the writer wants it, and by line, so it doesn't sort again
    named = named.sortWithinPartitions("condition", "verdict", "id").select("condition", "verdict", "value")
    named.write.partitionBy("condition", "verdict").text(path, compression="gzip")


def human_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.2f} {unit}" if unit != "B" else f"{n:.0f} B"
        n /= 1024
    raise AssertionError


def report(title: str, one_row: DataFrame) -> str:
    """A text report of a one-row frame."""
    row = one_row.first().asDict()
    value = lambda v: f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([title, "=" * len(title), *(f"{k}: {value(v)}" for k, v in row.items())]) + "\n"


def table_text(rows: DataFrame, columns: dict[str, str]) -> str:
    """A few rows as aligned text; columns gives each one's heading. For reports, whose rows
    are as many as conditions or parameter values."""
    cells = [list(columns.values())]
    for r in rows.select(*columns).collect():
        cells.append(["N/A" if v is None else f"{v:,}" if isinstance(v, int) else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r])
    widths = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells) + "\n"


def sequencing_report(stats: DataFrame) -> str:
    """The text report of condition_stats(): a block for each condition, the total last."""
    out = []
    for r in stats.orderBy(F.col("condition").isNull(), "condition").collect():
        title = r.condition or "Total"
        share = "N/A" if r.pass_percent is None else f"{r.pass_percent:.2f}%"
        out += [
            title, "-" * len(title), f"pass: {human_bytes(r.pass_bytes)}, {r.pass_reads:,} reads", f"fail: {human_bytes(r.fail_bytes)}, {r.fail_reads:,} reads",
            f"total: {human_bytes(r.pass_bytes + r.fail_bytes)}, {r.pass_reads + r.fail_reads:,} reads", f"pass rate: {share}", "",
        ]
    return "\n".join(out)


def sweep_text(summary: DataFrame, groups: DataFrame, best: DataFrame) -> str:
    """The text report of a sweep: metrics, means by parameter, and the best run."""
    one = best.first()
    run = [] if one is None else [f"Best run: {one.directory}/{one.stem} ({one.overall_rate:.2f}%)", *(f"  {k}: {one[k]}" for k in ("sensitivity", "mp", "rdg", "rfg"))]
    return "\n".join([
        "Metrics", table_text(summary.orderBy("metric"), {"metric": "metric", "mean": "mean", "median": "median", "min": "min", "max": "max"}),
        "By parameter", table_text(groups.orderBy("parameter", "value", "metric"), {"parameter": "parameter", "value": "value", "metric": "metric", "mean": "mean", "std": "std", "n": "n"}), *run, "",
    ])


def head_text(path: str, lines: int = 20) -> str:
    """The first lines of a report that was written as a file of the driver."""
    from itertools import islice

    with open(path) as f:
        return "".join(islice(f, lines))
