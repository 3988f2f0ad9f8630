"""Text sources: base counts, gene counts, length and log files, position and window
tables, and dot-bracket structures. Everything is read by Spark; only headers reach the
driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import safe_int
from ..operators.sweep import decode_name, parse_log
from .blocktext import is_blocked, read_block_text


def lines(spark: SparkSession, path) -> DataFrame:
    """The lines (value) of text files. One block-gzipped file is read in splits; other gzip files are
    one task each."""
    if isinstance(path, str) and path.endswith((".gz", ".bgz")) and is_blocked(path):
        return read_block_text(spark, path).select("value")
    return spark.read.text(path).select("value")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, ord, value): lines with their number in the file, from 0, and the block
    (split) they are read in. Blocks are read side by side: a line's number is its place in
    the block, plus the lines of the blocks before. There is one row for each block in the
    table that says so, a bound of the files' sizes, so it is broadcast."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    shift = blocks.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return raw.join(F.broadcast(shift), ["file", "block"]).select("file", "block", (F.col("id") + F.col("shift")).alias("ord"), "value")


def numbered_records(numbered: DataFrame, file: str = "file") -> DataFrame:
    """numbered_lines() with `rec`, the number of lines up to this one that begin with >:
    counted within blocks, plus those of the blocks before."""
    held = numbered if "block" in numbered.columns else numbered.withColumn("block", F.lit(0).cast("long"))
    head = F.col("value").startswith(">").cast("long")
    blocks = held.groupBy(file, "block").agg(F.sum(head).alias("n"))
    earlier = W.partitionBy(file).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.select(file, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = held.withColumn("within", F.sum(head).over(W.partitionBy(file, "block").orderBy("ord")))
    return within.join(F.broadcast(before), [file, "block"]).withColumn("rec", F.col("within") + F.col("before")).drop("within", "before")


def parse_counts(raw: DataFrame) -> DataFrame:
    """(gene, pos, refnt, depth, items) from count lines divided by white space. The generator keeps
    the optimizer from dividing the line anew for each field and each item."""
    parts = F.col("p")
    divided = raw.where(F.trim("value") != "").select(F.explode(F.array(F.split(F.trim("value"), r"\s+"))).alias("p"))
    return divided.select(
        F.regexp_replace(parts[0], "^>", "").alias("gene"), safe_int(parts[1], "long").alias("pos"), parts[2].alias("refnt"),
        safe_int(parts[3], "long").alias("depth"), F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))).alias("items"),
    )


def read_counts(spark: SparkSession, path) -> DataFrame:
    return parse_counts(lines(spark, path))


def parse_gene_counts(raw: DataFrame, order: str = "ord") -> DataFrame:
    """(gene, length, reads, total_reads): the last of repeated genes counts, all of them
    are in the total. Comment lines and the header are left out."""
    p = F.split("value", "\t")
    rows = raw.where(~F.col("value").startswith("#") & ~F.col("value").startswith("Geneid") & (F.size(p) >= 7))
    rows = rows.select(p[1].alias("gene"), safe_int(p[5], "long").alias("length"), safe_int(p[6], "long").alias("reads"), order)
    last = rows.groupBy("gene").agg(F.max_by(F.struct("length", "reads"), order).alias("x"))
    total = rows.agg(F.sum("reads").alias("total_reads"))
    return last.select("gene", "x.length", "x.reads").crossJoin(F.broadcast(total))


def read_gene_counts(spark: SparkSession, path) -> DataFrame:
    return parse_gene_counts(numbered_lines(spark, path))


def read_fasta_lengths(spark: SparkSession, path) -> DataFrame:
    """(name, length) of each FASTA record."""
    held = numbered_records(numbered_lines(spark, path)).where("rec > 0")
    head = F.col("value").startswith(">")
    name = F.max(F.when(head, F.regexp_extract("value", r"^>(\S+)", 1))).alias("name")
    return held.groupBy("file", "rec").agg(name, F.sum(F.when(~head, F.length(F.trim("value"))).otherwise(0)).alias("length")).select("name", "length")


def read_positions(spark: SparkSession, path) -> DataFrame:
    """Headerless position tables of 13 columns; NA is NULL."""
    return spark.read.csv(path, sep="\t", schema=schemas.POSITION, nullValue="NA")


def sample_name(pattern: str, prefix: str = ""):
    """prefix + file name without the pattern's fixed ending and trailing _ or dots."""
    name = F.col("_metadata.file_name")
    ending = pattern.rsplit("*", 1)[-1]
    return F.concat(F.lit(prefix), F.regexp_replace(F.replace(name, F.lit(ending), F.lit("")), r"[_.]+$", ""))


def read_window_files(spark: SparkSession, directory: str, pattern: str = "*_counts_mutrate.10nt.csv.gz", prefix: str = "", coverage_threshold: int = 200, keep: str | None = None) -> DataFrame:
    """Window tables of a folder with their sample; windows with too little coverage go, and
    so do files that can't be read. With `keep` the table is also written there, as text."""
    df = spark.read.option("ignoreCorruptFiles", True).csv(f"{directory}/{pattern}", sep="\t", header=True, schema=schemas.WINDOW, nullValue="NA")
    return kept_as(df.withColumn("sample", sample_name(pattern, prefix)).where(F.col("coverage") >= coverage_threshold), keep)


def kept_as(df: DataFrame, path: str | None) -> DataFrame:
    """The frame, written as tab-separated text where a path is given."""
    if path is not None:
        df.write.option("header", True).option("compression", "gzip").csv(path, sep="\t", nullValue="NA")
    return df


POSITION_COLUMNS = ("gene", "pos", "mutrate", "coverage", "mutant", "sample")


def read_position_files(spark: SparkSession, directory: str, pattern: str = "*mutrate.txt*", prefix: str = "", header: bool | None = None, coverage_threshold: int = 100, mutrate_threshold: float = 0.2, keep: str | None = None) -> DataFrame:
    """Position tables of a folder with their sample, projected to POSITION_COLUMNS.

    Without `header` each file's first line is looked at (it has one if it names gene or
    pos); files without the needed columns, and those that can't be read, are left out. The
    first lines, one for each file, reach the driver. With `keep` the table is also written
    there, as text."""
    raw = spark.read.option("ignoreCorruptFiles", True).text(f"{directory}/{pattern}")
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # one pass for the first lines of all files; files of the same header are read together
    first = raw.where("block = 0").groupBy("file").agg(F.min_by("value", "id").alias("line"))
    by_header: dict[tuple | None, list[str]] = {}
    for r in first.collect():
        named = header if header is not None else "gene" in r.line or "pos" in r.line
        by_header.setdefault(tuple(r.line.split("\t")) if named else None, []).append(r.file)
    parts = []
    for names, paths in by_header.items():
        if names is None:
            df = spark.read.option("ignoreCorruptFiles", True).csv(paths, sep="\t", schema=schemas.POSITION, nullValue="NA")
        elif {"gene", "pos", "mutrate", "coverage", "mutant"} <= set(names):
            df = spark.read.option("ignoreCorruptFiles", True).csv(paths, sep="\t", header=True, nullValue="NA")
        else:
            continue
        kinds = {"gene": "string", "pos": "long", "mutrate": "double", "coverage": "long", "mutant": "long"}
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"mutrate\.txt(\.gz)?$", "")
        sample = F.concat(F.lit(prefix), F.regexp_replace(stem, r"[_.]+$", ""))
        parts.append(df.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()], sample.alias("sample")))
    if not parts:
        return spark.createDataFrame([], "gene string, pos long, mutrate double, coverage long, mutant long, sample string")
    whole = reduce(DataFrame.unionByName, parts)
    return kept_as(whole.where((F.col("coverage") >= coverage_threshold) & (F.col("mutrate") <= mutrate_threshold)), keep)


def parse_length_lines(raw: DataFrame) -> DataFrame:
    """(length, n) from lines "RL length count"."""
    p = F.split(F.trim("value"), r"\s+")
    return raw.where((F.size(p) == 3) & (p[0] == "RL")).select(safe_int(p[1], "long").alias("length"), safe_int(p[2], "long").alias("n"))


def read_raw_lengths(spark: SparkSession, path) -> DataFrame:
    return parse_length_lines(lines(spark, path))


def read_logs(spark: SparkSession, base: str) -> DataFrame:
    """Runs of a sweep: one row per <base>/<folder>/<stem>.log, with the folder's parameters."""
    raw = spark.read.text(f"{base}/*/*.log", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    folder = F.element_at(parts, -2)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.log$", "")
    return raw.select(folder.alias("directory"), stem.alias("stem"), *[c.alias(n) for n, c in (decode_name(folder) | parse_log(F.col("value"))).items()])


SUMMARY = "type string, total_reads double, mean double, median double, std double, min double, max double, q25 double, q75 double"


def read_summaries(spark: SparkSession, base: str, schema: str = SUMMARY) -> DataFrame:
    """Length summaries <stem>_summary_statistics.csv of a sweep's folders."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    df = spark.read.csv(f"{base}/*/*_summary_statistics.csv", header=True, schema=schema)
    return df.select("*", F.element_at(parts, -2).alias("directory"), F.regexp_replace(F.element_at(parts, -1), "_summary_statistics\\.csv$", "").alias("stem"))


def find_fastq(spark: SparkSession, directory: str) -> DataFrame:
    """(path, n_bytes, verdict, condition) of *_pass.fastq.gz and *_fail.fastq.gz below a folder."""
    from ..operators.quality import condition_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_{pass,fail}.fastq.gz").load(directory)
    verdict = F.when(F.col("path").endswith("_pass.fastq.gz"), "pass").otherwise("fail")
    return files.select("path", F.col("length").alias("n_bytes"), verdict.alias("verdict"), condition_of(F.col("path")).alias("condition"))


def structures(numbered: DataFrame, file: str = "file") -> DataFrame:
    """(header, ord, dot_bracket) of each record of FASTA-like structure text."""
    held = numbered_records(numbered, file).where("rec > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("ord", F.trim("value").alias("v"))))), lambda x: x["v"])
    out = held.groupBy(file, "rec").agg(F.min_by("value", "ord").alias("header"), F.min("ord").alias("ord"), F.array_join(body, "").alias("dot_bracket"))
    return out.select(file, F.substr("header", F.lit(2)).alias("header"), "ord", "dot_bracket")


def dot_bracket(numbered: DataFrame, gene: str, exact: bool = False) -> DataFrame:
    """The first structure whose header begins with the gene's name (a prefix is enough
    unless exact): at most one row (dot_bracket), and none if that header has no structure."""
    h = F.col("header")
    hit = (F.regexp_extract(h, r"^(\S+)", 1) == gene) if exact else h.startswith(gene)
    return structures(numbered).where(hit).orderBy("file", "ord").limit(1).where(F.col("dot_bracket") != "").select("dot_bracket")
