"""VCF sources in long form: one row per position and cell, never a wide table.

The header (cells, contigs) is read on the driver; records are split by expressions.
Missing cells are left out of the array before it is exploded."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import info_map, safe_int
from ..session import written
from .blocktext import is_blocked, raw_lines, read_block_text, read_indexed_text
from .files import matching
from .text import lines


def read_header(spark: SparkSession, path, first: int = 1000) -> tuple[list[str], list[str]]:
    """(cells, contigs) from the header lines of a file, or of a folder whose files follow each
    other by name. Only its beginning is read: `first` lines of a file, and eight times as
    many until the line of column names is among them, then those of the next file."""
    if isinstance(path, str) and path.endswith((".gz", ".bgz")) and is_blocked(path):
        return block_header(path)
    # Spark deals out the files of a folder by size, so each is read by itself
    parts = [p for p in matching(spark, f"{path}/*") if not p.split("/")[-1].startswith(("_", "."))] if isinstance(path, str) else []
    head, end = [], None
    for part in parts or [path]:
        raw, wanted = spark.read.text(part), first
        while True:
            own = [r.value for r in raw.take(wanted)]
            end = next((i for i, x in enumerate(own) if x.startswith("#CHROM") or not x.startswith("#")), None)
            if end is not None or len(own) < wanted:
                break
            wanted *= 8
        head += own if end is None else own[: end + 1]
        if end is not None:
            break
    contigs = [m[1] for x in head if (m := re.match(r"##contig=<ID=([^,>]+)", x))]
    names = next((x.rstrip("\n").split("\t") for x in head if x.startswith("#CHROM")), [])
    return names[9:], contigs


#: FORMAT fields that the readers take.
FIELDS = ("DP", "AD", "ALL")


def records(raw: DataFrame) -> DataFrame:
    """(gene, pos, ref, info, at_DP, at_AD, at_ALL, samples) of record lines; the places of
    the FORMAT fields, from 1, are found once for each record."""
    p = F.split("value", "\t")
    form = F.split(F.get(p, F.lit(8)), ":")
    return raw.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        p[0].alias("gene"), safe_int(F.get(p, F.lit(1)), "long").alias("pos"), F.get(p, F.lit(3)).alias("ref"), F.get(p, F.lit(7)).alias("info"),
        *[F.array_position(form, f).cast("int").alias(f"at_{f}") for f in FIELDS], F.slice(p, 10, F.greatest(F.size(p) - 9, F.lit(0))).alias("samples"),
    )


def by_cell(rows: DataFrame, cells: list[str], outer: bool = False) -> DataFrame:
    """One row per cell of a record. Cells beyond the header are left out; so are cells
    that begin with a dot, before the array is exploded, unless outer."""
    named = F.array(*[F.lit(c) for c in cells])
    pairs = F.filter(
        F.transform("samples", lambda x, i: F.struct(i.alias("cell_idx"), x.alias("text"))),
        lambda s: (s["cell_idx"] < len(cells)) & (F.lit(outer) | ~s["text"].startswith(".")),
    )
    spread = rows.withColumn("s", F.explode_outer(pairs) if outer else F.explode(pairs))
    return spread.select("gene", "pos", "ref", "info", *[f"at_{f}" for f in FIELDS], F.get(named, F.col("s.cell_idx")).alias("cell"), F.col("s.cell_idx").alias("cell_idx"), F.split("s.text", ":").alias("v"))


def field(name: str) -> Column:
    """The cell's value of a FORMAT field; a record without the field is an error."""
    missing = F.raise_error(F.concat(F.lit(f"FORMAT has no {name} at "), F.col("gene"))).cast("string")
    return F.when(F.col(f"at_{name}") > 0, F.get(F.col("v"), F.col(f"at_{name}") - 1)).otherwise(missing)


def first_counts() -> Column:
    """Up to four values of ALL; one that isn't a number is NULL."""
    return F.transform(F.slice(F.split(field("ALL"), ",", 5), 1, 4), lambda x: x.try_cast("int"))


def parse_cells_dense(raw: DataFrame, cells: list[str]) -> DataFrame:
    """(gene, pos, ref, cell, cell_idx, coverage, mutrate): coverage sums up to four
    values of ALL; mutant = coverage - (DP - AD), AD "." is 0; entries without DP or ALL,
    and those that don't parse, are missing (a dense matrix has 0 there)."""
    df = by_cell(records(raw), cells).withColumns({"dp": safe_int(field("DP")), "ad": F.when(field("AD") == ".", F.lit(0)).otherwise(safe_int(field("AD"))), "four": first_counts()})
    df = df.where("dp is not null and ad is not null and not exists(four, x -> x is null)")
    coverage = F.aggregate("four", F.lit(0), lambda a, x: a + x)
    return with_rate(df.withColumn("coverage", coverage))


def with_rate(df: DataFrame) -> DataFrame:
    mutant = F.col("coverage") - (F.col("dp") - F.col("ad"))
    rate = F.coalesce(F.try_divide(mutant.cast("double"), F.col("coverage").cast("double")), F.lit(0.0))
    return df.select("gene", "pos", "ref", "cell", "cell_idx", F.col("coverage").cast("long").alias("coverage"), rate.alias("mutrate"))


def parse_cells_sparse(raw: DataFrame, cells: list[str]) -> DataFrame:
    """As the dense reader, but only entries with at least four values in ALL and a
    positive coverage."""
    df = by_cell(records(raw), cells).withColumns({"dp": safe_int(field("DP")), "ad": F.coalesce(safe_int(field("AD")), F.lit(0)), "four": first_counts()})
    df = df.where("dp is not null and size(four) = 4 and not exists(four, x -> x is null)")
    return with_rate(df.withColumn("coverage", F.aggregate("four", F.lit(0), lambda a, x: a + x))).where("coverage > 0")


def parse_cell_positions(raw: DataFrame, cells: list[str]) -> DataFrame:
    """The cell_position table for windows; a record without any cell is kept as one row
    with cell NULL, since it takes part in the gene's anchor."""
    # numbers are read inside the array, so that cells without both counts make no rows
    at = {f: F.col(f"at_{f}") for f in ("DP", "AD")}
    split = F.transform("samples", lambda x, i: F.struct(i.alias("cell_idx"), F.split(x, ":").alias("v")))
    numbers = F.transform(split, lambda s: F.struct(s["cell_idx"].alias("cell_idx"), *[safe_int(F.get(s["v"], at[f] - 1)).alias(f.lower()) for f in at]))
    kept = F.filter(numbers, lambda s: (s["cell_idx"] < len(cells)) & s["dp"].isNotNull() & s["ad"].isNotNull())
    missing = F.raise_error(F.concat(F.lit("FORMAT has no DP or AD at "), F.col("gene"))).cast("array<struct<cell_idx:int,dp:int,ad:int>>")
    spread = records(raw).select("gene", "pos", "ref", F.explode_outer(F.when((at["DP"] > 0) & (at["AD"] > 0), kept).otherwise(missing)).alias("s"))
    named = F.array(*[F.lit(c) for c in cells]).cast("array<string>")
    return spread.select("gene", "pos", "ref", F.get(named, F.col("s.cell_idx")).alias("cell"), "s.cell_idx", "s.dp", "s.ad")


def read_cells_dense(spark: SparkSession, path) -> DataFrame:
    return parse_cells_dense(lines(spark, path), read_header(spark, path)[0])


def read_cells_sparse(spark: SparkSession, path) -> DataFrame:
    return parse_cells_sparse(lines(spark, path), read_header(spark, path)[0])


def read_cell_positions(spark: SparkSession, path, gene: str | None = None) -> DataFrame:
    """All records of a text file, or one gene's."""
    out = parse_cell_positions(lines(spark, path), read_header(spark, path)[0])
    return out if gene is None else out.where(F.col("gene") == gene)


#: Folders of a store: one per gene, or, where genes are more than these, as many groups of genes.
FOLDERS, GROUPS = 512, 64


def gene_group(gene: Column) -> Column:
    return F.pmod(F.crc32(gene.cast("binary")), F.lit(GROUPS)).cast("int")


def store_by_gene(cell_positions: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """The indexed form: Parquet in one folder per gene, sorted by position. Rows are dealt
    by ranges of gene and position, so a deep gene is several files. More genes than `folders` share
    GROUPS folders, sorted by gene and position, so the number of files doesn't grow with the genes."""
    held = written(cell_positions, "store")
    if held.select("gene").distinct().limit(folders + 1).count() <= folders:
        held.repartitionByRange("gene", "pos").sortWithinPartitions("gene", "pos").write.partitionBy("gene").parquet(path)
    else:
        keys = ["gene_group", "gene", "pos"]
        grouped = held.withColumn("gene_group", gene_group(F.col("gene")))
        grouped.repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("gene_group").parquet(path)


def read_region(spark: SparkSession, store: str, gene: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The cell positions of one gene, or of first..last of it, from a store written by
    store_by_gene(): only the folder of the gene, or of its group, is read, and of its files the
    row groups whose genes and positions can be those."""
    schema = "pos long, ref string, cell string, cell_idx int, dp int, ad int, gene string"
    if matching(spark, f"{store}/gene_group=*"):
        out = spark.read.schema(f"{schema}, gene_group int").parquet(store).where(F.col("gene_group") == gene_group(F.lit(gene)))
    else:
        out = spark.read.schema(schema).parquet(store)
    out = out.where(F.col("gene") == gene)
    if first is not None:
        out = out.where(F.col("pos") >= first)
    if last is not None:
        out = out.where(F.col("pos") <= last)
    return out.select("gene", "pos", "ref", "cell", "cell_idx", "dp", "ad")


def read_block_cells(spark: SparkSession, path: str, split: int = 64 << 20) -> tuple[DataFrame, list[str]]:
    """The lines of a block-gzipped cell VCF file in splits, and its cells."""
    return read_block_text(spark, path, split=split), block_cells(path)


def block_cells(path: str) -> list[str]:
    """The cells of a block-gzipped file; its contigs aren't held."""
    return block_header(path, False)[0]


def block_header(path: str, listed: bool = True) -> tuple[list[str], list[str]]:
    """(cells, contigs) of a block-gzipped file, of which no more than the header is read."""
    contigs, cells = [], []
    for _, line in raw_lines(path, 0, 1 << 62):
        if listed and line.startswith(b"##contig=<ID="):
            contigs.append(re.split("[,>]", line.decode()[13:])[0])
        elif line.startswith(b"#CHROM"):
            cells = line.decode().rstrip("\r").split("\t")[9:]
            break
        elif not line.startswith(b"#"):
            break
    return cells, contigs


def read_indexed_region(spark: SparkSession, path: str, gene: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The cell positions of one gene, or of first..last of it, from a block-gzipped VCF file with a TBI
    index beside it: only the blocks that the index names for the range are read."""
    held = read_indexed_text(spark, path).where(F.col("name") == gene)
    if first is not None:
        held = held.where(F.col("pos") >= first)
    if last is not None:
        held = held.where(F.col("pos") <= last)
    return parse_cell_positions(held.select("value"), block_cells(path))


def parse_base(raw: DataFrame, include_oth: bool = False, min_coverage: int = 100) -> DataFrame:
    """(gene, pos, ref, coverage, mutrate) from INFO alone: coverage is DP, or DP + OTH;
    rate is AD or AD + OTH over it; missing numbers are 0; records of fewer than eight
    fields or too little coverage go."""
    p = F.split("value", "\t")
    info = info_map(p[7])
    number = lambda k: F.coalesce(safe_int(F.try_element_at(info, F.lit(k)), "long"), F.lit(0).cast("long"))
    rows = raw.where(~F.col("value").startswith("#") & (F.size(p) >= 8))
    rows = rows.select(p[0].alias("gene"), safe_int(p[1], "long").alias("pos"), p[3].alias("ref"), number("AD").alias("ad"), number("DP").alias("dp"), number("OTH").alias("oth"))
    extra = F.col("oth") if include_oth else F.lit(0)
    rows = rows.withColumn("coverage", F.col("dp") + extra).where(F.col("coverage") >= min_coverage)
    rate = F.coalesce(F.try_divide((F.col("ad") + extra).cast("double"), F.col("coverage").cast("double")), F.lit(0.0))
    return rows.select("gene", "pos", "ref", "coverage", rate.alias("mutrate"))


def read_base(spark: SparkSession, path, include_oth: bool = False, min_coverage: int = 100) -> DataFrame:
    return parse_base(lines(spark, path), include_oth, min_coverage)


def parse_windows(raw: DataFrame, cells: list[str]) -> DataFrame:
    """(gene, win, win_end, ref, cell, dp, mr): entries with dp > 0; mr is read, not
    recomputed, and a written zero is kept; a bad WIN_END is NULL."""
    df = by_cell(records(raw), cells)
    end = safe_int(F.regexp_extract("info", r"WIN_END=(\d+)", 1), "long")
    out = df.select("gene", F.col("pos").alias("win"), end.alias("win_end"), "ref", "cell", safe_int(F.get("v", F.lit(0)), "long").alias("dp"), safe_int(F.get("v", F.lit(2)), "double").alias("mr"))
    return out.where("dp > 0")


def read_windows(spark: SparkSession, path) -> DataFrame:
    return parse_windows(lines(spark, path), read_header(spark, path)[0])


def read_paired_windows(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two window files one below the other; their cells must be the same, in order."""
    a, b = read_header(spark, first)[0], read_header(spark, second)[0]
    if a != b:
        raise ValueError("the two files list different cells")
    return read_windows(spark, first).unionByName(read_windows(spark, second))


def read_samples(spark: SparkSession, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Pairs of window files of several samples, with a sample column."""
    return reduce(DataFrame.unionByName, [read_paired_windows(spark, *p).withColumn("sample", F.lit(s)) for s, p in paths.items()])
