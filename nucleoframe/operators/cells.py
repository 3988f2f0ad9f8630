"""Single-cell filters and cluster pseudo-bulk, on long tables (gene, win, cell, ...)."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from . import ranks


def metadata_predicate(cells: DataFrame, filters: Mapping) -> Column:
    """A scalar means equal, a list means one of, a pair means an inclusive range whose
    ends may be None; all must hold. Unknown columns are skipped with a warning."""
    parts: list[Column] = []
    for name, want in (filters or {}).items():
        if name not in cells.columns:
            warnings.warn(f"no column {name!r} in the cell metadata", stacklevel=2)
            continue
        c = F.col(f"`{name}`")
        if isinstance(want, tuple) and len(want) == 2:
            low, high = want
            parts += [c >= low] if low is not None else []
            parts += [c <= high] if high is not None else []
        elif isinstance(want, (list, set, frozenset)):
            parts.append(c.isin(*want))
        else:
            parts.append(c == want)
    return reduce(Column.__and__, parts, F.lit(True))


def filter_by_cells(long: DataFrame, cells: DataFrame, filters: Mapping | None = None) -> DataFrame:
    """Rows of cells whose metadata pass; joined by name, not by place in a list."""
    return long.join(cells.where(metadata_predicate(cells, filters or {})).select("cell"), "cell", "left_semi")


def threshold_filter(long: DataFrame, coverage_threshold: int, mutrate_threshold: float, coverage: str = "dp", rate: str = "mr") -> DataFrame:
    """Entries with enough coverage and a low enough rate. Positions and cells with
    nothing left vanish by themselves in the long form."""
    return long.where((F.col(coverage) >= coverage_threshold) & (F.col(rate) <= mutrate_threshold))


def dimensions(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct positions (row) and cells (col), numbered densely in order. Positions are
    numbered within their gene, after those of the genes before; all numbers are running sums
    over ranges of names and positions."""
    distinct = long.select("gene", "win").distinct().withColumn("n", F.lit(1))
    genes = ranks.running(distinct.groupBy("gene").agg(F.count("*").alias("n")), "gene").select("gene", (F.col("upto") - F.col("n")).alias("before"))
    placed = ranks.running(distinct, "win", ["gene"]).join(genes, "gene")
    cells = ranks.running(long.select("cell").distinct().withColumn("n", F.lit(1)), "cell")
    return placed.select("gene", "win", (F.col("before") + F.col("upto") - 1).alias("row")), cells.select("cell", (F.col("upto") - 1).alias("col"))


def empty_dimensions(long: DataFrame, positions: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: how many known cells and positions have no entry."""
    a = cells.select("cell").distinct().join(long.select("cell").distinct(), "cell", "left_anti").agg(F.count("*").alias("empty_cells"))
    b = positions.select("gene", "win").distinct().join(long.select("gene", "win").distinct(), ["gene", "win"], "left_anti")
    return a.crossJoin(b.agg(F.count("*").alias("empty_positions")))


def cluster_pseudobulk(long: DataFrame, clusters: DataFrame, cluster_column: str = "leiden", prefix: str = "dmso_") -> DataFrame:
    """(cluster, gene, win, coverage, mutrate, mutant, sample): the unweighted mean of the
    cells' rates and the least of their coverages. mutant is NULL. A cell listed twice in
    the clusters counts twice."""
    joined = long.join(clusters.select("cell", F.col(cluster_column).alias("cluster")), "cell")
    out = spread(joined, "cluster", "gene", "win").groupBy("cluster", "gene", "win").agg(F.min("dp").alias("coverage"), F.avg("mr").alias("mutrate"))
    return out.select(
        "cluster", "gene", "win", "coverage", "mutrate", F.lit(None).cast("long").alias("mutant"),
        F.concat(F.lit(prefix), F.col("cluster").cast("string")).alias("sample"),
    )


def cluster_pipeline(long: DataFrame, clusters: DataFrame, coverage_threshold: int, mutrate_threshold: float, cluster_column: str = "leiden") -> DataFrame:
    return cluster_pseudobulk(threshold_filter(long, coverage_threshold, mutrate_threshold), clusters, cluster_column)


def matrix_stats(long: DataFrame, coverage: str = "dp", rate: str = "mr") -> DataFrame:
    """One row: genes, positions, cells, stored entries, sparsity in percent, memory
    estimate, and the ranges of coverage and rate."""
    out = long.agg(
        F.count_distinct("gene").alias("n_genes"), F.count_distinct("gene", "win").alias("n_positions"), F.count_distinct("cell").alias("n_cells"), F.count("*").alias("n_entries"),
        F.min(coverage).alias("min_coverage"), F.max(coverage).alias("max_coverage"), F.avg(coverage).alias("mean_coverage"),
        F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), F.avg(rate).alias("mean_rate"),
    )
    whole = F.col("n_positions") * F.col("n_cells")
    sparsity = F.coalesce((1 - F.try_divide(F.col("n_entries").cast("double"), whole.cast("double"))) * 100, F.lit(0.0))
    # a sparse entry takes two values and two column numbers of 4 bytes each
    saved = F.coalesce((1 - F.try_divide(F.col("n_entries") * F.lit(16.0), whole * F.lit(8.0))) * 100, F.lit(0.0))
    return out.withColumns({"sparsity": sparsity, "dense_bytes": whole * 8, "memory_saved": saved})
