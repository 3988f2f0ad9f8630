"""The three entries as lazy pipelines: one plan from source to result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, mutrate, reactivity, reads, windows


def bulk_profile(counts: DataFrame, gene_counts: DataFrame | None = None, win_len: int = 10, step: int = 10, coverage_threshold: int = 200, mutrate_threshold: float = 0.2, ins_len: int = 3, del_len: int = 3, min_coverage: int = -1, min_normalized: float = 10) -> DataFrame:
    """Base counts to windows."""
    positions, anchors = mutrate.mutation_rates(counts, ins_len, del_len), None
    if gene_counts is not None:
        positions = mutrate.position_filter(mutrate.with_gene_counts(positions, gene_counts), min_coverage, min_normalized)
    else:  # each count is a position, whose rate the anchors don't need
        anchors = counts.groupBy("gene").agg(F.min("pos").alias("anchor"))
    return windows.bulk_windows(positions, win_len, step, coverage_threshold, mutrate_threshold, anchors)


def bulk_reactivity(signal_windows: DataFrame, control_windows: DataFrame, sample_col: str = "sample", method: str = "normalize_reactivity_zy") -> DataFrame:
    """Windows of treated and control samples to normalized reactivity."""
    return reactivity.normalized_reactivity(signal_windows, control_windows, ("gene", "win"), sample_col, method)


def single_cell_profile(cell_position: DataFrame, metadata: DataFrame, clusters: DataFrame, filters: Mapping | None = None, win_len: int = 10, step: int = 10, coverage_threshold: int = 200, mutrate_threshold: float = 0.2, cluster_column: str = "leiden") -> DataFrame:
    """Cell positions to cluster pseudo-bulk windows."""
    found = windows.cell_windows(cell_position, win_len, step, coverage_threshold, mutrate_threshold)
    kept = cells.filter_by_cells(found, metadata, filters)
    return cells.cluster_pipeline(kept, clusters, coverage_threshold, mutrate_threshold, cluster_column)


def read_profile(alignments: DataFrame, min_length: int = 0) -> dict[str, DataFrame]:
    """Alignments to read statistics, their summaries and the unique primary records."""
    stats = reads.read_stats(alignments, min_length)
    return {
        "stats": stats,
        "summary": reads.stats_summary(stats),
        "percentiles": reads.ratio_percentiles(stats),
        "histogram": reads.alignment_histogram(stats),
        "counters": reads.processing_counters(alignments, min_length),
        "unique": reads.unique_primary(reads.mapped(alignments, min_length), stats),
    }
