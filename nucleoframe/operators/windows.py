"""Position windows per gene and per cell.

A window's membership is arithmetic: from the distance to the gene's anchor follow the
first and last window that hold a position, so that there is no range join. Sums are
grouped by window, so partial aggregation takes up genes with very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import round_like_numpy
from ..sources.files import spread
from . import ranks


def check_sizes(win_len: int, step: int) -> None:
    if win_len <= 0 or step <= 0:
        raise ValueError(f"win_len and step must be positive, not {win_len} and {step}")


def window_starts(pos: Column, anchor: Column, win_len: int, step: int) -> tuple[Column, Column]:
    """Numbers of the first and last window that hold pos; none if first > last."""
    o = pos - anchor
    first = F.greatest(F.lit(0).cast("long"), F.ceil((o - (win_len - 1)) / F.lit(float(step))).cast("long"))
    return first, F.floor(o / F.lit(float(step))).cast("long")


def tiled(df: DataFrame, win_len: int, step: int, pos: str = "pos", anchor: str = "anchor") -> DataFrame:
    """One row for each window that holds the position, with win and win_end. Windows
    start at the anchor and end at start + win_len - 1; with step > win_len there are gaps."""
    if win_len == step:  # exactly one window: no generator
        at = F.floor((F.col(pos) - F.col(anchor)) / F.lit(float(step))).cast("long")
        out = df.withColumn("win", F.col(anchor) + at * step)
    else:
        first, last = window_starts(F.col(pos), F.col(anchor), win_len, step)
        # the filter goes first: sequence() of a gap would count downwards
        held = df.withColumns({"__first": first, "__last": last}).where("__first <= __last")
        out = held.withColumn("__k", F.explode(F.sequence("__first", "__last"))).withColumn("win", F.col(anchor) + F.col("__k") * step)
        out = out.drop("__first", "__last", "__k")
    return out.withColumn("win_end", F.col("win") + (win_len - 1))


def with_anchors(kept: DataFrame, anchors: DataFrame) -> DataFrame:
    """The rows with their gene's anchor. Of large inputs each gene is dealt to 16 parts, and the tasks
    grow in number with the input; they hold the anchors, and don't sort the rows."""
    part = F.pmod(F.xxhash64("pos"), F.lit(16)).cast("int")
    parts = kept.withColumn("part", part)
    dealt = spread(parts, "gene", "part")
    if dealt is parts:
        return kept.join(anchors, "gene")
    held = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")).hint("shuffle_hash")
    return dealt.join(held, ["gene", "part"]).drop("part")


def rate(mutant: str, coverage: str) -> Column:
    return round_like_numpy(F.try_divide(F.col(mutant).cast("double"), F.col(coverage).cast("double")), 5)


def bulk_windows(position: DataFrame, win_len: int = 10, step: int = 10, coverage_threshold: int = 200, mutrate_threshold: float = 0.2, anchors: DataFrame | None = None) -> DataFrame:
    """Window sums per gene: (gene, win, coverage, mutant, mutrate, win_end).

    The anchor is the gene's least position before any filter; rows with a rate above the
    threshold, or without one, don't count; windows below the coverage threshold go. `anchors` (gene,
    anchor) may be given where there is a cheaper way to them than through the positions."""
    check_sizes(win_len, step)
    if anchors is None:
        anchors = position.groupBy("gene").agg(F.min("pos").alias("anchor"))
    kept = position.where(F.col("mutrate") <= mutrate_threshold).select("gene", "pos", "coverage", "mutant")
    sums = spread(tiled(with_anchors(kept, anchors), win_len, step), "gene", "win").groupBy("gene", "win", "win_end")
    sums = sums.agg(F.sum("coverage").alias("coverage"), F.sum("mutant").alias("mutant")).where(F.col("coverage") >= coverage_threshold)
    return sums.select("gene", "win", "coverage", "mutant", rate("mutant", "coverage").alias("mutrate"), "win_end")


def cell_windows(cell_position: DataFrame, win_len: int = 10, step: int = 10, coverage_threshold: int = 200, mutrate_threshold: float = 0.2, legacy_anchor: bool = False) -> DataFrame:
    """Window sums per gene and cell: (gene, win, win_end, cell, dp, ad, mr).

    The anchor is the least position of any record of the gene, also of records whose
    cells are all missing; with legacy_anchor only records with a cell count. A
    position's rate is ad / dp, and 0 where dp is 0."""
    check_sizes(win_len, step)
    present = F.col("dp").isNotNull() & F.col("ad").isNotNull()
    anchored = cell_position.where(present) if legacy_anchor else cell_position
    anchors = anchored.groupBy("gene").agg(F.min("pos").alias("anchor"))
    own = F.coalesce(F.try_divide(F.col("ad").cast("double"), F.col("dp").cast("double")), F.lit(0.0))
    kept = cell_position.where(present & (own <= mutrate_threshold)).select("gene", "pos", "cell", "dp", "ad")
    sums = spread(tiled(with_anchors(kept, anchors), win_len, step), "gene", "win", "cell").groupBy("gene", "win", "win_end", "cell")
    sums = sums.agg(F.sum(F.col("dp").cast("long")).alias("dp"), F.sum(F.col("ad").cast("long")).alias("ad")).where(F.col("dp") >= coverage_threshold)
    return sums.select("gene", "win", "win_end", "cell", "dp", "ad", F.coalesce(rate("ad", "dp"), F.lit(0.0)).alias("mr"))


def any_cell_windows(windows: DataFrame) -> DataFrame:
    """Windows that at least one cell passes, with the number of such cells."""
    return spread(windows, "gene", "win").groupBy("gene", "win", "win_end").agg(F.count("*").alias("n_cells"), F.sum("dp").alias("dp"))


def row_rolling(position: DataFrame, rows: int, step: int) -> DataFrame:
    """Rolling sums over a number of rows per gene, every step-th row kept: (gene, pos,
    coverage, mutant, mutrate). The windows hold only whole runs of `rows` rows."""
    check_sizes(rows, step)
    order = W.partitionBy("gene").orderBy("pos")
    held = order.rowsBetween(-(rows - 1), 0)
    out = position.select(
        "gene", "pos", F.row_number().over(order).alias("rn"), F.sum("coverage").over(held).alias("coverage"), F.sum("mutant").over(held).alias("mutant")
    )
    out = out.where((F.col("rn") >= rows) & ((F.col("rn") - rows) % step == 0))
    return out.select("gene", "pos", "coverage", "mutant", rate("mutant", "coverage").alias("mutrate"))


def padded_rolling(position: DataFrame, win_len: int, step: int, coverage_threshold: int = 0, dense: bool = False) -> DataFrame:
    """Rolling sums per gene over `win_len` rows, with padding at both ends: (gene, win, coverage,
    mutant, mutrate). Before the first row is a copy of it, with number 0, and behind the last one
    are empty rows up to a multiple of win_len, one at least. A window ends at each step-th
    number; those with enough coverage stay, with the rate to 5 places.

    Rows are numbered in order of position, or, with `dense`, by position, so that gaps are empty
    rows. Each row is sent to the windows that hold it, so no task sorts windows."""
    check_sizes(win_len, step)
    held = spread(position, "gene", "pos").groupBy("gene", "pos").agg(F.sum("coverage").alias("coverage"), F.sum("mutant").alias("mutant"))
    if dense:
        ends = held.groupBy("gene").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        numbered = held.join(ends, "gene").withColumns({"number": F.col("pos") - F.col("first") + 1, "rows": F.col("last") - F.col("first") + 1})
    else:
        ranked = ranks.running(held.withColumn("n", F.lit(1).cast("long")), "pos", ["gene"])
        numbered = ranked.withColumns({"number": F.col("upto"), "rows": F.col("whole")})
    first = numbered.where(F.col("number") == 1).withColumn("number", F.lit(0).cast("long"))
    columns = ["gene", "number", "rows", "coverage", "mutant"]
    both = numbered.select(columns).union(first.select(columns))
    last = F.least(F.col("number") + win_len - 1, F.col("rows") + win_len - F.col("rows") % win_len)
    k = F.sequence(F.greatest(F.ceil(F.col("number") / step), F.lit(1)), F.floor(last / step))
    tiled_rows = both.where(F.floor(last / step) >= F.greatest(F.ceil(F.col("number") / step), F.lit(1))).select("gene", F.explode(k).alias("k"), "coverage", "mutant")
    sums = spread(tiled_rows.withColumn("win", F.col("k") * step), "gene", "win").groupBy("gene", "win").agg(F.sum("coverage").alias("coverage"), F.sum("mutant").alias("mutant"))
    kept = sums.where(F.col("coverage") >= coverage_threshold)
    return kept.select("gene", "win", "coverage", "mutant", F.bround(rate("mutant", "coverage"), 5).alias("mutrate"))
