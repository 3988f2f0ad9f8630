"""Reactivity: treated minus control rates, and their normalizations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def calculate_reactivity(signal: DataFrame, control: DataFrame, index_cols=("gene", "pos"), keep_cols=(), sample_col: str | None = None) -> DataFrame:
    """Inner join on the keys; reactivity = signal - control, which may be negative. Rows
    whose rate is missing on a side go."""
    keys = [*index_cols, *([sample_col] if sample_col else [])]
    side = lambda df, name: df.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in ("mutrate", "coverage")], *([F.col(c) for c in keep_cols] if name == "signal" else []))
    a = side(signal.where("mutrate is not null"), "signal")
    b = side(control.where("mutrate is not null"), "control")
    joined = a.join(b, keys)
    return joined.select(
        *keys, "mutrate_signal", "mutrate_control", (F.col("mutrate_signal") - F.col("mutrate_control")).alias("reactivity"), "coverage_signal", "coverage_control", *keep_cols
    )


def dropped_rows(signal: DataFrame, control: DataFrame, index_cols=("gene", "pos"), sample_col: str | None = None) -> DataFrame:
    """One row of what calculate_reactivity() leaves out: rows of each side, those without a rate, and
    those without a partner on the other side, and the rows of the join."""
    keys = [*index_cols, *([sample_col] if sample_col else [])]
    parts = []
    for name, df in (("signal", signal), ("control", control)):
        parts.append(df.select(*keys, F.lit(name).alias("side"), F.col("mutrate").isNull().cast("long").alias("missing")))
    by_key = parts[0].union(parts[1]).groupBy(*keys)
    n = lambda name, missing: F.count_if((F.col("side") == name) & (F.col("missing") == missing))
    counts = by_key.agg(*[n(s, m).alias(f"{s}_{m}") for s in ("signal", "control") for m in (0, 1)])
    whole = F.lit(True)
    for k in keys:  # a key that is missing has no partner
        whole = whole & F.col(k).isNotNull()
    alone = lambda a, b: F.coalesce(F.sum(F.when(whole & (F.col(f"{b}_0") > 0), 0).otherwise(F.col(f"{a}_0"))), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counts.agg(
        *[c for s in ("signal", "control") for c in (total(F.col(f"{s}_0") + F.col(f"{s}_1")).alias(f"{s}_rows"), total(f"{s}_1").alias(f"{s}_without_rate"))],
        alone("signal", "control").alias("signal_alone"), alone("control", "signal").alias("control_alone"),
        total(F.when(whole, F.col("signal_0") * F.col("control_0"))).alias("joined_rows"),
    )


def clip_scale(df: DataFrame, column: str = "reactivity", by=(), out: str = "normalized_reactivity") -> DataFrame:
    """(x - P5) / (P95 - P5) clipped to 0..1 within each group; unchanged where P95 = P5.

    The percentiles are joined back by the group's key; rows without a key go."""
    x = F.col(column)
    points = ranks.quantiles(df, column, [0.05, 0.95], by).select(*by, F.col("q").alias("__p"))
    joined = df.join(points, list(by)) if by else df.crossJoin(F.broadcast(points))
    low, high = F.col("__p")[0], F.col("__p")[1]
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - low, high - low)))
    return joined.withColumn(out, F.when(low == high, x).when(x.isNotNull(), scaled)).drop("__p")


def limits(df: DataFrame, column: str, by, bottom: float, top: float) -> DataFrame:
    """(by, __low, __high): the values at ranks floor(bottom * n) + 1 and n - floor(top * n) of each
    group, or of all rows."""
    ranked = ranks.running(ranks.distinct_counts(df, column, by), column, by)
    low, high = F.floor(bottom * F.col("whole")) + 1, F.col("whole") - F.floor(top * F.col("whole"))
    return ranked.groupBy(*by).agg(ranks.at_rank(low, F.col(column)).alias("__low"), ranks.at_rank(high, F.col(column)).alias("__high"))


def winsorize(df: DataFrame, column: str, by, bottom: float = 0.0, top: float = 0.0) -> DataFrame:
    """Clamps values to those at ranks floor(bottom * n) + 1 and n - floor(top * n) of
    the group, or of all rows where `by` is empty. The ranks are taken over distinct values
    with their counts."""
    if not bottom and not top:
        return df
    x, found = F.col(column), limits(df, column, by, bottom, top)
    joined = df.join(found, list(by), "left") if by else df.crossJoin(F.broadcast(found))
    clamped = F.when(x.isNotNull(), F.least(F.greatest(x, F.col("__low")), F.col("__high")))
    return joined.withColumn(column, clamped).drop("__low", "__high")


def quantile_of(values: Column, point: float) -> Column:
    """A quantile of a sorted array, interpolated linearly; NULL for an empty one."""
    place = (F.size(values) - 1) * F.lit(point)
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (place - F.floor(place))


def gene_divisors(df: DataFrame, column: str, by=("gene",)) -> DataFrame:
    """(by, divisor): of the values below max(cap, 1.5 * interquartile range) the mean of
    those above their 90th percentile; cap is P99 for groups of 500 rows or more (rows
    without a value count), else P95. NULL, or no row, where nothing lies above.

    Groups that are small enough to be held are one sorted array each; if there are
    larger ones, quantiles of ranges of values are joined back instead."""
    x, points = F.col(column), F.col("q")
    large = ranks.large_groups(df, by)
    cap_of = lambda q25, q75, q95, q99: F.greatest(F.when(F.col("__n") >= 500, q99).otherwise(q95), (q75 - q25) * 1.5)
    wanted = [0.25, 0.75, 0.95, 0.99]
    if large is None:
        held = df.groupBy(*by).agg(F.sort_array(F.collect_list(x.cast("double"))).alias("__v"), F.count("*").alias("__n"))
        held = held.withColumn("__cap", cap_of(*[quantile_of(F.col("__v"), p) for p in wanted]))
        held = held.select(*by, F.filter("__v", lambda v: v < F.col("__cap")).alias("__kept")).withColumn("__p90", quantile_of(F.col("__kept"), 0.9))
        tail = F.filter("__kept", lambda v: v > F.col("__p90"))
        total = F.aggregate(tail, F.lit(0.0), lambda a, v: a + v)
        return held.select(*by, F.try_divide(total, F.size(tail)).alias("divisor"))
    found = ranks.quantiles(df, column, wanted, by, large).join(df.groupBy(*by).agg(F.count("*").alias("__n")), list(by))
    found = found.select(*by, cap_of(*[points[i] for i in range(4)]).alias("__cap"))
    kept = df.select(*by, column).join(found, list(by)).where(x < F.col("__cap"))
    tail = ranks.quantiles(kept, column, [0.9], by, large).select(*by, points[0].alias("__p90"))
    return kept.join(tail, list(by)).where(x > F.col("__p90")).groupBy(*by).agg(F.avg(x).alias("divisor"))


def normalize_by_gene(df: DataFrame, columns=None, by=("gene",), keys=(), bottom: float = 0.0, top: float = 0.0, transcriptome_winsorize: bool = False, gene_winsorize: bool = False) -> DataFrame:
    """Divides each column by its group's divisor. Without `columns` all numeric columns
    other than the keys are taken. One column gives normalized_reactivity, several give
    <column>_normalized; a group without a divisor gives NULL."""
    if columns is None:
        columns = [f.name for f in df.schema if f.name not in (*by, *keys) and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal")]
    out = df
    for c in columns:
        # the clamped column is beside the others, so a divisor and a value are of one frame
        out = out.withColumn("__x", F.col(c))
        if transcriptome_winsorize:
            out = winsorize(out, "__x", (), bottom, top)
        if gene_winsorize:
            out = winsorize(out, "__x", by, bottom, top)
        name = "normalized_reactivity" if len(columns) == 1 else f"{c}_normalized"
        out = out.join(gene_divisors(out, "__x", by), list(by), "left").withColumn(name, F.try_divide(F.col("__x"), F.col("divisor"))).drop("divisor", "__x")
    return out


def normalized_reactivity(signal: DataFrame, control: DataFrame, index_cols=("gene", "pos"), sample_col: str = "group", method: str = "normalize_reactivity_zy") -> DataFrame:
    """Join, difference and normalization within each sample: by gene or by clipping."""
    joined = calculate_reactivity(signal, control, index_cols, sample_col=sample_col)
    if method == "normalize_reactivity_zy":
        return normalize_by_gene(joined, ["reactivity"], by=(sample_col, "gene"))
    if method == "normalize_reactivity":
        return clip_scale(joined, by=(sample_col,))
    raise ValueError(f"unknown normalization method {method!r}")
