"""Length distributions of raw and mapped reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cigar_mapped_length


def mapped_lengths(alignments: DataFrame) -> DataFrame:
    """Mapped length of every mapped record (flag 0x4 not set), secondary ones included."""
    kept = alignments.where((F.col("flag").bitwiseAND(4) == 0) & F.col("cigar").isNotNull())
    return kept.select(cigar_mapped_length("cigar").alias("length"))


def length_distribution(raw: DataFrame, mapped: DataFrame) -> DataFrame:
    """(kind, length, n): raw comes as (length, n), mapped as lengths."""
    a = raw.groupBy("length").agg(F.sum("n").cast("long").alias("n")).select(F.lit("raw").alias("kind"), F.col("length").cast("long").alias("length"), "n")
    b = mapped.groupBy("length").agg(F.count("*").alias("n")).select(F.lit("mapped").alias("kind"), F.col("length").cast("long").alias("length"), "n")
    return a.unionByName(b)


def length_summary(distribution: DataFrame, keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Figures of a weighted distribution (length, n) by key: n, mean, median, population
    deviation, range, quantiles, mode (the smallest on a tie) and CV in percent. The
    values are never expanded to one row per read."""
    x, w = F.col("length").cast("double"), F.col("n")
    moments = distribution.groupBy(*keys).agg(
        F.sum("n").cast("long").alias("n"), F.sum(x * w).alias("__s"), F.sum(x * x * w).alias("__ss"), F.min("length").alias("min"), F.max("length").alias("max"),
        F.percentile(x, [0.05, 0.25, 0.5, 0.75, 0.95], w).alias("__q"), F.min_by("length", F.struct((-F.col("n")).alias("a"), "length")).alias("mode"),
    )
    mean = F.col("__s") / F.col("n")
    out = moments.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("__ss") / F.col("n") - mean * mean, F.lit(0.0)))})
    out = out.withColumns({q: F.col("__q")[i] for i, q in enumerate(("q5", "q25", "median", "q75", "q95"))})
    out = out.withColumns({"range": F.col("max") - F.col("min"), "cv_percent": F.try_divide(F.col("std") * 100, F.col("mean"))})
    return out.drop("__s", "__ss", "__q")
