"""Read quality: filtering of FASTQ records and sequencing statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import mean_qscore


def with_mean_q(fastq: DataFrame, quality: str = "quality", skip: int = 60) -> DataFrame:
    return fastq.withColumn("mean_q", mean_qscore(quality, skip))


def quality_verdict(fastq: DataFrame, least: float = 10.0) -> DataFrame:
    """verdict is pass if the mean score is above `least` (strictly), else fail."""
    scored = fastq if "mean_q" in fastq.columns else with_mean_q(fastq)
    return scored.withColumn("verdict", F.when(F.col("mean_q") > least, "pass").otherwise("fail"))


def condition_of(path, conditions: tuple[str, ...] = ("DMSO", "2A3")):
    """The first condition whose name the path contains; NULL for none."""
    out = F.lit(None).cast("string")
    for c in reversed(conditions):
        out = F.when(path.contains(c), c).otherwise(out)
    return out


def condition_stats(files: DataFrame, fast: bool = False, bytes_per_read: int = 1000) -> DataFrame:
    """Bytes and reads by condition, with a total row (condition NULL): from (condition,
    verdict, n_bytes, n_lines). The share of passing reads is cut after two places,
    NULL without reads; fast estimates reads from bytes."""
    reads = F.floor(F.col("n_bytes") / bytes_per_read) if fast else F.floor(F.col("n_lines") / 4)
    of = lambda c, v: F.coalesce(F.sum(F.when(F.col("verdict") == v, c)), F.lit(0)).cast("long")
    known = files.where("condition is not null")
    out = known.withColumn("reads", reads).rollup("condition").agg(
        of(F.col("n_bytes"), "pass").alias("pass_bytes"), of(F.col("n_bytes"), "fail").alias("fail_bytes"),
        of(F.col("reads"), "pass").alias("pass_reads"), of(F.col("reads"), "fail").alias("fail_reads"),
    )
    total = F.col("pass_reads") + F.col("fail_reads")
    # integers before the division, so that the cut is exact
    return out.withColumn("pass_percent", F.when(total > 0, F.floor(F.col("pass_reads") * 10000 / total) / F.lit(100.0)))
