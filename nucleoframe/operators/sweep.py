"""Aligner parameter sweeps: the grid, name codec, log parsing and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import guarded_ratio

#: The sweep's parameter values.
GRID = {
    "sensitivity": ("very-sensitive-local", "very-sensitive", "sensitive-local", "sensitive"),
    "mp": ("3,1", "6,2"),
    "rdg": ("5,1", "5,3"),
    "rfg": ("5,1", "5,3"),
}
METRICS = ("overall_rate", "exact_rate", "multiple_rate")


def grid(spark: SparkSession, values: dict = GRID) -> DataFrame:
    """All combinations of the parameter values (32 rows by default), from one row."""
    out = spark.range(1)
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return out.select(*values)


def encode_name(sensitivity: Column, mp: Column, rdg: Column, rfg: Column) -> Column:
    """The folder name of a parameter set, as "bowtie_" + its options with - and _."""
    part = lambda n, v: F.concat(F.lit(f"_{n}_"), F.replace(v, F.lit(","), F.lit("-")))
    return F.concat(F.lit("bowtie_"), sensitivity, part("mp", mp), part("rdg", rdg), part("rfg", rfg))


def decode_name(name: Column) -> dict[str, Column]:
    """Parameters of a folder name; the sensitivity is what stands before _mp_, with
    underscores as hyphens. NULL for parts that aren't there."""
    value = lambda p: F.nullif(F.replace(F.regexp_extract(name, f"_{p}_([^_]+)", 1), F.lit("-"), F.lit(",")), F.lit(""))
    before = F.replace(F.regexp_extract(name, "^(.*?)_mp_", 1), F.lit("_"), F.lit("-"))
    return {"sensitivity": F.nullif(before, F.lit("")), "mp": value("mp"), "rdg": value("rdg"), "rfg": value("rfg")}


def parse_log(log: Column) -> dict[str, Column]:
    """Figures of an aligner's log; NULL where a line isn't there. The calculated rates need
    both counts of aligned reads. The patterns are fixed values: the log's own wording."""
    number = lambda p: F.regexp_extract(log, p, 1).try_cast("long")
    total = number(r"(\d+) reads; of these")
    exact = number(r"(\d+) \([\d.]+%\) aligned exactly 1 time")
    many = number(r"(\d+) \([\d.]+%\) aligned >1 times")
    return {
        "total_reads": total,
        "aligned_exactly_1": exact,
        "aligned_multiple": many,
        "unaligned": number(r"(\d+) \([\d.]+%\) were unaligned"),
        "overall_rate": F.regexp_extract(log, r"([\d.]+)% overall alignment rate", 1).try_cast("double"),
        "exact_rate": F.when(many.isNotNull(), guarded_ratio(exact * 100, total)),
        "multiple_rate": F.when(exact.isNotNull(), guarded_ratio(many * 100, total)),
        "calculated_rate": guarded_ratio((exact + many) * 100, total),
    }


def join_summaries(logs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Logs with the length summary of the same folder and stem, where there is one."""
    return logs.join(summaries, ["directory", "stem"], "left")


def group_stats(runs: DataFrame, parameters=("sensitivity", "mp", "rdg", "rfg"), metrics=METRICS) -> DataFrame:
    """(parameter, value, metric, mean, std, n): sample deviation; one pass over grouping
    sets. Of mp only the overall rate is summed up, of the other parameters all metrics."""
    stats = F.array(*[F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.count(m).alias("n")) for m in metrics])
    sets = [[F.col(p)] for p in parameters]
    grouped = runs.groupingSets(sets, *[F.col(p) for p in parameters]).agg(F.grouping_id().alias("g"), stats.alias("s"))
    last = len(parameters) - 1
    full = (1 << len(parameters)) - 1
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, p in enumerate(parameters):
        here = F.col("g") == full - (1 << (last - i))
        which, value = F.when(here, p).otherwise(which), F.when(here, F.col(p).cast("string")).otherwise(value)
    out = grouped.select(which.alias("parameter"), value.alias("value"), F.inline("s"))
    return out.where((F.col("parameter") != "mp") | (F.col("metric") == metrics[0]))


def metric_summary(runs: DataFrame, metrics=METRICS) -> DataFrame:
    """(metric, mean, median, max, min)."""
    cells = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.median(m).alias("median"), F.max(m).alias("max"), F.min(m).alias("min")) for m in metrics]
    return runs.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def pivot_mean(runs: DataFrame, index: str, column: str, metric: str, values: list | None = None) -> DataFrame:
    return runs.groupBy(index).pivot(column, values).agg(F.avg(metric))


def best_run(runs: DataFrame, metric: str = "overall_rate", order=("directory", "stem")) -> DataFrame:
    """The run with the greatest metric; the first by name on a tie."""
    return runs.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *order).limit(1)


def ranked_runs(runs: DataFrame, metric: str = "overall_rate", order=("directory", "stem")) -> DataFrame:
    """All runs, the greatest metric first and those without it last; ties by name. A total
    order, so Spark sorts by ranges and no task holds all rows."""
    return runs.orderBy(F.desc_nulls_last(metric), *order)
