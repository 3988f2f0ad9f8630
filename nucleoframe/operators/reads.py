"""Multi-mapping statistics of aligned reads.

Reads are grouped in two levels, (read, reference) and then read, both with partial
aggregation; the input's order doesn't matter, ties go to the reference seen first by
the explicit ordinal `ord`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import percent
from . import ranks


def mapped(alignments: DataFrame, min_length: int = 0) -> DataFrame:
    """Alignments to a reference of enough mapped length; a missing length counts as 0."""
    return alignments.where(F.col("ref_name").isNotNull() & (F.coalesce("ref_length", F.lit(0)) >= min_length))


def primary(alignments: DataFrame) -> DataFrame:
    """Neither secondary (0x100) nor supplementary (0x800)."""
    return alignments.where(F.col("flag").bitwiseAND(0x900) == 0)


def processing_counters(alignments: DataFrame, min_length: int = 0) -> DataFrame:
    """One row: total, unmapped, too short and passing alignments, with percentages."""
    unmapped = F.col("ref_name").isNull()
    short = ~unmapped & (F.coalesce("ref_length", F.lit(0)) < min_length)
    out = alignments.agg(F.count("*").alias("total"), F.count_if(unmapped).alias("unmapped"), F.count_if(short).alias("filtered"))
    out = out.withColumn("passed", F.col("total") - F.col("unmapped") - F.col("filtered"))
    return out.withColumns({f"{c}_percent": percent(c, "total") for c in ("unmapped", "filtered", "passed")})


def read_stats(alignments: DataFrame, min_length: int = 0, lists: bool = True) -> DataFrame:
    """One row per read: alignment_count, unique_transcript_count, is_uniquely_mapped,
    max_transcript, max_count, max_ratio, and, with lists, unique_transcripts (first seen
    first) and all_transcripts (in order of alignment)."""
    kept = mapped(alignments, min_length)
    counts = kept.groupBy("read_id", "ref_name").agg(F.count("*").alias("n"), F.min("ord").alias("first"), *([F.collect_list("ord").alias("ords")] if lists else []))
    aggs = [
        F.sum("n").alias("alignment_count"),
        F.count("*").cast("int").alias("unique_transcript_count"),
        F.max_by("ref_name", F.struct("n", (-F.col("first")).alias("f"))).alias("max_transcript"),
        F.max("n").alias("max_count"),
    ]
    if lists:
        aggs.append(F.collect_list(F.struct("first", "ref_name", "ords")).alias("seen"))
    out = counts.groupBy("read_id").agg(*aggs)
    out = out.withColumns({"is_uniquely_mapped": F.col("unique_transcript_count") == 1, "max_ratio": F.col("max_count") / F.col("alignment_count")})
    if lists:
        order = F.flatten(F.transform("seen", lambda s: F.transform(s["ords"], lambda o: F.struct(o.alias("o"), s["ref_name"].alias("r")))))
        out = out.withColumns(
            {
                "unique_transcripts": F.transform(F.array_sort("seen"), lambda s: s["ref_name"]),
                "all_transcripts": F.transform(F.array_sort(order), lambda s: s["r"]),
            }
        ).drop("seen")
    return out


FOLDED = "read_id string, alignment_count long, unique_transcript_count int, is_uniquely_mapped boolean, max_transcript string, max_count long, max_ratio double"


def fold_reads(alignments: DataFrame, min_length: int = 0) -> DataFrame:
    """read_stats() without lists, of a frame in which the records of a read follow each other within
    one partition (as read_bam(..., whole_reads=True) gives them): one pass over each partition
    that holds one read at a time, and no shuffle."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("read_id", pa.string()), ("alignment_count", pa.int64()), ("unique_transcript_count", pa.int32()), ("is_uniquely_mapped", pa.bool_()), ("max_transcript", pa.string()), ("max_count", pa.int64()), ("max_ratio", pa.float64())])
        name, counts, out = None, {}, []

        def ended():
            if counts:
                most, total = max(counts.values()), sum(counts.values())
                # the references are in the order in which they were seen
                out.append((name, total, len(counts), len(counts) == 1, next(r for r, n in counts.items() if n == most), most, most / total))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for part in batches:
            for read, ref in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if read != name:
                    ended()
                    name, counts = read, {}
                counts[ref] = counts.get(ref, 0) + 1
            if len(out) >= 10_000:
                yield batch()
                out = []
        ended()
        if out:
            yield batch()

    return mapped(alignments, min_length).select("read_id", "ref_name").mapInArrow(run, FOLDED)


def dominance_bucket(ratio: str = "max_ratio"):
    r = F.col(ratio)
    return F.when(r == 1, "=1").when(r >= 0.8, "[0.8,1)").when(r >= 0.5, "[0.5,0.8)").otherwise("(0,0.5)")


def stats_summary(stats: DataFrame, by=()) -> DataFrame:
    """One row of counts, percentages and dominance buckets over all reads, or for each group."""
    r = F.col("max_ratio")
    out = stats.groupBy(*by).agg(
        F.count("*").alias("total_reads"), F.count_if(F.col("alignment_count") == 1).alias("single"), F.count_if(F.col("alignment_count") > 1).alias("multi"),
        F.count_if("is_uniquely_mapped").alias("unique"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_ratio"), F.coalesce(F.min(r), F.lit(0.0)).alias("min_ratio"),
        F.coalesce(F.max(r), F.lit(0.0)).alias("max_ratio"), F.count_if(r == 1).alias("ratio_1"), F.count_if((r >= 0.8) & (r < 1)).alias("ratio_08"),
        F.count_if((r >= 0.5) & (r < 0.8)).alias("ratio_05"), F.count_if((r > 0) & (r < 0.5)).alias("ratio_low"),
    )
    return out.withColumns({f"{c}_percent": percent(c, "total_reads") for c in ("single", "multi", "unique")})


def ratio_percentiles(stats: DataFrame, ratio: str = "max_ratio") -> DataFrame:
    """One row: mean, median, population deviation, range and percentiles of the ratio,
    interpolated linearly; zeros where there are no reads. The percentiles' buffer has one
    entry for each ratio that occurs: quotients of the small numbers of a read's alignments,
    whose variety doesn't grow with the reads."""
    points = (10, 25, 50, 75, 90, 95, 99)
    r = F.col(ratio)
    out = stats.agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.median(r).alias("median"), F.stddev_pop(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"),
        F.percentile(r, [p / 100 for p in points]).alias("__p"),
    )
    out = out.withColumns({f"p{p}": F.get("__p", F.lit(i)) for i, p in enumerate(points)}).drop("__p")
    return out.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns if c != "n"])


def alignment_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("alignment_count").agg(F.count("*").alias("n"))


def top_counts(histogram: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent alignment counts; ties go to the smaller count."""
    return histogram.orderBy(F.desc("n"), "alignment_count").limit(k)


def unique_primary(alignments: DataFrame, stats: DataFrame) -> DataFrame:
    """Primary alignments of reads that map to one transcript."""
    return primary(alignments).join(stats.where("unique_transcript_count = 1").select("read_id"), "read_id", "left_semi")


def ecdf(stats: DataFrame, value: str = "max_ratio") -> DataFrame:
    """(value, percent): ranks of sorted values as percent of all. The rank of a value's
    last row is a running sum over its distinct values, in ranges of them."""
    ranked = ranks.running(ranks.distinct_counts(stats, value), value)
    return ranked.select(F.col(value).alias("value"), "n", (F.col("upto") * F.lit(100.0) / F.col("whole")).alias("percent"))


def histogram(df: DataFrame, value: str, bins: int = 50, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n): equal-width bins of which the last one is closed on the right. Without
    low and high the range is that of the data."""
    x = F.col(value)
    if low is None or high is None:
        df = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("__low"), F.max(x).alias("__high"))))
        lo, hi = F.col("__low"), F.col("__high")
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    at = F.least(F.floor(F.try_divide((x - lo) * bins, hi - lo)).cast("int"), F.lit(bins - 1))
    return df.where(x.between(lo, hi)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def box_by_bucket(stats: DataFrame) -> DataFrame:
    """Box-plot figures of alignment counts by dominance bucket; the percentiles hold one entry
    for each count that occurs."""
    c = F.col("alignment_count")
    out = stats.groupBy(dominance_bucket().alias("bucket")).agg(F.count("*").alias("n"), F.min(c).alias("min"), F.percentile(c, [0.25, 0.5, 0.75]).alias("q"), F.max(c).alias("max"))
    return out.select("bucket", "n", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(("q1", "median", "q3"))], "max")


def name_order_probe(alignments: DataFrame, sample: int = 10_000) -> DataFrame:
    """One row: records looked at, changes of the read name, and whether more than half
    of more than 100 records changed it. The limit is part of the diagnostic."""
    head = alignments.orderBy("ord").limit(sample)
    before = F.lag("read_id").over(W.orderBy("ord"))
    out = head.select((before.isNull() | (before != F.col("read_id"))).alias("new")).agg(F.count("*").alias("checked"), F.count_if("new").alias("changes"))
    return out.withColumn("looks_sorted", (F.col("checked") > 100) & (F.col("changes") > 0.5 * F.col("checked")))
