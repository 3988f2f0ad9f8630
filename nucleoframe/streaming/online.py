"""The stream-like operators as Structured Streaming.

Row-wise operators (mutation rates, position filter, FASTQ framing, read quality) are
stateless and run on a stream as they are. Statistics over reads keep state; with an event
time and a watermark it is bounded, without one it grows with the reads. online_reads() needs
the state store that it sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mutrate, quality
from ..operators import reads as reads_operators
from ..sources import text


def streamed_mutation_rates(raw: DataFrame, **how) -> DataFrame:
    """Mutation rates of a stream of count lines."""
    return mutrate.mutation_rates(text.parse_counts(raw), **how)


def streamed_verdicts(fastq: DataFrame, least: float = 10.0) -> DataFrame:
    """Verdicts of a stream of FASTQ records."""
    return quality.quality_verdict(fastq, least)


def streamed_fastq(raw: DataFrame) -> DataFrame:
    """FASTQ records of a stream of whole files (readStream.text with wholetext): framed in
    their row, without state; records after the first empty header go."""
    lines = F.split("value", "\r?\n")
    at = lambda k, i: F.coalesce(F.get(F.col("lines"), k * 4 + i), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("lines") / 4).cast("int") - 1, F.lit(0)))
    ended = F.filter(starts, lambda k: at(k, 0) == "")
    kept = F.filter(starts, lambda k: F.coalesce(k < F.get(ended, F.lit(0)), F.lit(True)))
    fields = ("header", "sequence", "plus", "quality")
    cut = F.transform(kept, lambda k: F.struct(k.cast("long").alias("rec"), *[at(k, i).alias(n) for i, n in enumerate(fields)]))
    return raw.select(F.col("_metadata.file_path").alias("file"), lines.alias("lines")).select("file", F.explode(cut).alias("r")).select("file", "r.*")


def online_alignment_counts(alignments: DataFrame, min_length: int = 0, time: str | None = None, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Running number of alignments and transcripts per read. With `time`, a column of event
    times, counts are those of a window, and the state of windows that the watermark has
    passed is dropped."""
    kept = alignments.where(F.col("ref_name").isNotNull() & (F.coalesce("ref_length", F.lit(0)) >= min_length))
    keys = ["read_id"]
    if time is not None:
        kept, keys = kept.withWatermark(time, delay), [F.window(time, window).alias("window"), "read_id"]
    return kept.groupBy(*keys).agg(F.count("*").alias("alignment_count"), F.size(F.collect_set("ref_name")).alias("transcripts"))


def online_counters(alignments: DataFrame, min_length: int = 0) -> DataFrame:
    """Running totals: all, unmapped, too short (one row, complete mode)."""
    unmapped = F.col("ref_name").isNull()
    short = ~unmapped & (F.coalesce("ref_length", F.lit(0)) < min_length)
    return alignments.groupBy().agg(F.count("*").alias("total"), F.count_if(unmapped).alias("unmapped"), F.count_if(short).alias("filtered"))


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def online_reads(alignments: DataFrame, time: str, min_length: int = 0, delay: str = "0 seconds", gap_ms: int = 0) -> DataFrame:
    """Statistics of each read of a stream, given once, when the watermark (the newest `time` less
    `delay`) is `gap_ms` and `delay` behind the read's last alignment; its state is then dropped. In a
    stream sorted by name the times of a read's alignments lie together, so no more reads are
    held than the delay and the gap reach over; alignments further apart than that are another
    read. `at` is the read's last time. A read is a session of Spark's, so no row of state and no
    timer goes through Python."""
    alignments.sparkSession.conf.set(*STATE_STORE)
    kept = reads_operators.mapped(alignments, min_length).select("read_id", "ref_name", "ord", F.col(time).alias("at")).withWatermark("at", delay)
    gap = f"{delay} {max(gap_ms, 1)} milliseconds"  # units of an interval add up
    held = kept.groupBy(F.session_window("at", gap).alias("session"), "read_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ref_name"))).alias("x"), F.max("at").alias("at"))
    # generators, lest each column walks the alignments again
    listed = held.select("read_id", "at", F.explode(F.array(F.transform("x", lambda x: x["ref_name"]))).alias("refs"))
    counts = F.transform(F.array_distinct("refs"), lambda r: F.struct(r.alias("ref"), F.size(F.filter("refs", lambda x: x == r)).cast("long").alias("n")))
    seen = listed.select("read_id", "at", F.size("refs").cast("long").alias("total"), F.explode(F.array(counts)).alias("seen"))
    most = F.array_max(F.transform("seen", lambda s: s["n"]))
    first = F.get(F.filter("seen", lambda s: s["n"] == most), F.lit(0))
    best = seen.select("read_id", "at", "total", F.size("seen").alias("refs"), F.explode(F.array(first)).alias("best"))
    return best.select(
        "read_id", "at", F.col("total").alias("alignment_count"), F.col("refs").alias("unique_transcript_count"), (F.col("refs") == 1).alias("is_uniquely_mapped"),
        F.col("best.ref").alias("max_transcript"), F.col("best.n").alias("max_count"), (F.col("best.n") / F.col("total")).alias("max_ratio"),
    )


def online_summary(alignments: DataFrame, time: str, min_length: int = 0, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """The summary of all reads of each window of time, given once, when the watermark has passed
    the window: one stateful operator gathers the references of each read, the next one
    counts the reads. Both drop their state with the window."""
    kept = reads_operators.mapped(alignments, min_length).withWatermark(time, delay)
    by_read = kept.groupBy(F.window(time, window).alias("window"), "read_id").agg(F.collect_list("ref_name").alias("refs"))
    counts = F.transform(F.array_distinct("refs"), lambda r: F.size(F.filter("refs", lambda x: x == r)))
    read = by_read.select("window", "read_id", F.size("refs").alias("alignment_count"), F.size(counts).alias("unique"), (F.array_max(counts) / F.size("refs")).alias("max_ratio"))
    return reads_operators.stats_summary(read.withColumn("is_uniquely_mapped", F.col("unique") == 1), ["window"])
