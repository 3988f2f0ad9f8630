"""Stateful streams over several batches, and the state that they keep."""

import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import reads
from nucleoframe.streaming import online

COLUMNS = ["read_id", "alignment_count", "unique_transcript_count", "is_uniquely_mapped", "max_transcript", "max_count", "max_ratio"]


@pytest.fixture(scope="module")
def sorted_reads(spark):
    """Alignments of 200 reads, one after the other, a second apart."""
    rng, rows = random.Random(4), []
    for r in range(200):
        rows += [(len(rows) + k, f"r{r:03d}", 0, rng.choice(["A", "B", "C", None]), rng.choice((5, 30))) for k in range(rng.randint(1, 6))]
    return spark.createDataFrame(rows, "ord long, read_id string, flag int, ref_name string, ref_length int")


def batches(spark, df, build, path, n=5):
    """The output of a query that is run after each part of the frame, and the rows of state after each."""
    timed = df.withColumn("at", F.timestamp_seconds(F.col("ord") + 86_400))
    most = df.agg(F.max("ord")).first()[0]
    state = []
    for k in range(n + 2):
        if k < n:
            part = timed.where((F.col("ord") >= k * most // n) & (F.col("ord") < ((k + 1) * most // n if k < n - 1 else most + 1)))
        else:  # time goes on
            part = timed.limit(1).select(F.lit(10**6 * (k + 1)).cast("long").alias("ord"), F.lit("end").alias("read_id"), "flag", F.lit("A").alias("ref_name"), F.lit(30).alias("ref_length")).withColumn("at", F.timestamp_seconds(F.col("ord") + 86_400))
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = build(spark.readStream.schema(timed.schema).parquet(f"{path}/in"))
        run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        state.append(max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in run.recentProgress[-1:]))
    return spark.read.parquet(f"{path}/out"), state


def test_reads_leave_the_state(spark, sorted_reads, tmp_path):
    provider = spark.conf.get(online.STATE_STORE[0])
    out, state = batches(spark, sorted_reads, lambda s: online.online_reads(s, "at", min_length=10, gap_ms=6000), str(tmp_path))
    want = reads.read_stats(sorted_reads, 10, lists=False).select(*COLUMNS)
    assert sorted(map(tuple, out.where("read_id != 'end'").select(*COLUMNS).collect())) == sorted(map(tuple, want.collect()))
    assert max(state) < 40, state  # value and timer of the reads of a few seconds, not of 200
    spark.conf.set(online.STATE_STORE[0], provider)


def test_summary_of_a_window(spark, sorted_reads, tmp_path):
    out, state = batches(spark, sorted_reads, lambda s: online.online_summary(s, "at", min_length=10, delay="1 second", window="10 days"), str(tmp_path))
    want = reads.stats_summary(reads.read_stats(sorted_reads, 10, lists=False)).first().asDict()
    (got,) = out.where("window.start < timestamp'1970-01-09'").collect()
    got = got.asDict()
    assert all(got[k] == pytest.approx(v) for k, v in want.items()) and state[-1] < 5, state


def late_lines(spark, path):
    """A lineitem table whose alignments lie in more than 1000 days of a second each."""
    rows = [(o, 1 + o % 7, s, n, float(5 + n)) for o in (1, 5_000_000, 9_000_000, 20_000_000) for n, s in ((1, 3), (2, 4))]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    df.repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_the_window_of_the_summary_holds_all_reads(spark, tmp_path):
    from nucleoframe.plans import filequeries

    provider = spark.conf.get(online.STATE_STORE[0], None)
    (got,) = filequeries.streamed_summary(spark, late_lines(spark, tmp_path)).collect()
    assert got.total_reads == 4 and got["unique"] == 0 and got.mean_ratio == 0.5
    if provider is not None:
        spark.conf.set(online.STATE_STORE[0], provider)


def test_files_of_a_stream_are_as_many_as_the_input_needs(spark, tmp_path):
    from nucleoframe.plans import filequeries

    df = spark.read.parquet(f"{late_lines(spark, tmp_path)}/lineitem.parquet")
    assert filequeries.sized(df) == 1 and filequeries.sized(df, each=1000) > 1


def test_reads_are_held_by_spark(spark, sorted_reads, tmp_path):
    """No row of state goes through Python, and a read whose alignments are a delay apart is one."""
    provider = spark.conf.get(online.STATE_STORE[0])
    sorted_reads.withColumn("at", F.timestamp_seconds(F.col("ord") * 30)).write.parquet(f"{tmp_path}/seen")
    shown = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/seen").schema).parquet(f"{tmp_path}/seen")
    found = online.online_reads(shown, "at", delay="3 minutes")
    assert "Pandas" not in found._jdf.queryExecution().analyzed().toString()
    out, _ = batches(spark, sorted_reads, lambda s: online.online_reads(s, "at", delay="6 seconds"), str(tmp_path))
    want = reads.read_stats(sorted_reads, 0, lists=False).select(*COLUMNS)
    assert sorted(map(tuple, out.where("read_id != 'end'").select(*COLUMNS).collect())) == sorted(map(tuple, want.collect()))
    spark.conf.set(online.STATE_STORE[0], provider)
