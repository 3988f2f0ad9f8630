"""Readers and sinks over real files, text reports, and streams."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from nucleoframe import sinks
from nucleoframe.functions import scalar
from nucleoframe.operators import correlation, mutrate, quality, reactivity, sweep
from nucleoframe.sources import blocktext, fastq, files, text, vcf
from nucleoframe.streaming import online


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """Files of several blocks, with carriage returns, and one that is compressed."""
    rng, want = random.Random(3), {}
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.txt", "c.txt.gz"):
        lines = [f"{i} " + "x" * rng.randrange(40) for i in range(900)]
        want[name] = lines
        data = "".join(x + ("\r\n" if name == "b.txt" else "\n") for x in lines).encode()
        (tmp_path / "in" / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = text.numbered_lines(spark, str(tmp_path / "in"))
        got = {}
        for r in df.withColumn("name", F.element_at(F.split("file", "/"), -1)).orderBy("name", "ord").collect():
            got.setdefault(r.name, []).append((r.ord, r.value))
        assert df.select("block").distinct().count() > 5
        assert {n: [v for _, v in rows] for n, rows in got.items()} == want
        assert all([o for o, _ in rows] == list(range(900)) for rows in got.values())
        fasta = "".join(f">t{i} text\n" + "ACGT\n" * (i % 9) for i in range(700))
        (tmp_path / "f.fa").write_text(fasta)
        assert {r.name: r.length for r in text.read_fasta_lengths(spark, str(tmp_path / "f.fa")).collect()} == {f"t{i}": 4 * (i % 9) for i in range(700)}
        whole = "".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(500)) + "\n@late\nA\n+\nI\n"
        (tmp_path / "r.fastq").write_text(whole)
        assert [r.header for r in fastq.read_fastq(spark, str(tmp_path / "r.fastq")).orderBy("rec").collect()] == [f"@r{i}" for i in range(500)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_are_read_from_the_beginning(spark, tmp_path):
    contigs = [f"g{i}" for i in range(3000)]
    head = "".join(f"##contig=<ID={c},length=9>\n" for c in contigs) + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n" + head + "g1\t1\t.\tA\n" * 9)
    assert vcf.read_header(spark, str(tmp_path / "x.vcf"), first=100) == (["a", "b"], contigs)
    (tmp_path / "y.vcf").write_text("##fileformat=VCFv4.2\n")
    assert vcf.read_header(spark, str(tmp_path / "y.vcf")) == ([], [])


def test_regions_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(g, p, "A", "c", 0, p, 1) for g in ("g1", "g2", "g3") for p in range(50)], "gene string, pos long, ref string, cell string, cell_idx int, dp int, ad int")
    vcf.store_by_gene(df, str(tmp_path / "store"))
    found = vcf.read_region(spark, str(tmp_path / "store"), "g2", 10, 19)
    assert sorted(r.pos for r in found.collect()) == list(range(10, 20)) and {r.gene for r in found.collect()} == {"g2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gene" in plan and "PushedFilters: [IsNotNull(pos), GreaterThanOrEqual(pos,10), LessThanOrEqual(pos,19)]" in plan
    assert vcf.read_region(spark, str(tmp_path / "store"), "none").count() == 0


def test_many_genes_share_folders(spark, tmp_path):
    """A store of more genes than folders has a bounded number of them, and the same regions."""
    df = spark.createDataFrame([(f"g{g}", p, "A", "c", 0, p, g) for g in range(300) for p in range(4)], "gene string, pos long, ref string, cell string, cell_idx int, dp int, ad int")
    store = str(tmp_path / "store")
    vcf.store_by_gene(df, store, folders=20)
    assert 1 < len(files.matching(spark, f"{store}/*=*")) <= vcf.GROUPS
    for g in (0, 7, 299):
        assert sorted((r.gene, r.pos, r.ad) for r in vcf.read_region(spark, store, f"g{g}", 1, 2).collect()) == [(f"g{g}", 1, g), (f"g{g}", 2, g)]
    plan = vcf.read_region(spark, store, "g7", 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gene_group" in plan and "EqualTo(gene,g7)" in plan
    assert vcf.read_region(spark, store, "none").count() == 0


def test_header_in_a_folder_of_parts(spark, tmp_path):
    """The header is in the first files by name, also where a later one is larger and the header goes over two."""
    (tmp_path / "part-0").write_text("##fileformat=VCFv4.2\n##contig=<ID=g1>\n")
    (tmp_path / "part-1").write_text("##contig=<ID=g2>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n")
    (tmp_path / "part-2").write_text("g1\t1\t.\tA\n" * 5000)
    (tmp_path / "_SUCCESS").write_text("")
    assert vcf.read_header(spark, str(tmp_path)) == (["a", "b"], ["g1", "g2"])


def test_marks_of_parts_hold_their_own_names(spark, tmp_path):
    """Of 20,000 listed names a part's index has those of its range; the plan doesn't list names."""
    names = [f"g{i}" for i in range(20_000)]
    df = spark.createDataFrame([(names[i * 7], 5 + i % 3, 1, f"{names[i * 7]}\t{5 + i % 3}\tx") for i in range(2500)], "name string, pos long, ref_length long, value string")
    path = str(tmp_path / "x.gz")
    assert blocktext.write_indexed_text(df, path, names, ["#h"]) == 2500
    assert [r.value for r in blocktext.read_indexed_text(spark, path).where("name = 'g7007'").collect()] == ["g7007\t7\tx"]
    lines = blocktext.read_block_text(spark, path).orderBy("ord").collect()
    assert [r.value.split("\t")[0] for r in lines[1:]] == names[:17_500:7]
    assert "g7007" not in blocktext.placed(df, names, "name").select("place")._jdf.queryExecution().analyzed().toString()


def test_dots_are_missing_numbers(spark):
    """A dot isn't cast, which would make an exception for each."""
    one = spark.createDataFrame([(".", "7", "x", " 8")], "a string, b string, c string, d string")
    assert tuple(one.select(*[scalar.safe_int(c) for c in "abcd"]).first()) == (None, 7, None, 8)
    assert "CASE WHEN" in str(scalar.safe_int("a"))


def test_normalized_coverage_is_rounded_once(spark):
    """1.499996 millionths are 1 of them; by way of eight places they would be 1.5, and so 2."""
    positions = spark.createDataFrame([("g", 1, 1499996)], "gene string, pos long, depth long")
    genes = spark.createDataFrame([("g", 5, 1)], "gene string, reads long, total_reads long")
    whole = mutrate.with_gene_counts(positions, genes.withColumn("total_reads", F.lit(10**18)), digits=None).select(scalar.round_like_numpy("normalized_cov", 6)).first()[0]
    assert whole == 1e-6
    assert mutrate.with_gene_counts(positions, genes.withColumn("total_reads", F.lit(10**18))).first().normalized_cov == 1.5e-6


def test_mutation_detail(spark):
    """Kinds whose sum is 0 aren't listed, and repeated letters add up."""
    raw = spark.createDataFrame([("g 5 a 100 A:60:1 C:10:1 A:20:2 +A:0:0 -AC:3:1 +ACGTA:2:1",), ("g 6 c 0 C:0:0",)], "value string")
    one, two = mutrate.mutation_rates(text.parse_counts(raw)).orderBy("pos").collect()
    assert one.detail == "A:60;C:10;A:20;-:3;+++:2" and (one.coverage, one.adj_coverage, one.mutant) == (102, 100, 20)
    assert two.detail == "C:0" and two.mutrate is None


def test_window_files_are_kept_and_bad_ones_skipped(spark, tmp_path):
    with gzip.open(tmp_path / "good_counts_mutrate.10nt.csv.gz", "wt") as f:
        f.write("gene\twin\tcoverage\tmutant\tmutrate\twin_end\ng\t1\t300\t3\t0.01\t10\n")
    (tmp_path / "bad_counts_mutrate.10nt.csv.gz").write_bytes(b"no gzip at all")
    got = text.read_window_files(spark, str(tmp_path), keep=str(tmp_path / "kept"))
    assert [(r["gene"], r["sample"]) for r in got.collect()] == [("g", "good")]
    assert spark.read.option("header", True).csv(str(tmp_path / "kept"), sep="\t").count() == 1


def test_reports(spark, tmp_path, capsys):
    assert [sinks.human_bytes(n) for n in (5, 2048, 3 << 20, 5 << 40)] == ["5 B", "2.00 KB", "3.00 MB", "5.00 TB"]
    rows = spark.createDataFrame([("DMSO", "pass", 2048, 8), ("DMSO", "fail", 100, 4), ("2A3", "pass", 10, 0)], "condition string, verdict string, n_bytes long, n_lines long")
    said = sinks.sequencing_report(quality.condition_stats(rows))
    assert said.startswith("2A3\n---\npass: 10 B, 0 reads") and "pass rate: N/A" in said and "DMSO\n----\npass: 2.00 KB, 2 reads\nfail: 100 B, 1 reads" in said and said.rstrip().endswith("66.66%")
    runs = spark.createDataFrame([("d1", "s", "a", "m", "x", "y", 80.0, 1.0, 2.0), ("d2", "s", "b", "m", "x", "y", 90.0, None, 2.0)], "directory string, stem string, sensitivity string, mp string, rdg string, rfg string, overall_rate double, exact_rate double, multiple_rate double")
    groups = sweep.group_stats(runs)
    assert {r.metric for r in groups.where("parameter = 'mp'").collect()} == {"overall_rate"} and groups.where("parameter = 'rdg'").count() == 3
    said = sinks.sweep_text(sweep.metric_summary(runs), groups, sweep.best_run(runs))
    assert "Best run: d2/s (90.00%)" in said and "sensitivity  a      overall_rate" in said
    assert [r.directory for r in sweep.ranked_runs(runs).collect()] == ["d2", "d1"]
    assert sweep.pivot_mean(runs, "rdg", "rfg", "overall_rate").first().asDict() == {"rdg": "x", "y": 85.0}
    (tmp_path / "r.txt").write_text(said)
    assert sinks.head_text(str(tmp_path / "r.txt"), 1) == "Metrics\n"
    sinks.print_tsv(spark.createDataFrame([("g", 1, None)], "a string, b int, c int"))
    assert capsys.readouterr().out == "g\t1\tNA\n"


def test_split_and_merged_fastq(spark, tmp_path):
    records = [("f", i, f"@r{i}", "AC", "+", "II" if i % 3 else "!!", ) for i in range(30)]
    df = spark.createDataFrame(records, "file string, rec long, header string, sequence string, plus string, quality string")
    sinks.write_fastq_split(quality.quality_verdict(df), str(tmp_path / "split"))
    for verdict, n in (("pass", 20), ("fail", 10)):
        lines = spark.read.text(str(tmp_path / f"split/verdict={verdict}"))
        assert lines.count() == 4 * n
        files.write_single(lines, str(tmp_path / "in/2A3"), f"x_{verdict}.fastq.gz", "gzip")
    found = text.find_fastq(spark, str(tmp_path / "in"))
    assert sorted((r.condition, r.verdict) for r in found.collect()) == [("2A3", "fail"), ("2A3", "pass")]
    sinks.merge_by_condition(spark, found, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/condition=2A3/verdict=pass")).count() == 80


def test_several_columns_are_normalized(spark):
    rng = random.Random(5)
    data = [(f"g{i % 2}", i, rng.random(), float(rng.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(data, "gene string, pos long, a double, b double")
    both = reactivity.normalize_by_gene(df, keys=("pos",))
    assert both.columns == ["gene", "pos", "a", "b", "a_normalized", "b_normalized"]
    for c in ("a", "b"):
        one = {r.pos: r.normalized_reactivity for r in reactivity.normalize_by_gene(df.select("gene", "pos", c), [c]).collect()}
        assert {r.pos: r[f"{c}_normalized"] for r in both.collect()} == pytest.approx(one)
    assert correlation.numeric_columns(df) == ["pos", "a", "b"] and correlation.pairwise(df).count() == 6


def run(stream, mode: str, name: str, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()


def test_streamed_fastq(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fastq").write_text("@a\nAC\n+\nII\n@b\nA\n+\n!\n")
    (tmp_path / "in/b.fastq").write_text("@c\nAC\n+\nII\n\n@late\nA\n+\n!\n")
    raw = spark.readStream.text(str(tmp_path / "in"), wholetext=True)
    run(online.streamed_verdicts(online.streamed_fastq(raw)), "append", "framed", tmp_path)
    assert sorted((r.rec, r.header, r.quality, r.verdict) for r in spark.table("framed").collect()) == [(0, "@a", "II", "pass"), (0, "@c", "II", "pass"), (1, "@b", "!", "fail")]


def test_state_behind_the_watermark_is_dropped(spark, tmp_path):
    schema = "read_id string, ref_name string, ref_length int, at timestamp"
    batches = [[("r1", "T1", 9, "2024-01-01 00:01:00"), ("r1", "T2", 9, "2024-01-01 00:02:00"), ("r1", "T1", 9, "2024-01-01 00:03:00")], [("r2", "T1", 9, "2024-01-01 05:00:00")], [("r1", "T9", 9, "2024-01-01 00:04:00")]]
    cast = [F.col("read_id"), F.col("ref_name"), F.col("ref_length"), F.col("at").cast("timestamp").alias("at")]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).select(*cast).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = online.online_alignment_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), time="at")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.read_id, r.alignment_count, r.transcripts) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("r1", 3, 2)]  # the late alignment of a closed window counts no more
