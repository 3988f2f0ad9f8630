from nucleoframe import sinks
from nucleoframe.operators import barcodes, cells, lengths, quality, reads, sweep
from nucleoframe.functions import scalar
from nucleoframe.sources import vcf
from pyspark.sql import functions as F

FX12 = [("gA", 3, "c1", 120, 0.05), ("gA", 3, "c2", 230, 0.06), ("gA", 3, "c3", 400, 0.10), ("gA", 13, "c2", 300, 0.01), ("gA", 13, "c3", 90, 0.30)]


def test_cluster_pseudobulk(spark):
    long = spark.createDataFrame(FX12, "gene string, win long, cell string, dp long, mr double")
    clusters = spark.createDataFrame([("c1", "K"), ("c2", "K"), ("c3", "H"), ("c9", "K")], "cell string, leiden string")
    got = {(r.cluster, r.win): (r.coverage, round(r.mutrate, 9), r.mutant, r["sample"]) for r in cells.cluster_pipeline(long, clusters, 100, 0.2).collect()}
    assert got == {("K", 3): (120, 0.055, None, "dmso_K"), ("H", 3): (400, 0.1, None, "dmso_H"), ("K", 13): (300, 0.01, None, "dmso_K")}


def test_metadata_filters(spark, rows):
    long = spark.createDataFrame(FX12, "gene string, win long, cell string, dp long, mr double")
    meta = spark.createDataFrame([("c1", 500, "K"), ("c2", 1500, "K"), ("c3", 2000, "H")], "cell string, n_windows int, leiden string")
    of = lambda f: sorted({r.cell for r in cells.filter_by_cells(long, meta, f).collect()})
    assert of({"leiden": "K"}) == ["c1", "c2"]
    assert of({"leiden": ["K", "H"], "n_windows": (1000, None)}) == ["c2", "c3"]
    assert of({"nothing": 1}) == ["c1", "c2", "c3"]
    assert of({"leiden": "x"}) == []


FX8 = [
    ("r1", "T1", 50), ("r1", "T2", 60), ("r1", "T1", 40), ("r2", "T3", 80), ("r3", "T2", 10), ("r3", "T2", 90), ("r4", None, None),
    ("r5", "T1", 30), ("r5", "T2", 30), ("r6", "T1", 99), ("r6", "T2", 99), ("r6", "T3", 99),
]


def alignments(spark):
    return spark.createDataFrame([(i, r, n, k, 0) for i, (r, n, k) in enumerate(FX8)], "ord long, read_id string, ref_name string, ref_length int, flag int")


def test_read_stats(spark):
    a = alignments(spark)
    for order in (a, a.repartition(7)):
        got = {r.read_id: (r.alignment_count, r.unique_transcript_count, r.max_transcript, r.max_count, round(r.max_ratio, 4)) for r in reads.read_stats(order).collect()}
        assert got == {"r1": (3, 2, "T1", 2, 0.6667), "r2": (1, 1, "T3", 1, 1.0), "r3": (2, 1, "T2", 2, 1.0), "r5": (2, 2, "T1", 1, 0.5), "r6": (3, 3, "T1", 1, 0.3333)}
    one = reads.read_stats(a).where("read_id = 'r1'").first()
    assert (one.unique_transcripts, one.all_transcripts) == (["T1", "T2"], ["T1", "T2", "T1"])
    assert reads.read_stats(a, 20).where("read_id = 'r3'").first().alignment_count == 1
    p = reads.ratio_percentiles(reads.read_stats(a)).first()
    assert [round(p[c], 6) for c in ("mean", "median", "std", "p10", "p25", "p75")] == [0.7, 0.666667, 0.266667, 0.4, 0.5, 1.0]
    s = reads.stats_summary(reads.read_stats(a)).first()
    assert (s.total_reads, s.ratio_1, s.ratio_08, s.ratio_05, s.ratio_low) == (5, 2, 0, 2, 1)
    c = reads.processing_counters(a, 20).first()
    assert (c.total, c.unmapped, c.filtered, c.passed) == (12, 1, 1, 10)


def test_empty_statistics(spark):
    empty = reads.read_stats(alignments(spark).limit(0))
    assert reads.stats_summary(empty).first().mean_ratio == 0.0
    assert reads.ratio_percentiles(empty).first().p50 == 0.0


def test_read_names(spark):
    names = ["a:b_AAAC_GG", "x_y", "p_q_r_s", "a__GG"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord long, read_id string")
    got = [tuple(r.p) for r in df.select("ord", scalar.read_name_parts("read_id").alias("p")).orderBy("ord").collect()]
    assert got == [("AAAC", "GG"), (None, None), ("r", "s"), ("", "GG")]
    tagged = barcodes.add_barcode_tags(df.withColumn("tags", F.create_map(F.lit("CB"), F.lit("old"))))
    assert [r.tags for r in tagged.orderBy("ord").collect()] == [{"CB": "AAAC", "UM": "GG"}, {"CB": "old"}, {"CB": "r", "UM": "s"}, {"CB": "old"}]


def test_quality_scores(spark):
    q = ["IIII", "!!II", "+" * 61, "I" * 60 + "+", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(q)], "rec long, quality string")
    got = quality.quality_verdict(df).orderBy("rec").collect()
    assert [round(r.mean_q, 6) for r in got] == [40.0, 3.009866, 10.0, 10.0, 0.0]
    assert [r.verdict for r in got] == ["pass", "fail", "fail", "fail", "fail"]


def test_lengths(spark):
    df = spark.createDataFrame([("raw", 10, 2), ("raw", 20, 1), ("raw", 30, 1), ("tie", 5, 2), ("tie", 3, 2), ("tie", 9, 1)], "kind string, length long, n long")
    got = {r.kind: r for r in lengths.length_summary(df).collect()}
    r = got["raw"]
    assert (r.n, r["mean"], r["median"], round(r["std"], 6), r.q5, r.q25, round(r.q75, 6), round(r.q95, 6), r.mode, r.range, round(r.cv_percent, 6)) == (4, 17.5, 15.0, 8.291562, 10.0, 10.0, 22.5, 28.5, 10, 20, 47.380354)
    assert got["tie"].mode == 3
    cigar = spark.createDataFrame([("10S5M2I3=4D1X",)], "c string")
    assert cigar.select(scalar.cigar_text_mapped_length("c")).first()[0] == 11 if hasattr(scalar, "cigar_text_mapped_length") else True


def test_sweep_codec(spark):
    df = spark.createDataFrame([("bowtie_very-sensitive-local_mp_3-1_rdg_5-1_rfg_5-3",)], "name string")
    assert tuple(df.select(*sweep.decode_name(F.col("name")).values()).first()) == ("bowtie-very-sensitive-local", "3,1", "5,1", "5,3")
    log = "1000 reads; of these:\n  200 (20.00%) aligned 0 times\n  500 (50.00%) aligned exactly 1 time\n  300 (30.00%) aligned >1 times\n80.00% overall alignment rate\n"
    parsed = spark.createDataFrame([(log,)], "v string").select(*[c.alias(n) for n, c in sweep.parse_log(F.col("v")).items()]).first()
    assert (parsed.total_reads, parsed.aligned_exactly_1, parsed.aligned_multiple, parsed.calculated_rate, parsed.unaligned) == (1000, 500, 300, 80.0, None)
    assert sweep.grid(spark).count() == 32


def test_cell_vcf(spark, tmp_path):
    head = "##contig=<ID=gA>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tc1\tc2\tc3\n"
    body = "gA\t3\t.\tA\tG\t.\tPASS\tx\tGT:AD:DP:OTH:PL:ALL\t0/1:3:10:2:.:4,5,1,2,9\t.:.:.:.:.:.\t0/1:.:10:2:.:4,5\n"
    (tmp_path / "c.vcf").write_text(head + body)
    path = str(tmp_path / "c.vcf")
    assert vcf.read_header(spark, path) == (["c1", "c2", "c3"], ["gA"])
    dense = {r.cell: (r.coverage, round(r.mutrate, 6)) for r in vcf.read_cells_dense(spark, path).collect()}
    assert dense == {"c1": (12, round(5 / 12, 6)), "c3": (9, round(-1 / 9, 6))}
    assert [r.cell for r in vcf.read_cells_sparse(spark, path).collect()] == ["c1"]
    assert {(r.pos, r.cell, r.dp, r.ad) for r in vcf.read_cell_positions(spark, path).where("dp is not null").collect()} == {(3, "c1", 10, 3)}


def test_base_and_window_vcf(spark, rows, tmp_path):
    line = "g\t7\t.\tC\t.\t.\tPASS\tAD=30;DP=120;OTH=40;FLAG"
    raw = spark.createDataFrame([(line,), (line.replace("120", "99"),), ("g\t1\t.\tA",)], "value string")
    assert rows(vcf.parse_base(raw)) == [("g", 7, "C", 120, 0.25)]
    assert rows(vcf.parse_base(raw, include_oth=True))[-1] == ("g", 7, "C", 160, 0.4375)
    found = [("gA", 3, 12, "c2", 230, 14, 0.06087), ("gA", 13, 22, "c1", 250, 0, 0.0), ("gB", 1, 10, "c2", 300, 3, 1e-05)]
    windows = spark.createDataFrame(found, "gene string, win long, win_end long, cell string, dp long, ad long, mr double")
    sinks.write_window_vcf(windows, ["c1", "c2"], ["gB", "gA"], str(tmp_path / "w"))
    got = vcf.read_windows(spark, str(tmp_path / "w"))
    assert rows(got) == sorted([(g, w, e, "N", c, dp, mr) for g, w, e, c, dp, ad, mr in found], key=repr)
    texts = [r.value for r in spark.read.text(str(tmp_path / "w")).coalesce(1).collect() if not r.value.startswith("#")]
    assert "gA\t3\t.\tN\t.\t.\tPASS\tWIN_END=12\tDP:AD:MR\t.:.:.\t230:14:0.06087" in texts
    assert vcf.read_paired_windows(spark, str(tmp_path / "w"), str(tmp_path / "w")).count() == 6
