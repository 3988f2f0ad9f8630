import gzip
import random

import pytest
from pyspark.sql import functions as F

from nucleoframe.operators import quality, reactivity
from nucleoframe import sinks
from nucleoframe.sources import bam, fastq, text
from nucleoframe.streaming import online

X = [-0.02, 0.0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.2]


def values(df, column):
    return [None if r[column] is None else round(r[column], 6) for r in df.orderBy("pos").collect()]


def test_clip_scale(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(X)], "gene string, pos long, reactivity double")
    assert values(reactivity.clip_scale(df, by=("gene",)), "normalized_reactivity") == [0, 0.076023, 0.134503, 0.192982, 0.251462, 0.368421, 0.54386, 1]
    same = df.withColumn("reactivity", F.lit(0.3))
    assert values(reactivity.clip_scale(same), "normalized_reactivity") == [0.3] * 8


def test_gene_normalization(spark):
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(X)] + [("one", 99, 0.4)], "gene string, pos long, reactivity double")
    got = reactivity.normalize_by_gene(df, ["reactivity"])
    assert values(got.where("gene = 'g'"), "normalized_reactivity") == [-0.25, 0, 0.125, 0.25, 0.375, 0.625, 1, 2.5]
    assert values(got.where("gene = 'one'"), "normalized_reactivity") == [None]


def test_reactivity_join(spark, rows):
    schema = "gene string, pos long, mutrate double, coverage long"
    a = spark.createDataFrame([("g", 1, 0.5, 10), ("g", 2, 0.1, 10), ("g", 3, None, 10), ("g", 4, 0.1, 5)], schema)
    b = spark.createDataFrame([("g", 1, 0.25, 20), ("g", 3, 0.1, 20), ("g", 4, 0.6, 5)], schema)
    got = reactivity.calculate_reactivity(a, b)
    assert rows(got, "pos", "reactivity", "coverage_control") == [(1, 0.25, 20), (4, -0.5, 5)]
    with pytest.raises(ValueError):
        reactivity.normalized_reactivity(a.withColumn("group", F.lit("x")), b.withColumn("group", F.lit("x")), method="other")


def test_winsorize(spark):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(10)], "gene string, pos long, x double")
    assert values(reactivity.winsorize(df, "x", ("gene",), 0.1, 0.2), "x") == [1, 1, 2, 3, 4, 5, 6, 7, 7, 7]
    assert values(reactivity.winsorize(df, "x", (), 0.1, 0.2), "x") == [1, 1, 2, 3, 4, 5, 6, 7, 7, 7]
    rng = random.Random(4)
    data = [rng.choice([None, 1.0, round(rng.gauss(0, 5), 2)]) for _ in range(3000)]
    many = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "pos long, x double")
    known = sorted(x for x in data if x is not None)
    low, high = known[int(0.03 * len(known))], known[len(known) - int(0.07 * len(known)) - 1]
    got = {r.pos: r.x for r in reactivity.winsorize(many, "x", (), 0.03, 0.07).collect()}
    assert got == {i: None if x is None else min(max(x, low), high) for i, x in enumerate(data)}
    assert reactivity.winsorize(many.limit(0), "x", (), 0.03, 0.07).count() == 0


def test_bam_round_trip(spark, rows, tmp_path):
    refs = [("T1", 1000), ("T2", 500)]
    records = [
        {"read_id": "r1", "flag": 16, "ref_name": "T2", "ref_start": 7, "ref_length": 9, "mapq": 42, "cigar": [{"op": 0, "len": 5}, {"op": 2, "len": 4}, {"op": 4, "len": 2}], "seq": "ACGTNAC", "qual": "IIIII!!", "tags": {"CB": "AA", "NM": "-3", "XB": "1,2,300", "XF": "0.5", "XA": "c", "XH": "1AE3"},
         "tag_types": {"CB": "Z", "NM": "c", "XB": "BS", "XF": "f", "XA": "A", "XH": "H"}, "mate_ref_name": "T1", "mate_start": 900, "template_length": -893},
        {"read_id": "r2", "flag": 4, "ref_name": None, "ref_start": None, "ref_length": None, "mapq": 0, "cigar": None, "seq": "AC", "qual": None, "tags": {}, "tag_types": {}, "mate_ref_name": None, "mate_start": None, "template_length": 0},
    ]
    many = [records[0] | {"read_id": f"m{i}"} for i in range(3000)]
    path = str(tmp_path / "x.bam")
    assert bam.write_file(path, "@HD\tVN:1.6\tSO:unsorted\n", refs, records + many) == 3002
    assert bam.sort_order(path) == "unsorted"
    got = bam.read_bam(spark, path)
    assert got.count() == 3002
    one = got.where("read_id = 'r1'").first().asDict(recursive=True)
    assert {k: v for k, v in one.items() if k != "ord"} == records[0]
    assert got.where("ref_name is null").first().qual is None
    assert bam.read_bam(spark, path, columns=["read_id", "flag"]).columns == ["read_id", "flag"]
    # the same records in the same order from many small ranges of bytes
    every = bam.read_bam(spark, path, split=700)
    assert every.rdd.getNumPartitions() > 5
    assert [tuple(r) for r in every.orderBy("ord").collect()] == [tuple(r) for r in got.orderBy("ord").collect()]
    assert [r.read_id for r in every.orderBy("ord").collect()] == ["r1", "r2", *(f"m{i}" for i in range(3000))]
    line = sinks.sam_lines(got.where("read_id = 'r1'")).first().value.split("\t")
    assert line[6:9] == ["T1", "901", "-893"] and line[11:] == ["CB:Z:AA", "NM:i:-3", "XA:A:c", "XB:B:S,1,2,300", "XF:f:0.5", "XH:H:1AE3"]
    header = "@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in refs)
    bam.write_bam(bam.coordinate_sorted(got, header), str(tmp_path / "again"), header)
    parts = sorted(map(str, (tmp_path / "again").glob("*.bam")))
    back = [r for part in parts for r in bam.read_bam(spark, part).collect()]
    assert len(back) == 3002 and back[-1].read_id == "r2" and bam.header_text(parts[0]) == header
    whole = next(r for r in back if r.read_id == "r1").asDict(recursive=True)
    assert {k: v for k, v in whole.items() if k != "ord"} == records[0]
    turned = fastq.alignments_to_fastq(got.where("read_id = 'r1'")).first()
    assert (turned.header, turned.sequence, turned.quality) == ("@r1", "GTNACGT", "!!IIIII")


def test_bam_sink(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    path = str(tmp_path / "x.bam")
    header = "@HD\tVN:1.6\n@SQ\tSN:T1\tLN:100\n"
    record = {"read_id": "r", "flag": 0, "ref_name": "T1", "ref_start": 3, "ref_length": 2, "mapq": 1, "cigar": [{"op": 0, "len": 2}], "seq": "AC", "qual": "II", "tags": {"XT": "T1"}, "tag_types": {"XT": "Z"}, "mate_ref_name": None, "mate_start": None, "template_length": 0}
    bam.write_file(path, header, [("T1", 100)], [record])
    bam.read_bam(spark, path).coalesce(1).write.format("nucleo_bam").option("path", str(tmp_path / "out")).option("header", header).mode("append").save()
    again = bam.read_bam(spark, str(tmp_path / "out/part-00000.bam")).first().asDict(recursive=True)
    assert {k: v for k, v in again.items() if k != "ord"} == record


def test_fastq(spark, rows, tmp_path):
    text_ = "@a\nACGT\n+\nIIII\n@b\nAC\n+\n!!\n"
    with gzip.open(tmp_path / "x_pass.fastq.gz", "wt") as f:
        f.write(text_)
    spark.dataSource.register(fastq.FastqSource)
    got = spark.read.format("nucleo_fastq").option("paths", str(tmp_path / "x_pass.fastq.gz")).load()
    assert rows(got, "rec", "header", "sequence", "quality") == [(0, "@a", "ACGT", "IIII"), (1, "@b", "AC", "!!")]
    assert rows(fastq.read_fastq(spark, str(tmp_path / "x_pass.fastq.gz")), "rec", "header", "quality") == [(0, "@a", "IIII"), (1, "@b", "!!")]
    for folder in ("DMSO", "2A3", "DMSO_2A3", "none"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "y_fail.fastq.gz").write_bytes(b"abc")
    found = rows(text.find_fastq(spark, str(tmp_path)), "condition", "verdict", "n_bytes")
    assert [r[0] for r in found if r[1] == "fail"] == ["2A3", "DMSO", "DMSO", None]


def test_condition_stats(spark):
    files = spark.createDataFrame([("DMSO", "pass", 2000, 8), ("DMSO", "fail", 1000, 4), ("2A3", "pass", 10, 0), (None, "pass", 5, 400)], "condition string, verdict string, n_bytes long, n_lines long")
    got = {r.condition: (r.pass_reads, r.fail_reads, r.pass_percent) for r in quality.condition_stats(files).collect()}
    assert got == {"DMSO": (2, 1, 66.66), "2A3": (0, 0, None), None: (2, 1, 66.66)}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("g 5 A 100 =:0 A:90:1 C:10:1\n")
    stream = online.streamed_mutation_rates(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").first().mutrate == 0.1


def test_online_counters(spark, tmp_path):
    df = spark.createDataFrame([("r1", "T1", 50), ("r1", None, None), ("r2", "T1", 3)], "read_id string, ref_name string, ref_length int")
    df.write.parquet(str(tmp_path / "in"))
    stream = online.online_counters(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 20)
    q = stream.writeStream.format("memory").queryName("counters").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("counters").first()) == (3, 1, 1)


def test_records_are_encoded_by_column(tmp_path):
    """Sliced batches with holes, odd letters and all kinds of tags come back as they were."""
    import pyarrow as pa

    from nucleoframe.sources import bam

    rows = [
        {"read_id": "a", "flag": 16, "ref_name": "T1", "ref_start": 5, "ref_length": 7, "mapq": 9, "cigar": [{"op": 0, "len": 4}, {"op": 2, "len": 3}], "seq": "acGTn", "qual": "!I~5+", "tags": {"NM": "3", "ZZ": "x" * 80, "BB": "1,2,3"}, "tag_types": {"NM": "C", "BB": "BS"}, "mate_ref_name": "T1", "mate_start": 8, "template_length": -4},
        {"read_id": "b", "cigar": None, "tags": None, "tag_types": None},
        {"read_id": "c", "ref_name": "T1", "ref_start": 0, "cigar": [], "seq": "A?", "tags": {}, "tag_types": {}},
        {"read_id": "d", "ref_name": "T1", "ref_start": 3, "cigar": [{"op": 0, "len": 2}], "seq": "CC", "qual": "II", "tags": {"NM": "300"}, "tag_types": {"NM": "S"}},
    ]
    schema = pa.schema([(c, bam.COLUMN_TYPES.get(c, pa.string())) for c in bam.schemas.ALIGNMENT_COLUMNS if c != "ord"])
    batch = pa.RecordBatch.from_pylist([{k: list(v.items()) if isinstance(v, dict) else v for k, v in r.items()} for r in rows], schema)
    columns = ["read_id", "flag", "ref_name", "ref_start", "mapq", "cigar", "seq", "qual", "tags", "mate_ref_name", "mate_start", "template_length"]
    for part, want in ((batch, rows), (batch.slice(2), rows[2:])):
        got = [dict(zip(columns, bam.decode(data[4:], [("T1", 100)], columns))) for data, *_ in bam.encoded(part, {"T1": 0})]
        assert [g["read_id"] for g in got] == [r["read_id"] for r in want]
        for g, r in zip(got, want):
            assert g["cigar"] == (r["cigar"] or None) and g["tags"] == (r["tags"] or {}) and g["qual"] == r.get("qual")
            assert g["seq"] == (r["seq"].upper().replace("?", "N") if r.get("seq") else None) and g["ref_start"] == r.get("ref_start") and g["mapq"] == r.get("mapq", 0)
