import gzip

import pytest

from nucleoframe import cli
from nucleoframe.sources import bam, text, vcf


def test_bulk_tools(spark, rows, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"g {i} A 100 A:95:1 C:5:1\n" for i in range(1, 21)))
    cli.main(["mutrate", "-i", str(tmp_path / "c.txt"), "-o", str(tmp_path / "p")], spark)
    got = text.read_positions(spark, str(tmp_path / "p"))
    assert (got.count(), got.first().strand, got.where("pos = 3").first().gene_position) == (20, ".", "g.3")
    cli.main(["windows", "-i", str(tmp_path / "p"), "-o", str(tmp_path / "w"), "-w", "10", "-s", "5"], spark)
    lines = [r.value for r in spark.read.text(str(tmp_path / "w")).collect()]
    assert "g\t6\t1000\t50\t0.05\t15" in lines


def test_cell_windows_tool(spark, tmp_path):
    head = "##contig=<ID=g>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tc1\tc2\n"
    (tmp_path / "c.vcf").write_text(head + "".join(f"g\t{i}\t.\tA\tG\t.\tPASS\tx\tGT:AD:DP:OTH:PL:ALL\t0/1:2:100:0:.:1,1,1,1\t.:.:.:.:.:.\n" for i in range(1, 9)))
    cli.main(["cell-windows", "-i", str(tmp_path / "c.vcf"), "-o", str(tmp_path / "w")], spark)
    r = vcf.read_windows(spark, str(tmp_path / "w")).first()
    assert (r.win, r.cell, r.dp, r.mr) == (1, "c1", 800, 0.02)
    cli.main(["cell-windows", "-i", str(tmp_path / "c.vcf"), "-o", str(tmp_path / "w.vcf.gz")], spark)
    one = str(tmp_path / "w.vcf.gz")
    assert vcf.read_windows(spark, one).first() == r and vcf.read_indexed_region(spark, one, "g").count() == 0 + len([x for x in gzip.open(one, "rt") if x[0] != "#"]) * 2


def test_read_tools(spark, tmp_path, capsys):
    record = {"read_id": "a_BC_UM", "flag": 0, "ref_name": "T1", "ref_start": 3, "ref_length": 2, "mapq": 1, "cigar": [{"op": 0, "len": 2}], "seq": "AC", "qual": "II", "tags": {"CB": "x", "UM": "y"}}
    path = str(tmp_path / "x.bam")
    bam.write_file(path, "@HD\tVN:1.6\n", [("T1", 100), ("T2", 50)], [record, record | {"read_id": "b_BC_UM", "ref_name": "T2"}, record | {"read_id": "b_BC_UM"}])
    cli.main(["read-stats", path, "-o", str(tmp_path / "r"), "--extract-unique"], spark)
    assert "total_reads: 2" in capsys.readouterr().out
    parts = lambda folder: sorted(map(str, (tmp_path / folder).glob("*.bam")))
    (kept,) = bam.read_bam(spark, *parts("r/unique")).collect()
    assert kept.read_id == "a_BC_UM" and kept.tags == {"CB": "x", "UM": "y"} and kept.tag_types == {"CB": "Z", "UM": "Z"}
    assert [r.value for r in spark.read.text(str(tmp_path / "r/unique_reads")).collect()] == ["read_id\ttranscript", "a_BC_UM\tT1"]
    cli.main(["-q", "read-stats", path, "-o", str(tmp_path / "r2"), "--extract-unique", "--sam", "--all-transcripts"], spark)
    sam = [r.value for r in spark.read.text(str(tmp_path / "r2/unique")).collect()]
    assert sam == ["@HD\tVN:1.6", "a_BC_UM\t0\tT1\t4\t1\t2M\t*\t0\t0\tAC\tII\tCB:Z:x\tUM:Z:y"]
    assert sorted(r.all_transcripts for r in spark.read.csv(str(tmp_path / "r2/reads"), sep="\t", header=True).collect()) == ["T1", "T2,T1"]
    capsys.readouterr()
    cli.main(["barcodes", "extract_list", path, "-o", str(tmp_path / "l")], spark)
    assert spark.read.csv(str(tmp_path / "l"), sep="\t", header=True).first().n == "3"
    cli.main(["barcodes", "add_tags", path, "-o", str(tmp_path / "t")], spark)
    assert {tuple(sorted(r.tags.items())) for r in bam.read_bam(spark, *parts("t")).collect()} == {(("CB", "BC"), ("UM", "UM"))}
    cli.main(["barcodes", "extract_barcodes", path, "-o", str(tmp_path / "b"), "--unique"], spark)
    assert [r.value for r in spark.read.text(str(tmp_path / "b")).collect()] == ["x"]
    cli.main(["gene-tag", path, "-o", str(tmp_path / "g")], spark)
    assert {r.tags["XT"] for r in bam.read_bam(spark, *parts("g")).collect()} == {"T1", "T2"}
    cli.main(["sort", path, "-o", str(tmp_path / "sorted")], spark)
    assert bam.read_bam(spark, *parts("sorted")).count() == 3
    assert sorted(r.ref_name for r in bam.read_bam(spark, *parts("sorted")).collect()) == ["T1", "T1", "T2"]
    cli.main(["sort", path, "-o", str(tmp_path / "one.bam")], spark)
    assert [r.ref_name for r in bam.read_bam(spark, str(tmp_path / "one.bam")).orderBy("ord").collect()] == ["T1", "T1", "T2"] and (tmp_path / "one.bam.bai").exists()
    cli.main(["fastq-filter", "-i", path, "-o", str(tmp_path / "q")], spark)
    assert spark.read.text(str(tmp_path / "q/verdict=pass")).count() == 12
    (tmp_path / "s.txt").write_text("RL 10 2\nRL 20 1\nSN x 1\n")
    cli.main(["lengths", str(tmp_path / "s.txt"), path, "-o", str(tmp_path / "len")], spark)
    assert spark.read.csv(str(tmp_path / "len/distribution"), sep="\t", header=True).count() == 3
    with pytest.raises(SystemExit):
        cli.main(["read-stats", path, "-o", "x", "-m", "-1"], spark)


def test_reports(spark, tmp_path, capsys):
    folder = tmp_path / "base/bowtie_fast-local_mp_3-1_rdg_5-1_rfg_5-3"
    folder.mkdir(parents=True)
    (folder / "s.log").write_text("10 reads; of these:\n  5 (50.00%) aligned exactly 1 time\n  3 (30.00%) aligned >1 times\n80.00% overall alignment rate\n")
    cli.main(["sweep-report", str(tmp_path / "base"), "-o", str(tmp_path / "o")], spark)
    said = capsys.readouterr().out
    assert "Best run:" in said and "sensitivity: bowtie-fast-local" in said and "exact_rate" in said
    (tmp_path / "f/DMSO").mkdir(parents=True)
    with gzip.open(tmp_path / "f/DMSO/a_pass.fastq.gz", "wt") as f:
        f.write("@a\nA\n+\nI\n" * 3)
    cli.main(["fastq-stats", str(tmp_path / "f")], spark)
    said = capsys.readouterr().out
    assert "DMSO\n----\npass: " in said and "3 reads" in said and "pass rate: 100.00%" in said and "Total" in said
