"""Block-gzipped files in splits, binning indexes, one sorted BAM, FASTQ splits and growth."""

import gzip
import os
import random
import struct
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nucleoframe import sinks
from nucleoframe.sources import bam, bgzf, binning, blocktext, fastq, vcf

HEADER = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:T{i}\tLN:{1 << 20}\n" for i in range(4))


def write_blocks(path, data: bytes, most: int = 500) -> str:
    """A file of small blocks."""
    with open(path, "wb") as f:
        for k in range(0, len(data), most):
            f.write(bgzf.block(data[k : k + most]))
        f.write(bgzf.END)
    return str(path)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 900), max_size=30), st.booleans(), st.integers(20, 700), st.integers(30, 3000))
def test_lines_belong_to_one_split(tmp_path_factory, lengths, ended, most, split):
    lines = [b"x" * n + b"%d" % i for i, n in enumerate(lengths)]
    data = b"\n".join(lines) + (b"\n" if ended and lines else b"")
    path = write_blocks(tmp_path_factory.mktemp("b") / "a.gz", data, most)
    got = [x for r in blocktext.ranges([path], split) for x in blocktext.raw_lines(*r)]
    assert [x for _, x in got] == lines and [o for o, _ in got] == sorted({o for o, _ in got})
    with gzip.open(path) as f:  # an offset is where the line is
        starts, at = {o: x for o, x in bgzf.blocks(open(path, "rb"), 0)}, 0
        for place, line in got:
            held = b"".join(x for o, x in sorted(starts.items()) if o >= place >> 16)[place & 0xFFFF :]
            assert held.startswith(line)
        assert f.read() == data and at == 0


def test_block_text_equals_the_text_reader(spark, tmp_path):
    rng = random.Random(4)
    lines = [rng.choice(["", "plain", "a\rb", "é" * 40, "end\r", "\t\t"]) + str(i) * rng.randrange(3) for i in range(5000)]
    data = "".join(x + rng.choice(["\n", "\r\n"]) for x in lines).encode()
    path = write_blocks(tmp_path / "a.gz", data, 3000)
    df = blocktext.read_block_text(spark, path, split=2000)
    assert df.rdd.getNumPartitions() > 8
    want = sorted(r.value for r in spark.read.text(path).collect())
    assert sorted(r.value for r in df.collect()) == want and len(want) > 5000
    assert [r.value for r in df.orderBy("ord").collect()] == [r.value for r in spark.read.text(path).coalesce(1).collect()]
    empty = write_blocks(tmp_path / "none.gz", b"")
    assert blocktext.read_block_text(spark, empty).count() == 0


def test_index_bytes():
    """Against bytes made by hand: two records in one chunk, one apart, one in a larger bin."""
    index = binning.Index()
    index.add(0, 0, 10, 0, 50)
    index.add(0, 5, 100, 50, 90)
    index.add(0, 16_000, 40_000, 90, 70_000)
    index.add(0, 20_000, 20_001, 70_000, 80_000)
    index.add(-1, -1, 0, 80_000, 90_000)
    bins = struct.pack("<i", 3) + struct.pack("<IiQQ", 585, 1, 90, 70_000) + struct.pack("<IiQQ", 4681, 1, 0, 90) + struct.pack("<IiQQ", 4682, 1, 70_000, 80_000)
    linear = struct.pack("<i", 3) + struct.pack("<QQQ", 0, 90, 90)
    want = b"BAI\1" + struct.pack("<i", 2) + bins + linear + struct.pack("<ii", 0, 0) + struct.pack("<Q", 1)
    assert index.bai(2) == want
    assert binning.Index().read_body(want, 8, 2).bai(2) == want
    assert index.chunks(0, 0, 16_000) == [(0, 70_000)] and index.chunks(0, 20_000, 20_001) == [(90, 80_000)] and index.chunks(1) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300_000), st.integers(1, 200_000)), max_size=60), st.integers(0, 500_000), st.integers(1, 200_000), st.integers(1, 6))
def test_regions_of_an_index(records, start, length, cut):
    """No record of a region is outside its chunks, also of an index that was put together of parts."""
    records = sorted(records)
    spans, whole = [], binning.Index()
    for k in range(0, len(records), cut):
        part, at = binning.Index(), 0
        for ref, pos, n in records[k : k + cut]:
            spans.append(((k + 1) * 1000 << 16) + at)
            part.add(ref, pos, pos + n, at, at + 7)
            at += 7
        again = binning.Index().read_body(part.body(3), 0, 3)
        whole.append(again, (k + 1) * 1000)
    for index in (whole, binning.Index().read_body(whole.body(3), 0, 3)):
        for ref in range(3):
            found = index.chunks(ref, start, start + length)
            parts = [p for c in found for p in index.cuts(ref, *c, 1)]
            assert parts[:1] == [] or (parts[0][0] == found[0][0] and parts[-1][1] == found[-1][1])
            for (r, pos, n), at in zip(records, spans):
                if r == ref and pos < start + length and pos + n > start:
                    assert sum(a <= at < b for a, b in found) == 1 == sum(a <= at < b for a, b in parts)


@pytest.fixture
def vcf_file(spark, tmp_path, monkeypatch):
    lines = [(f"g{k % 3}", 1 + i, f"g{k % 3}\t{1 + i}\t.\tA\t.\t.\t.\t.\tDP:AD\t{i % 9 + 1}:{i % 5}\t.:.") for k in range(3) for i in range(0, 60_000, 7)]
    head = ["##fileformat=VCFv4.2", "##contig=<ID=g0,length=9>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tc1\tc2"]
    df = spark.createDataFrame(lines, "name string, pos long, value string").withColumn("ref_length", F.lit(1)).repartition(5)
    path = str(tmp_path / "x" / "cells.vcf.gz")
    assert blocktext.write_indexed_text(df, path, ["g2", "g0", "g1"], head) == len(lines)
    return path, head, lines


def test_indexed_text(spark, vcf_file, monkeypatch):
    path, head, lines = vcf_file
    with gzip.open(path, "rt") as f:  # one file: the header first, names in the given order
        order = {"g2": 0, "g0": 1, "g1": 2}
        assert f.read().splitlines() == head + [x[2] for x in sorted(lines, key=lambda x: (order[x[0]], x[1]))]
    assert sorted(os.listdir(os.path.dirname(path))) == ["cells.vcf.gz", "cells.vcf.gz.tbi"]
    df = blocktext.read_indexed_text(spark, path, split=1000)
    assert df.count() == len(lines)
    for where, keep in (
        ("name = 'g0'", lambda n, p: n == "g0"), ("name = 'g1' AND pos BETWEEN 20000 AND 20100", lambda n, p: n == "g1" and 20_000 <= p <= 20_100),
        ("name IN ('g2', 'no') AND pos > 59000", lambda n, p: n == "g2" and p > 59_000), ("name = 'no'", lambda n, p: False), ("name = 'g0' AND pos = 8", lambda n, p: n == "g0" and p == 8),
        ("pos < 5", lambda n, p: p < 5),
    ):
        assert sorted(r.value for r in df.where(where).collect()) == sorted(v for n, p, v in lines if keep(n, p)), where
    # how many blocks a region reads
    read, real = [], bgzf.blocks

    def counted(f, at):
        for x in real(f, at):
            read.append(x[0])
            yield x

    monkeypatch.setattr(bgzf, "blocks", counted)
    reader = blocktext.IndexedReader([path], 64 << 20, blocktext.Region({"g0"}, 30_000, 30_100))
    parts = reader.partitions()
    read.clear()
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    whole = len(bgzf.starts(path))
    assert rows == sum(n == "g0" and 30_000 <= p <= 30_100 for n, p, _ in lines) and len(set(read)) <= 4 < whole / 3


def test_indexed_cells(spark, vcf_file):
    path, head, lines = vcf_file
    assert vcf.block_header(path) == (["c1", "c2"], ["g0"])
    got = vcf.read_indexed_region(spark, path, "g1", 100, 300)
    want = vcf.read_cell_positions(spark, path, "g1").where("pos between 100 and 300")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.count() > 20
    every = lambda raw: sorted(map(tuple, vcf.parse_cell_positions(raw, ["c1", "c2"]).collect()), key=repr)
    assert sorted(map(tuple, vcf.read_cell_positions(spark, path).collect()), key=repr) == every(spark.read.text(path))
    assert blocktext.is_blocked(path) and not blocktext.is_blocked(str(path) + "*") and not blocktext.is_blocked("no://such/file")
    raw, cells = vcf.read_block_cells(spark, path, 5000)
    assert cells == ["c1", "c2"] and raw.count() == len(lines) + len(head)


def alignments(spark, n=6000, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ref = rng.choice(["T0", "T2", "T3", None])
        start = rng.randrange(1 << 20) if ref else None
        rows.append((i, f"r{rng.randrange(n // 3):05d}", rng.choice((0, 16, 256)), ref, start, rng.choice((30, 30, 5000)) if ref else None, 9))
    df = spark.createDataFrame(rows, "ord long, read_id string, flag int, ref_name string, ref_start long, ref_length int, mapq int")
    return df.withColumns({"cigar": F.array(F.struct(F.lit(0).alias("op"), F.coalesce("ref_length", F.lit(1)).alias("len"))), "tags": F.create_map(F.lit("XI"), F.col("ord").cast("string")), "tag_types": F.create_map(F.lit("XI"), F.lit("i"))}), rows


def test_sorted_bam_and_regions(spark, tmp_path):
    df, rows = alignments(spark)
    path = str(tmp_path / "all.bam")
    assert bam.write_sorted_bam(df.repartition(6), path, HEADER) == len(rows)
    assert sorted(os.listdir(tmp_path)) == ["all.bam", "all.bam.bai"]
    with open(path, "rb") as f:
        assert f.read()[-28:] == bgzf.END and bgzf.END == bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    back = bam.read_bam(spark, path, columns=["ord", "ref_name", "ref_start", "tags"], split=9_000)
    assert back.rdd.getNumPartitions() > 3
    key = lambda r: (r[3] is None, r[3] or "", -1 if r[4] is None else r[4], r[0])
    assert [int(r.tags["XI"]) for r in back.orderBy("ord").collect()] == [r[0] for r in sorted(rows, key=key)]
    for ref, a, b in (("T0", 0, 1 << 20), ("T2", 500_000, 510_000), ("T3", 16_384, 16_385), ("T1", 0, 100), ("no", 0, 100), ("T3", 1_040_000, 1 << 29)):
        got = bam.read_region(spark, path, ref, a, b, ["tags"])
        assert sorted(int(r.tags["XI"]) for r in got.collect()) == sorted(r[0] for r in rows if r[3] == ref and r[4] < b and r[4] + r[5] > a), (ref, a, b)
    pushed = bam.read_bam(spark, path).where("ref_name = 'T2' AND ref_start >= 1000000")
    assert sorted(int(r.tags["XI"]) for r in pushed.collect()) == sorted(r[0] for r in rows if r[3] == "T2" and r[4] >= 1_000_000)
    schema = bam.read_bam(spark, path, columns=["ref_start"]).schema
    reader = bam.Reader([path], schema, 64 << 20, False)
    reader.region = blocktext.Region({"T2"}, 500_000, 500_100)
    parts = [p.value for p in reader.partitions()]
    assert all(p[3] for p in parts) and sum((p[2] >> 16) - (p[1] >> 16) for p in parts) < os.path.getsize(path) / 4
    none, _ = alignments(spark, 3)
    assert bam.write_sorted_bam(none.limit(0), str(tmp_path / "none.bam"), HEADER) == 0
    assert bam.read_bam(spark, str(tmp_path / "none.bam")).count() == 0


def test_reads_stay_whole(spark, tmp_path):
    """Each split has all records of its reads, however the splits fall; the fold equals the statistics."""
    from nucleoframe.operators import reads

    df, rows = alignments(spark, 3000, 5)
    folder = str(tmp_path / "by-name")
    bam.write_bam(df.orderBy("read_id", "ord").coalesce(2), folder, HEADER)
    paths = sorted(f"{folder}/{x}" for x in os.listdir(folder))
    want = sorted(map(tuple, reads.read_stats(df, 10, lists=False).select("read_id", "alignment_count", "unique_transcript_count", "is_uniquely_mapped", "max_transcript", "max_count", "max_ratio").collect()))
    for split in (900, 5000, 1 << 20):
        back = bam.read_bam(spark, *paths, columns=["read_id", "ref_name", "ref_length"], split=split, whole_reads=True)
        held = back.withColumn("p", F.spark_partition_id()).groupBy("read_id").agg(F.count_distinct("p").alias("parts"), F.count("*").alias("n"))
        assert held.where("parts > 1").isEmpty() and held.agg(F.sum("n")).first()[0] == len(rows)
        folded = reads.fold_reads(back, 10)
        assert sorted(map(tuple, folded.collect())) == want
        assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()


def fastq_bytes(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.choice((0, 1, 40, 300))
        out.append((f"@r{i} @x", "".join(rng.choice("ACGTN") for _ in range(m)), "+", "".join(rng.choice("@+!I5") for _ in range(m))))
    return out, "".join("\n".join(r) + "\n" for r in out).encode()


@pytest.mark.parametrize("packed", [False, True])
def test_fastq_splits(spark, tmp_path, packed):
    rows, data = fastq_bytes(800)
    path = str(tmp_path / "a.fastq")
    if packed:
        write_blocks(path, data, 700)
    else:
        (tmp_path / "a.fastq").write_bytes(data)
    for split in (200, 3333, 1 << 20):
        parts = [(a, a + split) for a in range(0, os.path.getsize(path), split)]
        got = [x for a, b in parts for x in fastq.records(path, fastq.kind_of(path), a, b)]
        assert [x[1:] for x in got] == rows and [x[0] for x in got] == sorted({x[0] for x in got})
    df = fastq.read_fastq_files(spark, path, split=5000)
    assert df.rdd.getNumPartitions() > 4 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[2:] for r in df.orderBy("rec").collect()] == rows


def test_fastq_that_grows(spark, tmp_path):
    """Cut inside records, between files, and with a file that joins later: each record once."""
    rows, data = fastq_bytes(300)
    other, more = fastq_bytes(50, 9)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        stream = fastq.stream_fastq(spark, str(folder), split=4000).writeStream.format("parquet").option("path", out)
        query = stream.option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r)[2:] for r in spark.read.parquet(out).collect())

    (folder / "a.fastq").write_bytes(data[: len(data) // 2 + 13])
    first = run()
    assert 0 < len(first) < len(rows) and set(first) <= set(rows)
    (folder / "a.fastq").write_bytes(data[:-1])
    (folder / "b.fastq").write_bytes(more)
    assert run() == sorted(rows[:-1] + other)
    (folder / "a.fastq").write_bytes(data)
    assert run() == sorted(rows + other)
    for start in (0, len("\n".join(rows[0])) + 1):
        for size in range(start, 3000, 61):
            end = fastq.complete(str(folder / "a.fastq"), start, size, window=50)
            assert data[:end].count(b"\n") % 4 == 0 and end <= size and data[end:size].count(b"\n") < 4


def traced(step):
    """What a step gives, and the most bytes that it held in this process."""
    tracemalloc.start()
    try:
        return step(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_index_is_not_held_by_the_driver(spark, tmp_path):
    """Each name's linear index has a value for every 16 KiB before it; the driver has none of them."""
    path, far = str(tmp_path / "far.vcf.gz"), 200_000_000
    df = spark.createDataFrame([(f"g{k}", far + k, 1, f"g{k}\t{far + k}\tx") for k in range(300)], "name string, pos long, ref_length int, value string")
    n, most = traced(lambda: blocktext.write_indexed_text(df, path, [f"g{k}" for k in range(300)], ["#h"]))
    assert n == 300 and most < 300 * (far >> 14) * 8 / 4
    assert [r.value for r in blocktext.read_indexed_text(spark, path).where("name = 'g77'").collect()] == [f"g77\t{far + 77}\tx"]


def test_names_of_the_lines(spark, tmp_path):
    """Without a list of names, the file and its index are those of the list of the lines' names; a name may be in many parts."""
    lines = [(n, p, 1, f"{n}\t{p}\t{'x' * (p % 50)}") for n, most in (("a", 3), ("b", 4000), ("b2", 1), ("ä", 900), ("c", 1)) for p in range(1, most * 20, 20)]
    df = spark.createDataFrame(lines, "name string, pos long, ref_length int, value string").repartition(6)
    for descending in (False, True):
        names = sorted({x[0] for x in lines}, key=str.encode, reverse=descending)
        paths = [str(tmp_path / f"{kind}-{descending}.gz") for kind in ("own", "listed", "contigs")]
        blocktext.write_indexed_text(df, paths[0], None, ["#a", "#b"], descending=descending)
        blocktext.write_indexed_text(df, paths[1], names, ["#a", "#b"])
        blocktext.write_indexed_text(df, paths[2], None, ["#a", "#b"], descending=descending, contigs_at=1)
        texts = [gzip.open(p, "rt").read().splitlines() for p in paths]
        assert texts[0] == texts[1] == ["#a", "#b"] + [x[3] for n in names for x in lines if x[0] == n]
        assert texts[2] == ["#a", *(f"##contig=<ID={n}>" for n in names), *texts[0][1:]]
        own, listed, more = (binning.read_tbi(f"{p}.tbi") for p in paths)
        assert own[1:] == listed[1:] == more[1:] == (names, binning.VCF) and own[0].bins == listed[0].bins and own[0].linear == listed[0].linear
        for n in names:
            assert sorted(r.value for r in blocktext.read_indexed_text(spark, paths[2]).where(F.col("name") == n).collect()) == sorted(x[3] for x in lines if x[0] == n)
    none = str(tmp_path / "none.gz")
    assert blocktext.write_indexed_text(df.where("pos < 0"), none, None, ["#a"], contigs_at=0) == 0
    assert gzip.open(none, "rt").read() == "#a\n" and blocktext.read_indexed_text(spark, none).count() == 0 and binning.read_tbi(f"{none}.tbi")[1] == []


def test_window_file_of_its_own_genes(spark, tmp_path):
    """The contigs of a window file are its genes, from the last to the first, without a list of them."""
    rows = [(f"g{k}", w, w + 9, "c1", 300, 3, 0.01) for k in range(40) for w in (1, 11)]
    df = spark.createDataFrame(rows, "gene string, win long, win_end long, cell string, dp long, ad long, mr double")
    path = str(tmp_path / "w.vcf.gz")
    assert sinks.write_window_file(df, ["c1", "c2"], None, path, descending=True) == 80
    assert vcf.block_header(path) == (["c1", "c2"], sorted({r[0] for r in rows}, reverse=True)) and vcf.block_cells(path) == ["c1", "c2"]
    assert [x.split("\t")[0] for x in gzip.open(path, "rt") if x[0] != "#"] == [n for n in sorted({r[0] for r in rows}, reverse=True) for _ in range(2)]


def test_index_is_read_piece_by_piece(tmp_path):
    """A region of one name doesn't hold the index of the others."""
    index, names = binning.Index(), [f"g{k}" for k in range(3000)]
    for k in range(3000):
        index.add(k, 9_000_000 + k, 9_000_001 + k, k << 20, (k << 20) + 9)
    path = str(tmp_path / "x.gz")
    binning.write_tbi(f"{path}.tbi", index, names)
    found, most = traced(lambda: [p.value for p in blocktext.IndexedReader([path], 64 << 20, blocktext.Region({"g2900", "no"})).partitions()])
    assert found == [(path, binning.VCF, "g2900", 2900 << 20, (2900 << 20) + 9)] and most < 5_000_000 < 3000 * (9_000_000 >> 14) * 8
    assert [(n, i.bins[0]) for n, i in binning.references(f"{path}.tbi")[1]] == [(n, index.bins[k]) for k, n in enumerate(names)]
    with open(f"{path}.tbi", "rb") as f:
        cut = f.read()[: bgzf.starts(f"{path}.tbi")[2]]
    with open(f"{path}.tbi", "wb") as f:
        f.write(cut)
    with pytest.raises(ValueError):
        list(binning.references(f"{path}.tbi")[1])
