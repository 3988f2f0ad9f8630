import random

import pytest

from nucleoframe.operators import mutrate, windows
from nucleoframe.sources import text

FX3 = [
    ("g1", 1, 100, 5, 0.05), ("g1", 2, 100, 30, 0.30), ("g1", 5, 150, 3, 0.02), ("g1", 10, 90, 9, 0.10), ("g1", 11, 200, 20, 0.10), ("g1", 24, 0, 0, None),
    ("g2", 7, 250, 0, 0.0), ("g2", 8, 50, 10, 0.2),
]
SCHEMA = "gene string, pos long, coverage long, mutant long, mutrate double"


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ((10, 10, 200, 0.2), [("g1", 1, 340, 17, 0.05, 10), ("g1", 11, 200, 20, 0.1, 20), ("g2", 7, 300, 10, 0.03333, 16)]),
        ((10, 5, 200, 0.2), [("g1", 1, 340, 17, 0.05, 10), ("g1", 6, 290, 29, 0.1, 15), ("g1", 11, 200, 20, 0.1, 20), ("g2", 7, 300, 10, 0.03333, 16)]),
        ((3, 10, 100, 0.2), [("g1", 1, 100, 5, 0.05, 3), ("g1", 11, 200, 20, 0.1, 13), ("g2", 7, 300, 10, 0.03333, 9)]),
    ],
)
def test_bulk_windows(spark, rows, args, expected):
    assert rows(windows.bulk_windows(spark.createDataFrame(FX3, SCHEMA), *args)) == sorted(expected, key=repr)


def test_anchor_counts_rows_without_rate(spark, rows):
    df = spark.createDataFrame([("g", 3, 0, 0, None), ("g", 12, 300, 3, 0.01)], SCHEMA)
    assert rows(windows.bulk_windows(df)) == [("g", 3, 300, 3, 0.01, 12)]


def test_bad_step(spark):
    with pytest.raises(ValueError):
        windows.bulk_windows(spark.createDataFrame(FX3, SCHEMA), 10, 0)


def test_equal_to_range_join(spark):
    rng = random.Random(1)
    data = [(f"g{rng.randrange(4)}", p, rng.randrange(100), rng.randrange(5), rng.random() * 0.4) for p in rng.sample(range(1, 400), 150)]
    df = spark.createDataFrame(data, SCHEMA)
    for _ in range(4):
        length, step = rng.randrange(1, 25), rng.randrange(1, 25)
        want = {}
        for g in {d[0] for d in data}:
            own = [d for d in data if d[0] == g]
            low, high = min(d[1] for d in own), max(d[1] for d in own)
            for start in range(low, high + 1, step):
                inside = [d for d in own if start <= d[1] < start + length and d[4] <= 0.2]
                if inside and sum(d[2] for d in inside) >= 50:
                    want[g, start] = (sum(d[2] for d in inside), sum(d[3] for d in inside))
        got = {(r.gene, r.win): (r.coverage, r.mutant) for r in windows.bulk_windows(df, length, step, 50).collect()}
        assert got == want, (length, step)


FX4 = [
    ("gA", 3, "c1", None, None), ("gA", 3, "c2", None, None), ("gA", 4, "c1", 120, 6), ("gA", 4, "c2", 50, 5), ("gA", 9, "c1", 100, 50),
    ("gA", 9, "c2", 180, 9), ("gA", 13, "c1", 10, 0), ("gA", 13, "c2", 300, 3), ("gB", 1, "c1", 199, 0), ("gB", 1, "c2", None, None),
]


def test_cell_windows(spark, rows):
    df = spark.createDataFrame(FX4, "gene string, pos long, cell string, dp int, ad int")
    assert rows(windows.cell_windows(df)) == [("gA", 13, 22, "c2", 300, 3, 0.01), ("gA", 3, 12, "c2", 230, 14, 0.06087)]
    assert rows(windows.cell_windows(df, legacy_anchor=True)) == [("gA", 4, 13, "c2", 530, 17, 0.03208)]


FX1 = """chr1  5 A 100 =:0:0 A:90:1 C:4:1 G:1:1 T:0:0 N:0:0 +AC:2:1 +ACGT:3:1 -A:5:1 -ACGTA:7:1
>chr1 6 c 0   =:0 A:0 C:0 G:0 T:0 N:0
chr1  7 G 50  =:0 A:0 C:0 G:50 T:0 N:0
"""


def test_mutation_rates(spark, tmp_path):
    (tmp_path / "counts.txt").write_text(FX1)
    got = mutrate.mutation_rates(text.read_counts(spark, str(tmp_path / "counts.txt"))).orderBy("pos").collect()
    shown = [(r.gene, r.pos, r.end, r.coverage, r.adj_coverage, r.mutant, r.mutrate, r.detail) for r in got]
    assert shown == [
        ("chr1", 5, 6, 105, 95, 5, 0.04761905, "=:0;A:90;C:4;G:1;T:0;N:0;+:2;-:5;+++:3;---:7"),
        ("chr1", 6, 7, 0, 0, 0, None, "=:0;A:0;C:0;G:0;T:0;N:0"),
        ("chr1", 7, 8, 50, 50, 0, 0.0, "=:0;A:0;C:0;G:50;T:0;N:0"),
    ]


def test_missing_reference(spark):
    raw = spark.createDataFrame([("g 1 T 5 A:5",)], "value string")
    assert mutrate.mutation_rates(text.parse_counts(raw)).first().mutant is None
    with pytest.raises(Exception, match="no count of the reference"):
        mutrate.mutation_rates(text.parse_counts(raw), strict=True).collect()


def test_gene_counts(spark, rows, tmp_path):
    (tmp_path / "fc.tsv").write_text("# made\nGeneid\tChr\tStart\tEnd\tStrand\tLength\tcount\nx\tg1\t1\t9\t+\t9\t10\ny\tg2\t1\t9\t+\t8\t20\nz\tg1\t1\t9\t+\t7\t30\n")
    assert rows(text.read_gene_counts(spark, str(tmp_path / "fc.tsv"))) == [("g1", 7, 30, 60), ("g2", 8, 20, 60)]


def test_fasta_and_structures(spark, rows, tmp_path):
    (tmp_path / "s.txt").write_text(">18S mouse\n((..\n..))\n>18S_alt\n....\n")
    numbered = text.numbered_lines(spark, str(tmp_path / "s.txt"))
    assert text.dot_bracket(numbered, "18S").first().dot_bracket == "((....))"
    assert text.dot_bracket(numbered, "1").first().dot_bracket == "((....))"
    assert text.dot_bracket(numbered, "28S").count() == 0
    assert text.dot_bracket(numbered, "18S_alt", exact=True).first().dot_bracket == "...."
    assert rows(text.read_fasta_lengths(spark, str(tmp_path / "s.txt"))) == [("18S", 8), ("18S_alt", 4)]


def test_position_and_window_files(spark, rows, tmp_path):
    line = "g1\t5\t6\tg1.5\t0.05\t+\t120\t110\t6\tNA\tNA\tA\tA:1\n"
    (tmp_path / "s1_mutrate.txt").write_text(line + line.replace("0.05", "NA"))
    got = text.read_position_files(spark, str(tmp_path))
    assert rows(got) == [("g1", 5, 0.05, 120, 6, "s1")]
    (tmp_path / "x_counts_mutrate.10nt.csv").write_text("gene\twin\tcoverage\tmutant\tmutrate\twin_end\ng\t1\t250\t5\t0.02\t10\ng\t11\t20\t5\t0.02\t20\n")
    got = text.read_window_files(spark, str(tmp_path), "*_counts_mutrate.10nt.csv", "p_")
    assert rows(got, "gene", "win", "sample") == [("g", 1, "p_x")]


def test_items_are_summed_once(spark):
    """Neither a filter above the rates nor their parts walk the items again."""
    from nucleoframe.operators import mutrate
    from nucleoframe.sources import text

    raw = spark.createDataFrame([(">g1 7 a 10 =:0:0 A:6:1 C:4:1 A:1:1 G:0:0 +AC:2:1 +ACGT:3:1 -A:5:1 -ACGTA:1:1",), (" ",)], "value string")
    found = mutrate.mutation_rates(text.parse_counts(raw)).where("coverage >= 1 and mutrate >= 0")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 3 and plan.count("split(trim") == 1, plan
    (r,) = found.collect()
    assert (r.coverage, r.adj_coverage, r.mutant, r.mutrate) == (15, 11, 4, round(4 / 15, 8))
    assert r.detail == "=:0;A:6;C:4;A:1;G:0;+:2;-:5;+++:3;---:1"


def test_tasks_grow_in_number_with_the_input(spark, monkeypatch):
    from nucleoframe.plans import queries
    from nucleoframe.sources import files

    names = ("cell_windows", "cell_windows_legacy_anchor", "window_any_cell", "bulk_windows_sliding", "padded_rolling_dense", "single_cell_pipeline")
    held = {n: queries.QUERIES[n](spark, "/root/testdata/sf0.001") for n in names}
    plain = {n: sorted(map(repr, df.collect())) for n, df in held.items()}
    monkeypatch.setitem(files.spread.__kwdefaults__, "each", 10_000)
    for n in names:
        df = queries.QUERIES[n](spark, "/root/testdata/sf0.001")
        assert sorted(map(repr, df.collect())) == plain[n]
        assert df.rdd.getNumPartitions() > 4, n
