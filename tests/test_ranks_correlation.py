"""Ranks and quantiles of groups of any size, co-moments, the cluster map, padded rolling."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nucleoframe.operators import cells, correlation, ranks, reactivity, reads, windows


def grouped(spark, seed=1):
    """One group with nearly all rows and many ties, small ones, one without values."""
    rng = random.Random(seed)
    rows = [("hot", rng.choice((rng.randrange(4000) / 7, 1.5))) for _ in range(6000)]
    rows += [(g, rng.random()) for g in "abc" for _ in range(rng.randint(1, 30))] + [("none", None), ("a", None), ("one", 2.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(4), rows


POINTS = [0.0, 0.05, 0.25, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("at_once", [50, 1 << 20])
def test_quantiles(spark, at_once):
    df, rows = grouped(spark)
    got = {r.g: r.q for r in ranks.quantiles(df, "v", POINTS, ["g"], at_once=at_once).collect()}
    assert set(got) == {"hot", "a", "b", "c", "none", "one"} and got["none"] is None
    for g in set(got) - {"none"}:
        assert np.allclose(got[g], np.quantile([v for x, v in rows if x == g and v is not None], POINTS), atol=1e-12)
    (whole,) = ranks.quantiles(df, "v", POINTS, at_once=at_once).collect()
    assert np.allclose(whole.q, np.quantile([v for _, v in rows if v is not None], POINTS), atol=1e-12)
    (none,) = ranks.quantiles(df.limit(0), "v", POINTS, at_once=at_once).collect()
    assert none.q is None


@pytest.mark.parametrize("at_once", [20, 1 << 20])
def test_running_sums(spark, at_once):
    df, rows = grouped(spark, 3)
    got = ranks.running(ranks.distinct_counts(df, "v", ["g"]), "v", ["g"], at_once=at_once).collect()
    known = [(g, v) for g, v in rows if v is not None]
    assert len(got) == len(set(known))
    for g in ("hot", "a", "one"):
        own = np.sort([v for x, v in known if x == g])
        for r in got:
            if r.g == g:
                assert r.upto == np.searchsorted(own, r.v, "right") and r.whole == len(own)
    names = spark.createDataFrame([(f"n{i * 37 % 5000:05d}",) for i in range(5000)], "x string").withColumn("n", F.lit(1))
    placed = ranks.running(names, "x", at_once=at_once).orderBy("x").collect()
    assert [r.upto for r in placed] == list(range(1, 5001)) and {r.whole for r in placed} == {5000}


def test_large_groups_are_spread(spark):
    """No task sorts more than a range of the large group, and no window is without a partition."""
    df, rows = grouped(spark, 5)
    counts = ranks.distinct_counts(df, "v", ["g"])
    large = ranks.large_groups(counts, ["g"], 50)
    assert [r.g for r in large.collect()] == ["hot"]
    spread = ranks._in_ranges(counts, large, "v", ["g"], "n")
    shares = spread.where("g = 'hot'").groupBy("__b").count().collect()
    distinct = len({v for g, v in rows if g == "hot"})
    assert len(shares) > 60 and max(r["count"] for r in shares) < distinct / 8
    plan = ranks.running(counts, "v", ["g"], at_once=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("windowspecdefinition(g" in line or "windowspecdefinition(__" in line for line in plan.splitlines() if "Window [" in line)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranks, "SHARES", 0)  # the bound on the number of large groups
        assert ranks.large_groups(counts, ["g"], 50) is None


def test_operators_with_large_groups(spark, monkeypatch):
    """What the operators give doesn't depend on which groups are cut."""
    df, _ = grouped(spark, 7)
    rows = spark.createDataFrame([(i, r.g, r.v) for i, r in enumerate(df.collect())], "id long, g string, v double")
    long = rows.select(F.col("g").alias("gene"), (F.col("id") % 500).alias("win"), F.concat(F.lit("c"), (F.col("id") % 300).cast("string")).alias("cell"))

    def results():
        out = [
            reactivity.clip_scale(rows, "v", ["g"]), reactivity.winsorize(rows, "v", ["g"], 0.05, 0.1), reactivity.winsorize(rows, "v", (), 0.05, 0.1),
            reactivity.gene_divisors(rows, "v", ["g"]), reads.ecdf(rows, "v"), *cells.dimensions(long),
        ]
        return [sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f.collect()), key=repr) for f in out]

    plain = results()
    monkeypatch.setattr(ranks, "AT_ONCE", 40)
    for f in (ranks.large_groups, ranks.running, ranks.quantiles):
        monkeypatch.setattr(f, "__defaults__", tuple(40 if d == 1 << 20 else d for d in f.__defaults__))
    assert results() == plain
    positions, numbered = plain[5], plain[6]
    assert sorted(r[-1] for r in positions) == list(range(len(positions))) and sorted(r[-1] for r in numbered) == list(range(300))


# ---- co-moments -------------------------------------------------------------


def test_comoments_of_many_columns(spark):
    """300 columns with gaps, one that is constant and one that is far from zero, in one pass."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 300)) + rng.normal(size=(400, 1))
    x[:, 7] = 3.25
    x[:, 8] = 1e6 + x[:, 9]
    x[rng.random(x.shape) < 0.05] = np.nan
    rows = [([None if np.isnan(v) else float(v) for v in r],) for r in x]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    got = {(r.a, r.b): (r.r, r.n) for r in correlation.comoments(df, 300).collect()}
    assert len(got) == 300 * 301 // 2
    for a, b in [(0, 0), (0, 1), (8, 9), (3, 299), (100, 200), *((int(i), int(j)) for i, j in rng.integers(10, 300, (200, 2)) if i <= j)]:
        both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert got[a, b][1] == both.sum() and abs(got[a, b][0] - np.corrcoef(x[both, a], x[both, b])[0, 1]) < 1e-7
    assert got[7, 7][0] is None and got[0, 7][0] is None
    assert correlation.comoments(df.limit(0), 3).where("r is not null or n > 0").isEmpty()


def test_pivot_pearson(spark):
    rng = random.Random(3)
    rows = [(i, g, rng.choice((None, rng.random(), 100 + rng.random()))) for i in range(60) for g in ("b", "a", "10", None) for _ in range(3) if rng.random() < 0.97]
    import pandas as pd

    wide = pd.DataFrame([(i, g or "null", v) for i, g, v in rows], columns=["i", "g", "v"]).pivot_table(index="i", columns="g", values="v").dropna()
    want = wide.corr()
    got = {(r.a, r.b): (r.r, r.n) for r in correlation.pivot_pearson(spark.createDataFrame(rows, "i int, g string, v double"), "i", "g", "v").collect()}
    assert set(got) == {(a, b) for a in want for b in want if a <= b}
    assert all(abs(r - want.loc[a, b]) < 1e-9 and n == len(wide) for (a, b), (r, n) in got.items())


# ---- cluster map ------------------------------------------------------------


def naive_ward(points):
    """The nearest two clusters of all, by centroids, until one is left; ties go to the least numbers."""
    held, out, fresh = {i: [i] for i in range(len(points))}, [], len(points)
    middle = lambda m: points[m].mean(axis=0)
    while len(held) > 1:
        d, a, b = min((2 * len(x) * len(y) / (len(x) + len(y)) * ((middle(x) - middle(y)) ** 2).sum(), i, j) for i, x in held.items() for j, y in held.items() if i < j)
        out.append((a, b, float(np.sqrt(d)), len(held[a]) + len(held[b])))
        held[fresh] = held.pop(a) + held.pop(b)
        fresh += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 25), st.integers(1, 5), st.integers(0, 10**6))
def test_ward_equals_the_naive_version(n, width, seed):
    points = np.random.default_rng(seed).normal(size=(n, width))
    got, want = correlation.ward(points), naive_ward(points)
    assert [m[:2] + m[3:] for m in got] == [m[:2] + m[3:] for m in want]
    assert np.allclose([m[2] for m in got], [m[2] for m in want])
    assert sorted(correlation.leaf_order(got)) == list(range(n))


def test_ties_of_the_cluster_map():
    """Equal points and equal distances: heights as the naive version has them, and always the same merges."""
    points = np.array([[0.0], [0.0], [0.0], [10.0], [10.0], [20.0]])
    got = correlation.ward(points)
    assert got == correlation.ward(points) and np.allclose(sorted(m[2] for m in got), sorted(m[2] for m in naive_ward(points)))
    assert got[0][:2] == (0, 1) and [m[3] for m in got][-1] == 6


def test_cluster_map(spark):
    names = ["s2", "s1", "s3", "s0"]
    r = {("s0", "s1"): 0.9, ("s0", "s2"): 0.1, ("s0", "s3"): 0.2, ("s1", "s2"): 0.15, ("s1", "s3"): 0.1, ("s2", "s3"): 0.8}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in r.items()] + [(n, n, 1.0) for n in names], "a string, b string, r double")
    got = correlation.cluster_map(pairs).collect()
    assert {x.name: x.place for x in got if x.step < 0} == {"s0": 0, "s1": 1, "s2": 2, "s3": 3}
    assert [(x.left, x.right, x["size"]) for x in sorted(got) if x.step >= 0] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)]
    assert correlation.cluster_map(pairs.limit(0)).count() == 0
    for broken in (pairs.where("a != 's0'").unionByName(spark.createDataFrame([("s0", "s0", 1.0)], pairs.schema)), pairs.withColumn("r", F.lit(None).cast("double"))):
        with pytest.raises(Exception, match="no correlation"):
            correlation.cluster_map(broken).collect()
    with pytest.raises(Exception, match="more than 3"):
        correlation.cluster_map(pairs, most=3).collect()


# ---- padded rolling ---------------------------------------------------------


@pytest.mark.parametrize("dense", [False, True])
def test_padded_rolling(spark, dense):
    import pandas as pd

    rng = random.Random(6)
    rows = [(g, p, rng.randrange(50), rng.randrange(9)) for g, n in (("a", 30), ("b", 20), ("c", 1), ("d", 7)) for p in sorted(rng.sample(range(5, 60), n))]
    df = spark.createDataFrame(rows, "gene string, pos long, coverage long, mutant long").repartition(3)
    for win_len, step in ((10, 5), (4, 1), (3, 7), (1, 1)):
        want = set()
        for g in "abcd":
            own = [r for r in rows if r[0] == g]
            held = pd.DataFrame([r[1:] for r in own], columns=["pos", "coverage", "mutant"]).set_index("pos")
            if dense:
                held = held.reindex(range(held.index[0], held.index[-1] + 1), fill_value=0)
            n = win_len - len(held) % win_len
            whole = pd.concat([held.iloc[:1], held, pd.DataFrame(0, index=range(n), columns=held.columns)], ignore_index=True)
            sums = whole.rolling(window=win_len, step=step, min_periods=0).sum().iloc[1:]
            want |= {(g, int(i), int(c), int(m), round(m / c, 5) if c else None) for i, c, m in sums[sums.coverage >= 40].itertuples()}
        got = {tuple(r) for r in windows.padded_rolling(df, win_len, step, 40, dense).collect()}
        assert {r[:4] for r in got} == {r[:4] for r in want}
        assert all(abs(dict((r[:4], r[4]) for r in got)[r[:4]] - r[4]) < 1.1e-5 for r in want)


def test_pivot_pearson_in_tiles(spark, monkeypatch):
    """More groups than a task's matrix has: blocks of them, each pair by itself, rows with a hole left out."""
    monkeypatch.setattr(correlation, "WIDE", 4)
    rng = random.Random(11)
    rows = [(i if i else None, None if g == 7 else f"s{g}", 3.0 if g == 5 else 100 + rng.random()) for i in range(30) for g in range(23) for _ in range(2) if (i, g) not in ((3, 2), (9, 21))]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    import pandas as pd

    held = pd.DataFrame([(-1 if i is None else i, g or "null", v) for i, g, v in rows], columns=["i", "g", "v"])
    wide = held.pivot_table(index="i", columns="g", values="v").dropna()
    want = wide.corr()
    for groups in (None, sorted(want)):
        got = correlation.pivot_pearson(df, "i", "g", "v", groups).collect()
        assert len(got) == 23 * 24 // 2 and {(r.a, r.b) for r in got} == {(a, b) for a in want for b in want if a <= b}
        assert all(r.n == 28 and (r.r is None if "s5" in (r.a, r.b) else abs(r.r - want.loc[r.a, r.b]) < 1e-9) for r in got)


def test_tiles_send_no_blocks(spark, monkeypatch):
    """Blocks aren't sent to each tile, which would take the square of the groups: tiles read them from the shared
    folder. A block's rows are the same however its files and the tile's arrays divide them."""
    monkeypatch.setattr(correlation, "WIDE", 4)
    rng = random.Random(5)
    values = {(i, f"s{g}"): 50 + rng.random() for i in range(2500) for g in range(9)}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "i int, g string, v double").repartition(3)
    found = correlation.pivot_pearson(df, "i", "g", "v")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = np.corrcoef(np.array([[values[i, f"s{g}"] for g in range(9)] for i in range(2500)]).T)
    got = {(r.a, r.b): (r.r, r.n) for r in found.collect()}
    assert set(got) == {(f"s{a}", f"s{b}") for a in range(9) for b in range(a, 9)}
    assert all(n == 2500 and abs(r - want[int(a[1:]), int(b[1:])]) < 1e-9 for (a, b), (r, n) in got.items())
    assert [correlation.tile(k) for k in range(6)] == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]
