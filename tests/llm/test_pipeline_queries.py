import itertools
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nucleoframe.llm import common, packing, pii, quality, queries

from .conftest import BENCH, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A whole table folder: clean, junk, near and exact copies, a leak and personal data."""
    base = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, prose(i, 60 + i % 50).capitalize() + ".") for i in range(1, 200)]
    junk = [(i, prose(i, 40).upper().replace(" ", "!! ")) for i in range(1000, 1080)]
    near = [(2000 + i, clean[i][1] + " tail") for i in range(20)]
    leak = [(3000, prose(7776, 20) + " " + BENCH), (3001, BENCH)]
    private = [(4000, prose(7777, 80) + " mail zoe.99@mail1.example.com and 4041894974608795."), (4001, None), (4002, "")]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in [*clean, *junk, *near, *leak, *private]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, clean, junk


def test_stages(spark, small):
    import corpus_pipeline as p

    base, clean, junk = small
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality"]) & {i for i, _ in junk} == set()
    assert {i for i, _ in clean} <= set(seen["quality"])
    assert set(seen["near_duplicates"]) & set(range(2000, 2020)) == set() and {i for i, _ in clean} <= set(seen["near_duplicates"])
    assert set(seen["decontamination"]) & {3000, 3001} == set() and {i for i, _ in clean} <= set(seen["decontamination"])
    changed = {i for i, r in seen["pii"].items() if r.text != seen["decontamination"][i].text}
    assert changed == {4000} and not re.search("zoe.99|4041894974608795", seen["pii"][4000].text)
    packed = p.packing_stage(spark, docs, base).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])
    whole = p.run(spark, base)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_against_brute_force(spark, small):
    """Every stage on rows with null and repeated ids and columns of odd names, against
    plain Python over the stage's own input."""
    import corpus_pipeline as p
    from nucleoframe.llm import pii, quality, textstats

    from .test_text_operators import VOCABULARY, brute_components, brute_leaks

    base, clean, _ = small
    docs = spark.read.parquet(f"{base}/documents.parquet")
    near = clean[30][1].replace(" ", "  ")
    extra = [(None, clean[3][1]), (None, "so " + BENCH), (5000, clean[60][1] + " one more"), (5000, prose(991, 70)), (5001, prose(992, 70)), (5001, prose(992, 70)), (5002, near), (5003, BENCH.upper()), (5003, prose(993, 60)), (5004, "x " * 30_000)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in extra], docs.schema)
    docs = docs.unionByName(more).withColumns({"a.b": F.lit("dot"), "__n": F.lit(1), "__upper_share": F.lit(2.0), "id": F.lit(0), "item": F.lit("x"), "text_hash": F.lit(5), "salt": F.lit(6)})
    model = quality.quality_model(docs, spark.read.parquet(f"{base}/labels.parquet"))
    surrogates, key = pii.Surrogates(pii.key_of(spark)), lambda r: repr((r.doc_id, r.text))

    def by_quality(rows):
        return [r for r in rows if float(model.score(np.array([textstats.statistics(r.text)]))[0]) >= 0.3]

    def by_group(rows):
        # rows are compared by their own texts; rows of one id are one document
        known = [r for r in rows if r.doc_id is not None]
        of = {i: c for i, (_, c) in brute_components([(i, r.text) for i, r in enumerate(known)]).items()}
        group, least = {r.doc_id: r.doc_id for r in known}, {}
        for _ in known:  # the least id of each group, from row to row
            by_row = {}
            for i, r in enumerate(known):
                by_row[of[i]] = min(by_row.get(of[i], group[r.doc_id]), group[r.doc_id])
            for i, r in enumerate(known):
                group[r.doc_id] = min(group[r.doc_id], by_row[of[i]])
        for r in known:
            if group[r.doc_id] == r.doc_id:
                least[r.doc_id] = min(least.get(r.doc_id, r), r, key=lambda r: (r.text is not None, r.text))
        return [r for r in rows if r.doc_id is None] + list(least.values())

    def by_leak(rows):
        return [r for r in rows if not brute_leaks(r.text or "", BENCH)]

    want = {"quality": by_quality, "near_duplicates": by_group, "decontamination": by_leak}
    for name, stage in p.STAGES[:-1]:
        rows = docs.collect()
        out = stage(spark, docs, base)
        assert out.columns == docs.columns
        got = out.collect()
        if name in want:
            wanted = Counter(map(tuple, want[name](rows)))
            assert not (found := Counter(map(tuple, got))) - wanted and not wanted - found, (name, found - wanted, wanted - found)
        else:
            replaced = {(r.doc_id, r.text): pii.replaced(r.text, surrogates)[0] if r.text is not None else None for r in rows}
            assert sorted(map(key, got)) == sorted(repr((i, t)) for (i, _), t in replaced.items())
            assert all(r.n_chars == len(r.text or "") for r in got)
        docs = spark.createDataFrame(got, out.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert None in ids and 5001 in ids and 5002 not in ids
    pieces = p.packing_stage(spark, docs, base).collect()
    whole = Tokenizer.from_file(VOCABULARY)
    lengths = []
    for r in docs.collect():
        tokens = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        lengths += [(r.doc_id, k // 2048, len(tokens[k : k + 2048]), crc32(np.array(tokens[k : k + 2048], dtype="<u4").tobytes())) for k in range(0, len(tokens), 2048)]
    assert sorted(((r.doc_id, r.piece, r.length, r.ids_crc32) for r in pieces), key=repr) == sorted(lengths, key=repr)
    places = defaultdict(list)
    for r in pieces:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) == -(-sum(n for _, _, n, _ in lengths) // 2048)


def test_empty_tables(spark, small, tmp_path):
    import corpus_pipeline as p

    base, _, _ = small
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{base}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_folds(spark):
    got = queries.QUERIES["op9_quality"](spark, SF).agg(F.max("doc_id"), F.count_if("held_out")).first()
    assert got[1] == sum(crc32(str(i).encode()) % 5 == 0 for i in range(got[0] + 1))


def test_columns_of_clashing_names(spark):
    """Repeated ids, with columns named as the stage's own."""
    import corpus_pipeline as p

    docs = spark.createDataFrame([(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(3, 60))], "doc_id long, text string").withColumns({"__again": F.lit(1), "__row": F.lit(2), "__n": F.lit(3), "__id": F.lit(4), "__part": F.lit(5), "__dropped_0": F.lit(6)})
    out = p.near_duplicate_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_batches_are_bounded_by_bytes(spark):
    """Texts of any length come to the workers in batches of a few MB, with unchanged results."""
    docs = spark.createDataFrame([(i, prose(i % 5, 20_000)) for i in range(200)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    found = [r["size"] for r in common.map_batches(docs, sizes, "size long").collect()]
    assert sum(found) > 4 * common.BATCH_BYTES and max(found) < 1.2 * common.BATCH_BYTES
    key = pii.Key(bytes(32))
    scored = quality.with_statistics(docs, ["doc_id"]).collect()
    assert {r[0] for r in scored} == set(range(200)) and len({tuple(r)[1:] for r in scored}) == 5
    out, counted, _ = pii.pseudonymized(docs, key)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in docs.collect()}


def test_the_batch_size_of_a_session_stands(spark):
    was = spark.conf.get(common.BATCH_SETTING, None)
    try:
        spark.conf.set(common.BATCH_SETTING, "1m")
        common.map_batches(spark.range(1), iter, "id long")
        assert spark.conf.get(common.BATCH_SETTING) == "1m"
    finally:
        spark.conf.unset(common.BATCH_SETTING) if was is None else spark.conf.set(common.BATCH_SETTING, was)


def test_workers_keep_one_store():
    """A task of another operator drops the tokenizer and the ids that packing keeps in its worker."""
    path = public_tokenizers.path("word_bpe_49k.json")

    def packed(batches):
        packing.ids_of(path)
        yield from batches

    packing.drop_ids()
    assert list(common.in_worker(packed, iter("ab"), packing.drop_ids)) == ["a", "b"]
    assert list(common.in_worker(packed, iter("a"), packing.drop_ids)) == ["a"]
    assert packing.ids_of.cache_info().currsize == 1 and packing.ids_of.cache_info().hits == 1
    assert list(common.in_worker(lambda batches: batches, iter("a"), None)) == ["a"]
    assert packing.ids_of.cache_info().currsize == 0
