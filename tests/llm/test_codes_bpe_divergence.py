"""Vector codes, byte-level BPE and the audit of sources, against plain Python."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache, reduce

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nucleoframe.llm import bytebpe, codes, divergence, queries
from nucleoframe.llm.common import table

from .conftest import edge_texts, prose

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- vector codes -----------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label). Every part against every entry, in Python's integers."""
    kept = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(-(-max((len(v) for _, v, _ in kept), default=0) // parts), 1) * parts
    whole = lambda v: [codes.integer(c) for c in v] + [0] * (width - len(v))
    first: dict = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: (i is None, i))[:entries]
    step = width // parts
    cut = lambda v: [v[p * step : (p + 1) * step] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(whole(first[i])) for i in order))]
    vectors = [cut(whole(v)) for _, v, _ in kept]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        of = [[near(x, b)[1] for x, b in zip(v, books)] for v in vectors]
        for p, book in enumerate(books):
            for k in range(len(book)):
                own = [v[p] for v, a in zip(vectors, of) if a[p] == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for (i, _, label), v in zip(kept, vectors):
        found = [near(x, b) for x, b in zip(v, books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), codes.LONGEST), label))
    sums = Counter()
    for *_, error, label in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, code, error, min(sums[label], codes.LONGEST), digest) for i, code, error, label in out), key=repr)


def of_rows(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "code": F.lit("x"), "vector": F.lit(2), "a.b": F.lit(3)}).repartition(3)
    coded, books = codes.compress(df, **how)
    out = codes.with_label_errors(coded).withColumn("h", F.lit(codes.codebooks_digest(books)))
    return sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error", "h").collect()), key=repr)


def test_codes_against_brute_force(spark):
    """Nulls, numbers that aren't finite, repeated ids and vectors, ties, other lengths."""
    rng = random.Random(5)
    rows = [(i, [rng.randint(-3, 3) / rng.choice((1, 4, 300)) for _ in range(32)], rng.choice((None, 1, 2))) for i in range(150)]
    rows += [(3, rows[9][1], 1), (3, rows[8][1], 2), (500, rows[7][1], 1), (None, rows[7][1], None), (None, rows[6][1], 7)]
    rows += [(501, None, 1), (502, [None] * 32, 1), (503, [1.0] * 31 + [None], 1), (504, [math.nan] * 32, 1), (0, [math.inf] * 32, 1), (505, [], 1), (506, [0.5] * 5, 1), (507, [-0.0] * 32, 1)]
    for how in ({}, {"entries": 5, "rounds": 1, "parts": 4}, {"entries": 200, "parts": 1}):
        assert of_rows(spark, rows, **how) == brute_codes(rows, how.get("parts", 16), how.get("entries", 64), how.get("rounds", 2))


def test_codes_of_large_numbers_and_few_rows(spark):
    large = [(i, [(-1) ** i * 10.0 ** (k + i % 3) for k in range(16)], 1) for i in range(12)] + [(20, [1e300] * 16, 2), (21, [-1.7e308] * 16, 2), (22, [0.25] * 16, None)]
    for rows in (large, large[-1:], [(1, [], None)], [(1, None, 2)], []):
        want = brute_codes(rows, 16, 4, 2) if any(v is not None for _, v, _ in rows) else []
        assert of_rows(spark, rows, entries=4) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 17), st.sampled_from((3, 200, 4_000_000)), st.integers(0, 10**6))
def test_bounds_keep_the_nearest_entry(n, entries, width, most, seed):
    rng = np.random.default_rng(seed)
    rows, book = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (entries, width))
    rows[: n // 3] = book[rng.integers(0, entries, n // 3)]  # exact hits, and entries that are there twice
    book[entries // 2] = book[0]
    index, distance, _ = codes.Book(book.tolist()).nearest(rows)
    exact = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert distance.tolist() == exact.min(axis=1).tolist() and index.tolist() == exact.argmin(axis=1).tolist()


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    book = rng.integers(-4000, 4000, (64, 16))
    rows = book[rng.integers(0, 64, 2000)] + rng.integers(-300, 300, (2000, 16))
    *_, exact = codes.Book(book.tolist()).nearest(rows)
    assert exact < 2000 * 64 / 8, exact


# ---- byte-level BPE ---------------------------------------------------------


@lru_cache(maxsize=1)
def engine_of_library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def library():
    return engine_of_library()


PIECES = ["'s", "'re", "'ll", "'ve", "'m", "'", "' ", "s", "re", " ", "  ", "\n", "\r\n", "\t", "　", " ", "\u0085", "\x1c", "a", "Zb", "é", "日本", "9", "٣", "½", "!", "?!", "<|endoftext|>", "😀", "́", "\x00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=2), max_size=12).map("".join), max_size=5), st.integers(9, 40))
def test_boundaries_and_ids(texts, size):
    """As the library's pattern and merges, for several texts at once and in windows."""
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    engine = engine_of_library()
    raws = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    starts = np.cumsum([0, *map(len, raws)])[:-1]
    whole = np.concatenate([*raws, np.zeros(0, np.uint8)])
    found = bytebpe.boundaries(whole, starts[[len(r) > 0 for r in raws]] if texts else np.zeros(0, np.int64))
    store = bytebpe.slices_of(RANKS)
    for t, raw, at in zip(texts, raws, starts):
        own = found[(found >= at) & (found < at + len(raw))] - at
        ids, offsets, _ = store.encoded(raw, own)
        assert ids.tolist() == engine.encode_ordinary(t)
        tokens = [engine.decode_single_token_bytes(i) for i in ids.tolist()]
        assert offsets.tolist() == [0, *itertools.accumulate(map(len, tokens))][:-1]
        parts = list(bytebpe.windows(raw, size))
        assert [a + x for a, _, f in parts for x in f.tolist()] == own.tolist()
        assert b"".join(raw[a:b].tobytes() for a, b, _ in parts) == raw.tobytes()


def test_products_are_associative():
    tool = bytebpe.scan()
    n = len(tool.from_done)
    mul = lambda a, b: int(tool.product[a * tool.width + b])
    assert all(mul(mul(a, b), c) == mul(a, mul(b, c)) for a in range(n) for b in range(n) for c in range(n))
    rng = np.random.default_rng(3)
    elements = tool.element[rng.integers(0, len(tool.element), 40_000)]
    got = tool.prefixes(elements, 16)
    assert got.tolist() == list(itertools.accumulate(elements.tolist(), mul)) and got[-1] == reduce(mul, elements.tolist())


def test_encode_and_decode(spark, edge, empty, library):
    extra = [(100, "x" * 300_000), (101, " " * 50_000 + "end"), (102, "'" * 3000), (103, "日本語" * 20_000), (104, "a'll'll" * 9000)]
    docs = edge.select("doc_id", "text", "id", "score").unionByName(spark.createDataFrame([(i, t, "x", 1.0) for i, t in extra], "doc_id long, text string, id string, score double")).withColumns({"ids": F.lit(1), "offsets": F.lit(2), "a.b": F.lit(3), "decoded": F.lit(4)})
    for window in (1 << 20, 700):
        got = bytebpe.decode(bytebpe.encode(docs, RANKS, window_bytes=window), RANKS, most_bytes=5000).collect()
        want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in [*edge_texts(), *extra]]
        assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    assert bytebpe.round_trip(empty, RANKS).count() == 0
    wrong = spark.createDataFrame([(1, [5, 6], [0, 7])], bytebpe.ENCODED)
    with pytest.raises(Exception, match="don't agree"):
        bytebpe.decode(wrong, RANKS).collect()


def test_the_store_is_begun_anew(library):
    store = bytebpe.Slices(bytebpe.read_ranks(RANKS), most=20)
    for k in range(50):
        text = prose(k, 30)
        raw = np.frombuffer(text.encode(), np.uint8)
        store.settle()
        assert store.encoded(raw, bytebpe.boundaries(raw, np.zeros(1, np.int64)))[0].tolist() == library.encode_ordinary(text)
    assert len(store) < 200


@needs_tables
def test_byte_bpe_query(spark, library):
    want = []
    for r in table(spark, SF, "documents").collect():
        ids, digest = library.encode_ordinary(r.text or ""), lambda x: hashlib.sha256(x).hexdigest()
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode())))
    got = queries.QUERIES["op12_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# ---- divergence of sources --------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, least_docs, top):
    """rows: (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        documents[lang or ""].update(set(found))
    out = set()
    for lang in documents:
        kept = sorted(t for t, n in documents[lang].items() if n >= least_docs)
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        total = Counter()
        for c in groups.values():
            total.update({t: c[t] for t in kept})

        def share(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        shares, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s, p in shares.items():
            far = sorted((-sum(abs(p[t] - r[t]) for t in kept), o.encode()) for o, r in shares.items() if o != s)
            more = sorted((q[t] - p[t], t.encode()) for t in kept if groups[s][t] and p[t] > q[t])[:top]
            for part, listed in (("pair", far), ("term", more)):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(listed, 1)}
    return out


def test_divergence_against_brute_force(spark, empty):
    """Nulls, empty groups and languages, other scripts, capitals, ties, many chunks, blocks
    and segments."""
    rng, rows = random.Random(8), []
    words = ["alpha", "Beta", "ALPHA", "été", "ÉTÉ", "日本", "x1y", "a_b", "it's", "Ω", "z", "q\x7fr", "[w]"] + [f"w{chr(97 + i)}" for i in range(26)]
    for k in range(220):
        lang, source = rng.choice(("en", "de", None)), rng.choice(("s1", "s2", "S3", None, "é", "s5"))
        rows.append((" ".join(rng.choice(words[: 8 + 7 * (len(source or "") % 4)]) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "none"), ("", "en", "blank"), ("word", "fr", "only"), (None, "", "s1"), ("once upon", "it", "a"), ("a time", "it", "b"), ("wa " * 5000, "en", "s1")] + [("Wa", "en", "s1")] * 40
    schema = "text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).withColumns({"term": F.lit(1), "n": F.lit("x"), "chunk": F.lit(2), "docs": F.lit(0), "block": F.lit(9)}).repartition(5)
    for how in ({"least_docs": 30}, {"least_docs": 3, "chunk": 4, "block": 2, "segment": 2}, {"least_docs": 1, "chunk": 5, "block": 1, "segment": 1}, {"least_docs": 10**6}):
        got = [tuple(r) for r in divergence.divergence(df, top_terms=6, **how).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, how["least_docs"], 6), how
    assert divergence.divergence(empty).count() == 0


def test_shares_are_exact():
    """Beyond 64-bit products too, as Spark computes them and as the tasks do."""
    for counts, total, terms in (([0, 1, 7], 8, 3), ([10**12, 5, 0], 10**12 + 5, 3), ([9_223_372_031, 1], 9_223_372_032, 2), ([10**17], 10**18, 10**6)):
        want = [1 + 10**9 * (c + 5) // (total + 5 * terms) for c in counts]
        assert divergence.shares(np.array(counts), total, terms).tolist() == want


def test_shares_in_spark(spark):
    rows = [(c, t, v) for c, t, v in ((0, 8, 3), (10**12, 10**12 + 5, 3), (10**17, 10**18, 10**6), (10**18, 10**18, 1), (7, 7, 1))]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = df.select("c", "t", "v", divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.t + 5 * r.v) for r in got)


def test_counts_are_drained(spark):
    docs = spark.createDataFrame([(prose(k, 40), "en", "s") for k in range(60)], "text string, lang string, source string").coalesce(1)
    few, many = (sorted(map(tuple, divergence.term_counts(docs, most=n).collect())) for n in (10, 10**6))
    assert few == many
