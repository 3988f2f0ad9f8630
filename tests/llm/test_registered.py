"""The registered queries that SQL can't express, as they are, against plain Python; and the
share of near pairs that are found where most of every text is the same."""

import os
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from nucleoframe.llm import neardup, packing, pii, quality, queries, textstats, tokencount, toxicity
from nucleoframe.llm.common import table

from .test_media_chat_tokens import VOCABULARY as PIECES
from .test_media_chat_tokens import best_segmentation
from .test_text_operators import VOCABULARY

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@needs_tables
@pytest.mark.parametrize(("name", "parts", "out"), [("op2_toxicity", 4, 2), ("op9_quality", 5, 0)])
def test_scores(spark, texts, name, parts, out):
    """Every score again, by the fitted model in plain numpy."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    if name == "op2_toxicity":
        model = toxicity.toxicity_model(docs, labels)
        score = lambda t: float(np.clip(model.score(np.array([toxicity.features(t, model.lexicon)])), 0, 1)[0])
    else:
        model = quality.quality_model(docs, labels)
        score = lambda t: float(model.score(np.array([textstats.statistics(t)]))[0])
    got = queries.QUERIES[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % parts == out)
        assert abs(r.score - score(texts[r.doc_id])) < 1e-9 and r.predicted == int(r.score >= 0.3)


@needs_tables
def test_packing_query(spark, texts):
    whole, want = Tokenizer.from_file(VOCABULARY), {}
    for i, t in texts.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), crc32(np.array(part, dtype="<u4").tobytes()))
    got = queries.QUERIES["op4_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([n for _, n, _ in want.values()])
    assert -(-int(lengths.sum()) // 2048) <= len(places) <= len(packing.best_fit(lengths, 2048))


@needs_tables
def test_pii_query(spark, texts):
    surrogates = pii.Surrogates(pii.key_of(spark))
    got = queries.QUERIES["op8_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        found = list(pii.entities(texts[r.doc_id] or ""))
        assert r.n_entities == len(found) and r.kinds == ",".join(sorted(k for _, _, k in found))
        assert r.text == (None if texts[r.doc_id] is None else pii.replaced(texts[r.doc_id], surrogates)[0])


@needs_tables
def test_token_count_query(spark, texts):
    pieces = dict(tokencount.read_pieces(PIECES))
    unknown, known = min(pieces.values()) - 10, {}
    for r in queries.QUERIES["op10_token_counts"](spark, SF).collect():
        words = tokencount.WORD.findall(texts[r.doc_id] or "")
        for w in set(words).difference(known):
            known[w] = best_segmentation(w, pieces, unknown)
        assert (r.n_words, r.n_tokens) == (len(words), sum(known[w] for w in words))


def boilerplate(n: int) -> list[tuple[int, str]]:
    """n / 2 pairs with a similarity of 0.80; texts of different pairs have 0.72, since 84 of
    their 100 shingles are the same everywhere."""
    shared, docs = [f"w{i}" for i in range(88)], []
    for k in range(n // 2):
        pair = [f"p{k}x{i}" for i in range(5)]
        docs += [(2 * k + side, " ".join([*shared, *pair, *(f"d{k}s{side}x{i}" for i in range(11))])) for side in (0, 1)]
    random.Random(1).shuffle(docs)
    return docs


def test_recall_where_most_text_is_shared(spark):
    docs = boilerplate(1000)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = sum(got[i] == got[i + 1] == i for i in range(0, len(docs), 2))
    assert found >= 0.99 * len(docs) / 2, found
