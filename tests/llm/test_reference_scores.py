"""The classifiers' features and scores against small versions of their own: plain loops over
characters and words, trees and rules walked node by node, blocks of the calibration by hand."""

import math
import os
import random

import numpy as np
import pytest

from nucleoframe.llm import quality, queries, textstats, toxicity
from nucleoframe.llm.common import table

from .conftest import edge_texts, prose

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain_statistics(text):
    """textstats.STATISTICS, one byte and one word after the other."""
    text = text or ""
    raw = text.encode()
    n = max(len(raw), 1)
    kinds = {"upper": 0, "digit": 0, "prose": 0, "loud": 0, "symbol": 0, "pipe": 0, "space": 0, "bracket": 0}
    words, word = [], b""
    for b in raw:
        c = chr(b)
        kinds["upper"] += "A" <= c <= "Z"
        kinds["digit"] += "0" <= c <= "9"
        kinds["prose"] += c in ".,;:'\"()-?"
        kinds["loud"] += c == "!"
        kinds["symbol"] += c in "#$%&*+/<=>@[\\]^_`{|}~"
        kinds["pipe"] += c == "|"
        kinds["space"] += c in " \t\n\r\x0b\x0c"
        kinds["bracket"] += c in "()[]{}"
        if c in " \t\n\r\x0b\x0c":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    words += [word] if word else []
    w = max(len(words), 1)
    counts = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    bits = len(words).bit_length()
    shouted = sum(1 for x in counts if len(x) > 1 and any(65 <= b <= 90 for b in x) and not any(97 <= b <= 122 for b in x))
    return [
        bits + len(words) / 2**bits, sum(len(x) for x in words) / w, kinds["upper"] / n, kinds["digit"] / n, kinds["prose"] / n, kinds["loud"] / n, kinds["symbol"] / n, kinds["pipe"] / n,
        (len(raw) - kinds["space"] - kinds["digit"] - kinds["prose"] - kinds["symbol"] - kinds["loud"]) / n, len(counts) / w, max(counts.values(), default=0) / w,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, 1 - len(set(lines)) / k if lines else 0.0, float(len(lines).bit_length()), len(words) / k,
        shouted / max(len(counts), 1), sum(65 <= x[0] <= 90 for x in words) / w, sum(chr(x[-1]) in "!#$%&*+/<=>@\\^_`|~" for x in words) / w,
        sum(chr(x[-1]) in ".!?" for x in words) / w, sum(len(x) < 4 for x in words) / w, sum(len(x) > 12 for x in words) / w, 1 - len(text) / n if text else 0.0, kinds["bracket"] / n,
    ]


def plain_words(low):
    out, word = [], ""
    for c in low + " ":
        if c.isalnum() or c == "_":
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def plain_masked(low):
    """Parts of runs that have a letter, then a sign or a digit, then a letter, without a stop between."""
    out, run = [], ""
    for c in low + " ":
        if c.isalnum() or c in "_@$*!+.-":
            run += c
            continue
        whole, run = run, ""
        if len(whole) < 3 or whole.isalpha() or whole.isdigit() or not any(x in "0123456789@$*!+" for x in whole):
            continue
        letters = [i for i, x in enumerate(whole) if x.isalpha()]
        ends = [i for i in letters[1:] if any(x in "0123456789@$*!+" for x in whole[max(letters[0] + 1, 1 + max([j for j in range(i) if whole[j] in ".-"], default=-1)) : i])]
        if ends:
            out.append(whole[letters[0] : ends[-1] + 1])
    return out


def plain_features(text, lexicon):
    """toxicity.FEATURES; distances are those of all pairs of places."""
    text = text or ""
    raw, words = text.encode(), plain_words(text.lower())
    n, size = max(len(words), 1), max(len(raw), 1)
    is_hit = [x in lexicon for x in words]
    is_stem = [any(len(x) >= k and x[:k] + "*" in lexicon for k in (4, 5, 6)) for x in words]
    hits = sum(is_hit)
    strong = sum(h and lexicon[x] >= 4 for h, x in zip(is_hit, words))
    person = [i for i, x in enumerate(words) if x in toxicity.SECOND]
    marked = [i for i, (a, b) in enumerate(zip(is_hit, is_stem)) if a or b]
    distance = min([20, *(abs(i - j) for i in marked for j in person)])
    runs = plain_masked(text.lower())
    signs = dict(zip("013457@$!+", "oleastasit")) | dict.fromkeys("*.-_", "")
    long_runs = sum(any(a.isalpha() and a == b == c for a, b, c in zip(x, x[1:], x[2:])) for x in set(words))
    return [
        math.log1p(len(words)), 100 * hits / n, math.log1p(hits), float(len({x for x in words if x in lexicon})), 100 * strong / n, math.log1p(strong),
        sum(lexicon[x] for x in words if x in lexicon) / n, max([lexicon[x] for x in words if x in lexicon], default=0.0), 100 * sum(is_stem) / n, math.log1p(sum(is_stem)),
        len(person) / n, float(distance), sum(65 <= b <= 90 for b in raw) / size, sum(chr(b) in ".,;:'\"()-?!" for b in raw) / size, sum(chr(b) in "!?" for b in raw) / size,
        len(runs) / n, float(sum("".join(signs.get(c, c) for c in r) in lexicon for r in runs)), long_runs / max(len(set(words)), 1),
    ]


def odd_texts():
    rng = random.Random(12)
    pieces = ["You", "your", "id1ot", "s.c.u.m", "tr@shy!", "moron", "moronic", "LOUD!!", "soooo", "a|b", "(x)", "[y]", "1234", "ok.", "ok.", "éé", "\n", "\n\n", "\t", "12-a3b", "-a*b.c1d", "_x_", "..", "ÀBC", "日本1語"]
    return [" ".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(400)] + [t for _, t in edge_texts() if t is None or len(t) < 5000] + [prose(5, 80)]


LEXICON = {"idiot": 5.0, "moron": 3.5, "moro*": 3.0, "trash*": 4.5, "trashy": 2.5, "scum": 6.0, "soooo": 1.0, "moronic": 4.0}


def test_statistics_by_loops():
    for t in odd_texts():
        got, want = textstats.statistics(t), plain_statistics(t)
        assert np.allclose(got, want, atol=1e-12), [(n, a, b) for n, a, b in zip(textstats.STATISTICS, got, want) if abs(a - b) > 1e-12] + [t]


def test_features_by_loops():
    for t in odd_texts():
        got, want = toxicity.features(t, LEXICON), plain_features(t, LEXICON)
        assert np.allclose(got, want, atol=1e-12), [(n, a, b) for n, a, b in zip(toxicity.FEATURES, got, want) if abs(a - b) > 1e-12] + [t]


def walked_tree(tree, x):
    node = 0
    while tree.feature[node] >= 0:
        node = tree.left[node] if x[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
    return tree.value[node]


@needs_tables
def test_queries_by_loops(spark):
    """The registered queries' scores from the fitted numbers alone: trees, rules and knots."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic, rules = toxicity.toxicity_model(docs, labels), quality.quality_model(docs, labels)
    assert rules.rules and toxic.model[1]
    bias, trees = toxic.model
    for r in queries.QUERIES["op2_toxicity"](spark, SF).collect():
        x = plain_features(texts[r.doc_id], toxic.lexicon)
        raw = bias + sum(walked_tree(t, x) for t in trees)
        xs, ys = (list(map(float, k)) for k in toxic.knots)
        at = sum(k <= raw for k in xs)
        want = ys[0] if at == 0 else ys[-1] if at == len(xs) else ys[at - 1] + (ys[at] - ys[at - 1]) * (raw - xs[at - 1]) / (xs[at] - xs[at - 1])
        assert abs(r.score - min(max(want, 0.0), 1.0)) < 1e-9
    for r in queries.QUERIES["op9_quality"](spark, SF).collect():
        x, total = plain_statistics(texts[r.doc_id]), rules.bias
        for rule, weight in zip(rules.rules, rules.weights):
            if all(x[f] <= t if low else x[f] > t for f, low, t in rule):
                total += weight
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_equal_texts_with_different_labels(spark):
    """They count once for the lexicon, and in one half; the fit is the same in any order of rows."""
    docs = [(i, f"some words number {i % 90} and {'moronic' if i % 3 == 0 else 'kind'} talk {i % 7}") for i in range(270)]
    labels = [(i, int(i % 3 == 0 and i < 240)) for i in range(270)]
    make = lambda d, s: spark.createDataFrame(d, s)
    scores = []
    for turn in (1, -1):
        d, y = make(docs[::turn], "doc_id long, text string").repartition(3), make(labels[::turn], "doc_id long, toxic int").repartition(2)
        sample = toxicity.labelled_sample(d, y, "toxic", 4, 2, 20_000)
        once = toxicity.distinct_texts(sample)
        assert once.count() == sample.select("text").distinct().count()
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.classify_toxicity(d, y).collect()))
    assert scores[0] == scores[1]
