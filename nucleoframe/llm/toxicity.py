"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features are densities of a lexicon, distance to second-person words, capitals,
punctuation and obfuscation rates. The lexicon (words and stems with their
log odds) is learnt from the labelled rows; for fitting, each row's features come from
the lexicon of the other half of the texts, and the calibration uses scores of models
that haven't seen the row.

The fit uses a bounded sample of labelled rows (parameter `most`) outside the held-out
fold. Every token of the sample with enough positive documents and odds is in the lexicon.

Cases: null and empty texts have zero features; without labels of both kinds every score
is the labels' mean, or 0.5; a sample with few rows or constant features gives few or no
trees; repeated rows get equal scores, and a repeated id counts once in the fit; equal texts
with different labels are toxic for the lexicon and keep their labels for the trees; a row
without an id is scored and isn't held out; very long texts and runs without white space
take time in proportion to their length; ties in scores share a calibration block; empty
tables give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sink, fold, rows, written
from .samples import labelled_sample
from .trees import boost, isotonic, out_of_fold, raw_score

WORD = re.compile(r"\w+")
#: Runs of letters, digits and signs; those with a mask are found by masked().
RUN = re.compile(r"[\w@$*!.+-]+")
MASKS = re.compile(r"[0-9@$*!+]")
NO_MASKS = str.maketrans("", "", "0123456789@$*!+")
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!+", "oleastasit", "*.-_")
LONG_RUN = re.compile(r"([^\W\d_])\1{2,}")
#: Second-person words of the four languages.
SECOND = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem ihr euch euer eure tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros tus tuyo tuya os vuestro vuestra".split()
)
UPPER, MARKS, LOUD = bytes(range(65, 91)), b".,;:'\"()-?!", b"!?"

FEATURES = (
    "log_words", "hits_per_100", "log_hits", "distinct_hits", "strong_per_100", "log_strong", "odds_per_word", "top_odds", "stem_hits_per_100", "log_stem_hits",
    "second_person_share", "second_person_distance", "upper_share", "mark_share", "loud_share", "masked_share", "masked_hits", "long_run_share",
)
STEMS = (4, 5, 6)


def masked(low: str) -> list[str]:
    """Of each run without white space the part from its first letter to its last letter
    that has a digit or a masking sign before it, with no full stop or hyphen between."""
    out = []
    if MASKS.search(low) is None:
        return out
    for run in RUN.findall(low):
        if len(run) < 3 or run.isalpha() or run.isdigit() or len(run.translate(NO_MASKS)) == len(run):
            continue
        first = next((i for i, c in enumerate(run) if c.isalpha()), None)
        if first is None:
            continue
        end, mask = 0, False
        for i in range(first + 1, len(run)):
            c = run[i]
            if c in ".-":
                mask = False
            elif c in "0123456789@$*!+":
                mask = True
            elif mask and c.isalpha():
                end = i + 1
        if end:
            out.append(run[first:end])
    return out


def tokens(words: set[str]) -> set[str]:
    """Distinct words and their stems, which are marked by a star."""
    return words.union(*({w[:k] + "*" for w in words if len(w) >= k} for k in STEMS))


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Values of FEATURES."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n = len(words) or 1
    distinct = set(words)
    hit = {w: lexicon[w] for w in distinct if w in lexicon}
    stems = {w for w in distinct if any(w[:k] + "*" in lexicon for k in STEMS)}
    counts = Counter(w for w in words if w in hit or w in stems) if hit or stems else {}
    hits = sum(counts[w] for w in hit)
    strong = sum(counts[w] for w, odds in hit.items() if odds >= 4)
    person = SECOND & distinct
    distance = 20
    if person and counts:
        near = [i for i, w in enumerate(words) if w in counts]
        second = np.array([i for i, w in enumerate(words) if w in person])
        at = np.searchsorted(second, near)
        after = second[np.minimum(at, len(second) - 1)] - near
        before = near - second[np.maximum(at - 1, 0)]
        gaps = np.concatenate([np.abs(after), np.abs(before)])
        distance = int(min(20, gaps.min()))
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw) or 1
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / size
    runs = masked(low)
    plain = [m.translate(SIGNS) for m in runs]
    stem_hits = sum(counts[w] for w in stems)
    return [
        float(np.log1p(len(words))), 100 * hits / n, float(np.log1p(hits)), float(len(hit)), 100 * strong / n, float(np.log1p(strong)),
        sum(hit[w] * counts[w] for w in hit) / n, max(hit.values(), default=0.0), 100 * stem_hits / n, float(np.log1p(stem_hits)),
        sum(1 for w in words if w in person) / n if person else 0.0, float(distance), share(UPPER), share(MARKS), share(LOUD),
        len(runs) / n, float(sum(1 for p in plain if p in lexicon)), sum(1 for w in distinct if LONG_RUN.search(w)) / (len(distinct) or 1),
    ]


def half_of() -> Column:
    """The half that a text is in: its copies are in the same, so none of them tells of the other."""
    return F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2)).cast("int")


def distinct_texts(sample: DataFrame) -> DataFrame:
    """(text, y, half): equal texts once, as positive if one of them is."""
    return sample.groupBy("text").agg(F.max("y").alias("y")).withColumn("half", half_of())


def lexicon_counts(sample: DataFrame, most_kept: int = 300_000) -> DataFrame:
    """(token, half, pos, neg): documents of each label that hold the token, by half of
    the texts. Counts are combined before the shuffle."""
    schema = pa.schema([("token", pa.string()), ("half", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches):
        held: dict = {}
        sink = Sink(schema)
        for half, y, text in rows(batches):
            for token in tokens(set(WORD.findall((text or "").lower()))):
                cell = held.setdefault((token, half), [0, 0])
                cell[0 if y else 1] += 1
            if len(held) > most_kept:
                for (token, h), (pos, neg) in held.items():
                    sink.add(token, h, pos, neg)
                    if sink.full():
                        yield sink.take()
                held = {}
        for (token, h), (pos, neg) in held.items():
            sink.add(token, h, pos, neg)
            if sink.full():
                yield sink.take()
        yield sink.take()

    partial = distinct_texts(sample).select("half", "y", "text").mapInArrow(run, "token string, half int, pos long, neg long")
    return partial.groupBy("token").agg(
        *[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for c in ("pos", "neg") for h in (0, 1)]
    )


def lexicons(counted: DataFrame, totals: list[list[int]], least: int, ratio: float) -> list[dict[str, float]]:
    """The lexicons of half 0, half 1 and of all rows: tokens of at least `least` positive
    documents of a half, with the odds. The sample's size bounds what reaches the driver."""
    out = []
    for halves in ((0,), (1,), (0, 1)):
        pos = sum((F.col(f"pos{h}") for h in halves[1:]), F.col(f"pos{halves[0]}"))
        neg = sum((F.col(f"neg{h}") for h in halves[1:]), F.col(f"neg{halves[0]}"))
        positives, negatives = (sum(totals[h][k] for h in halves) for k in (1, 0))
        odds = F.log((pos + 0.5) / (positives + 1.0)) - F.log((neg + 0.5) / (negatives + 1.0))
        found = counted.select("token", pos.alias("pos"), odds.alias("odds"))
        found = found.where((F.col("pos") >= least * len(halves)) & (F.col("odds") >= float(np.log(ratio))))
        out.append({r.token: float(r.odds) for r in found.collect()})
    return out


@dataclass
class Toxicity:
    lexicon: dict[str, float]
    model: tuple
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(raw_score(self.model, x), *self.knots)


def featured(df: DataFrame, carried: list[str], lexicon_of, ddl: str) -> DataFrame:
    """Carried columns and features; lexicon_of(row) gives the lexicon that a row takes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        sink = Sink(arrow)
        for *kept, text in rows(batches):
            sink.add(*kept, features(text, lexicon_of(kept)))
            if sink.full():
                yield sink.take()
        yield sink.take()

    return df.select(*carried, F.col("text")).mapInArrow(run, ddl)


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held_out: int = 2, most: int = 20_000, least: int = 4, ratio: float = 6.0) -> Toxicity:
    """Fits on at most `most` labelled rows; only features and the lexicon reach the driver."""
    sample = written(labelled_sample(docs, labels, label, parts, held_out, most), "labelled")
    totals = [[0, 0], [0, 0]]
    for r in distinct_texts(sample).groupBy("half", "y").count().collect():
        totals[r["half"]][1 if r["y"] else 0] += r["count"]
    first, second, whole = lexicons(written(lexicon_counts(sample), "lexicon"), totals, least, ratio)
    other = {0: second, 1: first}
    x = featured(sample.withColumn("half", half_of()), ["doc_id", "half", "y"], lambda kept: other[kept[1]], "doc_id long, half int, y int, x array<double>")
    found = x.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    y = found["y"].to_numpy(dtype=float)
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(y), len(FEATURES))
    model = boost(x, y)
    raw = out_of_fold(x, y, np.arange(len(y)) % 3) if model[1] else np.full(len(y), model[0])
    return Toxicity(whole, model, isotonic(raw, y))


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= threshold) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = np.array([features(t.as_py(), model.lexicon) for t in part.column(1)]).reshape(-1, len(FEATURES))
                score = np.clip(model.score(x), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, score double, predicted int")


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = score_toxicity(docs, toxicity_model(docs, labels))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
