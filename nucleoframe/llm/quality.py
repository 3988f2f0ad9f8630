"""Quality classifier: a sparse rule ensemble.

Boosted trees over text statistics are taken apart into their paths; each path is a
conjunctive rule. Lasso logistic regression keeps few rules, and the kept ones are
compiled into one Spark column expression over the statistics columns.

The fit uses a bounded sample of labelled rows (parameter `most`) outside the held-out
fold. Cases: null and empty texts are scored by their (zero) statistics; without labels
of both kinds every score is the labels' mean, or 0.5 where there are none; where the
sample is too small or too even for a rule, it is the mean too; repeated rows get equal
scores, and a repeated id counts once in the fit; a row without an id is scored and isn't
held out; very long texts take time in proportion to their length; empty tables give no
rows; other columns may have any name, since the statistics' names avoid them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, map_batches, quoted
from .samples import labelled_sample
from .textstats import STATISTICS, statistics
from .trees import Tree, boost, lasso_logistic, sigmoid

#: A rule: conditions (statistic, is "<=", threshold), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def prefix_of(carried: list[str]) -> str:
    """What the names of the statistics begin with, and no carried column does."""
    return free_name(carried, "__")


def with_statistics(df: DataFrame, carried: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns, as they are, and STATISTICS of each row's whole text in
    columns of these names with prefix_of(carried) in front."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    # a text that is carried anyway isn't sent a second time
    twice = text_col not in carried or df.schema[text_col].dataType.typeName() != "string"
    # the workers' side takes columns by place, under names without dots
    prefix = prefix_of(carried)
    fields = df.select(*[F.col(quoted(c)) for c in carried]).schema.fields
    sent = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carried)]
    held = df.select(*sent, *([F.col(text_col).cast("string").alias("text")] if twice else []))
    schema = StructType([*fields, *[StructField(f"{prefix}{s}", DoubleType()) for s in STATISTICS]])
    arrow, at, kept = to_arrow_schema(schema), -1 if twice else carried.index(text_col), len(carried)

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.columns[at]], dtype=float).reshape(-1, len(STATISTICS))
            columns = [*batch.columns[:kept], *[pa.array(c) for c in found.T]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return map_batches(held, run, schema)


def rules_of(trees: list[Tree]) -> list[Rule]:
    """The distinct paths from the roots, as conjunctions with one bound for each side."""
    found: dict[Rule, None] = {}

    def walk(tree: Tree, node: int, path: dict) -> None:
        if path:
            found[tuple(sorted((f, low, t) for (f, low), t in path.items()))] = None
        f, t = tree.feature[node], tree.threshold[node]
        if f >= 0:
            for low, child in ((True, tree.left[node]), (False, tree.right[node])):
                was = path.get((f, low), t)
                walk(tree, child, path | {(f, low): min(was, t) if low else max(was, t)})

    for tree in trees:
        walk(tree, 0, {})
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, low, t in rule:
        out &= x[:, f] <= t if low else x[:, f] > t
    return out


@dataclass
class Rules:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, prefix: str = "__") -> Column:
        """The score as a column expression over the statistics columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            both = F.lit(True)
            for f, low, t in rule:
                value = F.col(f"{prefix}{STATISTICS[f]}")
                both = both & (value <= F.lit(t) if low else value > F.lit(t))
            total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in zip(self.rules, self.weights):
            z += weight * holds(rule, x)
        return sigmoid(z)


def fit_rules(x: np.ndarray, y: np.ndarray, penalties=(0.004, 0.002, 0.001, 0.0005)) -> Rules:
    """The penalty is the one with the least log loss on every fifth row. Without labels of
    both kinds, or without a rule that divides the rows, there is the bias alone."""
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 0.5
    mean = Rules([], [], float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return mean
    check = np.arange(len(y)) % 5 == 4
    _, trees = boost(x[~check], y[~check], rounds=40, depth=3)
    rules = rules_of(trees)
    if not rules:
        return mean
    a = np.stack([holds(r, x) for r in rules], axis=1)
    _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows say the same
    first = [i for i in sorted(first) if 0.002 <= a[:, i].mean() <= 0.998]
    if not first:
        return mean
    rules, a = [rules[i] for i in first], a[:, first].astype(float)
    best = (np.inf, penalties[0])
    for penalty in penalties:
        w, b = lasso_logistic(a[~check], y[~check], penalty)
        p = np.clip(sigmoid(a[check] @ w + b), 1e-9, 1 - 1e-9)
        best = min(best, (float(-np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))), penalty))
    w, b = lasso_logistic(a, y, best[1], steps=600)
    kept = [i for i in np.flatnonzero(np.abs(w) > 1e-6)]
    return Rules([rules[i] for i in kept], [float(w[i]) for i in kept], float(b))


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 5, held_out: int = 0, most: int = 20_000) -> Rules:
    """Fits on at most `most` labelled rows; only their statistics reach the driver."""
    sample = with_statistics(labelled_sample(docs, labels, label, parts, held_out, most), ["doc_id", "y"])
    found = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    return fit_rules(found[[f"__{s}" for s in STATISTICS]].to_numpy(dtype=float), found["y"].to_numpy(dtype=float))


def of_quality(docs: DataFrame, model: Rules, threshold: float = 0.3) -> DataFrame:
    """The rows of docs with a score of at least the threshold; columns stay as they are."""
    score = model.column(prefix_of(docs.columns))
    return with_statistics(docs, docs.columns).where(score >= threshold).select(*[F.col(quoted(c)) for c in docs.columns])


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = quality_model(docs, labels)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = with_statistics(keyed, ["doc_id"]).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
