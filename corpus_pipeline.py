"""The corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
in the shared folder and read again as the next stage's docs. All but the last return
the columns of docs, whatever their names and whatever other columns there are.

Common to all stages: null and empty texts are documents without words; very long texts
are read whole; an empty table gives an empty result; tables of labels or of the benchmark
may be empty. Each stage's own cases are in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nucleoframe.llm import decontaminate, neardup, packing, pii, quality
from nucleoframe.llm.common import free_name, quoted, table, written


def columns_of(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def without(docs: DataFrame, dropped: DataFrame, keys: dict) -> DataFrame:
    """The rows of docs whose keys (name in `dropped`: expression over docs) aren't in
    `dropped`, a written table; nulls are equal. Spark broadcasts it only if its files are
    below the session's threshold."""
    names = {k: free_name(docs.columns, f"__dropped_{i}") for i, k in enumerate(keys)}
    gone = dropped.select(*[F.col(k).alias(n) for k, n in names.items()])
    both = [keys[k].eqNullSafe(gone[n]) for k, n in names.items()]
    return docs.join(gone, both, "left_anti").select(*columns_of(docs))


def doc_id() -> Column:
    return F.col("doc_id").cast("long")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more stay. The decision is the row's own:
    repeated rows and rows with a null id have that of their text."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.of_quality(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays. Rows that
    share an id are one document: the row with the least text stays. Rows with a null id
    belong to no group and stay."""
    found = neardup.near_duplicates(docs)
    dropped = written(found.where("not kept").select("doc_id").distinct(), "near")
    kept = without(docs, dropped, {"doc_id": doc_id()})
    repeated = written(found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = without(kept, repeated, {"doc_id": doc_id()})
    held = free_name(docs.columns, "__again")
    again = kept.join(repeated.select(F.col("doc_id").alias(held)), doc_id() == F.col(held), "left_semi")
    # rows of an id meet in a task: only the least of each part of the input goes there
    least = again.groupBy(doc_id().alias("__id"), F.pmod(F.xxhash64("text"), F.lit(64)).alias("__part")).agg(F.min_by(F.struct(*columns_of(docs)), F.struct("text")).alias("__row"))
    row = Window.partitionBy("__id").orderBy("__row.text", "__part")
    first = least.withColumn("__n", F.row_number().over(row)).where(F.col("__n") == 1)
    return once.union(first.select(*[F.col("__row")[c].alias(c) for c in docs.columns]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go. The decision is that of the text, with
    its id: a row with a null id, or that shares its id with another text, goes if its own
    text holds a passage."""
    texts = docs.select(doc_id().alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    found = decontaminate.leaks(texts, table(spark, sf_dir, "benchmark"), keys=("doc_id", "text_hash"))
    dropped = written(found.select("doc_id", "text_hash"), "leaks")
    return without(docs, dropped, {"doc_id": doc_id(), "text_hash": F.xxhash64(F.col("text").cast("string"))})


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; n_chars, if there, is the new length of the
    texts that changed. The key is the session's (pii.KEY_SETTING), or a random one that is
    kept nowhere. That different entities share a surrogate is an error. Every row stays."""
    key = pii.key_of(spark)
    pii.raise_collisions(docs, key)
    out, counted, _ = pii.pseudonymized(docs, key)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(counted) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*columns_of(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences; repeated rows are packed once
    each, and null ids stay null."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier's fit or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
