"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y, text): at most `most` labelled documents outside the held-out fold,
    those with the least hash of the id, one row for each. Of repeated label rows the
    larger counts, of rows that share an id the least text.

    The ids, at most `most`, are broadcast to the documents; texts of repeated ids are
    combined before the shuffle."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = ids.where("doc_id is not null and y is not null").where(fold("doc_id", parts) != held_out)
    chosen = usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
