"""Barcodes, UMIs and tags of aligned reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import read_name_parts


def set_tag(df: DataFrame, tag: str, value, when=None) -> DataFrame:
    """Sets a tag; an old value of it is replaced."""
    rest = F.map_filter("tags", lambda k, _: k != tag)
    new = F.map_concat(rest, F.create_map(F.lit(tag), value))
    return df.withColumn("tags", new if when is None else F.when(when, new).otherwise(F.col("tags")))


def add_barcode_tags(alignments: DataFrame, barcode_tag: str = "CB", umi_tag: str = "UM") -> DataFrame:
    """Tags from the read name where both parts are there and not empty; every row stays."""
    parts = read_name_parts("read_id")
    df = alignments.withColumns({"__b": parts["barcode"], "__u": parts["umi"]})
    both = F.coalesce((F.col("__b") != "") & (F.col("__u") != ""), F.lit(False))
    df = set_tag(set_tag(df, barcode_tag, F.col("__b"), both), umi_tag, F.col("__u"), both)
    return df.drop("__b", "__u")


def add_gene_tag(alignments: DataFrame, tag: str = "XT") -> DataFrame:
    """The reference name as a tag, "*" for unmapped reads."""
    return set_tag(alignments, tag, F.coalesce("ref_name", F.lit("*")))


def barcode_umi_counts(alignments: DataFrame) -> DataFrame:
    """(barcode, umi, n) from read names; names without them don't count."""
    parts = read_name_parts("read_id")
    df = alignments.select(parts["barcode"].alias("barcode"), parts["umi"].alias("umi"))
    return df.where("barcode <> '' and umi <> ''").groupBy("barcode", "umi").agg(F.count("*").alias("n"))


def barcode_totals(alignments: DataFrame) -> DataFrame:
    """One row: reads with and without tags, distinct barcodes and UMIs (exact)."""
    parts = read_name_parts("read_id")
    df = alignments.select(parts["barcode"].alias("barcode"), parts["umi"].alias("umi"))
    both = F.coalesce((F.col("barcode") != "") & (F.col("umi") != ""), F.lit(False))
    return df.agg(
        F.count_if(both).alias("with_tags"), F.count_if(~both).alias("without_tags"),
        F.count_distinct(F.when(both, F.col("barcode"))).alias("barcodes"), F.count_distinct(F.when(both, F.col("umi"))).alias("umis"),
    )


def barcode_list(alignments: DataFrame, unique_only: bool = False, barcode_tag: str = "CB") -> DataFrame:
    """(barcode, first): barcodes of the tags in order of appearance; distinct or all."""
    tagged = alignments.select(F.try_element_at("tags", F.lit(barcode_tag)).alias("barcode"), "ord").where("barcode is not null")
    if unique_only:
        return tagged.groupBy("barcode").agg(F.min("ord").alias("first"))
    return tagged.select("barcode", F.col("ord").alias("first"))


def validate_tags(alignments: DataFrame, barcode_tag: str = "CB", umi_tag: str = "UM", num_examples: int = 10) -> DataFrame:
    """The first rows that hold both tags; the limit is the feature."""
    get = lambda t: F.try_element_at("tags", F.lit(t))
    both = alignments.select("ord", "read_id", get(barcode_tag).alias("barcode"), get(umi_tag).alias("umi")).where("barcode is not null and umi is not null")
    return both.orderBy("ord").limit(num_examples)
