"""Scalar expressions. None of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CIGAR operators by BAM code.
CIGAR_OPS = "MIDNSHP=X"
#: Operators that count for the mapped length (M, I, =, X).
MAPPED_OPS = (0, 1, 7, 8)


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_int(text: Column | str, kind: str = "int") -> Column:
    """A number, or NULL for what isn't one. A dot, which stands for missing values, isn't tried: each
    failed cast makes an exception, which takes longer than all else about a value."""
    return F.when(column(text) != ".", column(text).try_cast(kind))


def guarded_ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as double; NULL where whole is 0 or NULL."""
    return F.try_divide(column(part).cast("double"), column(whole).cast("double"))


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole, 0 on an empty whole."""
    return F.coalesce(F.try_divide(column(part) * F.lit(100.0), column(whole).cast("double")), F.lit(0.0))


def round_half_even(x: Column | str, digits: int) -> Column:
    return F.bround(column(x), digits)


def round_like_numpy(x: Column | str, digits: int) -> Column:
    """rint(x * 10^digits) / 10^digits: ties of the scaled value go to even."""
    scale = 10.0**digits
    return F.rint(column(x) * scale) / scale


def read_name_parts(name: Column | str) -> Column:
    """(barcode, umi) from a read name: the last but one and last of at least three
    parts divided by underscores; both NULL for fewer parts."""
    parts = F.split(column(name), "_")
    at = lambda i: F.when(F.size(parts) >= 3, F.element_at(parts, i))
    return F.struct(at(-2).alias("barcode"), at(-1).alias("umi"))


def mean_qscore(quality: Column | str, skip: int = 60) -> Column:
    """Mean Phred score of a quality string, averaged as error probabilities. The first
    60 characters of a longer string are left out; an empty one scores 0."""
    q = column(quality)
    tail = F.when(F.length(q) > skip, F.substr(q, F.lit(skip + 1))).otherwise(q)
    errors = F.transform(F.filter(F.split(tail, ""), lambda c: c != ""), lambda c: F.pow(F.lit(10.0), -(F.ascii(c) - 33) / F.lit(10.0)))
    total = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e)
    return F.when(F.length(q) == 0, F.lit(0.0)).otherwise(F.lit(-10.0) * F.log10(total / F.length(tail)))


def cigar_mapped_length(cigar: Column | str) -> Column:
    """Bases of a structured CIGAR in M, I, = and X."""
    kept = F.filter(column(cigar), lambda c: c["op"].isin(*MAPPED_OPS))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + c["len"].cast("long"))


def cigar_text_mapped_length(cigar: Column | str) -> Column:
    """The same from CIGAR text."""
    counts = F.regexp_extract_all(column(cigar), F.lit(r"(\d+)[MI=X]"), F.lit(1))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c.cast("long"))


def info_map(info: Column | str) -> Column:
    """INFO text as a map; a flag without "=" has a NULL value."""
    return F.str_to_map(column(info), F.lit(";"), F.lit("="))


def dotted_key(gene: Column | str, pos: Column | str) -> Column:
    return F.concat_ws(".", column(gene), column(pos).cast("string"))


def split_dotted(key: Column | str) -> tuple[Column, Column]:
    """(gene, pos) of a dotted key; the gene's own dots stay with it."""
    k = column(key)
    pos = F.substring_index(k, ".", -1)
    return F.substr(k, F.lit(1), F.length(k) - F.length(pos) - 1), pos.try_cast("long")


def truncated(x: Column, digits: int) -> Column:
    """Cut, not rounded, after some digits."""
    scale = 10.0**digits
    return F.floor(x * scale) / scale
