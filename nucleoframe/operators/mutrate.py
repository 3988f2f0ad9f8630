"""Per-nucleotide mutation rates from base counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import round_half_even


def summed(items: Column, same: Column, ins_len: int, del_len: int) -> Column:
    """STRUCT<ins STRUCT<short, long>, dels STRUCT<short, long>, same> of texts like A:90:1; the symbol is before the first
    colon. `same` is NULL if the reference's letter isn't there, and adds up its repeated items. Only
    the few items that count make sums; to test a text's beginning is cheap beside that."""
    zero = F.lit(0).cast("long")
    number = lambda x: F.get(F.split(x, ":"), F.lit(1)).cast("long")

    def by_length(sign: str, most: int) -> Column:
        def add(a: Column, x: Column) -> Column:
            short, n = F.instr(x, ":") - 2 <= most, number(x)
            return F.struct((a["short"] + F.when(short, n).otherwise(0)).alias("short"), (a["long"] + F.when(short, 0).otherwise(n)).alias("long"))

        return F.aggregate(F.filter(items, lambda x: x.startswith(sign)), F.struct(zero.alias("short"), zero.alias("long")), add)

    letters = F.filter(items, lambda x: (F.substring_index(x, ":", 1) == same) & ~x.startswith("+") & ~x.startswith("-"))
    matches = F.aggregate(letters, F.lit(None).cast("long"), lambda a, x: F.coalesce(a, zero) + number(x))
    return F.struct(by_length("+", ins_len).alias("ins"), by_length("-", del_len).alias("dels"), matches.alias("same"))


def mutation_rates(counts: DataFrame, ins_len: int = 3, del_len: int = 3, equal_symbol_ref: bool = False, strict: bool = False) -> DataFrame:
    """Position rows from (gene, pos, refnt, depth, items).

    Insertions up to ins_len letters count as "+", longer ones as "+++", deletions
    likewise. coverage = depth + all insertions + long ones; adj_coverage = depth +
    short insertions - long deletions; mutant = adj_coverage - matches; mutrate =
    mutant / coverage to 8 places, half to even, NULL where coverage is 0. Repeated items of
    a letter add up for the matches and are listed one by one; a kind of insertion or
    deletion is listed if its sum isn't 0. The reference letter is looked up in upper case and
    given as read; one that isn't among the items leaves mutant NULL, or raises if strict."""
    wanted = F.lit("=") if equal_symbol_ref else F.upper("refnt")
    # behind a generator, or each sum, condition and rate would walk the items again
    df = counts.select("*", F.explode(F.array(summed(F.col("items"), wanted, ins_len, del_len))).alias("s"))
    same = F.col("s.same")
    if strict:
        same = F.coalesce(same, F.raise_error(F.concat(F.lit("no count of the reference at "), F.col("gene"), F.lit(":"), F.col("pos").cast("string"))).cast("long"))
    df = df.withColumns({"coverage": F.col("depth") + F.col("s.ins.short") + F.col("s.ins.long"), "adj_coverage": F.col("depth") + F.col("s.ins.short") - F.col("s.dels.long")})
    df = df.withColumn("mutant", F.col("adj_coverage") - same)
    plain = F.transform(F.filter("items", lambda x: ~x.startswith("+") & ~x.startswith("-")), lambda x: F.substring_index(x, ":", 2))
    listed = [F.when(F.col(f"s.{name}") != 0, F.concat(F.lit(sign), F.col(f"s.{name}").cast("string"))) for sign, name in (("+:", "ins.short"), ("-:", "dels.short"), ("+++:", "ins.long"), ("---:", "dels.long"))]
    mutrate = round_half_even(F.try_divide(F.col("mutant").cast("double"), F.col("coverage").cast("double")), 8)
    return df.select(
        "gene", "pos", (F.col("pos") + 1).alias("end"), mutrate.alias("mutrate"), "coverage", "adj_coverage", "mutant", F.col("depth"),
        "refnt", F.concat_ws(";", plain, *listed).alias("detail"),
    )


def with_gene_counts(positions: DataFrame, gene_counts: DataFrame, digits: int | None = 8) -> DataFrame:
    """Adds normalized_cov (depth per million reads of the whole run, 8 places; without `digits`
    as it is, for those who round it themselves: twice is not the same) and g_readcount. Genes without counts keep NULL. The counts table has one row for each
    gene; Spark broadcasts it if its size is below the session's threshold."""
    scale = F.col("total_reads") / F.lit(1e6)
    joined = positions.join(gene_counts.select("gene", F.col("reads").alias("g_readcount"), "total_reads"), "gene", "left")
    normalized = F.try_divide(F.col("depth").cast("double"), scale)
    return joined.withColumn("normalized_cov", normalized if digits is None else F.bround(normalized, digits)).drop("total_reads")


def position_filter(positions: DataFrame, coverage_threshold: int = -1, normalized_threshold: float = 10) -> DataFrame:
    """coverage >= c, and, where normalized_cov is known, that it is >= gc."""
    enough = F.col("normalized_cov").isNull() | (F.col("normalized_cov") >= normalized_threshold)
    return positions.where((F.col("coverage") >= coverage_threshold) & enough)


def rounded_mean(df: DataFrame, value: str, keys: list[str], digits: int = 8) -> DataFrame:
    """Mean to some places, half to even, 0 for no values."""
    return df.groupBy(*keys).agg(F.bround(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias("mean"))


def position_table(positions: DataFrame) -> DataFrame:
    """The 13 columns of a position file, in order; the strand isn't known."""
    have = set(positions.columns)
    or_null = lambda c, kind: (F.col(c) if c in have else F.lit(None).cast(kind)).alias(c)
    return positions.select(
        "gene", "pos", "end", F.concat_ws(".", "gene", F.col("pos").cast("string")).alias("gene_position"), "mutrate", F.lit(".").alias("strand"),
        "coverage", "adj_coverage", "mutant", or_null("normalized_cov", "double"), or_null("g_readcount", "long"), "refnt", "detail",
    )
