"""Connected components of an edge list, by alternating star contraction, and joins that
split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def share_of(df: DataFrame, total: int) -> int:
    """Rows of one key that a task may have beside others: an eighth of an even share."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(total // (8 * parts), 64)


def evenly(rows: DataFrame, one: DataFrame, key: str, share: int, ident: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with `one`, which has one row for each key, so that no key is in one
    task: keys with more than `share` rows get a salt on the side of the rows, and as many
    copies on the other. How many rows a key has is said by `counted` (key, n), or without it by
    the column n of `one`. There are at most total / share such keys, a bound that doesn't grow
    with the rows, so they are broadcast. `ident` tells the rows of a key apart."""
    splits = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast((one if counted is None else counted).where(F.col("n") > share).select(key, splits.alias("splits")))
    salted = rows.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*ident), F.coalesce("splits", F.lit(1))).cast("int")).drop("splits")
    # the count beside the row spares a join
    split = one.withColumn("splits", F.greatest(splits, F.lit(1))) if counted is None else one.join(hot, key, "left")
    copies = split.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1))).drop("splits")
    return salted.join(copies, [key, "salt"], how).drop("salt")


def _with_least(pairs: DataFrame, share: int) -> DataFrame:
    """(u, v, m): m is the least of all neighbours of u and of u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return evenly(pairs, least.select("u", F.least("u", "m").alias("m"), "n"), "u", share, ["v"])


def _each(df: DataFrame, *edges: tuple[str, str]) -> DataFrame:
    """(u, v): these edges of every row. One pass, where a union would plan df anew for each."""
    return df.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in edges])))


def _large_star(edges: DataFrame, share: int) -> DataFrame:
    joined = _with_least(_each(edges, ("u", "v"), ("v", "u")), share)
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, share: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _each(_with_least(down, share), ("v", "m"), ("u", "m")).where("u != v").distinct()


def _edges_and_stars(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and: does each u have one v, and is no v a u? Then every v is the
    least of its component."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("above")), F.struct(F.col("v").alias("x"), F.lit(0).alias("above")))))
    each = ends.groupBy("x").agg(F.sum("above").alias("a"), F.count("*").alias("n"))
    found = each.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("edges"), F.max(F.expr("a > 1 or (a > 0 and n > a)")).alias("more")).first()
    return found["edges"], not found["more"]


def components(edges: DataFrame, a: str, b: str, save=written) -> DataFrame:
    """(id, component) for every id of an edge; component is the least id reachable.

    Each round contracts stars and is saved to the shared folder; rounds grow with the
    logarithm of the longest path, and end where the edges are stars, which is tested on
    all of them. Only that answer and counts reach the driver."""
    down = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    state = save(down, "edges")
    while True:
        total, stars = _edges_and_stars(state)
        if stars:
            break
        share = share_of(state, 2 * total)
        # the half of a round is read more than once: unsaved, plans hold copies of copies of it, and the
        # driver's memory grows by all of them
        state = save(_small_star(save(_large_star(state, share), "large"), share), "star")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).union(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def joined_components(labels: DataFrame, links: DataFrame, save=written) -> DataFrame:
    """Labels (id, component) after further links (a, b): the links are drawn between the
    components they touch, so only what they join is contracted anew."""
    named = links
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    drawn = named.select(F.coalesce("of_a", "a").alias("u"), F.coalesce("of_b", "b").alias("v"))
    more = save(components(drawn, "u", "v", save), "joined").select(F.col("id").alias("old"), F.col("component").alias("new"))
    moved = labels.join(more, labels["component"] == more["old"], "left").select("id", F.coalesce("new", "component").alias("component"))
    # ids that no earlier label has
    return moved.union(more.join(labels, more["old"] == labels["id"], "left_anti").select("old", "new"))
