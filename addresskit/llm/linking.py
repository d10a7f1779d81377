"""Linking the members of lists without pairing the lists up: star rounds, then what is left between components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .components import joined


def with_root(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``df`` (with cid) and the root of each id's component, itself where it has no link yet."""
    if labels is None:
        return df.withColumn("root", F.col("cid"))
    return df.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))


TURNS, PARTS, HUBS = 3, 3, 8


def link(lists: DataFrame, similar: Callable[[DataFrame], DataFrame], could: str, bits: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the components of all ids that meet in a list and whose sets are similar.

    ``lists``: key, salt, cid, n (set size). Ids of one key and salt meet in the star rounds, ids of one key in the last
    pass. ``could``: SQL over n1, n2, cnt (lists in which a pair meets) and sub (key below 0), true for every pair that
    may be similar. ``similar`` keeps the pairs (a, b) whose Jaccard similarity is ``percent`` / 100 or more. ``bits``: cid
    and longs b0, b1, ... in which every member of the set flips one bit: sets differ in at least as many members as
    their bits do, so the joins drop pairs that differ too much to be similar.

    A star round takes a part of the lists (near copies meet in many) and tests each list's members against HUBS of
    them, drawn by hash. What links is one component. The last pass takes all pairs of different components that meet in
    any list, so no link between components is lost.
    """
    longs = [c for c in bits.columns if c != "cid"]
    differ = " + ".join(f"bit_count({c}_1 ^ {c}_2)" for c in longs)
    close = (f"root1 <> root2 AND 100 * least(n1, n2) >= {percent} * greatest(n1, n2) "
             f"AND {100 - percent} * (n1 + n2) >= {100 + percent} * ({differ})")

    def side(df, number, *more):
        return df.select(F.col("key").alias(f"key{number}"), F.col("cid").alias("ab"[number - 1]), F.col("n").alias(f"n{number}"),
                         F.col("root").alias(f"root{number}"), *[F.col(c).alias(f"{c}_{number}") for c in longs], *more)

    labels = None
    for turn in range(TURNS):
        part = lists.where(F.pmod(F.xxhash64("key"), F.lit(PARTS)) == turn)
        drawn = F.row_number().over(Window.partitionBy("key", "salt").orderBy(F.xxhash64("cid", "key")))
        part = written(with_root(part, labels).join(bits, "cid").withColumn("place", drawn), "star")
        hubs = side(part.where(F.col("place") <= HUBS), 1, F.col("salt").alias("salt1"))
        pairs = hubs.join(side(part, 2, F.col("salt").alias("salt2")), F.expr(f"key1 = key2 AND salt1 = salt2 AND {close}"))
        labels = joined(labels, similar(pairs.select("a", "b").distinct()))

    all_of = Window.partitionBy("key")
    mixed = with_root(lists, labels).select("*", F.min("root").over(all_of).alias("r1"), F.max("root").over(all_of).alias("r2"))
    mixed = written(mixed.where("r1 <> r2").select("key", "cid", "n", "root").join(bits, "cid"), "mixed")
    rest = side(mixed, 1).join(side(mixed, 2), F.expr(f"key1 = key2 AND a < b AND {close}"))
    rest = rest.groupBy("a", "b", "n1", "n2", (F.col("key1") < 0).alias("sub")).agg(F.count(F.lit(1)).alias("cnt")).where(could)
    return joined(labels, similar(rest.select("a", "b").distinct()))
