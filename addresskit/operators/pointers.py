"""Sequential rules as pointers: where each row jumps next, and which rows are reached from the starts.

A rule such as "the next window begins at the first request after this one's window" depends on one row only, so each row
gets a pointer, found with a merge of probes and rows inside time chunks, and the rows that a sequential scan would visit
are the ones reached from the starts. Pointer doubling finds them in log2 rounds of equi-joins: a key that holds most rows is
spread over all tasks, which a scan per key is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, its lineage cut."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def first_at_or_after(rows: DataFrame, probes: DataFrame, keys: Sequence[str], chunk_us: int) -> DataFrame:
    """``keys, src, g``: for each probe (``keys, src, t``) the least ``g`` of a row (``keys, g, t``) at ``t`` or later.

    ``g`` must rise with ``t`` inside a key; probes that find none are left out. Time is cut into chunks of ``chunk_us``: what
    a chunk lacks comes from a table of one row per key and chunk.
    """
    keys = list(keys)
    both = probes.select(*keys, "src", "t", F.lit(None).cast("long").alias("g"), F.lit(0).alias("_row")).unionByName(
        rows.select(*keys, F.lit(None).cast("long").alias("src"), "t", F.col("g").cast("long").alias("g"), F.lit(1).alias("_row")))
    both = both.withColumn("_chunk", F.floor(F.col("t") / chunk_us))
    ahead = Window.partitionBy(*keys, "_chunk").orderBy("t", "_row").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_here", F.min("g").over(ahead)).where("_row = 0")
    chunks = both.groupBy(*keys, "_chunk").agg(F.min("g").alias("_least"))
    later = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    chunks = chunks.select(*keys, "_chunk", F.min("_least").over(later).alias("_later"))
    return found.join(chunks, [*keys, "_chunk"]).select(*keys, "src", F.coalesce("_here", "_later").alias("g")).where("g IS NOT NULL")


def reachable(starts: DataFrame, pointers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, g``: everything reached from ``starts`` (``keys, g``) along ``pointers`` (``keys, g, to``)."""
    keys = list(keys)
    jump, reached = cut(pointers.select(*keys, "g", "to")), cut(starts.select(*keys, "g"))
    n = reached.count()
    while True:
        step = reached.join(jump, [*keys, "g"]).select(*keys, F.col("to").alias("g"))
        grown = cut(reached.unionByName(step).distinct())
        more = grown.count()
        if more == n:
            return grown
        reached, n = grown, more
        onward = jump.select(*keys, F.col("g").alias("to"), F.col("to").alias("_to"))
        jump = cut(jump.join(onward, [*keys, "to"]).select(*keys, "g", F.col("_to").alias("to")))
