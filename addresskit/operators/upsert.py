"""Snapshot upserts, rollback and truncation on immutable files.

An upsert is a full outer join of the current snapshot with the incoming
rows on the key; per column, the incoming value wins only for the columns the
conflict rule updates. The result is written as a new snapshot directory (the
input is never overwritten in place). Incoming rows are first reduced to one
row per key (D17: the last by delivery order), a hash aggregate with a
map-side partial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the row with the largest ``order`` (scan order when absent)."""
    o = F.col(order) if order else F.monotonically_increasing_id()
    cols = [c for c in df.columns if c != key]
    agg = df.withColumn("_o", o).groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_o")).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(current: DataFrame, incoming: DataFrame, key: str, update_cols: Sequence[str],
           order: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET <update_cols> as a join."""
    inc = dedupe_last(incoming.select(*current.columns, *([order] if order else [])), key, order)
    cur = current.alias("c")
    new = inc.alias("n")
    j = cur.join(new, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = []
    for c in current.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"c.{c}"), F.col(f"n.{c}")).alias(c))
        elif c in update_cols:
            # on conflict the incoming value is taken as is (even null); new keys insert it
            cols.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"c.{key}").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return j.select(*cols)


def rollback_batch(df: DataFrame, batch_col: str, batch_id: str) -> DataFrame:
    """Drop the rows of one load batch (written back with dynamic partition overwrite)."""
    return df.filter(F.col(batch_col).isNull() | (F.col(batch_col) != F.lit(batch_id)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one UNION ALL."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
