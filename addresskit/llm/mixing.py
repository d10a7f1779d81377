"""Mixing sources to target weights (SQL functions only).

Tokens are summed per source, each source's target becomes a repetition rate, and every document is emitted
floor(rate) times plus once more when a uniform number hashed from (seed, doc_id) is below the rate's fraction.

Edge cases: a null or empty text has size 0 and follows its source's rate; a source without words has rate 0 and is
left out; a null source is a source of its own, last in order; rows with the same doc_id share their hashed number;
an empty table gives an empty result; other columns of the documents pass through untouched
(names with a leading underscore are the operator's own; ``copy`` replaces a column of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

# The weights repeat over the sources in order; shares of all words and of a source's own.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATED = 2.0
SEED = "mix-1"
BROADCAST_SOURCES = 10_000
SALTS = 32


def source_targets(sized: DataFrame, source: str, size: str, weights=WEIGHTS, share=SHARE, most=MOST_REPEATED) -> DataFrame:
    """One row per source: its words, its target, and the repetition rate target / words.

    Targets are weight * level, stopped at ``most`` times the source's words. Sorted by the level at which each source
    stops, the level that shares out everything is the greatest of (what is left) / (weights left): handing the excess
    on by weight until none is above its stop ends at the same level.
    """
    sources = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    stops = sources.withColumn("weight", picked).withColumn("stop", F.col("source_size") * F.lit(float(most)))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = stops.withColumn("level", left / weights_left)
    target = F.least(F.col("stop"), F.col("weight") * F.max("level").over(everything))
    return levels.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:key); a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """The documents with ``_mix = struct(size, source_size, target, rate, copies)`` added.

    The table of sources is small next to the documents: up to BROADCAST_SOURCES of them (counted) are sent to every
    task; beyond that the join is salted, so that a source with a third of all rows spreads over SALTS partitions.
    """
    sized = docs.withColumn("_mix_size", word_count(F.col("text")))
    by_source = source_targets(sized.select("source", "_mix_size"), "source", "_mix_size", **targets).select(
        F.col("source").alias("_mix_source"), F.struct("source_size", "target", "rate").alias("_mix_target"))
    few = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = sized.join(F.broadcast(by_source), F.col("source").eqNullSafe(F.col("_mix_source")))
    else:
        salted = sized.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)))
        spread = by_source.withColumn("_mix_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col("_mix_source"))
                             & (F.col("_mix_salt") == F.col("_mix_to"))).drop("_mix_salt", "_mix_to")
    rate = F.col("_mix_target.rate")
    extra = F.when(uniform(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("_mix", F.struct(
        F.col("_mix_size").alias("size"), F.col("_mix_target.source_size").alias("source_size"),
        F.col("_mix_target.target").alias("target"), rate.alias("rate"),
        (F.floor(rate).cast("long") + extra.cast("long")).alias("copies"),
    )).drop("_mix_size", "_mix_source", "_mix_target")


def mix_sources(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """The mixed corpus: every document as often as its source's rate says, ``copy`` numbering the repeats from 1."""
    counted = mix_counts(docs, seed, **targets).where(F.col("_mix.copies") > 0)
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies")))).drop("_mix")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words of every document, its source's words and target, and the words that the mix takes."""
    from .common import documents

    m = mix_counts(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("_mix.size").alias("size"), F.col("_mix.source_size").alias("source_size"),
                    F.col("_mix.target").alias("target"), (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"),
                    F.col("_mix.copies").alias("copies"))


MIX_CTES = """
sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), stops AS (
  SELECT *, CAST(source_size AS DOUBLE) * 2.0 AS stop FROM sources
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
             - coalesce(sum(stop) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY stop / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM stops
), targets AS (
  SELECT source, source_size, least(stop, weight * max(level) OVER ()) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), mixed AS (
  SELECT s.*, r.source_size, r.target, CAST(floor(r.rate) AS BIGINT) + CASE WHEN
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE
         < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
)"""

ORACLE = ("WITH " + MIX_CTES.format(docs="documents")
          + " SELECT doc_id, size, source_size, target, size * copies AS taken, CAST(copies AS BIGINT) AS copies FROM mixed")
