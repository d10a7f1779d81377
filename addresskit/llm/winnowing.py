"""Document fingerprints by winnowing (SQL functions only).

Hashes of every K consecutive words roll over the text; of every WINDOW consecutive hashes the smallest is kept, the
rightmost one among equals, with its position. Two texts that share a run of K + WINDOW - 1 words share a fingerprint
there, and the kept positions say where.

Hash and place sit in one number, hash first and places counted down, so that the smallest number of a window is the
smallest hash and the rightmost of its ties; windows are minimised by doubling (1, 2, 4, ... hashes wide).

Edge cases: null counts as empty; a text without words has an empty fingerprint; one with fewer than K words has the hash
of all its words, one with fewer than WINDOW hashes the smallest of all; two empty fingerprints are alike (1), an empty
and another are not (0). Rows with the same doc_id are ordered by their text's hash, null doc_ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4
WINDOW = 8  # a power of two
PLACE_BITS = 27  # words of a text: up to 134 million; the other 36 bits are the hash
_LAST = (1 << PLACE_BITS) - 1


def fingerprints(df: DataFrame, **names: str) -> DataFrame:
    """``df`` with, for every keyword ``name=text column``, the picked numbers of that text (array<bigint>)."""
    passed = [c for c in df.columns]
    t = lambda n: f"_{n}_win"
    df = df.select("*", *[F.filter(F.split(F.col(c), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias(t(n)) for n, c in names.items()])
    df = df.select(*passed, *[F.transform(t(n), lambda w: F.xxhash64(w)).alias(t(n)) for n in names])
    df = df.select(*passed, *[_encoded(t(n)).alias(t(n)) for n in names])
    # fewer hashes than a window: the smallest of all
    df = df.select(*passed, *[F.expr(f"if(size({t(n)}) between 1 and {WINDOW - 1}, array(array_min({t(n)})), {t(n)})").alias(t(n)) for n in names])
    step = 1
    while step < WINDOW:
        df = df.select(*passed, *[F.expr(f"transform(slice({t(n)}, 1, greatest(1, size({t(n)}) - {step})), "
                                         f"(x, i) -> least(x, coalesce(get({t(n)}, i + {step}), x)))").alias(t(n)) for n in names])
        step *= 2
    return df.select(*passed, *[F.array_distinct(t(n)).alias(n) for n in names])


def _encoded(h: str) -> Column:
    gram = ", ".join(f"get({h}, i + {j})" for j in range(K))
    number = lambda x: f"shiftleft(shiftrightunsigned({x}, 28), {PLACE_BITS}) | ({_LAST}L - i)"
    return F.expr(
        f"CASE WHEN size({h}) >= {K} THEN transform(sequence(0, size({h}) - {K}), i -> {number(f'xxhash64({gram})')}) "
        f"WHEN size({h}) > 0 THEN transform(sequence(0, 0), i -> {number(f'xxhash64({h})')}) ELSE cast(array() as array<bigint>) END"
    )


def shown(picks: str) -> Column:
    """A fingerprint as text: hash@place of every pick, in order of place."""
    return F.expr(f"array_join(transform({picks}, x -> concat(lower(hex(shiftrightunsigned(x, {PLACE_BITS}))), '@', "
                  f"cast({_LAST}L - (x & {_LAST}L) as string))), ',')")


def alike(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, Window]:
    """Documents dealt into ranges of doc_id, and the window in which the next row is the next document.

    Range bounds are quantiles of doc_id; each range also gets a copy of the first document of the next one that has
    any (``_last`` = 1), so no task sees more than its range and one row. The last range gets the very first document.
    """
    keyed = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("_tie", F.xxhash64("text"))
    cuts = keyed.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets).alias("q")).first()["q"]
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts or []))] or [F.lit(0).cast("long")])
    keyed = keyed.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("_id"))))
    least = keyed.groupBy(F.col("_range").alias("_r")).agg(F.min("_id").alias("_first"))  # a row a range
    firsts = (keyed.join(F.broadcast(least), (F.col("_id") == F.col("_first")) & (F.col("_range") == F.col("_r")))
              .withColumn("_n", F.row_number().over(Window.partitionBy("_r").orderBy("_tie"))).where("_n = 1"))
    order = Window.orderBy("_range")
    previous = F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy()))
    copies = firsts.drop("_r", "_first", "_n").withColumn("_to", previous).withColumn("_range", F.col("_to")).drop("_to")
    rows = keyed.withColumn("_last", F.lit(0)).unionByName(copies.withColumn("_last", F.lit(1)))
    return rows, Window.partitionBy("_range").orderBy("_last", "_id", "_tie")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next one's."""
    from .common import documents

    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, window = with_next(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("_next", F.lead("text").over(window)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_edited", F.when(F.col("_last") == 0, F.concat(
        F.left("text", F.col("n_chars").cast("int") - half), F.left(F.coalesce("_next", F.lit("")), half))).otherwise(F.lit("")))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited"), 256))
    picked = fingerprints(rows, _own="text", _other="_edited").drop("text", "_edited", "_next")
    hashes = [F.expr(f"array_distinct(transform({c}, x -> shiftrightunsigned(x, {PLACE_BITS})))").alias(f"{c}_h") for c in ("_own", "_other")]
    picked = picked.select("*", *hashes)
    picked = picked.withColumn("_next_h", F.lead("_own_h").over(window)).where("_last = 0")
    return picked.select("doc_id", "n_chars", "edited_sha256", shown("_own").alias("fingerprint"),
                         shown("_other").alias("edited_fingerprint"), alike("_own_h", "_other_h").alias("near_edited"),
                         alike("_own_h", "_next_h").alias("near_next"))
