"""Benchmark decontamination (SQL functions only).

Every item of the benchmark is looked for in every document through windows of the item's own number of words:

1. Placement. A window can only be similar to an item if they share a five-word shingle, so windows are placed where a
   document holds a shingle of the benchmark, aligned with that shingle's place in an item. A fixed-size blocked Bloom
   filter finds these places inside each row; an exact join on the shingle hash removes its false positives.
2. Candidates. Two bags of a and b shingles with a Jaccard similarity of t share at least t / (1 + t) * (a + b), so a window
   with fewer places that the filter let through is no candidate. An item's similar windows hold one of its rarest
   a - ceil(t * a) + 1 shingles (rare in the benchmark); windows and items are joined on those. Nothing similar is lost.
3. Verification. Exact Jaccard similarity of the two bags of shingles, each shingle weighted by how often it occurs.

Edge cases: words are runs of other than ASCII white space, lower-cased; an item or text of fewer than five words
has no shingle and matches nothing; null texts count as empty; a window over the end of a text is moved back inside it,
and a text shorter than the item is one window; repeated items and rows match each on its own; documents with the same
doc_id and text are one; empty tables give an empty result; the documents' other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bloom_filter, filter_words, maybe_listed, written

SHINGLE = 5
THRESHOLD = 0.75


def word_hashes(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: str) -> Column:
    """Hashes of the shingles of an array of word hashes, in order."""
    gram = ", ".join(f"get({words}, i + {j})" for j in range(SHINGLE))
    return F.expr(f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({gram})) "
                  "ELSE cast(array() as array<bigint>) END")


def bag(ordered: str) -> Column:
    """A sorted array with repeats as a set: the n-th occurrence of a hash becomes a hash of (hash, n)."""
    return F.expr(f"transform({ordered}, (s, i) -> xxhash64(s, i - array_position({ordered}, s)))")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, start_word, n_words, similarity) of the best window of every document and item it leaks.

    ``docs`` needs doc_id and text, ``items`` item_id and text.
    """
    it = items.select("item_id", word_hashes(F.col("text")).alias("words")).select("*", shingles("words").alias("sh")).where("size(sh) > 0")
    it = it.select("item_id", "sh", F.size("words").alias("n"), F.array_sort("sh").alias("ordered"))
    it = written(it.select("item_id", "sh", "n", bag("ordered").alias("a")), "items")
    places = it.select("n", F.posexplode("sh").alias("offset", "h")).distinct()
    blocks = filter_words(places.count(), 128)
    bloom = bloom_filter(places, "h", blocks).scalar()

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), word_hashes(F.col("text")).alias("words"))
    found = found.select("doc_id", "text_hash", "words", shingles("words").alias("sh"))
    found = found.select("*", bloom.alias("bloom"))
    first_bit = f"getbit(get(bloom, cast(shiftrightunsigned(h, 32) & {blocks - 1}L as int)), cast(shiftrightunsigned(h, 2) & 63L as int)) = 1"
    at = F.expr(f"array_compact(transform(sh, (h, i) -> if({first_bit} AND {maybe_listed('h', 'bloom', blocks)}, struct(i as at, h as h), null)))")
    found = found.select("doc_id", "text_hash", "words", at.alias("hits"))
    # Written before it is filtered: Spark would push the filter, and with it all hashing, into each lambda. Only
    # documents with a place to look at keep their words.
    found = written(found.select("doc_id", "text_hash", "hits", F.expr("if(size(hits) > 0, words, null)").alias("words")), "hits")
    found = found.where("words IS NOT NULL")

    key = ["doc_id", "text_hash"]
    hits = found.select(*key, F.size("words").alias("size"), F.posexplode("hits").alias("nth", "hit")).select(*key, "size", "nth", "hit.at", "hit.h")
    placed = hits.join(places, "h").select(
        *key, "nth", F.col("n").alias("item_n"), F.least("n", "size").alias("n"),
        F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("size") - F.col("n"))).alias("start"),
    ).groupBy(*key, "item_n", "n", "start").agg(F.min("nth").alias("nth"))
    texts = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "words", F.expr("hits.at").alias("ats")).dropDuplicates(["_d", "_t"])
    windows = placed.join(texts, (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # The window's own places are among the n before and after the one that placed it.
    inside = F.expr("size(filter(slice(ats, greatest(nth - n, 0) + 1, 2 * n + 1), x -> x >= start AND x < start + n))")
    need = F.ceil((F.col("item_n") + F.col("n") - 2 * (SHINGLE - 1)) * (threshold / (1 + threshold)) - 1e-6)
    windows = windows.where(inside >= need).select(*key, "item_n", "n", "start", F.expr("slice(words, start + 1, n)").alias("words"))
    windows = windows.select(*key, "item_n", "n", "start", F.array_sort(shingles("words")).alias("ordered"))
    windows = written(windows.select(*key, "item_n", "n", "start", bag("ordered").alias("b")), "windows")

    of_item = it.select("item_id", F.col("n").alias("item_n"), F.xxhash64("a").alias("item"), F.size("a").alias("size"), F.explode("a").alias("e"))
    common = of_item.groupBy("e").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id", "item").orderBy("items", "e"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold - 1e-6) + 1
    rare = of_item.distinct().join(common, "e").withColumn("rank", rank).where(F.col("rank") <= keep).select("item_id", "item_n", "e")
    asked = windows.select(*key, "item_n", "n", "start", F.explode("b").alias("e"))
    pairs = asked.join(rare, ["item_n", "e"]).select(*key, "item_n", "start", "n", "item_id").distinct()
    w = windows.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), F.col("item_n").alias("_n"), F.col("start").alias("_s"), "b")
    pairs = pairs.join(w, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")) & (F.col("start") == F.col("_s")) & (F.col("item_n") == F.col("_n")))
    pairs = pairs.join(it.select("item_id", "a"), "item_id")
    both = F.size(F.array_intersect("a", "b"))
    pairs = pairs.withColumn("similarity", both / (F.size("a") + F.size("b") - both))
    best = F.max_by(F.struct("start", "n"), F.struct(F.col("similarity"), -F.col("start")))
    return pairs.groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"), best.alias("w")).where(
        F.col("similarity") >= threshold).select(
        "doc_id", "text_hash", "item_id", F.col("w.start").cast("long").alias("start_word"), F.col("w.n").cast("long").alias("n_words"), "similarity")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that leak no item, all columns as they are."""
    bad = leaks(docs.select("doc_id", "text"), items, threshold).select(
        F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (F.xxhash64("text") == F.col("_leak_text")), "left_anti")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the best window's place and similarity."""
    from .common import documents

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return leaks(documents(spark, sf_dir).select("doc_id", "text"), items).drop("text_hash")
