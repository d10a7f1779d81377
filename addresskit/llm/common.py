"""Helpers shared by the training-data operators: written intermediates, word sizes, fixed-size filters."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

# Fixed value: a word is a run of other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# Shuffle files of a statement go when it ends, not when the driver's garbage collection finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    """``df`` written as Parquet (in folders of the columns ``by``) to the shared checkpoint folder and read back: lineage ends
    here, its shuffles are removed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


# ------------------------------------------------ blocked Bloom filter in SQL
MAX_FILTER_WORDS = 1 << 18  # 2 MB: no filter that travels to the tasks is larger


def filter_words(n: int, bits_per_key: int = 32) -> int:
    """64-bit blocks of a filter for ``n`` keys: a power of two, at least 16, at most MAX_FILTER_WORDS."""
    return min(MAX_FILTER_WORDS, 1 << max(4, math.ceil(math.log2(max(1, n) * bits_per_key / 64))))


def _block(h: str, words: int) -> str:
    return f"cast(shiftrightunsigned({h}, 32) & {words - 1}L as int)"


def _mask(h: str) -> str:
    """Four bits of the key's block, from four 6-bit fields of its hash."""
    return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {s}) & 63L as int))" for s in (2, 8, 14, 20))


def bloom_filter(keys: DataFrame, h: str, words: int) -> DataFrame:
    """One row ``bloom array<bigint>``: the filter of the 64-bit hashes in column ``h`` (null hashes are ignored).

    Only the fixed number of blocks comes together in one row, never the keys.
    """
    set_blocks = (
        keys.where(F.col(h).isNotNull())
        .groupBy(F.expr(_block(h, words)).alias("block"))
        .agg(F.expr(f"bit_or({_mask(h)})").alias("bits"))
    )
    blocks = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("block"))
    return (
        blocks.join(set_blocks, "block", "left")
        .agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
             .alias("b"))
        .select(F.transform("b", lambda x: x["bits"]).alias("bloom"))
    )


def maybe_listed(h: str, bloom: str, words: int) -> str:
    """SQL condition: the filter may hold hash ``h`` (no false negatives)."""
    return f"(get({bloom}, {_block(h, words)}) & ({_mask(h)})) = ({_mask(h)})"


def split_by_keys(df: DataFrame, h: str, keys: DataFrame, key_h: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key, rows that have none): the second kind needs no join with ``keys``.

    ``h`` and ``key_h`` are SQL expressions of 64-bit hashes; the filter has a fixed greatest size.
    """
    n = filter_words(keys.count(), 16)
    bloom = bloom_filter(keys.select(F.expr(key_h).alias("h")), "h", n).scalar()
    marked = df.withColumn("_h", F.expr(h)).withColumn("_bloom", bloom)
    marked = marked.withColumn("_maybe", F.expr(maybe_listed("_h", "_bloom", n))).drop("_bloom", "_h")
    return marked.where("_maybe").drop("_maybe"), marked.where("NOT _maybe").drop("_maybe")


# --------------------------- fixed-size arrays summed over all tasks (numpy side)
CHUNK = 1 << 14
CHUNK_SCHEMA = "chunk int, salt int, data binary"


def emit_chunks(array: np.ndarray, task: int):
    """Rows of the non-zero chunks of a fixed-size array, compressed; ``salt`` spreads the later merge."""
    rows = [(i // CHUNK, task % 64, zlib.compress(array[i:i + CHUNK].tobytes(), 1))
            for i in range(0, len(array), CHUNK) if array[i:i + CHUNK].any()]
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["chunk", "salt", "data"])
                                         .astype({"chunk": "int32", "salt": "int32"}), preserve_index=False)


def merge_chunks(df: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """Sum (``add``) or union (``or``) of all tasks' arrays; ``size`` is a fixed parameter, so is what is collected."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(CHUNK, size), dtype)
        for blob in pdf["data"]:
            part = np.frombuffer(zlib.decompress(blob), dtype)
            if how == "or":
                total |= part
            else:
                total += part
        return pd.DataFrame({"chunk": [key[0]], "salt": [0], "data": [zlib.compress(total.tobytes(), 1)]}).astype(
            {"chunk": "int32", "salt": "int32"})

    part = df.groupBy("chunk", "salt").applyInPandas(merge, CHUNK_SCHEMA)
    out = np.zeros(size, dtype)
    for r in part.groupBy("chunk").applyInPandas(merge, CHUNK_SCHEMA).collect():
        out[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["data"]), dtype)
    return out


MAX_ID_BITS = 1 << 27  # 16 MB


def id_filter(ids: DataFrame, col: str, n: int) -> np.ndarray:
    """Bit set of at most 16 MB that holds every value of a long column (two bits each).

    It only saves shuffling rows that a later exact join drops anyway.
    """
    bits = 1 << max(17, min(27, math.ceil(math.log2(max(1, n) * 16))))

    def add(batches):
        from pyspark import TaskContext

        out = np.zeros(bits // 8, np.uint8)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for p in _id_bits(v, bits):
                np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
        yield from emit_chunks(out, TaskContext.get().partitionId())

    return merge_chunks(ids.select(col).where(F.col(col).isNotNull()).mapInArrow(add, CHUNK_SCHEMA), bits // 8,
                        "uint8", "or")


def _id_bits(v: np.ndarray, bits: int):
    from .tokens import mix

    h = mix(v)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(filt: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mask of the values that the bit set of ``id_filter`` may hold."""
    out = np.ones(len(v), bool)
    for p in _id_bits(v.astype(np.int64, copy=False).view(np.uint64), len(filt) * 8):
        out &= (filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out
