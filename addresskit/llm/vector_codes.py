"""Vector code compression: product codes of whole-number vectors, nearest entries by slice and intersect.

Vectors become whole numbers floor(scale * x) and are cut into equal parts, each with a codebook trained by rounds of
assign-and-average in exact arithmetic. The nearest entry of a part is found without comparing it with every entry: for
each dimension the entries' coordinates lie sorted beside prefix masks (bit e of mask i: entry e is among the first i).
The distance to one guessed entry is the initial radius; it selects a range of the sorted coordinates per dimension, whose
mask is one prefix mask without another; the masks of all dimensions ANDed leave the entries that can be as near, among them
the nearest and all its ties, and only these are measured.

A round is one pass: every task hands on the sums of its parts per entry, a fixed number of rows. Only codebooks (parts *
entries rows) come to the driver.

Edge cases: rows whose vector is null or has null or non-finite components are dropped; of the others, the first by id sets
the length, and vectors of another length are dropped too; a length that the parts do not divide gives earlier parts one
component more; vectors with equal ids rank by their components, null ids come last; fewer vectors than entries give as many
entries; equal entries stay, ties go to the lower one; components beyond +-65535 raise ValueError, as their squares
may not fit; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 28
BROADCAST_LABELS = 100_000
SALTS = 32


def whole_vectors(df: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """The usable rows with ``vector`` as whole numbers (array<bigint>)."""
    fine = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    big = F.exists(vector, lambda x: F.abs(F.floor(x.cast("double") * scale)) > LARGEST)
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    stop = F.raise_error(F.lit(f"a component beyond +-{LARGEST // scale - 1} cannot be coded")).cast("array<bigint>")
    return df.where(fine).withColumn(vector, F.when(big, stop).otherwise(numbers))


def part_bounds(length: int, parts: int) -> list[int]:
    """Where each part starts, and the length."""
    return [i * (length // parts) + min(i, length % parts) for i in range(parts)] + [length]


class Slices:
    """Sorted coordinates and prefix masks of one part's codebook."""

    def __init__(self, book: np.ndarray):
        self.book, n = book, len(book)
        self.words = -(-n // 64)
        order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, order, 0)
        bits = np.zeros((n, self.words), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.prefix = np.zeros((book.shape[1], n + 1, self.words), np.uint64)
        for d in range(book.shape[1]):
            self.prefix[d, 1:] = np.bitwise_or.accumulate(bits[order[:, d]], axis=0)
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if book.shape[1] else 0

    def guess(self, x: np.ndarray) -> np.ndarray:
        """An entry that is near in the dimension in which the entries spread most."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64)
        line = self.sorted[:, self.widest]
        at = np.clip(np.searchsorted(line, x[:, self.widest]), 1, len(line) - 1) if len(line) > 1 else np.zeros(len(x), np.int64)
        if len(line) > 1:
            at = at - (x[:, self.widest] - line[at - 1] <= line[at] - x[:, self.widest])
        return np.argsort(self.book[:, self.widest], kind="stable")[at]

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask words per row: the entries within ``radius`` in every dimension."""
        masks = np.tile(self.prefix[0, -1] if x.shape[1] else np.array(self._all()), (len(x), 1))
        for d in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            hi = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            masks &= self.prefix[d, hi] & ~self.prefix[d, lo]
        return masks

    def _all(self) -> list:
        n = len(self.book)
        return [np.uint64((1 << min(64, n - 64 * w)) - 1) for w in range(self.words)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row (ties to the lower) and its squared distance, exactly."""
        first = ((x - self.book[self.guess(x)]) ** 2).sum(1)
        radius = np.ceil(np.sqrt(first.astype(np.float64))).astype(np.int64) + 1  # never short by rounding
        masks = self.candidates(x, radius)
        best, error = np.full(len(x), -1, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for e in range(len(self.book)):
            rows = np.flatnonzero(masks[:, e // 64] >> np.uint64(e % 64) & np.uint64(1))
            d = ((x[rows] - self.book[e]) ** 2).sum(1)
            less = d < error[rows]
            best[rows[less]], error[rows[less]] = e, d[less]
        return best, error


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), len(flat) // len(column)) if len(column) else flat.reshape(0, 0)


ROWS_AT_ONCE = 4096


def _sums(vectors: DataFrame, books: list[np.ndarray], bounds: list[int]) -> dict:
    """(part, entry) -> (sum of the parts assigned to it, their number), added up over all tasks."""
    width = max(b - a for a, b in zip(bounds, bounds[1:]))

    def add(batches):
        slices = [Slices(b) for b in books]
        total = np.zeros((len(books), len(books[0]), width + 1), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = _matrix(batch.column(0).slice(lo, ROWS_AT_ONCE))
                for p, s in enumerate(slices):
                    part = x[:, bounds[p]:bounds[p + 1]]
                    at, _ = s.nearest(part)
                    np.add.at(total[p], (at, slice(0, part.shape[1])), part)
                    total[p, :, -1] += np.bincount(at, minlength=len(total[p]))
        for p, e in np.argwhere(total[:, :, -1] > 0).tolist():
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "entry": pa.array([e], pa.int32()),
                                              **{f"s{i}": pa.array([v]) for i, v in enumerate(total[p, e].tolist())}})

    schema = "part int, entry int, " + ", ".join(f"s{i} long" for i in range(width + 1))
    rows = vectors.select("v").mapInArrow(add, schema).groupBy("part", "entry").agg(
        *[F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(width + 1)]).collect()
    return {(r["part"], r["entry"]): ([int(r[f"s{i}"]) for i in range(width)], int(r[f"s{width}"])) for r in rows}


def train(vectors: DataFrame, parts: int, entries: int, rounds: int, bounds: list[int]) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` of assigning and averaging; ``vectors`` holds ``id`` and ``v``."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), bounds[-1])
    books = [start[:, a:b].copy() for a, b in zip(bounds, bounds[1:])]
    for _ in range(rounds):
        for (p, e), (total, n) in _sums(vectors, books, bounds).items():
            books[p][e] = [t // n for t in total[:books[p].shape[1]]]
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def codes(vectors: DataFrame, books: list[np.ndarray], bounds: list[int]) -> DataFrame:
    """Column ``v`` of ``vectors`` replaced by its code (two hex digits a part) and its error."""
    other = [c for c in vectors.columns if c != "v"]
    digits = max(2, math.ceil(math.log2(max(2, len(books[0]))) / 4))

    def assign(batches):
        slices = [Slices(b) for b in books]
        hexes = [f"{e:0{digits}x}" for e in range(len(books[0]))]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                b = batch.slice(lo, ROWS_AT_ONCE)
                x = _matrix(b.column("v"))
                found = [s.nearest(x[:, bounds[p]:bounds[p + 1]]) for p, s in enumerate(slices)]
                code = ["".join(map(hexes.__getitem__, row)) for row in np.stack([f[0] for f in found], 1).tolist()]
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in other], pa.array(code), pa.array(error, pa.int64())],
                                                 [*other, "code", "error"])

    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in other] + ["code string", "error long"])
    return vectors.mapInArrow(assign, schema)


def compress(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows ``id, label, code, error`` of the usable vectors, the codebooks)."""
    v = whole_vectors(df.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")), "v", scale)
    kept = written(v, "vectors")
    lead = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    if not lead:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    bounds = part_bounds(len(lead[0]["v"]), parts)
    kept = kept.where(F.size("v") == bounds[-1])
    books = train(kept, parts, entries, rounds, bounds)
    return written(codes(kept, books, bounds), "codes"), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over equal labels, nulls together.

    A counted few labels are sent to every task; beyond that the join is salted, so that no label's rows meet in one task.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    spread = sums.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("to"))).drop("of", "salt", "to")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, with a digest of the codebooks."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                                          F.lit(books_sha256(books)).alias("codebooks_sha256"))
