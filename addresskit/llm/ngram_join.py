"""N-gram Jaccard join: documents whose five-word shingle sets have similarity PERCENT / 100 or more, exactly.

A size-aware join of heavy and light sets. Equal sets are one set (its content id). Shingles have one global order,
common ones last: by their count in a fixed-size table of counters over all documents, then by hash. Sets that can be
similar share at least ``a = ceil(0.75 s)`` shingles, so

* small sets (up to the boundary) enumerate all subsets of two among their first s - a + 2 shingles; similar small sets
  share such a subset;
* large sets, and small ones that a large one can be similar to, are in the inverted lists of their first s - a + 1
  shingles, and lists are scanned.

The boundary is the size up to which enumerating costs fewer rows than scanning, from the counters' measured list length.

Scanning does not pair up a list (see ``linking``). A round of stars tests a list's members against a few hubs of
it; what links is one component. After the rounds only pairs of different components that meet in a list remain:
those are dropped whose flipped bits, or number of common places, show that the sets cannot reach the threshold, and the
others are tested. So groups of copies cost one test per member and round, and no link between components is lost.

Edge cases: A-Z lower-cased, words are runs of other than ASCII white space; fewer than five words make one shingle of
the whole sequence; a text without words, or null, has the empty set and links with nothing; repeated rows and equal
texts link; a null doc_id joins groups like others and is no group's smallest; an empty table gives an empty result;
the documents' other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import emit_chunks, id_filter, may_hold, merge_chunks, split_by_keys, written
from .linking import link, with_root
from .tokens import mix, shingle_sets

PERCENT = 75
COUNTERS = 1 << 22  # of 4 bytes; counts only order shingles, so their number changes speed, never results
PIECE, ROWS = 1 << 18, 1 << 10  # values, and sets, that a task holds before it passes them on
LONGS = 8  # of 64 bits, in which each shingle of a set flips one
HOT_LEVEL, SALTS = 8, 16
_U = np.uint64


def content_ids(sets: list) -> np.ndarray:
    """63-bit ids of sets of hashes, none of them empty."""
    size = np.array([len(s) for s in sets], np.uint64)
    start = np.cumsum(size).astype(np.int64) - size.astype(np.int64)
    s = np.concatenate(sets)
    both = np.bitwise_xor.reduceat(mix(s ^ _U(0x5851F42D4C957F2D)), start) + _U(31) * np.add.reduceat(s, start) + size
    return (mix(both) >> _U(1)).view(np.int64)


def _in_pieces(sets):
    """Lists of (index, set), a few sets at a time."""
    out, held = [], 0
    for i, s in sets:
        out.append((i, s))
        held += len(s)
        if held >= PIECE or len(out) >= ROWS:
            yield out
            out, held = [], 0
    if out:
        yield out


def _flips(sets: list) -> list[bytes]:
    """The bits that the members of each set flip."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = of * (64 * LONGS) + (np.concatenate(sets) & _U(64 * LONGS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sets) * 64 * LONGS).reshape(len(sets), -1) & 1
    return [row.tobytes() for row in np.packbits(odd.astype(np.uint8), axis=1)]


def _sets_and_counts(batches):
    """Rows of (doc_id, n, cid, data: the set's flipped bits), and at the end of the task its counters in chunks."""
    from pyspark import TaskContext

    total = np.zeros(COUNTERS, np.int32)
    for b in batches:
        n, cid, flips = [], [], []
        for piece in _in_pieces(shingle_sets(b.column(1))):
            sets = [s for _, s in piece]
            full = [s for s in sets if len(s)]
            ids = iter(content_ids(full).tolist() if full else ())
            n += [len(s) for s in sets]
            cid += [next(ids) if len(s) else None for s in sets]
            np.add.at(total, (np.concatenate(sets) >> _U(42)).astype(np.int64), 1)
            flips += _flips(sets)
        rows = len(n)
        yield pa.RecordBatch.from_arrays([pa.array(b.column(0)), pa.array(n, pa.int64()), pa.array(cid, pa.int64()),
                                          pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.array(flips, pa.binary())],
                                         names=["doc_id", "n", "cid", "chunk", "salt", "data"])
    for c in emit_chunks(total, TaskContext.get().partitionId()):
        rows = c.num_rows
        yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), *c.columns],
                                         names=["doc_id", "n", "cid", "chunk", "salt", "data"])


def _levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(level of every counter, 0 for the usual ones and rising with the count; mean list length beyond one of level 0)."""
    mean = counts.mean()
    usual = mean + 6 * np.sqrt(mean) + 2
    level = np.where(counts <= usual, 0, 1 + np.floor(2 * np.log2(np.maximum(counts / usual, 1.0))))
    light = counts[level == 0].astype(float)
    partners = max(0.0, (light * light).sum() / max(1.0, light.sum()) - mean - 1) if len(light) else 0.0
    return np.minimum(level, 31).astype(np.uint8), partners


def _least(s):
    """Shingles that a set of s shares at least with any similar one."""
    return (PERCENT * s + 99) // 100


def boundary(sizes: dict[int, int], partners: float) -> int:
    """Largest size up to which subsets of two cost no more rows than inverted lists (with ``partners`` met per place)."""
    best = 1
    for s in range(2, max(sizes, default=1) + 1):
        p = s - _least(s) + 1
        if (p + 1) * p // 2 > p * (1 + partners):
            break
        best = s
    return best


def _ordered(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set's shingles as numbers in the global order."""
    return np.sort((level[(s >> _U(42)).astype(np.int64)].astype(np.uint64) << _U(58)) | (s >> _U(6)))


def _postings(levels, small: int):
    """mapInArrow function: (key, salt, cid, n) for every list and subset a set is in; subsets have negative keys."""
    border = _least(small + 1)

    def rows(out):
        length = [len(k) for k, *_ in out]
        return pa.RecordBatch.from_arrays([
            np.concatenate([k for k, *_ in out]), np.concatenate([x for _, x, *_ in out]),
            np.repeat(np.array([c for *_, c, _ in out], np.int64), length),
            np.repeat(np.array([n for *_, n in out], np.int32), length)], names=["key", "salt", "cid", "n"])

    def emit(batches):
        level, done = levels.value, set()
        for b in batches:
            out, held = [], 0
            # a set of one is similar to equal sets only
            several = ((i, s) for i, s in shingle_sets(b.column(0)) if len(s) >= 2)
            for s, cid in ((s, c) for piece in _in_pieces(several) for (_, s), c in zip(piece, content_ids([x for _, x in piece]).tolist(), strict=True)):
                n = len(s)
                if cid in done:
                    continue
                done.add(cid)
                keys, p = _ordered(s, level), n - _least(n) + 1
                if n <= small:
                    i, j = np.triu_indices(p + 1, 1)
                    pair = mix(keys[i] * _U(0x9E3779B97F4A7C15) ^ mix(keys[j])) | _U(1 << 63)
                    out.append((pair.view(np.int64), np.zeros(len(pair), np.int32), cid, n))
                    held += len(pair)
                if n > small or n >= border:
                    k = keys[:p]
                    hot = (k >> _U(58)) >= HOT_LEVEL
                    out.append((k.view(np.int64), np.where(hot, 1 + cid % SALTS, 0).astype(np.int32), cid, n))
                    held += p
                if held >= PIECE:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    return emit


def _could(cnt: str, subset: str) -> str:
    """SQL: a pair (sizes n1, n2) that meets in ``cnt`` lists, or subsets of two where ``subset``, can be similar.

    What is shared beyond the prefixes is at most a - 1 (lists) or a - 2 (subsets) shingles of the larger set.
    """
    least = f"cast(ceil({PERCENT} * greatest(n1, n2) / 100) as long)"
    lists = f"{cnt} + {least} - 1"
    subsets = f"floor((1 + sqrt(1 + 8 * {cnt})) / 2) + {least} - 2"
    return f"{100 + PERCENT} * (CASE WHEN {subset} THEN {subsets} ELSE {lists} END) >= {PERCENT} * (n1 + n2)"


def similar_sets(x: str, y: str) -> Column:
    """Whether two columns with sets (arrays of distinct hashes) are similar."""
    both = F.size(F.array_intersect(x, y)).cast("long")
    return 100 * both >= PERCENT * (F.size(x) + F.size(y) - both)


def set_rows(cids: list, sets: list) -> pa.RecordBatch:
    """Rows (cid, s) of sets of hashes, as arrays of long."""
    first = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    values = pa.array(np.concatenate(sets).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.ListArray.from_arrays(pa.array(first), values)], names=["cid", "s"])


def similar(docs: DataFrame, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) of content ids whose sets are similar. ``firsts``: (cid, doc_id) with one document of each set.

    Sets are made again from the texts of the documents asked for; a bit set of bounded size keeps the others from
    being shuffled, the join on cid decides.
    """
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    asked = written(ids.join(firsts, "cid").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "asked")
    filt = docs.sparkSession.sparkContext.broadcast(id_filter(asked, "doc_id", asked.count()))

    def sets(batches):
        for b in batches:
            hold = may_hold(filt.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            found = ((i, s) for i, s in shingle_sets(b.column(1).filter(pa.array(hold))) if len(s)) if hold.any() else ()
            for piece in _in_pieces(found):
                sets = [s for _, s in piece]
                yield set_rows(content_ids(sets).tolist(), sets)

    made = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text").mapInArrow(sets, "cid long, s array<long>")

    with_a = pairs.join(made.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(made.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    return written(with_b.where(similar_sets("sa", "sb")).select("a", "b").distinct(), "similar")


def ngram_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n long, cid long, chunk int, salt int, data binary"
    first = written(docs.mapInArrow(_sets_and_counts, schema), "sets")
    info = first.where("chunk IS NULL").select("doc_id", "n", "cid")
    level, partners = _levels(merge_chunks(first.where("chunk IS NOT NULL").select("chunk", "salt", "data"), COUNTERS, "int32", "add"))
    sizes = {r["n"]: r["c"] for r in info.where("n BETWEEN 2 AND 400").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    small = boundary(sizes, partners)
    levels = spark.sparkContext.broadcast(level)

    posted = docs.select("text").mapInArrow(_postings(levels, small), "key long, salt int, cid long, n int")
    w = Window.partitionBy("key", "salt")
    lists = posted.select("*", F.min("cid").over(w).alias("lo"), F.max("cid").over(w).alias("hi"))
    lists = written(lists.where("lo <> hi OR salt > 0").select("key", "salt", "cid", "n"), "lists")
    firsts = info.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    bits = first.where("chunk IS NULL AND cid IS NOT NULL").dropDuplicates(["cid"]).select(
        "cid", *[F.conv(F.hex(F.substring("data", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"b{i}") for i in range(LONGS)])

    labels = link(lists, lambda pairs: similar(docs, pairs, firsts), _could("cnt", "sub"), bits, PERCENT)

    rooted = with_root(info.where("cid IS NOT NULL"), labels)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = rooted.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = info.where("cid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.union(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, all columns as they are.

    Of rows with that doc_id one stays (the least by hash of the text). A document without doc_id stays if its component
    has none with one. Documents alone under their doc_id skip the join.
    """
    found = written(ngram_components(docs), "components")
    by_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("to"), F.count(F.lit(1)).alias("rows"))
    touched = written(by_id.where("to <> doc_id OR rows > 1").select(F.col("doc_id").alias("_id"), (F.col("to") == F.col("doc_id")).alias("_first")), "touched")
    hit, rest = split_by_keys(docs, "xxhash64(cast(doc_id as bigint))", touched, "xxhash64(_id)")
    judged = hit.join(touched, F.col("doc_id").cast("long") == F.col("_id"), "left")
    one = judged.where("_first").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1")
    return rest.unionByName(judged.where("_id IS NULL").select(*docs.columns)).unionByName(one.select(*docs.columns))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest doc_id that it reaches by links."""
    from .common import documents

    return ngram_components(documents(spark, sf_dir))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.to_id
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
