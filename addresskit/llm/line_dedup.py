"""Line dedup: a line goes if an equal one, or one within an edit of one word, stands earlier in the corpus.

Lines compare by their words (runs of other than ASCII white space, A-Z lower-cased). Lines of MIN_WORDS words or more
are near when one word is inserted, removed or replaced (edit distance at most one); shorter lines only when equal. Blank
lines stay. Earlier is by (doc_id, hash of the text, line number).

Deletion neighbourhood: a near line has a variant, the line without one word, in common with the other. Each line
emits its variants as hashed keys: with the place of the missing word (equal keys: one word replaced there), and without
(equal to another whole line: one word inserted). In every group of equal keys the earliest line is the one to compare
with, so groups are never paired up; word-by-word comparison of the two verifies the edit distance.

Only lines that can have a partner emit variants: an edit lies in one half of a line, so near lines share the other half,
and lines whose halves nobody shares are left out. That is exact and keeps the neighbourhood small next to the corpus.

Edge cases: null text counts as empty; a document left without any word is dropped, one without words before stays as it
is; rows with the same doc_id and text are one document listed as often as before; an empty table stays empty; other
columns pass through (names with a leading underscore are the operator's own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_filter, may_hold, split_by_keys, written
from .tokens import Runs, mix, words

MIN_WORDS = 8
_U = np.uint64
ORDER = ("doc", "tie", "line")
LINE_SCHEMA = "doc long, tie long, line int, h long, n int, k0 long, k1 long, k2 long, k3 long"


def _lines(w):
    """(first word, end word, line number in its text) of every line that has words."""
    if not len(w.start):
        z = np.zeros(0, np.int64)
        return z, z, z
    breaks = np.cumsum(w.data == 10)
    at = breaks[w.start]
    cut = np.flatnonzero((at[1:] != at[:-1]) | (w.text[1:] != w.text[:-1])) + 1
    first = np.concatenate([[0], cut])
    before = np.where(w.bounds[w.text[first]] > 0, breaks[np.maximum(w.bounds[w.text[first]], 1) - 1], 0)
    return first, np.append(cut, len(at)), at[first] - before


def _half_keys(runs: Runs, first, end):
    """For partners of equal length and one word shorter: keys of the first and the last half; null where too short."""
    out = []
    for less in (0, 1):
        m = end - first - less
        fits = m >= MIN_WORDS
        half = np.where(fits, m // 2, 0)
        salt = m.astype(np.uint64) * _U(2)
        head = mix(runs.hash(first, first + half) ^ mix(salt))
        tail = mix(runs.hash(end - np.where(fits, m - half, 0), end) ^ mix(salt + _U(1)))
        out += [(head, fits), (tail, fits)]
    return [pa.array(k.view(np.int64), mask=~fits) for k, fits in out]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, tie, line, h, n, k0..k3): every line with words, its hash, its number of words and its half keys."""

    def emit(batches):
        for b in batches:
            for w in words(b.column(2)):
                first, end, line = _lines(w)
                if not len(first):
                    continue
                runs = Runs(w.hash)
                of = pa.array(w.text[first] + w.lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(1).take(of), pa.array(line.astype(np.int32)),
                     pa.array(runs.hash(first, end).view(np.int64)), pa.array((end - first).astype(np.int32)), *_half_keys(runs, first, end)],
                    names=["doc", "tie", "line", "h", "n", "k0", "k1", "k2", "k3"])

    return docs.select("doc", "tie", "text").mapInArrow(emit, LINE_SCHEMA)


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, words): the word hashes of every distinct line in ``wanted`` (h)."""
    filt = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "h", wanted.count()))

    def emit(batches):
        done = set()
        for b in batches:
            for w in words(b.column(0)):
                first, end, _ = _lines(w)
                h = Runs(w.hash).hash(first, end).view(np.int64) if len(first) else np.zeros(0, np.int64)
                own = []
                for i in np.flatnonzero(may_hold(filt.value, h)):
                    if int(h[i]) not in done:
                        done.add(int(h[i]))
                        own.append((int(h[i]), w.hash[first[i]:end[i]].tobytes()))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own]), pa.array([s for _, s in own], pa.binary())], names=["h", "words"])

    made = docs.select("text").mapInArrow(emit, "h long, words binary")
    return made.join(wanted, "h").groupBy("h", *[c for c in wanted.columns if c != "h"]).agg(F.first("words").alias("words"))


def _variants(batches):
    """(key, kind, h): kind 0 a variant with the place of its missing word, 1 a variant, 2 the whole line.

    ``side`` 1: partners share the first half, 2: the last half, 3: some either; words missing from a shared half are
    left out.
    """
    for b in batches:
        for h, blob, side in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            x = np.frombuffer(blob, np.uint64)
            n = len(x)
            lo, hi = (max(0, (n - 1) // 2 - 1) if side == 1 else 0), ((n + 1) // 2 + 1 if side == 2 else n)
            i = np.arange(lo, min(hi, n), dtype=np.int64)
            runs = Runs(x)
            head = runs.raw(np.zeros_like(i), i)
            tail = runs.raw(i + 1, np.full_like(i, n)) * _powers_at(i)
            v = mix(head + tail + _U(n - 1))
            placed = mix(v ^ mix(i.astype(np.uint64) + _U(1)))
            key = np.concatenate([placed, v, [np.int64(h).view(np.uint64)]]).astype(np.uint64).view(np.int64)
            kind = np.concatenate([np.zeros(len(i), np.int8), np.ones(len(i), np.int8), [2]]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([key, kind, np.full(len(key), h, np.int64)], names=["key", "kind", "h"])


def _powers_at(i: np.ndarray) -> np.ndarray:
    from .tokens import _BASE, _powers

    return _powers(_BASE, int(i.max()) + 1 if len(i) else 1)[i]


def _one_edit(batches):
    """Pairs (h, with) whose word sequences are at most one insertion, removal or replacement apart."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if len(x) == len(y):
                keep.append(int((x != y).sum()) <= 1)
            else:
                differ = np.flatnonzero(x != y[:len(x)])
                p = int(differ[0]) if len(differ) else len(x)
                keep.append(len(y) - len(x) == 1 and bool((x[p:] == y[p + 1:]).all()))
        yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, with): lines that have an earlier line within one edit, and one such line."""
    halves = lines.select("h", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key")).where("key IS NOT NULL")
    halves = halves.select("key", "h", F.when(F.col("which") % 2 == 0, 1).otherwise(2).alias("side")).distinct()
    shared = Window.partitionBy("key")
    met = halves.select("*", F.min("h").over(shared).alias("lo"), F.max("h").over(shared).alias("hi")).where("lo <> hi")
    wanted = written(met.groupBy("h").agg(F.bit_or("side").alias("side")), "wanted")
    seqs = written(_sequences(docs, wanted).select("h", "words", "side"), "sequences")

    same = Window.partitionBy("key")
    keys = seqs.mapInArrow(_variants, "key long, kind byte, h long")
    keys = keys.select("*", F.min("h").over(same).alias("lo"), F.max("h").over(same).alias("hi")).where("lo <> hi").select("key", "kind", "h")
    keys = keys.join(firsts.select("h", "first"), "h")
    at = F.struct("first", "h")
    earliest = F.min(F.when(F.col("kind") < 2, at)).over(same)
    whole = F.min(F.when(F.col("kind") == 2, at)).over(same)
    other = F.when(F.col("kind") == 1, whole).otherwise(earliest)
    pairs = keys.select("h", F.col("first"), other.alias("o")).where("o.first < first").groupBy("h").agg(F.min("o").alias("o"))
    pairs = pairs.select("h", F.col("o.h").alias("with")).join(seqs.select("h", F.col("words").alias("x")), "h")
    pairs = pairs.join(seqs.select(F.col("h").alias("with"), F.col("words").alias("y")), "with")
    return pairs.select("h", "with", "x", "y").mapInArrow(_one_edit, "h long, with long")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, tie, gone array<int>): the line numbers that go, for every document that loses any. ``docs``: doc, tie, text."""
    lines = written(line_table(docs), "lines")
    firsts = lines.groupBy("h").agg(F.min(F.struct(*ORDER)).alias("first"), F.count(F.lit(1)).alias("copies"))
    firsts = written(firsts, "first-lines")
    near = near_lines(docs, lines, firsts).select("h", F.lit(True).alias("near"))
    judged = firsts.join(near, "h", "left").where("copies > 1 OR near")
    gone = lines.select("h", *ORDER).join(judged, "h").where(F.coalesce("near", F.lit(False)) | (F.struct(*ORDER) > F.col("first")))
    return gone.groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines taken out of ``text``; ``_line_counts`` struct(lines, removed) is added.

    Documents that lose nothing skip the join: a fixed-size filter of the others lets them pass.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    gone = written(removed_lines(docs.select(doc.alias("doc"), tie.alias("tie"), "text")), "removed")
    keyed = docs.withColumn("_doc", doc).withColumn("_tie", tie)
    hit, rest = split_by_keys(keyed, "xxhash64(_doc, _tie)", gone, "xxhash64(doc, tie)")
    hit = hit.join(gone.withColumnsRenamed({"doc": "_doc", "tie": "_tie", "gone": "_gone"}), ["_doc", "_tie"], "left")
    rest = rest.withColumn("_gone", F.lit(None).cast("array<int>"))
    out = rest.unionByName(hit)
    left = F.expr(r"array_join(filter(split(text, '\n'), (l, i) -> NOT array_contains(_gone, i)), '\n')")
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    out = out.withColumn("_line_counts", F.struct(n_lines.alias("lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed")))
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    emptied = F.col("_gone").isNotNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where(~emptied).select(*docs.columns, "_line_counts")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the lines that it keeps."""
    from .common import documents

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_line_counts.lines").alias("n_lines"), F.col("_line_counts.removed").alias("n_removed"))
