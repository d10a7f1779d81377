"""Source divergence audit: how far the sources of a language differ in their terms, and by which terms.

Single-pass in-memory indexing: a task counts the terms of its documents in memory, per language and source, until the
index holds ENTRIES entries, and spills it as a run sorted by term, cut into blocks of BLOCK postings per hash shard. A
shard's blocks arrive ordered by their first term; a heap of the blocks that are begun merges them, so that the postings of
all runs are summed, and a term's frequencies written or dropped, while little more than one block a run is open. Blocks of
many runs that stay open are summed by term.

Smoothed shares p and their distances are whole numbers. The distance of two sources over all kept terms is not summed term
by term for each pair: it starts as if both had none of the terms, is corrected for the terms that one of them has (from a
histogram of its counts), and last for the terms that both have, which stream from the index.

Edge cases: null text, lang or source count as empty; a document without terms still makes its group occur; a language
without kept terms gives distances of 0 and no terms; repeated rows count as often as they stand; ties rank by the item's
UTF-8 bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
# Terms are runs of ASCII letters and of characters beyond ASCII; in UTF-8 bytes, lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
NO_TERM = re.compile(rb"[^a-z\x80-\xff]")
ENTRIES = 800_000
BLOCK = 128
POSTINGS_AT_ONCE = 1 << 18
TEXT_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 64

RUNS = "lang string, shard int, first binary, source string, terms array<binary>, counts array<long>, documents array<long>"
FREQUENCIES = "lang string, term string, documents long, sources array<string>, counts array<long>"


# ------------------------------------------------------------------ indexing
def _portions(data: bytes):
    """The bytes of a text, about TEXT_AT_ONCE at a time, cut between terms."""
    at = 0
    while at < len(data):
        end = at + TEXT_AT_ONCE
        if end < len(data):
            stop = NO_TERM.search(data, end)
            end = stop.start() if stop else len(data)
        yield data[at:end]
        at = end


class Index:
    """Postings of a block of documents: per (lang, source), how often each term occurs and in how many documents."""

    def __init__(self):
        self.counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        found, documents = self.counts.setdefault((lang, source), (Counter(), Counter()))
        before = len(found)
        distinct: set[bytes] = set()
        for part in _portions(text.lower()):
            words = TERM.findall(part)
            found.update(words)
            distinct.update(words)
        documents.update(distinct)
        self.entries += len(found) - before

    def spill(self, shards: int):
        """The run: batches of RUNS, each block sorted by term. The index is empty then."""
        for (lang, source), (found, documents) in self.counts.items():
            if found:
                terms = sorted(found)
                shard = np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms)) % np.uint32(shards)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
                ends = np.append(starts[1:], len(shard))
                cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts.tolist(), ends.tolist())])
                offsets = pa.array(np.append(cuts, len(shard)), pa.int32())
                columns = [pa.array(terms, pa.binary()), *(pa.array(list(map(c.__getitem__, terms)), pa.int64()) for c in (found, documents))]
                columns = [c.take(pa.array(order)) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(cuts), pa.string()), pa.array(shard[cuts], pa.int32()), columns[0].take(pa.array(cuts)),
                     pa.array([source] * len(cuts), pa.string()), *(pa.ListArray.from_arrays(offsets, c) for c in columns)],
                    [c.split()[0] for c in RUNS.split(", ")])
        self.__init__()


class Merge:
    """Merges the blocks of one language and shard, which come in the order of their first terms.

    Begun blocks lie in a heap by their last terms. No later block has a term before the next one's first: up to there the heap
    gives up its blocks, or what of them lies before it, and the frequencies of those terms are final. Where many runs have a block
    begun, little of it is final: then the begun blocks of a source become one, and the next look waits until as much has come again,
    so that the work follows the postings and not the postings times the runs.
    """

    def __init__(self, least: int, at_once: int = POSTINGS_AT_ONCE):
        self.least, self.at_once, self.begun, self.no, self.held, self.sources = least, at_once, [], 0, 0, {}
        self.full = at_once

    def add(self, source: str, columns: list[pa.Array]) -> None:
        self._push(self.sources.setdefault(source, len(self.sources)), columns)

    def _push(self, source: int, columns: list[pa.Array]) -> None:
        heapq.heappush(self.begun, (columns[0][-1].as_py(), self.no, source, columns))
        self.no += 1
        self.held += len(columns[0])

    def make_room(self, next_first: bytes):
        """What is final before ``next_first``, as ``settle`` has it; what is not takes no more room than its distinct terms."""
        settled = self.settle(next_first)
        if 2 * self.held > self.at_once:
            begun, self.begun, self.held = self.begun, [], 0
            for source in self.sources.values():
                own = [c for _, _, s, c in begun if s == source]
                if own:
                    t = pa.table([pa.concat_arrays([c[i] for c in own]) for i in range(3)], ["term", "n", "df"])
                    t = t.group_by("term").aggregate([("n", "sum"), ("df", "sum")]).sort_by("term").combine_chunks()
                    self._push(source, [t[c].combine_chunks() for c in ("term", "n_sum", "df_sum")])
        self.full = max(self.at_once, 2 * self.held)
        return settled

    def settle(self, next_first: bytes | None):
        """(terms, documents, sources, counts) of the kept terms before ``next_first`` (None: of all), in order."""
        done, on = [], []
        while self.begun and (next_first is None or self.begun[0][0] < next_first):
            done.append(heapq.heappop(self.begun)[2:])
        for _, _, source, columns in self.begun:
            at = bisect_left(columns[0], next_first, key=lambda t: t.as_py())
            if at:
                done.append((source, [c[:at] for c in columns]))
            on.append((source, [c[at:] for c in columns]))
        self.begun, self.held = [], 0
        for x in on:
            self._push(*x)
        if not done:
            return None
        sizes = [len(c[0]) for _, c in done]
        t = pa.table([pa.concat_arrays([c[i] for _, c in done]) for i in range(3)] + [pa.array(np.repeat([x for x, _ in done], sizes))],
                     ["term", "n", "df", "source"])
        df = t.group_by("term").aggregate([("df", "sum")])
        kept = df.filter(pc.greater_equal(df["df_sum"], self.least)).sort_by("term")
        if not len(kept):
            return None
        t = t.filter(pc.is_in(t["term"], kept["term"].combine_chunks()))
        t = t.group_by(["term", "source"]).aggregate([("n", "sum")]).sort_by([("term", "ascending"), ("source", "ascending")]).combine_chunks()
        term = t["term"].combine_chunks()
        starts = np.flatnonzero(np.append(True, pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)))
        offsets = pa.array(np.append(starts, len(term)), pa.int32())
        names = pa.array(list(self.sources), pa.string()).take(t["source"].combine_chunks())
        return (kept["term"].combine_chunks().cast(pa.string()), kept["df_sum"].combine_chunks(),
                pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, t["n_sum"].combine_chunks()))


def merge_runs(batches, least: int, at_once: int = POSTINGS_AT_ONCE):
    """Batches of FREQUENCIES from batches of RUNS that are ordered by language, shard and first term."""
    merge, place = Merge(least, at_once), None

    def out(settled):
        if settled:
            terms, documents, sources, counts = settled
            yield pa.RecordBatch.from_arrays([pa.array([place[0]] * len(terms), pa.string()), terms, documents, sources, counts],
                                             [c.split()[0] for c in FREQUENCIES.split(", ")])

    for b in batches:
        lists = [b.column(c) for c in ("terms", "counts", "documents")]
        flat = [x.flatten() for x in lists]
        ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
        rows = zip(*(b.column(c).to_pylist() for c in ("lang", "shard", "first", "source")), [0, *ends], ends)
        for lang, shard, first, source, lo, hi in rows:
            if (lang, shard) != place:
                yield from out(merge.settle(None))
                merge, place = Merge(least, at_once), (lang, shard)
            elif merge.held >= merge.full:
                yield from out(merge.make_room(first))
            merge.add(source, [x[lo:hi] for x in flat])
    yield from out(merge.settle(None))


def frequencies(docs: DataFrame, least: int = LEAST_DOCUMENTS, entries: int = ENTRIES, shards: int | None = None) -> DataFrame:
    """A row per language and term in ``least`` or more of its documents: the sources that have it, and how often."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_text("lang"), _text("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def index(batches):
        held = Index()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                for lang, source, text in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "text")]):
                    held.add(lang, source, text)
                    if held.entries >= entries:
                        yield from held.spill(shards)
        yield from held.spill(shards)

    runs = texts.mapInArrow(index, RUNS).repartition(shards, "lang", "shard")
    return runs.sortWithinPartitions("lang", "shard", "first").mapInArrow(lambda batches: merge_runs(batches, least), FREQUENCIES)


def _text(c: str) -> Column:
    return F.coalesce(c, F.lit("")).alias(c)


# ------------------------------------------------------------------ distances
def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly; 1 where there are no terms."""
    return F.expr(f"1L + coalesce(((cast({n} as decimal(20,0)) + 2) * {UNIT}) div "
                  f"nullif(cast({total} as decimal(20,0)) + 2 * cast({terms} as decimal(20,0)), 0), 0L)")


def distance(p: str, q: str) -> str:
    """SQL: floor((p - q)^2 / (p + q)); a share is at most UNIT + 1, so its square fits a long."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def groups(docs: DataFrame, freq: DataFrame) -> DataFrame:
    """Every occurring (lang, source): number in its language, occurrences of kept terms, kept terms, share of a missing term."""
    found = docs.select(_text("lang"), _text("source")).distinct()
    terms = freq.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    n = _postings(freq).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = found.join(n, ["lang", "source"], "left").join(terms, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("terms", F.lit(0)).cast("long").alias("terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return g.withColumn("g", number).withColumn("p0", share("0", "total", "terms"))


def _postings(freq: DataFrame) -> DataFrame:
    return freq.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))


CORRECTIONS = "lang string, a int, b int, correction long"
CORRECTION_SCHEMA = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("correction", pa.int64())])
ENTRIES_AT_ONCE = 1 << 18


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _corrections(g: np.ndarray, p: np.ndarray, p0: np.ndarray):
    """Sums per pair (a < b) of what the terms that both have add; rows of the arrays are terms, columns their sources."""
    keys, values = [], []
    for i in range(g.shape[1] - 1):
        a, b = slice(i, i + 1), slice(i + 1, None)
        c = (_distance(p[:, a], p[:, b]) - _distance(p[:, a], p0[:, b]) - _distance(p0[:, a], p[:, b])
             + _distance(p0[:, a], p0[:, b])).reshape(-1)
        key = ((g[:, a] << 32) | g[:, b]).reshape(-1)
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        keys.append(key)
        values.append(np.add.reduceat(c[order], first))
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    return key >> 32, key & 0xFFFFFFFF, np.add.reduceat(value[order], first)


def both_have(terms: DataFrame) -> DataFrame:
    """Corrections per pair of sources from rows ``lang, has array<struct(g, p, p0)>`` sorted by g, one a term."""

    def stream(batches):
        for b in batches:
            langs = np.array(b.column("lang").to_pylist())
            has = b.column("has")
            flat = has.flatten()
            cols = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
            ends = np.cumsum(has.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = np.diff(ends, prepend=0)
            for lang in np.unique(langs):
                for k in np.unique(sizes[langs == lang]):
                    rows = np.flatnonzero((langs == lang) & (sizes == k)) if k > 1 else []
                    step = max(1, ENTRIES_AT_ONCE // int(k))
                    for lo in range(0, len(rows), step):
                        at = (ends - sizes)[rows[lo:lo + step]][:, None] + np.arange(k)
                        x, y, c = _corrections(*[col[at] for col in cols])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([str(lang)] * len(x), pa.string()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(c)],
                            schema=CORRECTION_SCHEMA)

    return terms.mapInArrow(stream, CORRECTIONS).groupBy("lang", "a", "b").agg(F.sum("correction").alias("correction"))


def source_pairs(freq: DataFrame, g: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: distance over all kept terms."""
    posted = _postings(freq).join(g.select("lang", "source", "g", "total", "terms", "p0"), ["lang", "source"])
    posted = posted.withColumn("p", share("n", "total", "terms"))
    pairs = _ordered(g, "a").join(_ordered(g, "b"), "lang").where("a <> b")
    # the terms that a has and b is taken not to have: one row a distinct count of a
    counts = posted.groupBy("lang", F.col("g").alias("a"), "p", F.col("p0").alias("pa")).agg(F.count(F.lit(1)).alias("of"))
    alone = counts.join(_ordered(g, "b"), "lang").where("a <> b").withColumn(
        "more", F.expr(f"of * ({distance('p', 'pb')} - {distance('pa', 'pb')})"))
    alone = alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "more")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum("more").alias("alone"))
    has = F.sort_array(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), "p", "p0")))  # at most all sources of the language
    both = both_have(posted.groupBy("lang", "term").agg(has.alias("has")).where(F.size("has") > 1).select("lang", "has"))
    low = pairs.where("a < b").join(alone, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.expr(f"terms * ({distance('pa', 'pb')}) + coalesce(alone, 0L) + coalesce(correction, 0L)")
    value = F.when(F.col("terms") == 0, F.lit(0).cast("long")).otherwise(value)
    low = low.withColumn("value", value).select("lang", "source_a", "source_b", "value")
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                             F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return low.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def _ordered(g: DataFrame, side: str) -> DataFrame:
    other = ["terms"] if side == "a" else []
    return g.select("lang", F.col("g").alias(side), F.col("source").alias(f"source_{side}"), F.col("p0").alias(f"p{side}"), *other)


def source_terms(freq: DataFrame, g: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has more of than its language), value: how far its share is off."""
    whole = g.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    in_lang = freq.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("lang_n"), "sources", "counts")
    p = in_lang.select("lang", "term", "lang_n", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "lang_n", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    p = p.join(g.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, "lang")
    p = p.withColumn("p", share("n", "total", "terms")).withColumn("q", share("lang_n", "lang_total", "terms")).where("p > q")
    return p.select("lang", "source", F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, **index) -> DataFrame:
    """``lang, source, part, item, value, rank``: all source pairs and each source's ``top`` terms."""
    freq = written(frequencies(docs, least, **index), "frequencies")
    g = written(groups(docs, freq), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(freq, g).withColumn("rank", F.row_number().over(order))
    terms = source_terms(freq, g).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    cols = ["item", "value", "rank"]
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *cols).unionByName(
        terms.select("lang", "source", F.lit("term").alias("part"), *cols))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances between all sources of each language, and the terms that mark each source."""
    from .common import documents

    return audit(documents(spark, sf_dir).select("text", "lang", "source"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents
), words AS (
  SELECT id, lang, source, unnest(found) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), grps AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS total,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM grps g
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q
  FROM counts GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((s.p - w.q) * (s.p - w.q)) // (s.p + w.q)
  FROM shares s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND s.p > w.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10
"""
