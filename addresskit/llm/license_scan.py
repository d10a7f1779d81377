"""License scans: phrases at their exact places, and an exact set-similarity join of text blocks with templates.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A block is a line; a line
longer than BLOCK_WORDS words is also taken in overlapping runs of that many, so that a notice inside a long paragraph
has a block of its own. A block matches a template when it holds at least ``threshold`` of the template's distinct
words. The join is the usual one for such containment: template words are ordered by how many blocks of the whole corpus
hold them, rarest first; a match must hold one of the first m - o + 1 of them (o: words needed of m), so only blocks
with such a word are looked at (prefix filter), only if they have o words at all (length filter), and only if the words
from the matched place on can still make up o (positional filter). The test of what is left is exact.

Edge cases: null or empty text has no words, no block and no label; phrases and blocks never reach over two texts,
phrases may reach over lines; repeated rows are scanned like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ALNUM, hash_word, words

# The phrases with their labels, and the templates (label, text).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
)
THRESHOLD = 0.8
BLOCK_WORDS = 64
MAX_TEMPLATE_WORDS = BLOCK_WORDS // 2


class Index:
    """Templates by the hashes of their distinct words, ordered by corpus frequency, with their prefixes."""

    def __init__(self, templates, threshold: float, frequency: dict[int, int]):
        self.items = []
        for label, text in templates:
            own = sorted({int(h) for h in _hashes(text)}, key=lambda h: (frequency.get(h, 0), h))
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            self.items.append((label, own, need))
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for i, (_, own, need) in enumerate(self.items):
            for place, h in enumerate(own[: len(own) - need + 1]):
                self.by_word.setdefault(h, []).append((i, place))
        self.prefix = np.array(sorted(self.by_word), np.uint64)

    def best(self, block: set[int], found: list[int]):
        """(template, share of its words) of every template that the block matches; ``found``: its prefix words."""
        seen, out = set(), []
        for h in found:
            for i, place in self.by_word[h]:
                _, own, need = self.items[i]
                if i in seen or len(block) < need or len(own) - place < need:
                    continue  # already tested, too short, or too few words left from this place on
                seen.add(i)
                held = sum(x in block for x in own)
                if held >= need:
                    out.append((i, held / len(own)))
        return out


def _hashes(text: str) -> np.ndarray:
    w = list(words(pa.array([text]), ALNUM))
    return w[0].hash if w else np.zeros(0, np.uint64)


def _blocks(w):
    """(first word, end word) of every block of a piece of texts, in order."""
    lines = np.cumsum(w.data == 10)
    line = lines[w.start] if len(w.start) else np.zeros(0, np.int64)
    cut = np.flatnonzero((line[1:] != line[:-1]) | (w.text[1:] != w.text[:-1])) + 1
    first = np.concatenate([[0], cut]) if len(line) else np.zeros(0, np.int64)
    end = np.append(first[1:], len(line)) if len(line) else first
    long = np.flatnonzero(end - first > BLOCK_WORDS)
    if len(long):
        parts = [(a, min(a + BLOCK_WORDS, e)) for f, e in zip(first[long], end[long], strict=True)
                 for a in range(f, e - BLOCK_WORDS // 2, BLOCK_WORDS // 2)]
        keep = np.ones(len(first), bool)
        keep[long] = False
        first = np.concatenate([first[keep], [a for a, _ in parts]])
        end = np.concatenate([end[keep], [b for _, b in parts]])
    return first.astype(np.int64), end.astype(np.int64)


def word_frequencies(docs: DataFrame, templates) -> dict[int, int]:
    """For each word of the templates, the number of blocks of all documents that hold it."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for _, t in templates]))

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for w in words(b.column(0), ALNUM):
                at = np.searchsorted(vocabulary, w.hash)
                at[at == len(vocabulary)] = 0
                hit = np.flatnonzero(vocabulary[at] == w.hash)
                first, end = _blocks(w)
                order = np.argsort(first, kind="stable")
                lo, hi = np.searchsorted(hit, first[order]), np.searchsorted(hit, end[order])
                single = np.repeat(np.arange(len(order)), hi - lo)
                spans = np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True) if z > a] or [np.zeros(0, np.int64)])
                pairs = np.unique(single * np.int64(len(vocabulary)) + at[hit[spans]])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": vocabulary.view(np.int64), "n": total})

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in rows}  # one row per template word


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: words, phrase places, matched blocks and labels.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and ``blocks``
    array<struct<first_word, end_word, label, containment>> with the place of every matched block.
    ``docs`` needs doc_id and text; templates are a bounded list of at most MAX_TEMPLATE_WORDS words each.
    """
    if any(len(_hashes(t)) > MAX_TEMPLATE_WORDS for _, t in templates):
        raise ValueError(f"a template has over {MAX_TEMPLATE_WORDS} words")
    index = Index(templates, threshold, word_frequencies(docs, templates))
    known = [(np.array(_hashes(p)), label) for p, label in phrases]

    def scan(batches):
        for b in batches:
            ids, out = b.column(0), []
            for w in words(b.column(1), ALNUM):
                out.append(_scan(w, ids, index, known))
            if out:
                yield from pa.Table.from_pandas(pd.concat(out), SCHEMA, preserve_index=False).to_batches()

    return docs.select("doc_id", "text").mapInArrow(scan, RESULT)


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, blocks array<struct<first_word:long,end_word:long,label:string,containment:double>>")
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()),
                                   ("containment", pa.float64())]))),
])


def _scan(w, ids, index: Index, known) -> pd.DataFrame:
    n, firsts = w.hi - w.lo, w.firsts()
    base = [[] for _ in range(n)]  # (place, label)
    for phrase, label in known:
        k = len(phrase)
        if len(w.hash) < k:
            continue
        at = np.flatnonzero(w.hash[:len(w.hash) - k + 1] == phrase[0])
        at = at[w.text[at] == w.text[at + k - 1]]
        for j in range(1, k):
            at = at[w.hash[at + j] == phrase[j]]
        for a in at:
            base[w.text[a]].append((int(a - firsts[w.text[a]]), label))
    blocks: dict[int, list] = {}
    rare = np.flatnonzero(np.isin(w.hash, index.prefix))
    if len(rare):
        first, end = _blocks(w)
        order = np.argsort(first, kind="stable")
        first, end = first[order], end[order]
        lo, hi = np.searchsorted(rare, first), np.searchsorted(rare, end)
        for i in np.flatnonzero(hi > lo):
            block = {int(h) for h in w.hash[first[i]:end[i]]}
            doc = int(w.text[first[i]])
            for t, share in index.best(block, [int(h) for h in w.hash[rare[lo[i]:hi[i]]]]):
                blocks.setdefault(doc, []).append({"first_word": int(first[i] - firsts[doc]), "end_word": int(end[i] - firsts[doc]),
                                                   "label": index.items[t][0], "containment": share})
    rows = []
    counts = w.counts()
    for i in range(n):
        places, found = base[i], blocks.get(i, [])
        own = {x for _, x in places}
        score = 1.0 if places else max((x["containment"] for x in found), default=0.0)
        rows.append((ids[w.lo + i].as_py(), int(counts[i]), len(places), min(p for p, _ in places) if places else None,
                     max(p for p, _ in places) if places else None, ",".join(sorted(own)),
                     ",".join(sorted(own | {x["label"] for x in found})), score, found))
    return pd.DataFrame(rows, columns=SCHEMA.names)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Phrase places and license labels of every document."""
    from .common import documents

    return scan_licenses(documents(spark, sf_dir)).withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")
