"""Language identification by unigram pieces, summed over all segmentations of every word.

A text's score in a language is the product, over its words, of the probability that the language's unigram model emits
the word: the forward algorithm adds up all ways of cutting it into pieces of a fixed public vocabulary. Each language
has its own piece probabilities, trained by expectation maximisation (forward-backward over all segmentations) on a
bounded sample: SAMPLE_DOCS documents per language, taken whole, by hash. Everything else reads all rows.

Texts are scored about two megabytes at a time. A word scores the same wherever it stands, so a task scores only words that
it has not met (up to KNOWN_WORDS, then it starts anew). The forward pass holds as many characters' sums as the longest
piece has, scaled so that no word is too long for it. Memory follows neither the batch nor the text but for its own bytes.

Words are runs of letters, lower-cased. In training alone, runs over MAX_LETTERS letters are cut and their parts learned
from as words that go on. The vocabulary's path is a parameter; its pieces are read on the driver and travel with the task.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled text to learn from every
text is ``und``; equal posteriors go to the first language in code point order; other columns pass through whatever their
names; a column named like the result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mixing import uniform
from .tokens import LETTER, mix, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 400
ROUNDS = 4
MAX_LETTERS = 32
SMOOTHING = 0.05
UND = "und"
START = "▁"  # the vocabulary's mark for the start of a word
_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with or without the mark for a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in own if p.removeprefix(START).isalpha() or p == START)


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts of one length, a row each."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _B, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


@dataclass
class Lattice:
    """Finds the piece, if any, at every place of words of one length. Piece 0 stands for any one unknown character."""

    hashes: np.ndarray
    ids: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Lattice:
        h = np.array([cls._whole(p) for p in pieces], np.uint64)
        order = np.argsort(h)
        return cls(h[order], order + 1, max(map(len, pieces)))

    @staticmethod
    def _whole(piece: str) -> np.uint64:
        c = mix(_codes([piece])[0] + np.uint64(1))
        n = len(c)
        return mix(np.array([(c * _powers(n)[::-1]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))[0]

    def places(self, codes: np.ndarray):
        """(start, length, piece of each word there or -1) for every span of the words."""
        m, n = codes.shape
        c = mix(codes + np.uint64(1))
        for length in range(1, min(n, self.longest) + 1):
            h = None
            for j in range(length):
                part = c[:, j:n - length + 1 + j]
                h = part.copy() if h is None else h * _B + part
            h = mix(h + np.uint64(length))
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, self.ids[at], 0 if length == 1 else -1)
            for i in range(n - length + 1):
                yield i, length, found[:, i]


def forward(lattice: Lattice, prob: np.ndarray, codes: np.ndarray):
    """Probability of the first i characters, summed over their segmentations: array (words, i, languages)."""
    m, n = codes.shape
    spans: dict[int, list] = {}
    for i, length, piece in lattice.places(codes):
        if (piece >= 0).any():
            spans.setdefault(i, []).append((length, piece))
    alpha = np.zeros((m, n + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for i in range(n):
        for length, piece in spans.get(i, ()):
            has = np.flatnonzero(piece >= 0)
            alpha[has, i + length] += alpha[has, i] * prob[piece[has]]
    return alpha, spans


def by_length(texts: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        out.setdefault(len(t), []).append(i)
    return out


CELLS = 1 << 20
RESCALE = 8


def log_likelihoods(lattice: Lattice, prob: np.ndarray, texts: list[str], cells: int = CELLS) -> np.ndarray:
    """log P(word | language) of every word (a row each), over all segmentations; words of like length go together."""
    out = np.zeros((len(texts), prob.shape[1]))
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(size, kind="stable")
    lo = 0
    while lo < len(order):
        fits = np.arange(1, len(order) - lo + 1) * np.maximum(size[order[lo:]], 1) <= cells  # words x letters of the longest
        hi = lo + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        part = order[lo:hi]
        out[part] = _forward_ends(lattice, prob, [texts[i] for i in part], size[part])
        lo = hi
    return out


def _forward_ends(lattice: Lattice, prob: np.ndarray, texts: list[str], size: np.ndarray) -> np.ndarray:
    """Log of the forward sum at each word's end; of the sums before, only those that a piece can reach back to are held."""
    widest = int(size[-1])
    codes = np.frombuffer("".join(t.ljust(widest, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), widest)
    codes = np.ascontiguousarray(mix(codes.T.astype(np.uint64) + np.uint64(1)))  # a row a place
    ring = lattice.longest + 1
    sums = np.zeros((ring, len(texts), prob.shape[1]))
    sums[0] = 1.0
    scale, out = np.zeros((len(texts), prob.shape[1])), np.zeros((len(texts), prob.shape[1]))
    for i in range(widest):
        live = int(np.searchsorted(size, i, "right"))  # words are in order of length; those before are over
        here, h = sums[i % ring, live:], np.zeros(len(texts) - live, np.uint64)
        for length in range(1, min(lattice.longest, widest - i) + 1):
            h = h * _B + codes[i + length - 1, live:]
            span = mix(h + np.uint64(length))
            at = np.minimum(np.searchsorted(lattice.hashes, span), len(lattice.hashes) - 1)
            piece = np.where(lattice.hashes[at] == span, lattice.ids[at], 0 if length == 1 else -1)
            has = np.flatnonzero((piece >= 0) & (size[live:] >= i + length))
            sums[(i + length) % ring, live + has] += here[has] * prob[piece[has]]
        done = np.flatnonzero(size[live:] == i + 1) + live
        out[done] = np.log(sums[(i + 1) % ring, done]) + scale[done]
        sums[i % ring] = 0.0
        if i % RESCALE == RESCALE - 1 and i + 1 < widest:
            most = sums[:, live:].max(axis=0)
            most[most == 0] = 1.0
            sums[:, live:] /= most
            scale[live:] += np.log(most)
    return out


def fit(lattice: Lattice, n_pieces: int, samples: list[dict[str, int]], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (piece, language) by EM over all segmentations of each language's sampled words."""
    out = np.zeros((n_pieces + 1, len(samples)))
    for lang, counts in enumerate(samples):
        texts = list(counts)
        times = np.array([counts[t] for t in texts], float)
        prob = np.full((n_pieces + 1, 1), 1.0 / (n_pieces + 1))
        for _ in range(rounds):
            expected = np.zeros(n_pieces + 1)
            for rows in by_length(texts).values():
                for k in range(0, len(rows), 5_000):
                    part = rows[k:k + 5_000]
                    alpha, spans = forward(lattice, prob, _codes([texts[i] for i in part]))
                    beta = np.zeros_like(alpha)
                    beta[:, -1] = 1.0
                    weight = times[part] / alpha[:, -1, 0]
                    for i in range(alpha.shape[1] - 2, -1, -1):
                        for length, piece in spans.get(i, ()):
                            has = np.flatnonzero(piece >= 0)
                            p = prob[piece[has], 0]
                            beta[has, i, 0] += p * beta[has, i + length, 0]
                            np.add.at(expected, piece[has], alpha[has, i, 0] * p * beta[has, i + length, 0] * weight[has])
            prob = ((expected + SMOOTHING) / (expected.sum() + SMOOTHING * (n_pieces + 1)))[:, None]
        out[:, lang] = prob[:, 0]
    return out


def _cut(word: str) -> list[str]:
    marked = START + word
    return [marked[i:i + MAX_LETTERS] for i in range(0, len(marked), MAX_LETTERS)]


def _text_of(w, i: int) -> str:
    return w.data[w.start[i]:w.end[i]].tobytes().decode("utf-8", "replace")


def train(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS):
    """(languages, lattice, piece probabilities) from a bounded sample of the labelled documents ``docs``."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: x.encode())
    pieces = read_pieces(vocabulary)
    lattice = Lattice.of(pieces)
    if not langs:
        return [], lattice, np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / sizes[lang]))])
    sample = labelled.where(uniform(F.col("doc_id"), "langid") < share[F.col("lang")])

    def count(batches):
        for b in batches:
            for w in words(b.column(1), LETTER):
                lang = np.array([langs.index(x) for x in b.column(0).slice(w.lo, w.hi - w.lo).to_pylist()], np.int64)
                _, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
                if not len(first):
                    continue
                key, n = np.unique(lang[w.text] * len(first) + at, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([langs[k // len(first)] for k in key]),
                                                  "word": pa.array([_text_of(w, first[k % len(first)]) for k in key]), "n": n})

    rows = (sample.select("lang", F.lower("text").alias("text")).mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")).collect())  # words of the bounded sample
    samples: list[dict[str, int]] = [{} for _ in langs]
    for r in sorted(rows, key=lambda r: (r["lang"], r["word"])):
        for part in _cut(r["word"]):
            own = samples[langs.index(r["lang"])]
            own[part] = own.get(part, 0) + r["n"]
    return langs, lattice, fit(lattice, len(pieces), samples)


def identify(docs: DataFrame, labelled: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS,
             into: str = "_language") -> DataFrame:
    """``docs`` with the column ``into`` struct(pred, score) added: the predicted language and its posterior, 0 to 1.

    Predictions read the text alone; ``labelled`` (doc_id, text, lang) is what the model learns from.
    """
    langs, lattice, prob = train(labelled, vocabulary, sample_docs)
    names = [c for c in docs.columns if c != into]
    rows = docs.select(F.struct(*names).alias("row"), F.lower("text").alias("low"))
    language = T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([rows.schema["row"], T.StructField("told", language)])

    def predict(batches):
        scores = WordScores(langs, lattice, prob)
        for b in batches:
            pred, score = scores.predict(b.column(1))
            told = pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["pred", "score"])
            yield pa.RecordBatch.from_arrays([b.column(0), told], names=["row", "told"])

    return rows.mapInArrow(predict, schema).select(*[F.col("row").getField(c).alias(c) for c in names], F.col("told").alias(into))


KNOWN_WORDS = 200_000


class WordScores:
    """Scores of the words that a task has met, by their hashes, and predictions from them."""

    def __init__(self, langs: list[str], lattice: Lattice, prob: np.ndarray):
        self.langs, self.lattice, self.prob = langs, lattice, prob
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.table = np.zeros((0, len(self.langs) + 1))  # the last column: whether the word holds a letter

    def _learn(self, w, hashes: np.ndarray, first: np.ndarray) -> None:
        texts = [_text_of(w, i) for i in first]
        rows = np.zeros((len(texts), len(self.langs) + 1))
        rows[:, :-1] = log_likelihoods(self.lattice, self.prob, [START + t for t in texts])
        rows[:, -1] = [any(c.isalpha() for c in t) for t in texts]
        order = np.argsort(both := np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes, self.table = both[order], np.concatenate([self.table, rows])[order]

    def _of(self, w, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of the table for each distinct word of a piece."""
        if len(self.hashes) + len(hashes) > KNOWN_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = np.ones(len(hashes), bool) if not len(self.hashes) else self.hashes[at] != hashes
        if new.any():
            self._learn(w, hashes[new], first[new])
        return self.table[np.searchsorted(self.hashes, hashes)]

    def predict(self, column) -> tuple[list, np.ndarray]:
        n = len(column)
        pred, score = [UND] * n, np.zeros(n)
        if not self.langs:
            return pred, score
        for w in words(column, LETTER):
            if not len(w.hash):
                continue
            distinct, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
            rows = self._of(w, distinct, first)
            starts = np.flatnonzero(np.append(True, w.text[1:] != w.text[:-1]))
            total = np.add.reduceat(rows[at], starts, axis=0)
            best = total[:, :-1].argmax(axis=1)
            post = 1.0 / np.exp(total[:, :-1] - total[np.arange(len(best)), best][:, None]).sum(axis=1)
            for i in np.flatnonzero(total[:, -1] > 0):
                at_text = w.lo + int(w.text[starts[i]])
                pred[at_text], score[at_text] = self.langs[best[i]], min(1.0, post[i])
        return pred, score


def held_out(docs: DataFrame):
    """Condition: the document's fold (crc32 of doc_id as text, mod 4) is 2; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the labelled documents outside the held-out fold."""
    from .common import documents

    docs = documents(spark, sf_dir)
    learn = docs.where(~held_out(docs)).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), learn)
    return out.select("doc_id", held_out(out).alias("held_out"), F.col("_language.pred").alias("lang_pred"), F.col("_language.score").alias("score"))
