"""LM scoring with a hierarchical Pitman-Yor language model.

Every token is a customer of a restaurant: that of the word before it, whichever it is (a text's start counts as a word).
The parent of all of them is the unigram restaurant, and below it every known word and one unknown word are equally
likely. The first customer of a dish at a table is sent on to the parent as its customer.

Seatings are drawn by blocked Gibbs sweeps: a sweep seats every restaurant's customers anew, dish by dish, given the
other restaurants and the totals of the sweep before. A dish's customers come one by one and open a table with
probability (theta + d T) P / (i - d t + (theta + d T) P); beyond the first SINGLY they come in growing groups, and the
number of tables that a group opens is its mean, rounded up or down at random. Random numbers are hashes of (word, word
before, sweep, step): they depend on nothing of how the work is dealt. After BURN sweeps, a token's probability is the
average of the predictive probabilities of the remaining ones. Discounts are estimated from the counts of one and two.

Nothing is cut: contexts are the words themselves, and their number grows with the corpus. Documents are counted in blocks
(an Arrow batch each). The pairs (word, word before) lie in a grid: its rows are classes of the word, its columns classes
of the word before, so that a frequent word or context is spread over a whole row or column. The words' own totals
(customers and tables of the unigram restaurant, tables of the word's restaurant) lie by word, in as many parts. Most pairs
occur once and have one table for good; only the others are seated. A sweep sends the sums of tables from the grid to the
words that a part of the grid holds, and their new totals back, in the order of lists that both know. What comes to the
driver are two numbers a sweep. A block asks once for each of its distinct pairs and words, and adds up the answers.

Edge cases: a null text counts as empty: its one token is the end; a null doc_id counts as empty text for the fold and is
kept; repeated rows are scored each; without training text every token is unknown and scores are finite; an empty table
gives an empty result; the documents' other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import mix, words

CONTEXTS, GROUPS = 256, 16  # of Dishes
SHARE = CONTEXTS // GROUPS
SWEEPS, BURN = 4, 1
THETA = (1.0, 1.0, 1.0)  # the unigram restaurant first, the contexts' last
SINGLY = 16
FOLDS, HELD_FOLD = 10, 0
DOCS_PER_ROW = 256
GRID_BYTES = 1 << 24  # bytes of text a part of the grid
_U = np.uint64
END = np.int64(mix(np.array([3], np.uint64)).view(np.int64)[0])
BOS = np.int64(mix(np.array([5], np.uint64)).view(np.int64)[0])


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_FOLD


@dataclass
class Block:
    """Tokens of a batch of texts: distinct words, distinct (word, word before) pairs in order, and each token's word."""

    words: np.ndarray  # sorted; the start of a text is among them
    trained: np.ndarray  # training tokens of the words; of the start, training texts
    pairs: np.ndarray  # number of the word * number of words + number of the word before
    counts: np.ndarray  # training tokens of the pairs
    token: np.ndarray  # number of each token's word
    tokens: np.ndarray  # of each text


def block_of(texts: pa.Array, train: np.ndarray) -> Block:
    h, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in words(texts):
        h.append(w.hash)
        counts.append(w.counts())
    h, counts = np.concatenate(h).view(np.int64), np.concatenate(counts)
    distinct, token = np.unique(np.append(np.insert(h, np.cumsum(counts), END), BOS), return_inverse=True)
    del h
    token, counts = token[:-1], counts + 1
    pairs, pair = pairs_of(token, counts, distinct)
    each = np.repeat(train, counts)
    trained = np.bincount(token, each, len(distinct)).astype(np.int64)
    trained[np.searchsorted(distinct, BOS)] = train.sum()
    return Block(distinct, trained, pairs, np.bincount(pair, each, len(pairs)).astype(np.int64), token.astype(np.int32), counts)


def pairs_of(token: np.ndarray, tokens: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word, word before) pairs of a block, in order, and each token's pair."""
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1]
    before[np.cumsum(tokens) - tokens] = np.searchsorted(distinct, BOS)
    return np.unique(token.astype(np.int64) * len(distinct) + before, return_inverse=True)


def _place(w: np.ndarray) -> np.ndarray:
    return (mix(w.view(np.uint64) ^ _U(0x632BE59BD9B4E019)) >> _U(33)).astype(np.int64)


def _part(pairs: np.ndarray, place: np.ndarray, grid: int) -> np.ndarray:
    """Part of the grid of every pair of a block."""
    word, before = np.divmod(pairs, len(place))
    part = (place % grid)[word] * grid + (place % grid)[before]
    return part.astype(np.uint16) if grid < 256 else part


# ----------------------------------------------------------------- rows on their way
# A row goes to a part (of the grid or of the words) and says who sent it; its arrays are packed.
COLUMNS = "abcde"
ROW = "part long, sender long, a binary, b binary, c binary, d binary, e binary, kind int"
(PAIRS, WORDS, ASK, COUNT, DISH, SUMS_W, SUMS_U, NODE, WANT, LINK_W, LINK_U, REPLY_W, REPLY_U, STATE, NUMBERS, ANSWER, TOTALS, HEAD,
 TEXTS) = range(19)
_TYPES = (np.uint8, np.uint16, np.uint32, np.uint64)


def pack(a: np.ndarray) -> bytes:
    """Numbers from 0 in the smallest type that holds them, compressed."""
    kind = next(i for i, t in enumerate(_TYPES) if not len(a) or int(a.max()) <= np.iinfo(t).max)
    data = np.ascontiguousarray(a.astype(_TYPES[kind])).tobytes()
    return bytes([kind]) + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data) -> np.ndarray:
    data = memoryview(data)
    size = int.from_bytes(data[1:9], "little")
    raw = pa.decompress(pa.py_buffer(data[9:]), decompressed_size=size, codec="zstd") if size else b""
    return np.frombuffer(raw, _TYPES[data[0]]).astype(np.int64)


def _hashes(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int64)


def _rows(rows) -> pa.RecordBatch:
    """(kind, part, sender, arrays as bytes) of each row."""
    kind, part, sender, data = zip(*rows, strict=True)
    arrays = [pa.array([d[i] if i < len(d) else None for d in data], pa.binary()) for i in range(len(COLUMNS))]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(sender, pa.int64()), *arrays, pa.array(kind, pa.int32())],
                                      names=["part", "sender", *COLUMNS, "kind"])


def _groups(batches):
    """Rows sorted by part -> (part, {kind: [(sender, arrays as bytes), ...] by sender})."""
    now, held = None, {}
    for b in batches:
        part, sender, kind = (b.column(c).to_numpy() for c in ("part", "sender", "kind"))
        data = [b.column(c) for c in COLUMNS]
        for i in range(b.num_rows):
            if part[i] != now and held:
                yield now, held
                held = {}
            now = int(part[i])
            held.setdefault(int(kind[i]), []).append((int(sender[i]), [x[i].as_py() for x in data]))
    if held:
        yield now, held


def _dealt(df: DataFrame, grid: int) -> DataFrame:
    """Rows by part, in as many partitions as there are parts, so that a task's rows do not grow with the input."""
    return df.repartition(grid * grid, "part").sortWithinPartitions("part", "kind", "sender")


def _of(df: DataFrame, *kinds: int) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def _blocks(batches):
    for i, b in enumerate(batches):
        if not b.num_rows:
            continue
        ids = b.column(0).to_pylist()
        train = np.array([not is_held_out(d) for d in ids], bool)
        yield (b.column(2)[0].as_py() << 24) + i, ids, train, block_of(b.column(1), train)


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)) if len(values) else np.zeros(1, np.int64)


# ----------------------------------------------------------------- counting
def _asked(grid: int):
    """For every block: its pairs with their training counts to the grid, its words to the words' parts."""

    def asked(batches):
        for number, _, _, b in _blocks(batches):
            place = _place(b.words)
            part = _part(b.pairs, place, grid)
            order = np.argsort(part, kind="stable")
            cuts = _cuts(part[order])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[lo:hi]
                word, before = np.divmod(b.pairs[at], len(b.words))
                each = _cuts(word)
                yield _rows([(PAIRS, part[at[0]], number, [b.words[word[each[:-1]]].tobytes(), pack(np.diff(each)), b.words[before].tobytes(),
                                                           pack(b.counts[at])])])
            node = place % (grid * grid)
            order = np.argsort(node, kind="stable")
            cuts = _cuts(node[order])
            yield _rows([(WORDS, node[order[lo]], number, [b.words[order[lo:hi]].tobytes(), pack(b.trained[order[lo:hi]])])
                         for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])

    return asked


def _listed(x: np.ndarray, grid: int, cell: int):
    """Sorted words of a row or column of the grid -> their order by the part that has their totals, where each part's
    start, and the parts."""
    node = _place(x) % (grid * grid)
    order = np.argsort(node, kind="stable")
    parts = np.arange(grid) * grid + cell
    return order, np.searchsorted(node[order], np.append(parts, grid * grid)), parts


def _counted(grid: int):
    """The grid's pairs counted over all blocks; which of them each block asked for; the dishes that need seating; to the words'
    parts, the number of contexts of each word and of words after it. The blocks' words pass through."""

    def counted(batches):
        for part, rows in _groups(batches):
            if WORDS in rows:
                yield _rows([(WORDS, part, sender, data) for sender, data in rows[WORDS]])
            if PAIRS not in rows:
                continue
            got = rows.pop(PAIRS)
            sizes = [unpack(d[1]) for _, d in got]
            w, word = np.unique(_hashes(d[0] for _, d in got), return_inverse=True)
            word = np.repeat(word, np.concatenate(sizes))
            u, before = np.unique(_hashes(d[2] for _, d in got), return_inverse=True)
            pairs, at = np.unique(word * len(u) + before, return_inverse=True)
            total = np.bincount(at, np.concatenate([unpack(d[3]) for _, d in got]), len(pairs)).astype(np.int64)
            ends = np.cumsum([int(s.sum()) for s in sizes])
            for (sender, _), lo, hi in zip(got, np.append(0, ends[:-1]), ends, strict=True):
                yield _rows([(ASK, part, sender, [pack(np.diff(at[lo:hi], prepend=0))])])
            del got, word, before, at
            word, before = np.divmod(pairs, len(u))
            dish, many = total > 0, total > 1
            yield _rows([(COUNT, part, part, [pack(total)]), (NUMBERS, 0, part, [pack(np.array([(total == 1).sum(), (total == 2).sum()]))])])
            seats, number = [], []
            for kind, x, of, cell in ((SUMS_W, w, word, part // grid), (SUMS_U, u, before, part % grid)):
                number_of, seated = np.bincount(of[dish], minlength=len(x)), np.bincount(of[many], minlength=len(x)) > 0
                order, first, parts = _listed(x, grid, cell)
                for q, lo, hi in zip(parts, first[:-1], first[1:], strict=True):
                    mine = order[lo:hi][number_of[order[lo:hi]] > 0]
                    if len(mine):
                        yield _rows([(kind, q, part, [x[mine].tobytes(), pack(number_of[mine]), pack(seated[mine])])])
                kept = order[seated[order]]
                place = np.zeros(len(x), np.int64)
                place[kept] = np.arange(len(kept))
                seats.append(place[of[many]])
                number.append(np.diff(np.append(0, np.cumsum(seated[order]))[first]))
            if many.any():
                key = mix(mix(w[word[many]].view(np.uint64)) ^ mix(u[before[many]].view(np.uint64) + _U(2001)))
                yield _rows([(DISH, part, part, [pack(seats[0]), pack(seats[1]), pack(total[many]), key.tobytes(), pack(np.concatenate(number))])])

    return counted


def _nodes(grid: int):
    """The words' parts: training tokens, contexts and following words of each word; who asks for which; totals of the first seating."""

    def nodes(batches):
        for part, rows in _groups(batches):
            asked = rows.get(WORDS, [])
            x, at = np.unique(_hashes(d[0] for _, d in asked), return_inverse=True)
            counts = [unpack(d[1]) for _, d in asked]
            n = np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(x)).astype(np.int64)
            ends = np.cumsum([len(c) for c in counts])
            for (sender, d), lo, hi in zip(asked, np.append(0, ends)[:-1], ends, strict=True):
                yield _rows([(WANT, part, sender, [pack(np.diff(at[lo:hi], prepend=0)), np.bitwise_xor.reduce(_hashes(d[:1])).tobytes()])])
            sums, links = {SUMS_W: np.zeros(len(x), np.int64), SUMS_U: np.zeros(len(x), np.int64)}, {}
            for kind in (SUMS_W, SUMS_U):
                for sender, d in rows.get(kind, []):
                    at = np.searchsorted(x, _hashes(d[:1]))
                    sums[kind][at] += unpack(d[1])
                    links.setdefault(kind, []).append((sender, at[unpack(d[2]) > 0]))
            c, after = sums[SUMS_W], sums[SUMS_U]
            links = [(LINK_W if kind == SUMS_W else LINK_U, sender, at) for kind, of in links.items() for sender, at in of if len(at)]
            for kind, sender, at in links:
                yield _rows([(kind, part, sender, [pack(np.diff(at, prepend=0))])])
            known = (n > 0) & (x != BOS)
            yield _rows([(NODE, part, part, [x.tobytes(), pack(n), pack(c), pack(after)]),
                         (NUMBERS, 1, part, [pack(np.array([known.sum(), n[known].sum(), (n[known] == 1).sum(), (n[known] == 2).sum()]))])])
            yield from _told(part, c, np.minimum(c, 1), after, links)

    return nodes


def _told(part: int, c, t, after, links):
    """A words' part's totals: kept, summed up, and sent to the parts of the grid that hold the words."""
    yield _rows([(STATE, part, part, [pack(c), pack(t), pack(after)]), (NUMBERS, 2, part, [pack(np.array([c.sum(), t.sum()]))])])
    for kind, to, at in links:
        data = [pack(c[at]), pack(t[at])] if kind == LINK_W else [pack(after[at])]
        yield _rows([(REPLY_W if kind == LINK_W else REPLY_U, to, part, data)])


def _numbers(df: DataFrame) -> dict:
    """Sums of the number rows by their place; a row a part comes to the driver in turn, a few numbers each."""
    def add(batches):
        out = {}
        for b in batches:
            for part, a in zip(b.column("part").to_pylist(), b.column("a").to_pylist(), strict=True):
                v = unpack(a)
                out[part] = out.get(part, 0) + v
        rows = [(part, i, int(n)) for part, v in out.items() for i, n in enumerate(v)]
        if rows:
            part, place, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64())], names=["part", "place", "n"])

    rows = _of(df, NUMBERS).select("part", "a").mapInArrow(add, "part long, place long, n long")
    return {(r["part"], r["place"]): r["n"] for r in rows.groupBy("part", "place").agg(F.sum("n").alias("n")).collect()}


# ----------------------------------------------------------------- the model
@dataclass
class Totals:
    """Customers C and tables T of the restaurants of each level after a sweep (of the unigram restaurant alone in ``fit``)."""

    C: list[np.ndarray]
    T: list[np.ndarray]


@dataclass
class Model:
    vocabulary: int
    tokens: int
    discounts: tuple[float, ...]  # the unigram restaurant's first, the contexts' last
    history: list[Totals]

    @property
    def base(self) -> float:
        return 1.0 / (self.vocabulary + 1)


def predictive(c, t, C, T, level: int, discount: float, above):
    """Predictive probability of dishes with c customers at t tables in restaurants with C customers at T tables."""
    return (np.maximum(c - discount * t, 0) + (THETA[level] + discount * T) * above) / (THETA[level] + C)


def unigram(c, t, totals: Totals, model: Model):
    """Predictive probability of words in the unigram restaurant."""
    return predictive(c, t, float(totals.C[0]), float(totals.T[0]), 0, model.discounts[0], model.base)


class Dishes:
    """The sampler in memory over a closed set of numbered contexts, with groups of them as a level between: 2 contexts, 1 groups,
    0 the unigram restaurant. What is dealt over tasks has as many contexts as the corpus and takes its steps from the same functions."""

    def __init__(self, w: np.ndarray, ctx: np.ndarray, n: np.ndarray, first: np.ndarray):
        self.w = w.view(np.uint64)
        word = np.repeat(np.arange(len(w)), np.diff(first))
        groups, self.up2 = np.unique(word * GROUPS + ctx.astype(np.int64) // SHARE, return_inverse=True)
        self.word = [np.arange(len(w)), groups // GROUPS, word]
        self.where = [np.zeros(len(w), np.int64), groups % GROUPS, ctx.astype(np.int64)]
        self.up = [None, self.word[1], self.up2]
        self.key = [mix(self.w[self.word[k]] ^ mix(self.where[k].astype(np.uint64) + _U(1000 * k + 1))) for k in range(3)]
        self.n = n
        self.known = np.bincount(word, n, len(w)) > 0

    def start(self):
        """The seating with one table for every dish of a restaurant."""
        c2, t2 = self.n, np.ones(len(self.n), np.int64)
        c1 = np.bincount(self.up[2], t2, len(self.word[1])).astype(np.int64)
        t1 = np.ones(len(c1), np.int64)
        c0 = np.bincount(self.up[1], t1, len(self.w)).astype(np.int64)
        return [c0, c1, c2], [np.minimum(c0, 1), t1, t2]

    def probabilities(self, c, t, totals: Totals, model: Model):
        """Predictive probability of the dishes in the restaurants of each level, with a parent's weight per level."""
        parent = np.full(len(self.w), model.base)
        out = []
        for k in range(3):
            d, C, T = model.discounts[k], totals.C[k][self.where[k]], totals.T[k][self.where[k]]
            above = parent if k == 0 else out[k - 1][self.up[k]]
            out.append(predictive(c[k], t[k], C, T, k, d, above))
        return out

    def sweep(self, c, t, totals: Totals, model: Model, number: int):
        """All customers seated anew, context restaurants first, given the totals and parents of the sweep before."""
        p = self.probabilities(c, t, totals, model)
        c, t = list(c), list(t)
        for k in (2, 1, 0):
            above = np.full(len(self.w), model.base) if k == 0 else p[k - 1][self.up[k]]
            pull = (THETA[k] + model.discounts[k] * totals.T[k][self.where[k]]) * above
            t[k] = seat(c[k], pull, model.discounts[k], mix(self.key[k] + _U(number)))
            if k:
                c[k - 1] = np.bincount(self.up[k], t[k], len(self.word[k - 1])).astype(np.int64)
        return c, t

    def sweeps(self, model: Model):
        """(customers, tables) of every sweep that the model's history has totals for, and one more."""
        c, t = self.start()
        yield c, t
        for number, totals in enumerate(model.history):
            c, t = self.sweep(c, t, totals, model, number)
            yield c, t


def seat(c: np.ndarray, pull: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Number of tables that c customers of a dish take."""
    t = np.minimum(c, 1).astype(float)
    live = np.flatnonzero(c > 1)
    i, step = 1, 0
    while len(live):
        size = 1 if i < SINGLY else max(1, i // 4)
        come = np.minimum(size, c[live] - i)
        opens = pull[live] / (pull[live] + i + (come - 1) / 2 - d * t[live]) * come
        u = (mix(key[live] + _U(step)) >> _U(11)).astype(float) / float(1 << 53)
        t[live] = np.minimum(t[live] + np.floor(opens + u), c[live])
        i, step = i + size, step + 1
        live = live[c[live] > i]
    return t.astype(np.int64)


SIZES = (1, GROUPS, CONTEXTS)


# ----------------------------------------------------------------- sweeps
@dataclass
class Seats:
    """Dishes of a part of the grid that need seating: places in its lists of words and of contexts, customers, random key."""

    word: np.ndarray
    before: np.ndarray
    n: np.ndarray
    key: np.ndarray
    sizes: np.ndarray  # of the lists: entries of each of the parts that have the totals, words' first

    @staticmethod
    def of(row) -> Seats:
        word, before, n, key, sizes = row
        return Seats(unpack(word), unpack(before), unpack(n), np.frombuffer(key, np.uint64), unpack(sizes))

    def tables(self, replies_w, replies_u, model: Model, number: int) -> np.ndarray:
        """Tables of the dishes after sweep ``number``, given the totals of the sweep before."""
        c, t = (np.concatenate([unpack(d[i]) for _, d in replies_w]) for i in (0, 1))
        p = unigram(c, t, model.history[number - 1], model)
        after = np.concatenate([unpack(d[0]) for _, d in replies_u])
        d = model.discounts[-1]
        return seat(self.n, (THETA[-1] + d * after[self.before]) * p[self.word], d, mix(self.key + _U(number)))


def _seated(model: Model, number: int, grid: int):
    """A sweep of the grid: tables beyond the first, summed by word and by word before, to the words' parts."""

    def seated(batches):
        for part, rows in _groups(batches):
            seats = Seats.of(rows[DISH][0][1])
            t = seats.tables(rows[REPLY_W], rows[REPLY_U], model, number) - 1
            for kind, at, sizes, cell in ((SUMS_W, seats.word, seats.sizes[:grid], part // grid), (SUMS_U, seats.before, seats.sizes[grid:], part % grid)):
                sums, ends = np.bincount(at, t, int(sizes.sum())).astype(np.int64), np.cumsum(sizes)
                out = [(kind, i * grid + cell, part, [pack(sums[ends[i] - sizes[i]:ends[i]])]) for i in range(grid) if sizes[i]]
                yield _rows(out)

    return seated


def _swept(model: Model, number: int):
    """A sweep of the words' parts: the sums of tables added, the unigram restaurant seated anew."""

    def swept(batches):
        for part, rows in _groups(batches):
            x, _, c, after = (_hashes([d]) if i == 0 else unpack(d) for i, d in enumerate(rows[NODE][0][1][:4]))
            links = []
            for kind, sums, into in ((LINK_W, SUMS_W, c), (LINK_U, SUMS_U, after)):
                told = dict(rows.get(sums, []))
                for sender, d in rows.get(kind, []):
                    at = np.cumsum(unpack(d[0]))
                    into[at] += unpack(told[sender][0])
                    links.append((kind, sender, at))
            pull = (THETA[0] + model.discounts[0] * float(model.history[number - 1].T[0])) * model.base
            t = seat(c, np.full(len(c), pull), model.discounts[0], mix(mix(x.view(np.uint64)) + _U(number)))
            yield from _told(part, c, t, after, links)

    return swept


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def _history(numbers: dict) -> Totals:
    return Totals([numbers.get((2, 0), 0)], [numbers.get((2, 1), 0)])


def fit(counted: DataFrame, grid: int, sweeps: int = SWEEPS) -> tuple[Model, DataFrame, list[DataFrame]]:
    """The model, the words' lists, and the words' totals after each sweep with the replies to the grid."""
    nodes = written(_dealt(_of(counted, WORDS, SUMS_W, SUMS_U), grid).mapInArrow(_nodes(grid), ROW), "words", ["kind"])
    of_pairs, got = _numbers(counted), _numbers(nodes)
    vocabulary, tokens, once, twice = (got.get((1, i), 0) for i in range(4))
    discounts = (_discount(once, twice), _discount(of_pairs.get((0, 0), 0), of_pairs.get((0, 1), 0)))
    model, states = Model(vocabulary, tokens, discounts, [_history(got)]), [nodes]
    for number in range(1, sweeps + 1):
        asked = _of(counted, DISH).unionByName(_of(states[-1], REPLY_W, REPLY_U))
        sums = _dealt(asked, grid).mapInArrow(_seated(model, number, grid), ROW)
        state = _dealt(sums.unionByName(_of(nodes, NODE, LINK_W, LINK_U)), grid).mapInArrow(_swept(model, number), ROW)
        states.append(written(state, "sweep", ["kind"]))
        model.history.append(_history(_numbers(states[-1])))
    return model, nodes, states


# ----------------------------------------------------------------- scores
def _tagged(states: list[DataFrame], numbers, *kinds: int) -> DataFrame:
    """Rows of several sweeps, the sweep's number before the sender."""
    out = None
    for s in numbers:
        rows = _of(states[s], *kinds).withColumn("sender", F.col("sender") + F.lit(s << 40))
        out = rows if out is None else out.unionByName(rows)
    return out


def _untagged(rows):
    out = {}
    for sender, d in rows:
        out.setdefault(sender >> 40, []).append((sender & ((1 << 40) - 1), d))
    return out


def _pair_answers(model: Model, kept: list[int]):
    """For every block that asks a part of the grid: customers of its pairs, and their tables summed over the kept sweeps."""

    def answer(batches):
        for part, rows in _groups(batches):
            c = unpack(rows[COUNT][0][1][0])
            t = np.minimum(c, 1) * len(kept)
            if DISH in rows:
                seats, w, u = Seats.of(rows[DISH][0][1]), _untagged(rows.get(REPLY_W, [])), _untagged(rows.get(REPLY_U, []))
                t[c > 1] = sum(seats.tables(w[s - 1], u[s - 1], model, s) if s else np.ones(len(seats.n), np.int64) for s in kept)
            for block, d in rows.get(ASK, []):
                at = np.cumsum(unpack(d[0]))
                yield _rows([(ANSWER, block, part, [pack(c[at]), pack(t[at])])])

    return answer


def _word_answers(kept: list[int]):
    """For every block that asks a part of the words: training tokens, and the totals of the kept sweeps one after the other."""

    def answer(batches):
        for part, rows in _groups(batches):
            n = unpack(rows[NODE][0][1][1])
            states = _untagged(rows[STATE])
            totals = [[unpack(x) for x in states[s][0][1][:3]] for s in kept]
            for block, d in rows.get(WANT, []):
                at = np.cumsum(unpack(d[0]))
                yield _rows([(TOTALS, block, part, [pack(n[at]), *(pack(np.concatenate([x[i][at] for x in totals])) for i in range(3)), d[1]])])

    return answer


def _documents(batches):
    """A block's words, then rows of up to DOCS_PER_ROW of its documents: ids, which are null, tokens of each, every token's word."""
    for number, ids, _, b in _blocks(batches):
        yield _rows([(HEAD, number, 0, [b.words.tobytes()])])
        last = np.append(0, np.cumsum(b.tokens))
        for lo in range(0, len(ids), DOCS_PER_ROW):
            hi = min(len(ids), lo + DOCS_PER_ROW)
            some = ids[lo:hi]
            yield _rows([(TEXTS, number, lo, [np.array([i or 0 for i in some], np.int64).tobytes(), bytes(i is None for i in some),
                                              pack(b.tokens[lo:hi]), pack(b.token[last[lo]:last[hi]])])])


def _scores(model: Model, kept: list[int], grid: int):
    """mapInArrow function over a block's answers, its words and its documents."""

    def score(batches):
        for _, rows in _groups(batches):
            x = _hashes(rows[HEAD][0][1][:1])
            place = _place(x)
            check, order = 0, np.argsort(place % (grid * grid), kind="stable")
            n, totals = np.zeros(len(x), np.int64), np.zeros((3, len(kept), len(x)), np.int64)
            lo = 0
            for _, d in rows.pop(TOTALS):
                mine = unpack(d[0])
                at = order[lo:lo + len(mine)]
                n[at] = mine
                for i in range(3):
                    totals[i][:, at] = unpack(d[1 + i]).reshape(len(kept), -1)
                check ^= int(np.frombuffer(d[4], np.int64)[0])
                lo += len(mine)
            texts = [(np.frombuffer(d[0], np.int64), np.frombuffer(d[1], np.uint8), unpack(d[2]), unpack(d[3]).astype(np.int32))
                     for _, d in rows.pop(TEXTS)]
            token, tokens = (np.concatenate([t[i] for t in texts]) for i in (3, 2))
            pairs, pair = pairs_of(token, tokens, x)
            part = _part(pairs, place, grid)
            at = np.argsort(part, kind="stable")
            answers = rows.pop(ANSWER)
            c, t = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            for into, i in ((c, 0), (t, 1)):
                got = np.concatenate([unpack(d[i]) for _, d in answers])
                if len(got) != len(pairs) or lo != len(x) or check != int(np.bitwise_xor.reduce(x)):
                    raise RuntimeError("a block's documents and its words come from different rows of the input")
                into[at] = got
            del answers, got, at, part
            word, before = np.divmod(pairs, len(x))
            mean = np.zeros(len(pairs))
            for i, s in enumerate(kept):
                p = unigram(totals[0][i], totals[1][i], model.history[s], model)
                mean += (THETA[-1] + model.discounts[-1] * totals[2][i])[before] * p[word]
            mean = (np.maximum(c - model.discounts[-1] / len(kept) * t, 0) + mean / len(kept)) / (THETA[-1] + n[before])
            lp = np.log10(mean)
            base = np.log10((n + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
            lo = 0
            for ids, null, m, w in texts:
                hi, start = lo + len(w), np.cumsum(m) - m
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, mask=null > 0), "held_out": pa.array([is_held_out(None if k else i) for i, k in zip(ids.tolist(), null, strict=True)]),
                    "n_tokens": m, "n_known": np.add.reduceat((n[w] > 0).astype(np.int64), start), "train_tokens": np.full(len(m), model.tokens, np.int64),
                    "base_score": np.add.reduceat(base[w], start), "score": np.add.reduceat(lp[pair[lo:hi]], start)})
                lo = hi

    return score


def score_documents(docs: DataFrame, sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every document."""
    # The scan's own partition number: both passes below read the same splits, and each block checks that.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("split"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grid = max(2, math.ceil(math.sqrt(size / GRID_BYTES)))
    counted = written(_dealt(docs.mapInArrow(_asked(grid), ROW), grid).mapInArrow(_counted(grid), ROW), "pairs", ["kind"])
    model, nodes, states = fit(counted, grid, sweeps)
    kept = list(range(burn + 1, sweeps + 1)) or list(range(sweeps + 1))
    pairs = _of(counted, ASK, COUNT, DISH)
    if any(kept):
        pairs = pairs.unionByName(_tagged(states, [s - 1 for s in kept if s], REPLY_W, REPLY_U))
    answers = _dealt(pairs, grid).mapInArrow(_pair_answers(model, kept), ROW)
    totals = _dealt(_of(nodes, NODE, WANT).unionByName(_tagged(states, kept, STATE)), grid).mapInArrow(_word_answers(kept), ROW)
    both = answers.unionByName(totals).unionByName(docs.mapInArrow(_documents, ROW))
    out = _dealt(both, grid).mapInArrow(_scores(model, kept, grid), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document."""
    from .common import documents

    return score_documents(documents(spark, sf_dir))
