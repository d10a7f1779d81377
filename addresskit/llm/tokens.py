"""Words and their 64-bit hashes of whole texts, vectorised over the byte buffer of an Arrow batch.

Texts are taken in pieces of about PIECE bytes (at least one whole text each), so that a task holds a bounded number
of temporary arrays besides its batch. A null text counts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing (xor-shift and multiply rounds)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_HASH[65:91] = _BYTE_HASH[97:123]  # A-Z count as a-z

# Word bytes of the two word contracts, and letters (every byte of a character beyond ASCII counts as one).
_c = np.arange(256)
NOT_SPACE = ~((_c == 32) | ((_c >= 9) & (_c <= 13)))
ALNUM = ((_c >= 48) & (_c <= 57)) | ((_c >= 65) & (_c <= 90)) | ((_c >= 97) & (_c <= 122)) | (_c >= 128)
LETTER = ALNUM & ~((_c >= 48) & (_c <= 57))

_POWERS: dict[int, np.ndarray] = {}


def _powers(base, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + (1 << 16)), base, np.uint64)
        steps[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass
class Words:
    """Words of texts ``lo``..``hi`` of a batch: byte spans in ``data``, hash, and the text (from 0) each is in."""

    lo: int
    hi: int
    base: int  # where data starts in the column's buffer
    data: np.ndarray
    bounds: np.ndarray  # byte offsets of the texts, hi - lo + 1 of them
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.hi - self.lo)

    def firsts(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a string or binary column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets.astype(np.int64)


def words(column: pa.Array, table: np.ndarray = NOT_SPACE):
    """``Words`` of consecutive texts of the column, about PIECE bytes at a time."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        hi = min(hi, n)
        yield _words(lo, hi, int(offsets[lo]), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], table)
        lo = hi


def _words(lo, hi, base, data, bounds, table) -> Words:
    inside = table[data]
    edge = np.ones(len(data) + 1, bool)  # a word starts where the byte before is none, or a text starts
    edge[1:] = ~np.append(inside, False)[:-1]
    edge[bounds] = True
    start = np.flatnonzero(inside & edge[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = ~inside
    after[bounds] = True
    end = np.flatnonzero(inside & after[1:]) + 1
    text = np.searchsorted(bounds[1:], start, "right")
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASH[data] * _powers(_BASE, len(data)), out=sums[1:])
    h = (sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start] if len(start) else np.zeros(0, np.uint64)
    return Words(lo, hi, base, data, bounds, start, end, text, mix(h + (end - start).astype(np.uint64)))


def hash_word(word: str, table: np.ndarray = NOT_SPACE) -> np.uint64:
    """Hash of one word, as ``words`` gives it."""
    return next(words(pa.array([word]), table)).hash[0]


class Runs:
    """Hashes of any runs of consecutive words, from running sums; equal runs have equal hashes wherever they stand."""

    def __init__(self, h: np.ndarray):
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * _powers(_BASE, len(h)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(h) + 1)

    def raw(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def hash(self, start, end):
        return mix(self.raw(start, end) + (end - start).astype(np.uint64))


_PLACE = mix(np.arange(101, 165, dtype=np.uint64)) | _U(1)


def grams(h: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words inside a text: position of the first word, and hash."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:len(text) - k + 1] == text[k - 1:])
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += h[at + j] * _PLACE[j]
    return at, mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words (any number), different from that of each of its grams."""
    out = _U(len(h) + 7)
    for x in h:
        out = mix(np.array([out ^ x], np.uint64) * _U(0x9E3779B97F4A7C15))[0]
    return out


def shingle_sets(column: pa.Array, k: int = 5):
    """For every text: (index, sorted distinct hashes of its k-word shingles).

    A text with fewer words has its whole sequence as the one shingle; without words the set is empty.
    """
    for w in words(column):
        at, g = grams(w.hash, w.text, k)
        of = w.text[at]
        cuts = np.searchsorted(of, np.arange(w.hi - w.lo + 1))
        first, n = w.firsts(), w.counts()
        for i in range(w.hi - w.lo):
            if n[i] >= k:
                s = np.sort(g[cuts[i]:cuts[i + 1]])
                yield w.lo + i, s[np.append(True, s[1:] != s[:-1])]
            elif n[i]:
                yield w.lo + i, np.array([sequence_hash(w.hash[first[i]:first[i] + n[i]])], np.uint64)
            else:
                yield w.lo + i, np.zeros(0, np.uint64)
