"""Packing: whole documents into training windows by best-fit decreasing.

Every document becomes its token ids and an end id. A document of more than a window is cut into full windows first; what is
left of it, and every shorter document, is placed by decreasing length into the open window with the tightest room, found by
a segment tree over the capacities. Windows that stay open are then closed: the emptiest ones are cut up to fill the others,
and the last one is cut at powers of two, so that next to nothing is padded.

Pieces are dealt to groups of about GROUP_BYTES of text by a hash of their row; a group is packed by one task, the groups
are as many as the input asks for, and no row is treated by its document's source or id.

Edge cases: a null or empty text is its end id alone; rows with equal or null doc_id are documents of their own (``row``
tells them apart); the name of a special token inside a text is ordinary text; an empty table gives an empty result; other
columns of the documents are not read, join them by doc_id.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
GROUP_BYTES = 16 << 20
TOKENIZER = "byte_bpe_50k.json"
PIECES = "row long, doc_id {id}, doc_tokens long, start long, length long, ids binary, group long"
PACKED = "row long, doc_id {id}, doc_tokens long, start long, length long, ids binary, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ------------------------------------------------------------------ token ids
AT_ONCE = 1 << 20
# Fixed value: how the vocabulary cuts a text into words before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")  # tokens never reach over a space between two visible characters
LONG_SPACE = re.compile(r"\s{1000}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by a byte-level vocabulary file of the tokenizers library.

    The file's own merges are run by a faster implementation, which gives the same ids (tests compare them over every code
    point); it cannot take endless white space, so a text with such a run goes to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of, vocab = _byte_of(), model["vocab"]
        merged = [vocab[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
        self.merges = tiktoken.Encoding("merges", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text) or not out:
            cut = SAFE_CUT.search(text, at + AT_ONCE)
            part = text[at:cut.start()] if cut else text[at:]
            at += max(1, len(part))
            out.append(self.plain(part) if LONG_SPACE.search(part) else np.array(self.merges.encode_ordinary(part), "<u4").tobytes())
        return b"".join(out)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents' ids and the end id, cut into full windows and what is left: a row per piece, with its group."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = 1 + int(size) // GROUP_BYTES
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    end = int(end_id).to_bytes(4, "little")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches):
        enc = _encoder(tokenizer_path(tokenizer))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [enc.encode(t.as_py()) + end for t in part.column("text")]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                of = np.repeat(np.arange(len(ids)), -(-n // window))
                start = (np.arange(len(of)) - np.searchsorted(of, of)) * window
                length = np.minimum(n[of] - start, window)
                data = [ids[k][4 * a:4 * (a + m)] for k, a, m in zip(of.tolist(), start.tolist(), length.tolist())]
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(at), part.column("doc_id").take(at), pa.array(n[of]), pa.array(start),
                     pa.array(length), pa.array(data, pa.binary()), part.column("group").take(at)], names)

    return rows.mapInArrow(cut, PIECES.format(id=dict(docs.dtypes)["doc_id"]))


# ------------------------------------------------------- best fit, decreasing
class Capacities:
    """Segment tree over the capacities 0..window: how many open windows each range of capacities holds."""

    def __init__(self, window: int):
        self.leaves = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity of ``need`` or more that an open window has."""
        i = need + self.leaves
        if self.count[i]:
            return need
        while i > 1 and (i & 1 or not self.count[i + 1]):
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window and offset of each piece, and the length used of each window.

    Pieces of one length go together: the tightest window takes as many as it holds, as it would one by one, since what
    is left of it is the tightest again.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    tree, open_at, used = Capacities(window), {}, []
    for same in np.split(order, cuts) if len(order) else []:
        need, at = int(lengths[same[0]]), 0
        while at < len(same):
            room = tree.tightest(need)
            each = (room or window) // need
            n = -(-(len(same) - at) // each)
            if room is None:
                room = window
                wins = list(range(len(used), len(used) + n))
                used.extend([0] * n)
            else:
                have = open_at[room]
                n = min(n, len(have))
                wins = have[len(have) - n:]
                del have[len(have) - n:]
                tree.add(room, -n)
            take = same[at:at + n * each]
            where[take] = np.repeat(wins, each)[:len(take)]
            offset[take] = window - room + np.tile(np.arange(each) * need, n)[:len(take)]
            last = len(take) - (n - 1) * each
            for group, k in ((wins[:-1], each), (wins[-1:], last)):
                left = room - k * need
                for w in group:
                    used[w] = window - left
                if group and left:
                    open_at.setdefault(left, []).extend(group)
                    tree.add(left, len(group))
            at += len(take)
    return where, offset, np.array(used, np.int64)


def _whole(n: int) -> bool:
    return n & (n - 1) == 0


def close(lengths: np.ndarray, where: np.ndarray, offset: np.ndarray, used: np.ndarray, window: int):
    """Rows (piece, from, length, window, offset) after the open windows are closed.

    A window is open if it is neither full nor, at a power of two, unpadded. From the fullest on, each is filled by
    cutting up the emptiest; the last one's ids go to windows of powers of two.
    """
    full = np.array([w == window or _whole(int(w)) for w in used], bool)
    keep = full[where] if len(where) else np.zeros(0, bool)
    rows = [np.stack([np.flatnonzero(keep), np.zeros(keep.sum(), np.int64), lengths[keep], where[keep], offset[keep]], 1)]
    held: dict[int, list] = {}
    for i in np.flatnonzero(~keep):
        held.setdefault(int(where[i]), []).append([int(i), 0, int(lengths[i])])
    line = sorted(held, key=lambda w: (-used[w], w))
    more: list[tuple] = []

    def put(parts: list, to: int, at: int, n: int) -> None:
        """``n`` ids of the pieces at the end of ``parts`` go to window ``to``."""
        while n:
            piece, start, length = parts[-1]
            take = min(n, length)
            more.append((piece, start, take, to, at))
            at, n = at + take, n - take
            if take == length:
                parts.pop()
            else:
                parts[-1] = [piece, start + take, length - take]

    while len(line) > 1:
        w = line.pop(0)
        at = 0
        for piece, start, length in held[w]:
            more.append((piece, start, length, w, at))
            at += length
        while at < window and line:
            donor = held[line[-1]]
            n = min(window - at, sum(x[2] for x in donor))
            put(donor, w, at, n)
            at += n
            if not donor:
                line.pop()
        if at < window:  # no donor is left: this one is the last
            mine = [x for x in more if x[3] == w]
            more[:] = [x for x in more if x[3] != w]
            held[w] = [list(x[:3]) for x in reversed(mine)]
            line = [w]
    new = len(used)
    for w in line:
        left = sum(x[2] for x in held[w])
        while left:
            n = 1 << (left.bit_length() - 1)
            put(held[w], new, 0, n)
            new, left = new + 1, left - n
    if more:
        rows.append(np.array(more, np.int64))
    return np.concatenate(rows)


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str = TOKENIZER, fill: bool = True) -> DataFrame:
    """A row per piece: its document, place, ids (little-endian 32-bit), sequence and offset there.

    ``fill=False`` leaves open windows as best fit left them.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "start"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, used = best_fit(lengths, window)
        if fill:
            got = close(lengths, where, offset, used, window)
        else:
            got = np.stack([np.arange(len(lengths)), np.zeros(len(lengths), np.int64), lengths, where, offset], 1)
        names = {w: i for i, w in enumerate(np.unique(got[:, 3]).tolist())}
        out = pdf.iloc[got[:, 0]].copy()
        out["ids"] = [x[4 * a:4 * (a + n)] for x, a, n in zip(out["ids"], got[:, 1].tolist(), got[:, 2].tolist())]
        out["start"] = out["start"].to_numpy() + got[:, 1]
        out["length"] = got[:, 2]
        out["sequence_id"] = (int(pdf["group"].iloc[0]) << 32) + np.array([names[w] for w in got[:, 3].tolist()], np.int64)
        out["offset"] = got[:, 4]
        return out.drop(columns="group")

    cut = pieces(docs, window, end_id, tokenizer)
    return cut.groupBy("group").applyInPandas(place, PACKED.format(id=dict(docs.dtypes)["doc_id"]))


def sequences(packed: DataFrame) -> DataFrame:
    """The training windows themselves: ids of each sequence in order, and how many pieces it holds."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a window has at most as many pieces as ids
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("pieces"), joined.alias("ids"))


def op13_pack(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a window of 2048 ids."""
    from .common import documents

    p = pack(documents(spark, sf_dir).select("doc_id", "text"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
