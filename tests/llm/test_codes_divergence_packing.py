"""Operators 11 to 13 against brute force, a sequential packer, the public tokenizer and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


# ----------------------------------------------------------------- operator 11
def test_slices_find_the_nearest_entry_and_its_lowest_tie():
    from addresskit.llm.vector_codes import Slices

    rng = np.random.default_rng(1)
    for trial in range(120):
        n, d, spread = int(rng.integers(1, 140 if trial % 3 else 17)), int(rng.integers(1, 9)), int(rng.choice([2, 50, 5000]))
        book, x = rng.integers(-spread, spread + 1, (n, d)), rng.integers(-spread, spread + 1, (100, d))
        all_distances = ((x[:, None] - book[None]) ** 2).sum(2)
        at, error = Slices(book).nearest(x)
        assert (at == all_distances.argmin(1)).all() and (error == all_distances.min(1)).all()


def test_slices_leave_out_entries_that_are_too_far():
    from addresskit.llm.vector_codes import Slices

    book = np.array([[0, 0], [100, 0], [0, 100], [100, 100]])
    masks = Slices(book).candidates(np.array([[1, 1], [50, 1]]), np.array([5, 60]))
    assert masks[:, 0].tolist() == [0b0001, 0b0011]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])),
                  key=lambda r: (r[0] is None, r[0]))
    x = [[math.floor(4096 * c) for c in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in x]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in v) for v in last]
    by_label = collections.Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i:02x}" for _, i in v), e, by_label[r[2]], sha)
                  for r, v, e in zip(rows, last, errors))


VECTORS = "vec_id long, embedding array<float>, label int, code string, v string, id string"


def codes_of(spark, tmp_path, rows):
    from addresskit.llm.vector_codes import op11_vector_codes

    folder = str(tmp_path / "in")
    spark.createDataFrame([(*r, "c", "v", "i") for r in rows], VECTORS).repartition(3).write.mode("overwrite").parquet(
        f"{folder}/embeddings.parquet")
    return op11_vector_codes(spark, folder)


def test_codes_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3 - 40, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(400 + i, rows[5][1], 7) for i in range(30)]  # a group of copies
    rows += [(900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [float("nan")] + [0.1] * 15, 1),
             (903, [0.1] * 15 + [float("inf")], None), (904, [0.1] * 15 + [float("-inf")], None)]
    got = sorted(map(tuple, codes_of(spark, tmp_path, rows).collect()))
    assert got == brute_codes(rows)


def test_codes_of_the_small_table(spark):
    from addresskit.llm.vector_codes import op11_vector_codes

    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SMALL}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, op11_vector_codes(spark, SMALL).collect())) == brute_codes(rows)


def test_codes_on_edge_rows(spark, tmp_path):
    few = [(1, [0.5] * 8, None), (1, [0.25] * 8, None), (None, [0.75] * 8, 3)]  # equal and null ids, fewer than 16
    got = codes_of(spark, tmp_path, few).collect()
    assert sorted((r.vec_id is None, r.code, r.error) for r in got) == [
        (False, "00" * 8, 0), (False, "01" * 8, 0), (True, "02" * 8, 0)]
    other = codes_of(spark, tmp_path, [(1, [0.5] * 8, 1), (2, [0.5] * 4, 1)]).collect()
    assert [r.vec_id for r in other] == [1]  # another length is dropped
    assert codes_of(spark, tmp_path, []).collect() == []
    with pytest.raises(Exception, match="cannot be coded"):
        codes_of(spark, tmp_path, [(1, [1e9] * 8, 1)]).collect()


# ----------------------------------------------------------------- operator 12
def test_divergence_equals_sql(spark):
    from addresskit.llm import divergence

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({divergence.ORACLE})").fetchall())
    got = sorted(map(tuple, divergence.op12_source_divergence(spark, SMALL).collect()))
    assert got == want and {r[2] for r in got} == {"pair", "term"}


DOCS = "text string, lang string, source string, term string, p string"


def brute_divergence(rows, least):
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "")
            for t, lang, s in rows]
    out = []
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = collections.Counter(w for words, _, _ in mine for w in set(words))
        kept = sorted(w for w in df if df[w] >= least)
        v = len(kept)
        sources = {d[2] for d in mine}
        count = {s: collections.Counter(w for words, _, z in mine if z == s for w in words if df[w] >= least) for s in sources}
        count[None] = sum(count.values(), collections.Counter())
        share = {s: {w: 1 + 10 ** 9 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept} for s, c in count.items()}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(far(share[s][w], share[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-far(share[s][w], share[None][w]), w.encode(), w) for w in kept
                           if count[s][w] and share[s][w] > share[None][w])[:10]
            for part, items in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(items)]
    return sorted(out)


def test_divergence_on_edge_rows_with_small_blocks(spark):
    from addresskit.llm.divergence import audit

    rng = random.Random(8)
    vocabulary = [f"Wörd{c}" for c in "abcdefghij"] + list("klmnopqrst") + ["é", "word", "WORD"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de"]), rng.choice(["a", "b", "ü", None]))
            for _ in range(120)]
    rows += [(None, "en", "silent"), ("", None, None), ("12 _ 3", "fr", "x"), ("only once", "fr", "y"), (rows[0][0], "en", "a"),
             ("k " * 200_000 + "longtail", "en", "b")]
    docs = spark.createDataFrame([(*r, "t", "p") for r in rows], DOCS).repartition(5)
    want = brute_divergence(rows, 4)
    assert sorted(map(tuple, audit(docs, least=4, entries=40, shards=3).collect())) == want
    assert sorted(map(tuple, audit(docs, least=4).collect())) == want
    assert ("fr", "x", "pair", "y", 0, 1) in want
    assert audit(docs.where("false")).collect() == []


def test_runs_merge_alike_whatever_is_held(monkeypatch):
    import pyarrow as pa

    from addresskit.llm import divergence

    rng = random.Random(4)
    total, df, batches = collections.Counter(), collections.Counter(), []
    monkeypatch.setattr(divergence, "BLOCK", 3)
    for _ in range(12):
        index = divergence.Index()
        for _ in range(rng.randint(0, 20)):
            lang, source = rng.choice(["en", "de"]), rng.choice(["s", "t", ""])
            words = rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=rng.randint(0, 9))
            index.add(lang, source, " ".join(words).upper().encode())
            total.update((lang, w, source) for w in words)
            df.update((lang, w) for w in set(words))
        batches += list(index.spill(2))
        assert index.entries == 0 and list(index.spill(2)) == []
    runs = pa.Table.from_batches(batches).sort_by([("lang", "ascending"), ("shard", "ascending"), ("first", "ascending")])
    want = sorted((lang, w, n, {s: total[lang, w, s] for s in ("s", "t", "") if total[lang, w, s]}) for (lang, w), n in df.items() if n >= 25)
    assert want
    for at_once, size in ((1, 1), (7, 5), (1 << 18, 1000)):
        out = [r for b in divergence.merge_runs(iter(runs.to_batches(max_chunksize=size)), 25, at_once) for r in b.to_pylist()]
        assert sorted((r["lang"], r["term"], r["documents"], dict(zip(r["sources"], r["counts"]))) for r in out) == want


# ----------------------------------------------------------------- operator 13
def sequential_best_fit(lengths, window):
    used = []
    for n in sorted(lengths, reverse=True):
        fits = [(window - u, i) for i, u in enumerate(used) if window - u >= n]
        if fits:
            used[min(fits)[1]] += n
        else:
            used.append(n)
    return sorted(used)


def test_best_fit_equals_a_sequential_one_and_closing_pads_nothing():
    from addresskit.llm.packing import best_fit, close

    rng = random.Random(1)
    for _ in range(150):
        window = rng.choice([16, 100, 2048])
        lengths = np.array([rng.randint(1, window if rng.random() < .5 else window // 5) for _ in range(rng.randint(0, 120))], np.int64)
        where, offset, used = best_fit(lengths, window)
        assert sorted(used.tolist()) == sequential_best_fit(lengths.tolist(), window)
        rows = close(lengths, where, offset, used, window)
        pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
        for piece, start, n, w, at in rows.tolist():
            pieces[piece].append((start, n))
            windows[w].append((at, n))
        for cut, total in [(pieces[i], n) for i, n in enumerate(lengths.tolist())] + [(x, None) for x in windows.values()]:
            end = 0
            for start, n in sorted(cut):
                assert start == end and n > 0
                end += n
            assert end == total if total is not None else end == window or (end < window and end & (end - 1) == 0)


def test_capacities_find_the_tightest():
    from addresskit.llm.packing import Capacities

    tree, rng, held = Capacities(100), random.Random(2), collections.Counter()
    for _ in range(2000):
        c = rng.randint(1, 100)
        if held[c] and rng.random() < .6:
            held[c] -= 1
            tree.add(c, -1)
        elif rng.random() < .3:
            held[c] += 1
            tree.add(c, 1)
        need = rng.randint(1, 100)
        assert tree.tightest(need) == min((k for k, n in held.items() if n and k >= need), default=None)


TEXTS = ["", None, "a", " leading and trailing ", "two  spaces\n\nand\tlines \n x", "<|endoftext|> is text", "don't 123 it's  ’quoted’ ünïcödé 漢字かな 🙂🙂",
         " ", "\n", "tab \x1c odd\x85 spaces here ​ zero", "word " * 9000, "x" * 30000, "same", "same"]


def check_packing(packed, texts, window=2048):
    """Every text comes back from its pieces; sequences are gapless and hold at most a window."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = collections.Counter(tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]) for t in texts)
    got = collections.Counter()
    for _, g in packed.groupby("row"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and set(g["doc_tokens"]) == {g["length"].sum()}
        got[tuple(np.frombuffer(b"".join(g["ids"]), "<u4").tolist())] += 1
    assert got == want
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        n = g["length"].sum()
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and n <= window


def test_packing_returns_every_text(spark):
    from addresskit.llm import packing

    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "r") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string")
    packed = packing.pack(docs).toPandas()
    check_packing(packed, TEXTS)
    sizes = packed.groupby("sequence_id")["length"].sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)  # no padding at all
    check_packing(packing.pack(docs, fill=False).toPandas(), TEXTS)
    whole = packing.sequences(packing.pack(docs)).toPandas()
    assert sorted(len(x) // 4 for x in whole["ids"]) == sorted(sizes)
    assert packing.pack(docs.where("false")).collect() == []


def test_packing_in_several_groups(spark, monkeypatch):
    from addresskit.llm import packing

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    monkeypatch.setattr(packing, "GROUP_BYTES", 100_000)
    packed = packing.pack(docs).toPandas()
    assert (packed["sequence_id"] // 2 ** 32).nunique() > 3
    check_packing(packed, [r.text for r in docs.collect()])
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.op13_pack(spark, SMALL).collect()}
    assert digests == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in packed.itertuples()}


def test_ids_are_those_of_the_tokenizers_library(monkeypatch):
    from addresskit.llm import packing

    enc = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "é", "ß", "×", "'s", "'", "’", "1", "²", "Ⅷ", ".", ",", "!?", "漢", "🙂", "\xa0", "\u2003", "\x1c", "\x85", "ª",
            "ǅ", "\u0301", "<|endoftext|>", "word", "The", "\r\n", "'ll", "'S"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [t or "" for t in TEXTS] + [" " * 300_000 + "x", "\n" * 300_000]
    texts += [f"a{c}b {c}1{c} {c}{c}!" for c in map(chr, range(1, 0x110000, 1)) if not 0xD800 <= ord(c) <= 0xDFFF and ord(c) % 16 in (1, 7)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert [enc.encode(t) for t in texts] == want
    monkeypatch.setattr(packing, "AT_ONCE", 7)  # long texts are cut where it makes no difference
    assert [enc.encode(t) for t in texts[:6000]] == want[:6000]


def test_merge_of_many_runs_does_not_look_at_every_begun_block_again(monkeypatch):
    import pyarrow as pa

    from addresskit.llm import divergence as D

    rng, rows, total = np.random.default_rng(4), [], collections.Counter()
    for run in range(300):  # every run has one block, all of them over the whole range of terms
        terms = sorted({f"t{i:03d}".encode() for i in rng.integers(0, 400, 25)})
        rows.append((terms[0], f"s{run % 3}", terms))
        total.update((t.decode(), f"s{run % 3}") for t in terms)
    rows.sort()
    batch = pa.RecordBatch.from_pydict({
        "lang": ["en"] * 300, "shard": pa.array([0] * 300, pa.int32()), "first": pa.array([r[0] for r in rows], pa.binary()),
        "source": [r[1] for r in rows], "terms": pa.array([r[2] for r in rows], pa.list_(pa.binary())),
        "counts": pa.array([[2] * len(r[2]) for r in rows], pa.list_(pa.int64())),
        "documents": pa.array([[1] * len(r[2]) for r in rows], pa.list_(pa.int64()))})
    pushed, push = [], D.Merge._push
    monkeypatch.setattr(D.Merge, "_push", lambda self, *block: (pushed.append(1), push(self, *block))[1])
    got, documents = {}, {}
    for b in D.merge_runs([batch.slice(i, 7) for i in range(0, 300, 7)], 10, at_once=200):
        for term, n, sources, counts in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
            documents[term] = n
            got.update({(term, s): c for s, c in zip(sources, counts, strict=True)})
    whole = collections.Counter()
    for (term, _), n in total.items():
        whole[term] += n
    assert documents == {t: n for t, n in whole.items() if n >= 10}
    assert got == {(t, s): 2 * n for (t, s), n in total.items() if whole[t] >= 10}
    assert len(pushed) < 3 * 300
