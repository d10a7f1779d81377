"""Training-data operators against brute force, hand-made cases and edge rows."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("copy", T.StringType()),
                       T.StructField("key", T.StringType())])


def frame(spark, texts, sources=None):
    rows = [(i, t, "en" if i % 2 else None, (sources or ["a"] * len(texts))[i], len(t or ""), "c", "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and very long texts, repeated rows, clashing column names."""
    long = sentence(random.Random(1), 30_000)
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", None, 0, "x", "y"), (3, " \n\t ", "en", "s", 4, "x", "y"),
            (4, "one two three four five six seven eight nine", "en", "s", 1, "x", "y"),
            (4, "one two three four five six seven eight nine", "en", "s", 1, "x", "y"),
            (5, "one two three four five six seven eight nine", "en", "t", 1, "x", "y"),
            (None, "under the MIT license", "en", "t", 1, "x", "y"), (6, long, "fr", "t", 1, "x", "y"), (7, "12 34 !!", "fr", "t", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ operator 1
def test_leaks_equal_brute_force(spark):
    from addresskit.llm.decontaminate import leaks

    rng = random.Random(5)
    items = [sentence(rng, n) for n in (4, 12, 20, 40, 41)]
    docs = [sentence(rng, 50) + " " + items[1].upper() + " " + sentence(rng, 9), items[2], sentence(rng, 80), None, "",
            " ".join(items[3].split()[:20] + ["changed"] + items[3].split()[21:]), items[0], sentence(rng, 5) + "\n" + items[4] + "\n" + items[1]]
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(frame(spark, docs).select("doc_id", "text"), it).collect()}
    want = {}
    bag = lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    for d, t in enumerate(docs):
        for k, item in enumerate(items):
            a, w = bag(words(item)), words(t)
            best = 0
            for s in range(max(1, len(w) - len(words(item)) + 1)):
                b = bag(w[s:s + len(words(item))])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both) if both else 0)
            if best >= 0.75:
                want[d, k] = best
    assert set(got) == set(want) == {(0, 1), (1, 2), (5, 3), (7, 4), (7, 1)}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_keep_every_window_near_the_threshold(spark):
    """Items with their first or last words replaced (by other words, or by one word again and again)."""
    from addresskit.llm.decontaminate import leaks

    rng = random.Random(15)
    items, docs, want = [], [], {}
    bag = lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    for k in range(120):
        n = (30, 60, 60, 200)[k % 4]
        item, other = sentence(rng, n).split(), sentence(rng, n).split()
        j = n // 7 - k % 2
        if k % 5 == 0:
            other = ["again"] * n
        text = item[:n - j] + other[:j] if k % 3 else other[:j] + item[j:]
        a, b = bag(item), bag(text)
        similarity = sum((a & b).values()) / sum((a | b).values())
        items.append(" ".join(item))
        docs.append(" ".join(text))
        if similarity >= 0.75:
            want[k, k] = similarity
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks(frame(spark, docs).select("doc_id", "text"), it).collect()}
    assert len(want) > 80 and sorted(want.values())[len(want) // 2] < 0.82
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ------------------------------------------------------------------ operator 2
def test_scores_of_every_document(spark, small):
    from addresskit.llm.pitman_yor import op2_lm_scoring

    got = {r.doc_id: r for r in op2_lm_scoring(spark, SMALL).collect()}
    tokens = {i: [*words(t), None] for i, t in small}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    held = [0.0, 0.0]
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and abs(r.base_score - base) < 1e-6 * abs(base)
        if r.held_out:
            held[0] += r.base_score
            held[1] += r.score
    assert held[1] > held[0]  # unseen texts are likelier under the model than under the base


def test_predictions_add_up_to_one():
    import numpy as np

    from addresskit.llm import pitman_yor as P

    rng = np.random.default_rng(3)
    v = 40
    ctx = [np.sort(rng.choice(P.CONTEXTS, rng.integers(1, 9), replace=False)) for _ in range(v)]
    first = np.append(0, np.cumsum([len(c) for c in ctx]))
    n = rng.integers(1, 200, first[-1])
    dishes = P.Dishes(rng.integers(-(2**60), 2**60, v), np.concatenate(ctx).astype(np.uint8), n, first)
    model = P.Model(v, int(n.sum()), (0.5, 0.6, 0.7), [])
    for _ in range(3):
        *_, (c, t) = dishes.sweeps(model)
        model.history.append(P.Totals([np.bincount(dishes.where[k], c[k], P.SIZES[k]) for k in range(3)],
                                      [np.bincount(dishes.where[k], t[k], P.SIZES[k]) for k in range(3)]))
    *_, (c, t) = dishes.sweeps(P.Model(v, model.tokens, model.discounts, model.history[:-1]))
    totals = model.history[-1]
    p0 = dishes.probabilities(c, t, totals, model)[0]
    unknown = (P.THETA[0] + model.discounts[0] * totals.T[0][0]) / (P.THETA[0] + totals.C[0][0]) * model.base
    assert abs(p0.sum() + unknown - 1) < 1e-9


# ------------------------------------------------------------------ operator 3
def test_license_places_and_blocks(spark):
    from addresskit.llm.license_scan import scan_licenses

    docs = frame(spark, ["Free, Under the MIT\nlicense! under the mit license", None, "Licensed under the Apache License, Version 2.0.",
                         "the mit licensed under", sentence(random.Random(2), 200) + " all rights reserved " + sentence(random.Random(3), 200), "cc-by-nc"])
    r = {x.doc_id: x for x in scan_licenses(docs).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (2, 1, 5, "mit")
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].labels, r[1].score) == (0, 0, None, "", 0.0)
    assert r[2].base_labels == "apache-2" and r[2].labels == "apache-2"
    assert r[3].labels == "" and r[4].labels == "all-rights-reserved" and r[5].base_labels == "cc-by-nc"


# ------------------------------------------------------------------ operator 4
def test_targets_by_resharing(spark):
    from addresskit.llm.mixing import mix_counts

    texts = ["w " * n for n in (100, 10, 500, 40, 300)]
    got = {r.source: r._mix for r in mix_counts(frame(spark, texts, ["b", "a", "c", None, "d"])).collect()}
    order, sizes = ["a", "b", "c", "d", None], {"a": 10, "b": 100, "c": 500, "d": 300, None: 40}
    weight = dict(zip(order, (3, 1, 2, 3, 1), strict=True))
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the excess is handed on by weight until none is above its stop
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    assert all(abs(got[s].target - target[s]) < 1e-6 and got[s].copies <= 2 for s in order)


# ------------------------------------------------------------------ operator 5
def test_language_of_held_out_documents(spark):
    from addresskit.llm.language_id import op5_language_id

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op5_language_id(spark, SMALL).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in held)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_forward_sums_all_segmentations():
    import numpy as np

    from addresskit.llm.language_id import Lattice, log_likelihoods

    pieces = ["a", "b", "ab", "ba", "aba"]
    prob = np.array([[0.01], [0.3], [0.2], [0.1], [0.15], [0.24]])
    lattice = Lattice.of(pieces)

    def total(word):
        return 1.0 if not word else sum(prob[pieces.index(word[:k]) + 1, 0] * total(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in pieces)

    for word in ("aba", "abab", "baab"):
        assert abs(math.exp(log_likelihoods(lattice, prob, [word])[0, 0]) - total(word)) < 1e-12


def test_scores_of_a_long_word_and_of_words_scored_together():
    import numpy as np

    from addresskit.llm.language_id import Lattice, log_likelihoods

    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)} | {"a", "b", "c"})
    prob = np.array([[rng.random(), rng.random()] for _ in range(len(pieces) + 1)])
    lattice = Lattice.of(pieces)

    def total(word, lang):  # logarithms all the way
        best = [0.0]
        for i in range(1, len(word) + 1):
            ways = [best[i - k] + math.log(prob[pieces.index(word[i - k:i]) + 1, lang]) for k in range(1, min(4, i) + 1) if word[i - k:i] in pieces]
            top = max(ways)
            best.append(top + math.log(sum(math.exp(x - top) for x in ways)))
        return best[-1]

    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 2, 3, 3, 40, 41, 900, 3000)]
    for cells in (1, 100, 1 << 20):
        got = log_likelihoods(lattice, prob, texts, cells)
        assert all(abs(got[i, lang] - total(t, lang)) < 1e-6 * max(1, len(t)) for i, t in enumerate(texts) for lang in (0, 1))


def test_language_of_a_text_of_five_megabytes_and_of_clashing_columns(spark):
    from addresskit.llm import language_id

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    one = docs.where("lang = 'de' AND length(text) > 300").orderBy("doc_id").first()
    long = " ".join([one.text] * (5_000_000 // len(one.text)))
    rows = spark.createDataFrame([(1, long, "x", "y", "z"), (2, one.text, "x", "y", "z"), (3, None, "x", "y", "z")],
                                 "doc_id long, text string, _low string, _language string, row string")
    got = {r.doc_id: r for r in language_id.identify(rows, docs.select("doc_id", "text", "lang"), into="told").collect()}
    assert [got[i].told.pred for i in (1, 2, 3)] == ["de", "de", "und"]
    assert got[1].text == long and (got[2]._low, got[2]._language, got[2].row) == ("x", "y", "z")


def test_words_are_forgotten_without_a_difference(spark, monkeypatch):
    import pyarrow as pa

    from addresskit.llm import language_id, tokens

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    langs, lattice, prob = language_id.train(docs)
    texts = pa.array([(r.text or "").lower() for r in docs.orderBy("doc_id").limit(60).collect()])
    whole = language_id.WordScores(langs, lattice, prob).predict(texts)
    monkeypatch.setattr(language_id, "KNOWN_WORDS", 50)
    monkeypatch.setattr(tokens, "PIECE", 3000)
    small = language_id.WordScores(langs, lattice, prob).predict(texts)
    assert small[0] == whole[0] and max(abs(a - b) for a, b in zip(small[1], whole[1])) < 1e-9


# ------------------------------------------------------------------ operator 6
def test_urls(spark):
    from addresskit.llm.url_filter import op6_url_filter, rule_of, url_parts
    from pyspark.sql import functions as F

    urls = ["http://A.Example.NET/en/x?q#f", None, "no scheme", "https://x.org/fr/", "http://example.com/de", "http://sub.example.com/de/1", "ftp://net", "http://notnet/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_of(F.col("h"), F.col("p"))
    got = [tuple(r) for r in df.select("page_id", host.alias("h"), path.alias("p")).select("h", "p", rule, verdict).collect()]
    assert got == [("a.example.net", "/en/x", "example.net/en/", "allow"), ("", "", None, None), ("", "", None, None), ("x.org", "/fr/", "org/fr/", "allow"),
                   ("example.com", "/de", None, None), ("sub.example.com", "/de/1", "example.com/de/", "block"), ("net", "", None, None), ("notnet", "/", None, None)]
    assert op6_url_filter(spark, SMALL).where("listed").count() > 0


# ------------------------------------------------------------------ operator 7
def test_winnowing_picks_and_next_document(spark, small):
    import hashlib

    from addresskit.llm import winnowing as W

    got = {r.doc_id: r for r in W.op7_fingerprints(spark, SMALL).collect()}
    ids = sorted(i for i, _ in small)
    text = dict(small)
    for at, i in enumerate(ids):
        t, following = text[i], text[ids[(at + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    cases = ["", "a", "a b c", "x x x x x x x x x x x x x x x", sentence(random.Random(4), 60)]
    rows = W.fingerprints(frame(spark, cases).select("doc_id", "text"), p="text").collect()
    for r in rows:
        n = max(len(cases[r.doc_id].split()) - W.K + 1, 1 if cases[r.doc_id].split() else 0)
        places = [W._LAST - (x & W._LAST) for x in r.p]
        assert all(0 <= p < n for p in places) and len(set(places)) == len(places)
        assert all(any(s <= p < s + W.WINDOW for p in places) for s in range(max(0, n - W.WINDOW + 1)))
    assert [W._LAST - (x & W._LAST) for x in rows[3].p] == list(range(W.WINDOW - 1, 12))  # ties: the rightmost of every window


# ------------------------------------------------------------------ operator 8
def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_line_dedup_equals_all_pairs(spark):
    from addresskit.llm.line_dedup import MIN_WORDS, dedup_lines

    rng = random.Random(7)
    base = [sentence(rng, n) for n in (3, 8, 9, 12, 25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(base).split()
            for _ in range(rng.choice((0, 1, 1, 2))):
                k = rng.randrange(len(w))
                w = rng.choice((w[:k] + w[k + 1:], w[:k] + ["new"] + w[k:], w[:k] + ["zz"] + w[k + 1:])) or ["x"]
            lines.append(rng.choice((" ".join(w), " ".join(w).upper(), "", sentence(rng, 10))))
        texts.append("\n".join(lines))
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, texts)).collect()}
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept, lost = [], False
        for line in t.split("\n"):
            w = words(line)
            if w and any(w == s or (min(len(w), len(s)) >= MIN_WORDS and near(w, s)) for s in seen):
                lost = True
            else:
                kept.append(line)
            if w:
                seen.append(w)
        if not lost or words("\n".join(kept)):
            want[i] = "\n".join(kept)
    assert got == want


# ------------------------------------------------------------------ operator 9
def test_repeated_passages(spark):
    from addresskit.llm.substring_dedup import repeats

    rng = random.Random(9)
    passage, line = sentence(rng, 60), sentence(rng, 13)
    docs = [sentence(rng, 100) for _ in range(6)]
    docs[1] += "\n" + passage
    docs[2] = passage + "\n" + docs[2]
    docs[4] = line + "\n" + docs[4]
    docs[5] = line + "\n" + docs[5]
    words_ = sentence(rng, 90).split()
    docs.append(" ".join(words_[:40]) + " " + passage + " " + " ".join(words_[40:]))
    got = collections.defaultdict(int)
    for r in repeats(frame(spark, docs)).collect():
        got[r.doc_id] += r.removed_words
    assert {1, 2, 6} == set(got) and got[1] == 0 and got[2] >= 40 and got[6] >= 20


def test_near_copies_of_long_lines(spark):
    from addresskit.llm.substring_dedup import repeats

    rng = random.Random(19)
    docs = []
    for k in range(100):
        line = sentence(rng, 41 + k % 20).split()
        at = rng.randrange(len(line))
        docs += [" ".join(line), " ".join(line[:at] + ["changed"] + line[at + 1:])]
    got = {(r.doc_id, r.start_word, r.n_words, r.removed_words) for r in repeats(frame(spark, docs)).collect()}
    whole = {(d, 0, len(t.split()), len(t.split()) if d % 2 else 0) for d, t in enumerate(docs)}
    assert len(got & whole) >= 0.95 * len(docs)


def test_short_lines_continue_passages(spark):
    from addresskit.llm.substring_dedup import repeats

    rng = random.Random(29)
    mixed = "\n".join(sentence(rng, n) for n in (15, 5, 15, 5, 15))
    verse = "\n".join(sentence(rng, n) for n in (6, 4, 7, 5, 6))
    docs = [sentence(rng, 30) + "\n" + t + "\n" + sentence(rng, 30) for t in (mixed, verse, mixed, verse)] + [sentence(rng, 3)] * 2
    got = {(r.doc_id, r.start_word, r.n_words, r.n_paragraphs, r.removed_words) for r in repeats(frame(spark, docs)).collect()}
    assert got == {(0, 30, 55, 5, 0), (2, 30, 55, 5, 55), (1, 30, 28, 5, 0), (3, 30, 28, 5, 28)}


def test_passages_inside_longer_lines(spark):
    from addresskit.llm.substring_dedup import repeats

    rng = random.Random(39)
    docs, want = [], {}
    for k in range(100):
        passage = sentence(rng, 51 + k % 10)
        for side in "ab":
            before = rng.randint(60, 90)
            want[len(docs)] = (before, 51 + k % 10)
            docs.append(" ".join([f"{side}{k}x{i}" for i in range(before)] + [passage] + [f"{side}{k}y{i}" for i in range(90)]))
    got = collections.defaultdict(list)
    for r in repeats(frame(spark, docs)).collect():
        got[r.doc_id].append((r.start_word, r.n_words, r.removed_words))
    assert set(got) == set(want)
    for d, (start, n) in want.items():
        (at, size, removed), = got[d]
        assert start - 8 <= at <= start and start + n <= at + size <= start + n + 8 and removed == (size if d % 2 else 0)


# ----------------------------------------------------------------- operator 10
def test_components_joined_in_parts(spark):
    from addresskit.llm.components import joined

    rng = random.Random(11)
    parts = [[(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(n)] for n in (12, 0, 15, 9)] + [[(k, k + 1) for k in range(100, 140)]]
    labels = None
    for part in parts:
        labels = joined(labels, spark.createDataFrame(part, "a long, b long"))
    root = {x: x for part in parts for e in part if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in (e for part in parts for e in part if e[0] != e[1]):
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in labels.collect()} == root


def test_components_of_random_near_copies(spark):
    from addresskit.llm.ngram_join import keep_one, ngram_components

    rng = random.Random(11)
    texts = []
    for size in (3, 6, 9, 12, 20, 45, 90, 150):
        seed = sentence(rng, size).split()
        for _ in range(14):
            w = list(seed)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(len(w))] = "q" + str(rng.randrange(5))
            texts.append(" ".join(w))
    texts += [None, "", texts[0]]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w := words(t)) >= 5 else ({tuple(w)} if w else set()) for t in texts]
    to = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if to[a] != to[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                    to[a] = to[b] = min(to[a], to[b])
                    changed = True
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == {i: (len(s), to[i]) for i, s in enumerate(sets)}
    assert {r.doc_id for r in keep_one(docs).collect()} == set(to)


# ------------------------------------------------------------- edges, pipeline
def test_edge_rows_and_empty_tables(spark, edge, empty):
    from addresskit.llm import decontaminate, language_id, license_scan, line_dedup, mixing, ngram_join, pitman_yor, substring_dedup, winnowing

    items = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None), (3, "")], "item_id long, text string")
    for docs, n in ((edge, 9), (empty, 0)):
        assert pitman_yor.score_documents(docs).count() == n
        assert license_scan.scan_licenses(docs).count() == n
        told = language_id.identify(docs, docs.where("lang IS NOT NULL"))
        assert told.count() == n and told.where("doc_id = 7 OR text IS NULL").where("_language.pred <> 'und'").count() == 0
        assert mixing.mix_counts(docs).count() == n
        mixing.mix_sources(docs).count()
        assert ngram_join.ngram_components(docs).count() == n
        substring_dedup.repeats(docs).count()
        assert winnowing.fingerprints(docs.select("doc_id", "text"), p="text").count() == n
        assert sorted(decontaminate.leaks(docs, items).select("doc_id").toPandas()["doc_id"]) == ([4, 5] if n else [])
        assert decontaminate.decontaminate(docs, items.where("false")).count() == n
        left = line_dedup.dedup_lines(docs)
        assert left.columns == [*docs.columns, "_line_counts"] and left.count() == (n - 1 if n else 0)
        one = ngram_join.keep_one(docs)
        assert one.columns == docs.columns and one.where("doc_id = 4").count() == (1 if n else 0)


def test_pipeline_keeps_columns_and_clean_documents(spark):
    import corpus_pipeline as P
    from addresskit.llm.common import documents

    docs = documents(spark, SMALL)
    out = P.run(spark, SMALL)
    assert out.columns == [*docs.columns, "copy"] and 0.5 * docs.count() < out.select("doc_id").distinct().count() <= docs.count()
    assert [name for name, _ in P.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]


def test_ngram_join_passes_rows_on_in_pieces(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from addresskit.llm import ngram_join

    class Levels:
        value = np.zeros(ngram_join.COUNTERS, np.uint8)

    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(200)) for i in range(50)])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    whole = list(ngram_join._postings(Levels, 20)([batch]))
    monkeypatch.setattr(ngram_join, "PIECE", 500)
    pieces = list(ngram_join._postings(Levels, 20)([batch]))
    assert max(b.num_rows for b in pieces) < 600 < sum(b.num_rows for b in whole)
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches(whole).combine_chunks())

    # the test of two sets runs on columns, not on batches of whole sets
    pairs = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4]), ([1, 2], [1, 2, 3]), ([5], [5]), ([5], [6])], "x array<long>, y array<long>")
    assert [r[0] for r in pairs.select(ngram_join.similar_sets("x", "y").cast("boolean")).collect()] == [True, False, True, False]
    rows = ngram_join.set_rows([7, 8], [np.array([1, 1 << 63], np.uint64), np.array([2], np.uint64)])
    assert rows.to_pylist() == [{"cid": 7, "s": [1, -(1 << 63)]}, {"cid": 8, "s": [2]}]


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time

    from pyspark.sql import functions as F

    from addresskit.llm.common import SHUFFLE_CLEANUP, written

    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in held.split("\n") if "/shuffle_" in f}

    before, setting = files(), spark.conf.get(SHUFFLE_CLEANUP, "false")
    out = written(spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).agg(F.count(F.lit(1)).alias("n")), "test")
    for _ in range(50):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000 and spark.conf.get(SHUFFLE_CLEANUP, "false") == setting


def test_lm_contexts_are_the_words_before(spark):
    from addresskit.llm import pitman_yor as P

    rng = random.Random(8)
    follows = {f"w{i}": f"w{j}" for i, j in enumerate(rng.sample(range(3000), 3000))}  # each word has one next word

    def walk(i):
        out = [f"w{i}"]
        while len(out) < 40:
            out.append(follows[out[-1]])
        return " ".join(out)

    docs = spark.createDataFrame([(i, walk(rng.randrange(3000))) for i in range(1200)], "doc_id long, text string")
    held = [r for r in P.score_documents(docs).collect() if r.held_out]
    # 256 classes hold 12 words each, so no model of classes can tell the next word better than one of ten
    assert held and 10 ** (-sum(r.score for r in held) / sum(r.n_tokens for r in held)) < 3


def test_lm_equals_the_sampler_in_memory(spark, monkeypatch):
    import numpy as np

    from addresskit.llm import pitman_yor as P
    from addresskit.llm.tokens import hash_word, mix

    rng = random.Random(9)
    texts = {i: " ".join(rng.choice("abcdefghijkl") * rng.choice((1, 1, 2)) for _ in range(rng.randint(0, 60))) for i in range(90)}
    texts[90] = None
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(P, "GRID_BYTES", 200)
    got = {r.doc_id: r for r in P.score_documents(docs).collect()}

    tokens = {i: [*(int(hash_word(w).view(np.int64)) for w in words(t)), int(P.END)] for i, t in texts.items()}
    pairs = {i: list(zip([int(P.BOS), *ws[:-1]], ws, strict=True)) for i, ws in tokens.items()}
    n = collections.Counter(p for i, ps in pairs.items() if not P.is_held_out(i) for p in ps)
    count, after = collections.Counter(), collections.Counter()
    for (u, w), k in n.items():
        count[w] += k
        after[u] += k
    v = len(count)
    found = lambda c: [sum(x == k for x in c.values()) for k in (1, 2)]
    d0, d1 = (min(0.95, max(0.1, a / max(1, a + 2 * b))) for a, b in (found(count), found(n)))
    one = lambda x: np.array([x], np.int64).view(np.uint64)
    t, kept = dict.fromkeys(n, 1), []
    for s in range(P.SWEEPS + 1):
        if s:
            t = {(u, w): int(P.seat(np.array([k]), np.array([(1 + d1 * T[u]) * p[w]]), d1, mix(mix(mix(one(w)) ^ mix(one(u) + np.uint64(2001))) + np.uint64(s)))[0])
                 for (u, w), k in n.items()}
        c0, T = collections.Counter(), collections.Counter()
        for (u, w), k in t.items():
            c0[w] += k
            T[u] += k
        t0 = {w: int(P.seat(np.array([k]), np.array([(1 + d0 * all0) / (v + 1)]), d0, mix(mix(one(w)) + np.uint64(s)))[0]) if s else 1 for w, k in c0.items()}
        all0 = sum(t0.values())
        p = collections.defaultdict(lambda x=(1 + d0 * all0) / (v + 1) / (1 + sum(c0.values())): x)
        p.update({w: (k - d0 * t0[w] + (1 + d0 * all0) / (v + 1)) / (1 + sum(c0.values())) for w, k in c0.items()})
        kept.append((dict(t), T, p))
    for i, ps in pairs.items():
        score = sum(math.log10(sum((max(n[u, w] - d1 * t.get((u, w), 0), 0) + (1 + d1 * T[u]) * p[w]) / (1 + after[u])
                                   for t, T, p in kept[P.BURN + 1:]) / len(kept[P.BURN + 1:])) for u, w in ps)
        assert abs(got[i].score - score) < 1e-9 * abs(score) and got[i].n_tokens == len(ps)
