"""What a task or a query holds follows its share of the input: log parts, batches of a backlog, columns that are read, pieces of texts."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from addresskit.operators import text as T
from addresskit.plans import common as C
from addresskit.plans import sources, store
from addresskit.sources.fixtures import derived
from addresskit.streaming import pipelines as P
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ logs
def test_a_log_is_several_files_that_begin_with_an_event(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "LOG_PART", 200)
    rows = [(log, n, f"2024-01-01 00:00:00.000 {log} {n}" if n % 7 == 3 and not 400 <= n < 900 else f"  more {n}") for log in ("a.log", "b.log") for n in range(2000)]
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    monkeypatch.setattr(sources, "derived", lambda *_: lines)
    monkeypatch.setattr(sources.FS, "staging_root", lambda *_: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.log_file, r.n_lines, r.event_text) for r in sources.stitch_multiline(spark, "none").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, here = [], {}
    for log, _, line in sorted(rows):
        if line[:4].isdigit() or log not in here:
            here[log] = []
            want.append((log, here[log]))
        here[log].append(line)
    assert got == sorted((log, len(ls), "\n".join(ls)) for log, ls in want)
    for log in ("a.log", "b.log"):
        files = sorted(glob.glob(f"{tmp_path}/logs/file={log}/*.txt"))
        assert len(files) > 2
        for path in files[1:]:
            with open(path) as f:
                assert f.read(4) == "2024"


def test_whole_events_pass_the_state_batch_by_batch():
    import pandas as pd

    from addresskit.streaming.stitching import Stitcher

    def rows():
        for i in range(3):
            taken.append(i)
            yield pd.DataFrame({"file": ["f"], "written": [1], "path": ["p"], "block": [0], "kind": [0], "first": [f"e{i}"], "rest": [None], "lines": [1]})

    taken = []
    out = Stitcher(None).handleInputRows(("f", 3), rows(), None)
    assert next(out)["first"].tolist() == ["e0"] and taken == [0]
    assert [p["first"][0] for p in out] == ["e1", "e2"]


# ------------------------------------------------------------------ register
def test_queries_of_few_columns_do_not_persist_the_register(spark, tmp_path):
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):  # a folder of which nothing is persisted yet
        os.symlink(path, tmp_path / os.path.basename(path))
    q = E.queries()
    for name in ("geohash", "current_addresses", "search_postings", "register_store"):
        assert "InMemoryTableScan" not in _plan(q[name](spark, str(tmp_path))), name
    assert "mesh_block_code" not in _plan(q["geohash"](spark, str(tmp_path)))


def test_stored_register_reads_no_persisted_register(spark, monkeypatch):
    def persisted(*_):
        raise AssertionError("the persisted register was read")

    want = C.addresses(spark, SF_SMALL).count()
    monkeypatch.setattr(C, "addresses", persisted)
    assert E.queries()["store_upsert"](spark, SF_SMALL).count() == want


def test_a_backlog_is_taken_in_few_batches(spark, tmp_path):
    raw = derived(spark, SF_SMALL, "address_detail")
    src = f"{tmp_path}/src"
    raw.select([F.col(c).cast("string").alias(c.upper()) for c in raw.columns]).repartition(40).write.option("sep", "|").option("header", True).csv(src)
    assert len(glob.glob(f"{src}/*.csv")) == 40
    table = store.register_table(spark, store.fresh(spark, "backlog"), C.addresses(spark, SF_SMALL))
    schema = ", ".join(f"{c} string" for c in raw.columns)
    P.register_refresh_stream(spark, src, schema, C.geocodes(spark, SF_SMALL), C.localities(spark, SF_SMALL), C.streets(spark, SF_SMALL), table,
                              store.spatial_layout, f"{tmp_path}/out", C.AS_OF_DATE).awaitTermination()
    assert len(table.versions()) == P.BACKLOG
    got = table.read().select("address_detail_pid", "formatted_address").collect()
    want = C.addresses(spark, SF_SMALL).select("address_detail_pid", "formatted_address").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_words_and_weights_equal_the_plain_rule(spark):
    texts = ["", " Unit 3, 12-14 O'Brien St. ", "é ü_1 x", "a\t\nb", "...", "MAIN main", None]
    old = F.array_remove(F.split(F.regexp_replace(F.lower("t"), r"[^\w\s]", " "), r"\s+"), "")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(old.alias("a"), T.words(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    rnd = random.Random(4)
    sources_ = [("x", 1.0), ("y", 0.4), ("z", 0.2), ("v", 0.2)]
    rows = [tuple([rnd.choice("abcdef") for _ in range(rnd.randint(0, 4))] for _ in sources_) for _ in range(60)]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, z array<string>, v array<string>").select("*", T.weighted_doc(sources_).alias("doc"))
    for r in df.collect():
        want = {}
        for c, w in sources_:
            for t in r[c]:
                want[t] = max(w, want.get(t, 0))
        assert r.doc == want
    assert "lambda" not in _plan(df)


# ------------------------------------------------------------------ training-data operators
def test_texts_are_taken_in_small_pieces():
    from addresskit.llm.tokens import words

    pieces = list(words(pa.array(["word " * 200] * 4000)))
    assert sum(len(p.start) for p in pieces) == 800_000 and max(len(p.data) for p in pieces) <= 1 << 19


def test_ids_of_sets_do_not_depend_on_their_company():
    from addresskit.llm import ngram_join as N

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 700, 3)]
    assert N.content_ids(sets).tolist() == [int(N.content_ids([s])[0]) for s in sets] and len(set(N.content_ids(sets).tolist())) == 4
    flips = N._flips([np.zeros(0, np.uint64), *sets])
    assert [len(b) for b in flips] == [64] * 5 and flips[0] == bytes(64) and sum(x.bit_count() for x in flips[2]) == 2
