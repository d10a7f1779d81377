"""Streams equal their batch twins; the distributed quota equals a sequential scan."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from addresskit.operators import metrics as M
from addresskit.operators import quota as Q
from addresskit.sources.fixtures import derived
from addresskit.streaming import pipelines as P
from conftest import SF_SMALL


def test_quota_windows_equal_sequential_scan(spark):
    r = derived(spark, SF_SMALL, "request_log").select(
        (F.col("client") % 7).alias("client"), "request_id", M.micros("ts").alias("ts_us"))
    w_us, limit = 6 * 3600 * 1_000_000, 3
    got = {row.request_id: (row.window_start_us, row.allowed)
           for row in Q.fixed_windows(r, "client", "ts_us", w_us, limit, chunk_us=12 * 3600 * 1_000_000).collect()}
    pdf = r.toPandas().sort_values(["client", "ts_us", "request_id"])
    expect = {}
    for _, g in pdf.groupby("client"):
        start, n = None, 0
        for row in g.itertuples(index=False):
            if start is None or row.ts_us > start + w_us:
                start, n = row.ts_us, 0
            n += 1
            expect[row.request_id] = (start, n <= limit)
    assert got == expect
    assert any(not a for _, a in expect.values())


def test_stream_logs_equal_batch_twin(spark):
    q = E.queries()
    s = {r.day: (r.log_events, r.alert_events) for r in q["stream_logs"](spark, SF_SMALL).collect()}
    b = {r.day: (r.log_events, r.alert_events) for r in q["route_alert_logs"](spark, SF_SMALL).collect()}
    assert s == b


def test_stream_register_equals_batch_load(spark):
    q = E.queries()
    s = q["stream_register"](spark, SF_SMALL).select("address_detail_pid", "formatted_address").collect()
    b = q["etl_addresses"](spark, SF_SMALL).select("address_detail_pid", "formatted_address").collect()
    assert sorted(map(tuple, s)) == sorted(map(tuple, b))


def test_retried_log_epoch_replaces_its_rows(spark):
    out = P.run_dir(spark, "retry-test")
    rows = spark.createDataFrame([("high", "a", "2024-01-01"), ("low", "b", "2024-01-02")], "alert_priority string, x string, day string")
    for epoch in (0, 0, 1):
        P.route_logs(rows, epoch, out)
    assert spark.read.parquet(f"{out}/logs").count() == 4
    assert spark.read.parquet(f"{out}/alerts").count() == 2


def test_a_replayed_register_stream_changes_nothing(spark, tmp_path):
    from addresskit.plans import common as C
    from addresskit.plans import store
    from addresskit.sources import files as FS

    root = FS.stage_dataset(spark, SF_SMALL)
    cols = derived(spark, SF_SMALL, "address_detail").columns
    schema = ", ".join(f"{c} string" for c in cols) + ", file_name string"
    table = store.register_table(spark, store.fresh(spark, "replay"), C.addresses(spark, SF_SMALL))
    for attempt in ("a", "b"):  # the second run has lost its checkpoint and starts from the first file again
        P.register_refresh_stream(spark, f"{root}/G-NAF/G-NAF DEMO/Standard/address_detail", schema, C.geocodes(spark, SF_SMALL),
                                  C.localities(spark, SF_SMALL), C.streets(spark, SF_SMALL), table, store.spatial_layout,
                                  f"{tmp_path}/{attempt}", C.AS_OF_DATE).awaitTermination()
    got = table.read().select("address_detail_pid", "formatted_address").collect()
    want = C.addresses(spark, SF_SMALL).select("address_detail_pid", "formatted_address").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


LOG = """2024-01-01 10:00:00 first
  at one
  at two
2024-01-01 10:00:01 second
2024-01-01 10:00:02 third
  at three
    nested 2024-01-01

  at four
2024-01-01 10:00:03 fourth"""


@pytest.mark.parametrize("cuts", [(), (1,), (2, 6), (1, 2, 3, 4, 5, 6, 7, 8, 9)])
def test_events_cut_by_files_and_batches_arrive_whole(spark, tmp_path, cuts):
    from addresskit.streaming.stateful import use_rocksdb
    from addresskit.streaming.stitching import log_events
    from addresskit.streaming.watches import into_files

    use_rocksdb(spark)
    lines = LOG.split("\n")
    src, out = tmp_path / "src", str(tmp_path / "out")
    bounds = [0, *cuts, len(lines)]
    for log in ("a.log", "b.log"):
        (src / f"file={log}").mkdir(parents=True)
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        for log in ("a.log", "b.log"):
            chunk = src / f"file={log}" / f"chunk-{i}"
            chunk.write_text("\n".join(lines[lo:hi]) + "\n")
            os.utime(chunk, (1_700_000_000 + i, 1_700_000_000 + i))
    read = lambda: sorted((r.file, r.first, r.rest, r.lines) for r in spark.read.parquet(f"{out}/data").collect())
    into_files(log_events(spark, str(src)), out).awaitTermination()
    want = [("first", "  at one\n  at two", 3), ("second", None, 1), ("third", "  at three\n    nested 2024-01-01\n\n  at four", 5)]
    want = [(log, f"2024-01-01 10:00:0{i} {name}", rest, n) for log in ("a.log", "b.log") for i, (name, rest, n) in enumerate(want)]
    assert read() == want  # the fourth event may go on
    for log in ("a.log", "b.log"):
        (src / f"file={log}" / "more").write_text("  at five\n2024-01-02 end\n")
    into_files(log_events(spark, str(src)), out).awaitTermination()
    assert read() == sorted(want + [(log, "2024-01-01 10:00:03 fourth", "  at five", 2) for log in ("a.log", "b.log")])


def test_split_parts_do_not_depend_on_arrow_batches():
    import pyarrow as pa

    from addresskit.streaming.stitching import split_parts

    rows = [("f", 1, "p", 0, x) for x in LOG.split("\n")[1:]] + [("f", 1, "p", 9, x) for x in ("  a", "  b")] + [("g", 1, "q", 0, "2024-01-01 x")]
    names = ["file", "written", "path", "block", "line"]

    def parts(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], names=names) for i in range(0, len(rows), size)]
        return sorted(((r["file"], r["block"], r["kind"], r["first"], r["rest"], r["lines"]) for b in split_parts(iter(batches)) for r in b.to_pylist()), key=str)

    assert all(parts(size) == parts(100) for size in (1, 2, 3, 5))
    assert ("f", 9, 1, None, "  a\n  b", 2) in parts(100) and ("g", 0, 2, "2024-01-01 x", None, 1) in parts(2)
