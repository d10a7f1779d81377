"""Alert episodes, quotas and watches: batch equals a sequential loop, streams equal batch with shuffled and late rows."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from addresskit.operators import episodes as E
from addresskit.operators import quota as Q
from addresskit.plans import alerts as A
from addresskit.plans.streams import streamed
from addresskit.streaming import pipelines as P
from addresskit.streaming import stateful as ST
from addresskit.streaming import watches as W

START = dt.datetime(2024, 3, 1)
REPEAT = {"critical": 300, "warning": 1800, "info": 43200}
RANK = {"info": 1, "warning": 2, "error": 3, "critical": 4}


def walk(rows):
    """The rule of ST12, one group and window after another."""
    groups = {}
    for alert, service, severity, t in rows:
        windows = groups.setdefault((alert, service), {})
        windows[t] = max(windows.get(t, 0), RANK.get(severity, 0))
    out = []
    for (alert, service), windows in groups.items():
        last = sent = None
        episode = sent_rank = 0
        for t, rank in sorted(windows.items()):
            name = {v: k for k, v in RANK.items()}.get(rank)
            opens = last is None or (t - last).total_seconds() > 300
            if opens:
                episode += 1
            notify = opens or rank > sent_rank or (t - sent).total_seconds() >= REPEAT.get(name, 3600)
            if notify:
                sent, sent_rank = t, rank
            out.append((alert, service, name, t, notify, episode))
            last = t
    return sorted(out, key=str)


def alert_rows(n, seed, keep=0.9):
    rng = random.Random(seed)
    rows = []
    for group in (("latency", "api"), ("latency", "admin"), ("errors", "api")):
        severity = "warning"
        for i in range(n):
            if rng.random() < 0.05:
                severity = rng.choice(["info", "warning", "error", "critical", "odd"])
            if rng.random() < keep:
                t = START + dt.timedelta(seconds=300 * i)
                rows.append((*group, severity, t))
                if rng.random() < 0.1:
                    rows.append((*group, rng.choice(["info", "critical"]), t))
    return rows


ALERTS = "alert_type string, service string, severity string, window_start timestamp_ntz"


@pytest.mark.parametrize("chunk_us", [7_000_000_000, E.DAY_US])
def test_notifications_equal_a_walk(spark, chunk_us):
    rows = alert_rows(260, 1)
    got = E.notifications(spark.createDataFrame(rows, ALERTS).repartition(4), chunk_us=chunk_us).collect()
    assert sorted(map(tuple, got), key=str) == walk(rows)


def test_a_step_in_severity_notifies_but_opens_no_episode(spark):
    at = lambda i: START + dt.timedelta(seconds=300 * i)
    rows = [("a", "s", "warning", at(0)), ("a", "s", "warning", at(1)), ("a", "s", "critical", at(2)), ("a", "s", "warning", at(3)),
            ("a", "s", "critical", at(4)), ("a", "t", "critical", at(4)), ("a", "s", "warning", at(9)), ("a", None, None, at(1))]
    n = E.notifications(spark.createDataFrame(rows, ALERTS))
    got = {(r.service, r.window_start): (r.notified, r.episode, r.severity) for r in n.collect()}
    assert got == {("s", at(0)): (True, 1, "warning"), ("s", at(1)): (False, 1, "warning"), ("s", at(2)): (True, 1, "critical"),
                   ("s", at(3)): (False, 1, "warning"), ("s", at(4)): (True, 1, "critical"), ("t", at(4)): (True, 1, "critical"),
                   ("s", at(9)): (True, 2, "warning"), ("", at(1)): (True, 1, None)}
    first = {(r.service, r.episode): r for r in E.episodes(n).collect()}["s", 1]
    assert (first.windows, first.notifications, first.severity, first.resolved) == (5, 3, "critical", at(5))
    assert E.notifications(spark.createDataFrame([], ALERTS)).collect() == []


def run_files(spark, frames, schema, watch):
    """A stream over the frames, one file and batch each."""
    ST.use_rocksdb(spark)
    out = P.run_dir(spark, "test")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(f"{out}/src")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/src")
    W.into_files(watch(source), out).awaitTermination()
    return out, spark.read.parquet(f"{out}/data")


def test_alert_stream_equals_walk_with_shuffled_and_late_rows(spark):
    rows = alert_rows(80, 2, keep=0.8)
    rng = random.Random(3)
    # rows come up to two windows out of order, inside the watermark's ten minutes
    shuffled = [r for _, r in sorted((r[3] + dt.timedelta(seconds=rng.choice([0, 300, 590])), r) for r in rows)]
    late = ("latency", "api", "critical", START)  # far behind the watermark: dropped
    flush = ("flush", "api", "info", START + dt.timedelta(days=3))
    files = [shuffled[k:k + 40] for k in range(0, len(shuffled), 40)] + [[late, flush]]
    schema = spark.createDataFrame([], ALERTS.replace("timestamp_ntz", "timestamp")).schema
    frames = [spark.createDataFrame(f, ALERTS).withColumn("window_start", F.col("window_start").cast("timestamp")) for f in files]
    _, got = run_files(spark, frames, schema, ST.alert_episodes)
    got = got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    told = sorted((tuple(r)[:6] for r in got.where("NOT resolved AND alert_type <> 'flush'").collect()), key=str)
    assert told == walk(rows)
    ends = E.episodes(E.notifications(spark.createDataFrame(rows, ALERTS)))
    want = sorted((r.alert_type, r.service, r.episode, r.resolved, r.severity) for r in ends.collect())
    assert sorted((r.alert_type, r.service, r.episode, r.window_start, r.severity)
                  for r in got.where("resolved AND alert_type <> 'flush'").collect()) == want


def requests(n, seed, clients=3):
    rng = random.Random(seed)
    t, out = 0, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 20, 60, 200])
        out.append((rng.choice(["a"] * 5 + ["b", None][:clients - 1]), i, START + dt.timedelta(seconds=t)))
    return out


def walk_quota(rows, window_s, limit):
    state, out = {}, []
    for client, request, t in sorted(rows, key=lambda r: (r[2], r[1])):
        client = client or "unknown"
        start, n = state.get(client, (None, 0))
        if start is None or (t - start).total_seconds() > window_s:
            start, n = t, 0
        state[client] = (start, n + 1)
        out.append((client, request, t, start, n + 1, n < limit))
    return sorted(out)


def test_quota_window_includes_its_end(spark):
    rows = [("a", i, START + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 60, 61, 121, 122])]
    df = spark.createDataFrame(rows, "client string, request_id long, ts timestamp_ntz")
    from addresskit.operators import metrics as M

    got = Q.fixed_windows(df.withColumn("ts_us", M.micros("ts")), "client", "ts_us", 60_000_000, 2).orderBy("request_id").collect()
    assert [(r.rank_in_window, r.allowed) for r in got] == [(1, True), (2, True), (3, False), (1, True), (2, True), (1, True)]


def test_quota_stream_equals_a_walk_with_shuffled_files(spark):
    rows = requests(240, 5)
    rng = random.Random(6)
    shuffled = [r for _, _, r in sorted((r[2] + dt.timedelta(seconds=rng.randint(0, 500)), r[1], r) for r in rows)]
    files = [shuffled[k:k + 80] for k in range(0, 240, 80)] + [[("flush", 999, START + dt.timedelta(days=2))]]
    kind = "client string, request_id long, ts timestamp"
    frames = [spark.createDataFrame(f, kind.replace("timestamp", "timestamp_ntz")).withColumn("ts", F.col("ts").cast("timestamp")) for f in files]
    out, got = run_files(spark, frames, frames[0].schema, lambda s: ST.quota(s, 900_000_000, 5))
    got = got.select("client", "request_id", F.col("ts").cast("timestamp_ntz"), F.col("window_start").cast("timestamp_ntz"), "rank_in_window", "allowed")
    assert sorted(map(tuple, got.where("client <> 'flush'").collect())) == walk_quota(rows, 900, 5)
    # started again on the same files, the stream adds nothing
    source = spark.readStream.schema(frames[0].schema).parquet(f"{out}/src")
    W.into_files(ST.quota(source, 900_000_000, 5), out).awaitTermination()
    assert spark.read.parquet(f"{out}/data").where("client <> 'flush'").count() == 240


def test_traffic_stream_emits_empty_buckets_and_equals_batch(spark):
    rng = random.Random(9)
    rows = []
    for i in range(30):
        for _ in range(0 if i in (4, 11, 12, 13) else rng.choice([1, 3, 14, 60])):
            rows.append((START + dt.timedelta(seconds=300 * i + rng.randint(0, 299)), rng.choice([200, 200, 500]),
                         f"10.0.0.{rng.randint(0, 30)}", f"/r{rng.randint(0, 14)}"))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, status_code long, ip string, route string")
    want = {r.bucket: r for r in A.anomalies(df).collect()}
    stream = df.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.bucket: r for r in streamed(spark, stream, "ts", stream, ST.traffic_watch, "bucket", "traffic-test").collect()}
    assert set(got) == set(want) and any(r.n == 0 for r in got.values()) and any(r.drop for r in got.values())
    for bucket, w in want.items():
        g = got[bucket]
        assert (g.n, g.errors, g.error_share, g.top_endpoints, g.prev_n, g.spike, g.drop) == (
            w.n, w.errors, w.error_share, w.top_endpoints, w.prev_n, w.spike, w.drop)
        assert abs(g.distinct_ips - w.distinct_ips) <= 1


def test_security_hits_by_query_body_and_header(spark):
    rows = [(1, None, "q=1 union select", None, None), (2, None, "q=a", '{"a":"javascript:x"}', "1.2.3.4"),
            (3, None, None, None, "1..2"), (4, None, "on click", "{}", "10.0.0.1"), (5, None, "onload = x", "drop it", "..")]
    df = spark.createDataFrame([(i, START, "ip", "/p", q, b, h) for i, _, q, b, h in rows],
                               "request_id long, ts timestamp_ntz, ip string, path string, query_text string, body_text string, forwarded_for string")
    got = sorted((r.request_id, r.event) for r in A.security_hits(df).collect())
    assert got == [(1, "suspicious_query_params"), (2, "suspicious_request_body"), (3, "suspicious_header"),
                   (5, "suspicious_header"), (5, "suspicious_query_params"), (5, "suspicious_request_body")]


def test_parts_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "run_dir", lambda spark, name: f"{tmp_path}/{name}")
    start = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    rows = spark.range(0, 400, 1, 4).select(F.timestamp_seconds(F.lit(start) + (F.col("id") * 37) % 400).alias("ts"), F.lit(500).alias("status_code"),
                                            F.lit("E").alias("error_name"))
    got = streamed(spark, rows, "ts", rows, lambda s: W.error_burst_watch(s, 5), "window_start", "parts").collect()
    assert len(list((tmp_path / "parts" / "src").glob("*.parquet"))) > 4  # three parts and the last row
    want = {w: sum(w <= s < w + 300 for s in range(400)) for w in range(-240, 400, 60)}
    assert {r.window_start: r.n_errors for r in got} == {START + dt.timedelta(seconds=w): n for w, n in want.items() if n > 5}


class _Handle:
    """Lists and values of one key in memory; ``timers`` holds what was asked for."""

    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return _Value()

    def registerTimer(self, ms):
        self.timers.append(ms)

    rows = ()

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]

    def put(self, rows):
        self.rows = rows

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = ()


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def clear(self):
        self.held = None


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_need_one_timer_a_batch():
    quota, handle = ST.Quota(900_000_000, 5), _Handle()
    quota.init(handle)
    rows = pd.DataFrame({"t": [s * 1_000_000 for s in (*range(100), 5)], "request_id": [*range(100), 5]})  # one row twice
    list(quota.handleInputRows(("c",), iter([rows]), _Now(0)))
    assert handle.timers == [0]
    first = pd.concat(quota.handleExpiredTimer(("c",), _Now(39_000), None))
    assert first["request_id"].tolist() == list(range(40)) and 40_000 in handle.timers and len(handle.rows) == 60
    assert pd.concat(quota.handleExpiredTimer(("c",), _Now(200_000), None))["rank_in_window"].tolist() == list(range(41, 101))
    assert not handle.rows
