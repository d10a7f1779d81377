"""Property checks: distributed formulations equal brute force on small inputs."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from addresskit.functions import geo as G
from addresskit.operators import metrics as M
from addresskit.operators import spatial as S
from addresskit.operators import upsert as U
from addresskit.plans import common as C
from addresskit.plans import spatial as SP
from conftest import SF_SMALL


def test_grid_join_equals_brute_force(spark):
    req = SP.normalised_requests(spark, SF_SMALL).select("request_id", "rx", "ry", "radius")
    pts = S.with_xy(C.addresses(spark, SF_SMALL)).select("gnaf_pid", "x", "y")
    grid = S.within_distance(req, pts, F.col("radius"), cell_m=300.0, salt=3).select("request_id", "gnaf_pid")
    d = G.planar_distance(F.col("rx"), F.col("ry"), F.col("x"), F.col("y"))
    brute = req.crossJoin(pts).filter(d <= F.col("radius")).select("request_id", "gnaf_pid")  # test oracle only
    a = sorted(map(tuple, grid.collect()))
    b = sorted(map(tuple, brute.collect()))
    assert a == b and len(a) > 0


def test_nearest_ranks_as_the_whole_radius_does_from_few_pairs(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.uniform(0, 1500, (4000, 2)), np.full((80, 2), 700.0), rng.uniform(9000, 20000, (30, 2))])
    pts = spark.createDataFrame(pd.DataFrame({"gnaf_pid": [f"P{i * 7919 % 4110:05d}" for i in range(len(xy))],
                                              "x": xy[:, 0], "y": xy[:, 1]}))
    at = np.concatenate([rng.uniform(-300, 1800, (150, 2)), [[700.0, 701.0]], rng.uniform(2000, 20000, (40, 2))])
    req = pd.DataFrame({"request_id": range(len(at)), "rx": at[:, 0], "ry": at[:, 1], "radius": 2000, "k": 1 + np.arange(len(at)) % 12})
    # requests come twice, some from elsewhere with another k
    again = req[:30].assign(k=3, rx=req["rx"][:30] + 400)
    req = spark.createDataFrame(pd.concat([req, req[40:60], again]))
    order = [F.round("distance_m").cast("long"), F.col("gnaf_pid")]

    def ranked(pairs):
        top = S.top_k(pairs, "request_id", order, 10, F.col("k")).withColumn("m", F.round("distance_m").cast("long"))
        return sorted(map(tuple, top.select("request_id", "gnaf_pid", "m", "rank").collect()))

    whole = S.within_distance(req, pts, F.col("radius"), cell_m=500.0)
    near = S.nearest(req, pts, F.col("radius"), [F.col("gnaf_pid")], 10, F.col("k"))
    assert ranked(near) == ranked(whole)
    assert near.count() * 10 < whole.count()
    empty = S.nearest(req.limit(0), pts, F.col("radius"), [F.col("gnaf_pid")], 10, F.col("k"))
    assert empty.columns == near.columns and empty.count() == 0


def test_distance_joins_do_not_broadcast_exploded_requests(spark):
    """The estimate of an exploded side is that of the rows before; the session's limit must not matter."""
    req = SP.normalised_requests(spark, SF_SMALL)
    pts = S.with_xy(C.addresses(spark, SF_SMALL)).select("gnaf_pid", "x", "y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        near = S.nearest(req, pts, F.col("radius"), [F.col("gnaf_pid")], 10, F.col("k"))
        for pairs in (S.within_distance(req, pts, F.col("radius")), near):
            plan = pairs._jdf.queryExecution().executedPlan().toString()
            assert plan.index("SortMergeJoin") < (plan + "BroadcastHashJoin").index("BroadcastHashJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def test_point_in_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2)]])
    row = spark.range(1).select(S.point_in_ring(F.lit(1.0), F.lit(1.0), ring).alias("a"),
                                S.point_in_ring(F.lit(3.0), F.lit(1.0), ring).alias("b")).first()
    assert row["a"] is True and row["b"] is False


def test_upsert_is_idempotent_and_updates_only_listed_columns(spark):
    cur = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, w int")
    new = spark.createDataFrame([("a", "X", 9), ("c", "z", 3)], "k string, v string, w int")
    out = {r.k: (r.v, r.w) for r in U.upsert(cur, new, "k", ["v"]).collect()}
    assert out == {"a": ("X", 1), "b": ("y", 2), "c": ("z", 3)}
    again = {r.k: (r.v, r.w) for r in U.upsert(cur, cur, "k", ["v", "w"]).collect()}
    assert again == {"a": ("x", 1), "b": ("y", 2)}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 50, size=503)
    df = spark.createDataFrame(pd.DataFrame({"k": vals % 3, "v": vals}))
    got = {r.k: (r.p95, r.p50) for r in M.exact_percentiles(df, ["k"], "v", {"p95": 0.95, "p50": 0.5}).collect()}
    gotc = {r.k: r.p95 for r in M.exact_percentiles(df, ["k"], "v", {"p95": 0.95}, "ceil").collect()}
    for k in range(3):
        s = np.sort(vals[vals % 3 == k])
        assert got[k] == (s[math.floor(len(s) * 0.95)], s[math.floor(len(s) * 0.5)])
        assert gotc[k] == s[max(math.ceil(len(s) * 0.95) - 1, 0)]


def test_moving_average_and_ema_blocks(spark):
    rng = np.random.default_rng(3)
    n = 157
    pdf = pd.DataFrame({"k": ["a"] * n + ["b"] * 40, "t": list(range(n)) + list(range(40)),
                        "v": rng.integers(1, 100, size=n + 40)})
    df = M.positions(spark.createDataFrame(pdf), ["k"], ["t"], F.floor(F.col("t") / 25))
    ma = {(r.k, r.t): r.moving_avg for r in M.moving_average(df, ["k"], "v", 10, block=16).collect()}
    em = {(r.k, r.t): r.ema for r in M.ema(df, ["k"], "v", 0.2, block=16).collect()}
    for k, g in pdf.groupby("k"):
        v = g.sort_values("t")["v"].to_numpy(dtype=float)
        e = v[0]
        for i, t in enumerate(g.sort_values("t")["t"]):
            assert abs(ma[(k, t)] - v[max(0, i - 9): i + 1].mean()) < 1e-9
            if i > 0:
                e = 0.8 * e + 0.2 * v[i]
            assert abs(em[(k, t)] - e) < 1e-6 * max(1.0, abs(e))


def test_histogram_quantile(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": ["r"] * 10, "v": [0.002, 0.003, 0.004, 0.02, 0.02, 0.03, 0.2,
                                                                     0.3, 0.7, 2.0]}))
    h = M.cumulative_histogram(df, ["k"], F.col("v"), [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0])
    q = M.histogram_quantile(h, ["k"], 0.5).first()["quantile"]
    # rank 5 falls in (0.01, 0.05] holding cumulative 3 -> 6: 0.01 + 0.04 * (5 - 3) / 3
    assert abs(q - (0.01 + 0.04 * 2 / 3)) < 1e-12


def test_issue_counts_equal_exploded_issues(spark):
    import __spark_entry__ as E

    q = E.queries()
    per_row = q["validation_issues"](spark, SF_SMALL).agg(F.sum("n_issues")).first()[0]
    rules = sum(q[n](spark, SF_SMALL).count() for n in ("rule_required", "rule_bounds", "rule_postcode", "rule_length"))
    assert per_row == rules


def test_stitch_across_splits(spark, tmp_path):
    from addresskit.plans.sources import stitch

    lines = []
    for i in range(400):
        lines.append(f"2024-01-01 00:00:{i % 60:02d}.000 event {i}")
        for j in range(i % 3):
            lines.append(f"    at frame {i}.{j}")
    p = tmp_path / "app.log"
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        ev = stitch(spark.read.text(str(p))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expect = {}
    cur = None
    for ln in lines:
        if ln[:4].isdigit():
            cur = ln
            expect[cur] = [ln]
        else:
            expect[cur].append(ln)
    got = {r.first_line: r.event_text for r in ev}
    assert len(got) == 400
    assert all(got[k] == "\n".join(v) for k, v in expect.items())


def test_ema_is_exact_over_the_whole_history(spark):
    rng = np.random.default_rng(11)
    v = rng.integers(1, 100, size=5000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "_g": np.arange(1, 5001), "v": v}), "k string, _g long, v double")
    for alpha, seed in ((0.01, None), (0.5, 0.0), (0.01, 7.0)):
        e, expect = seed, []
        for x in v:
            e = x if e is None else (1 - alpha) * e + alpha * x
            expect.append(e)
        got = [r.ema for r in M.ema(df, ["k"], "v", alpha, seed, block=64).orderBy("_g").collect()]
        assert np.allclose(got, expect, rtol=1e-9)
    flat = df.withColumn("v", F.lit(10.0))
    assert flat.count() == M.ema(flat, ["k"], "v", 0.01, block=64).where(F.abs(F.col("ema") - 10) < 1e-9).count()


def test_traffic_anomaly_sees_empty_buckets(spark):
    from addresskit.plans.alerts import anomalies

    at = ["2024-01-01 00:00:30"] * 20 + ["2024-01-01 00:11:00"] * 9  # the bucket at 00:05 is empty
    r = spark.createDataFrame([(t, 200, "1.1.1.1") for t in at], "t string, status_code int, ip string").select(
        F.to_timestamp_ntz("t").alias("ts"), "status_code", "ip", F.lit("/r").alias("route"))
    got = [(x.n, x.prev_n, x.spike, x.drop) for x in anomalies(r).orderBy("bucket").collect()]
    assert got == [(20, 0, False, False), (0, 20, False, True), (9, 0, True, False)]


def test_counter_increase_spans_days_without_samples(spark):
    from addresskit.plans.alerts import increases

    rows = [("m", "2024-01-01 23:59:00", 100), ("m", "2024-01-04 00:00:00", 150), ("m", "2024-01-09 00:00:00", 30)]
    c = spark.createDataFrame(rows, "metric string, t string, value long").select(
        "metric", F.to_timestamp_ntz("t").alias("minute"), "value")
    got = {str(x.t): x.increase_5m for x in increases(c).collect()}
    assert got["2024-01-04 00:00:00"] == 50 and got["2024-01-09 00:04:00"] == 30 and got["2024-01-01 23:59:00"] == 0


def test_later_geocode_wins(spark):
    from addresskit.operators import register as R

    rows = [("p", -30.0, 150.0, None, 1), ("p", -35.0, 140.0, "GAP", 2), ("p", None, 140.0, "GAP", 3)]
    g = spark.createDataFrame(rows, "address_detail_pid string, latitude double, longitude double, geocode_type_code string, n int")
    r = R.load_geocodes(g, "n").first()
    assert (r.latitude, r.longitude, r.geocode_type) == (-35.0, 140.0, "GAP")


def test_delimited_files_keep_their_order_and_headers(spark, tmp_path):
    import pytest
    from addresskit.operators import register as R
    from addresskit.sources import files as FS

    head = "ADDRESS_DETAIL_PID|LATITUDE|LONGITUDE|GEOCODE_TYPE_CODE"
    body = [f"p{i % 50}|-{20 + i / 100:.2f}|140|GAP" for i in range(500)]
    (tmp_path / "a.psv").write_text("\n".join([head, *body[:300]]) + "\n")
    (tmp_path / "b.psv").write_text("\n".join([head, *body[300:]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        paths = [str(tmp_path / "a.psv"), str(tmp_path / "b.psv")]
        g = FS.read_delimited(spark, paths, "|", "place")
        g = g.select([F.col(c).alias(c.lower()) for c in g.columns])
        got = {r.address_detail_pid: round(r.latitude, 2) for r in R.load_geocodes(g, "place").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"p{i}": -round(20 + (450 + i) / 100, 2) for i in range(50)}
    (tmp_path / "c.psv").write_text("LATITUDE|ADDRESS_DETAIL_PID|LONGITUDE|GEOCODE_TYPE_CODE\n-20|p0|140|GAP\n")
    with pytest.raises(Exception, match="(?i)header"):
        FS.read_delimited(spark, [*paths, str(tmp_path / "c.psv")], "|").collect()
