"""Snapshot tables: what a change rewrites, what older snapshots still hold, order on read, budget, replay."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addresskit.plans import common as C
from addresskit.plans import store
from addresskit.sources import snapshots as S
from conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("state", T.StringType()), T.StructField("pid", T.StringType()), T.StructField("spot", T.LongType()),
                       T.StructField("name", T.StringType()), T.StructField("batch", T.StringType())])
STATES = ["NSW", "VIC", "A/B=c d", None]


def table(spark, name="t"):
    return S.SnapshotTable(spark, store.fresh(spark, name), SCHEMA, ["state"], ["spot", "pid"])


def rows(spark, n=200, batch="b1", first=0, seed=1):
    rng = random.Random(seed)
    data = [(STATES[i % 4] if rng.random() < 0.5 else "NSW", f"p{i}", rng.randint(0, 999), f"n{i}", batch) for i in range(first, first + n)]
    return spark.createDataFrame(data, SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def folders(t, version=None):
    return {r["state"]: r["folder"] for r in t.manifest(version).collect()}


def test_append_adds_folders_and_keeps_the_old_ones(spark):
    t = table(spark)
    assert t.versions() == [] and content(t.read()) == []
    a, b = rows(spark), rows(spark, 40, "b2", 200, 2).where("state = 'VIC'")
    assert t.append(a) == 0 and t.append(b) == 1
    assert content(t.read(0)) == content(a) and content(t.read()) == content(a.unionByName(b))
    assert set(folders(t, 0).values()) < {r["folder"] for r in t.manifest(1).collect()}
    assert t.manifest().agg(F.sum("rows")).first()[0] == t.read().count()
    assert content(t.read(where=F.col("state") == "A/B=c d")) == content(a.where("state = 'A/B=c d'"))
    assert content(t.read(where=F.col("state").isNull())) == content(a.where("state IS NULL"))


def test_rollback_rewrites_only_partitions_of_the_batch(spark):
    t = table(spark)
    a = rows(spark).withColumn("batch", F.when(F.col("state") == "VIC", "bad").otherwise(F.col("batch"))).withColumn(
        "batch", F.when(F.col("pid") == "p9", None).otherwise(F.col("batch")))
    t.append(a)
    t.delete(F.col("batch") == "bad")
    assert content(t.read()) == content(a.where("batch IS NULL OR batch <> 'bad'"))
    before, after = folders(t, 0), folders(t, 1)
    assert "VIC" not in after and all(after[s] == before[s] for s in after)
    t.delete(F.col("pid").isin([r.pid for r in a.where("state = 'NSW'").limit(3).collect()]))
    changed = {s for s in after if folders(t, 2)[s] != after[s]}
    assert changed == {"NSW"}
    assert content(t.read(0)) == content(a)


def test_retention_and_truncation_rewrite_nothing(spark):
    t = table(spark)
    a = rows(spark)
    t.append(a)
    t.drop(F.col("state").isin("NSW", "VIC"))
    assert content(t.read()) == content(a.where("state IS NULL OR state NOT IN ('NSW', 'VIC')"))
    assert all(folders(t, 0)[s] == f for s, f in folders(t, 1).items())
    t.drop(F.lit(True))
    assert content(t.read()) == [] and content(t.read(0)) == content(a)
    t.append(rows(spark, 3))
    assert t.read().count() == 3


def test_upsert_takes_the_last_row_and_touches_only_its_partitions(spark):
    t = table(spark)
    a = rows(spark)
    t.append(a)
    pid = a.where("state = 'VIC'").first().pid
    delivery = spark.createDataFrame([("XX", pid, 1, "late", "b2", 2), ("XX", pid, 1, "early", "b2", 1), ("TAS", "new", 5, "new", "b2", 1)],
                                     T.StructType([*SCHEMA.fields, T.StructField("seq", T.IntegerType())]))
    t.upsert(delivery, "pid", ["name"], "seq")
    old = {r.pid: r for r in a.collect()}
    got = {r.pid: r for r in t.read().collect()}
    assert set(got) == set(old) | {"new"} and got["new"].state == "TAS"
    assert tuple(got[pid]) == (old[pid].state, pid, old[pid].spot, "late", old[pid].batch)
    assert all(got[p] == old[p] for p in old if p != pid)
    assert {s for s in folders(t, 1) if folders(t, 1)[s] != folders(t, 0).get(s)} == {"VIC", "TAS"}


def test_a_retried_version_starts_from_the_same_snapshot(spark):
    t = table(spark)
    d = lambda i: rows(spark, 20, f"b{i}", 10 * i).withColumn("seq", F.lit(1))
    for version in (0, 1, 1, 0, 1):  # epochs, some of them again
        t.upsert(d(version), "pid", ["name", "batch"], "seq", version=version)
    assert t.versions() == [0, 1]
    assert sorted(r.pid for r in t.read().collect()) == sorted(f"p{i}" for i in range(30))


def test_files_are_sorted_and_a_hot_partition_is_split(spark):
    t = table(spark)
    a = rows(spark, 4000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would go to one file
    try:
        t.append(a)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    placed = t.read().withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id()).collect()
    files = {}
    for r in sorted(placed, key=lambda r: r.at):
        files.setdefault(r.file, []).append(r)
    for rs in files.values():
        assert [(r.spot, r.pid) for r in rs] == sorted((r.spot, r.pid) for r in rs) and len({r.state for r in rs}) == 1
    ranges = sorted((min(r.spot for r in rs), max(r.spot for r in rs)) for rs in files.values() if rs[0].state == "NSW")
    assert len(ranges) > 1 and all(x[1] <= y[0] for x, y in zip(ranges, ranges[1:]))


def test_a_load_over_its_budget_leaves_no_snapshot(spark):
    t = table(spark)
    with pytest.raises(S.RejectBudgetExceeded, match="1001 of 1201"):
        t.append(rows(spark), check=S.within_budget(1201, 1000))
    assert t.versions() == [] and content(t.read()) == []
    t.append(rows(spark), check=S.within_budget(1200, 1000))
    assert t.read().count() == 200


def test_expire_keeps_what_newer_snapshots_refer_to(spark):
    t = table(spark)
    a = rows(spark)
    t.append(a)
    t.delete(F.col("state") == "VIC")
    t.append(rows(spark, 5, "b2", 900))
    whole = content(t.read())
    assert t.expire(keep=1) > 0 and t.versions() == [2] and content(t.read()) == whole
    assert t.expire(keep=1) == 0


def test_stored_register_is_in_spatial_order(spark):
    t = store.stored_register(spark, SF_SMALL, "order-test")
    a = C.addresses(spark, SF_SMALL)
    assert t.read().count() == a.count()
    by_file = {}
    for r in t.read().select("geohash", "state_code", "cell", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).orderBy("i").collect():
        by_file.setdefault(r.f, []).append(r)
    assert all([r.geohash for r in rs] == sorted(r.geohash for r in rs) and len({(r.state_code, r.cell) for r in rs}) == 1 for rs in by_file.values())
    state = t.manifest().first().state_code
    assert t.read(where=F.col("state_code") == state).count() == a.where(F.col("state_code") == state).count()
