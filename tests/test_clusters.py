"""DBSCAN equals a brute-force DBSCAN on core sets and core partitions; geohash known value."""

import numpy as np
from pyspark.sql import functions as F

from addresskit.operators import dbscan as D
from addresskit.operators import spatial as S
from addresskit.plans import common as C
from conftest import SF_SMALL


def _brute(xy, eps, min_pts):
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_pts
    label = -np.ones(len(xy), dtype=int)
    cid = 0
    for i in np.where(core)[0]:
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = cid
        while stack:
            j = stack.pop()
            for k in np.where(nb[j] & core)[0]:
                if label[k] < 0:
                    label[k] = cid
                    stack.append(k)
        cid += 1
    return core, label


import pytest


@pytest.mark.parametrize("eps,min_pts", [(350.0, 4), (5000.0, 10), (120.0, 2)])
def test_dbscan_matches_brute_force(spark, eps, min_pts):
    pts = S.with_xy(C.addresses(spark, SF_SMALL)).select("gnaf_pid", "x", "y")
    got = {r.gnaf_pid: (r.cluster, r.is_core) for r in D.dbscan(pts, "gnaf_pid", eps, min_pts).collect()}
    pdf = pts.toPandas().sort_values("gnaf_pid").reset_index(drop=True)
    core, label = _brute(pdf[["x", "y"]].to_numpy(), eps, min_pts)
    pids = pdf["gnaf_pid"].tolist()
    assert [got[p][1] for p in pids] == core.tolist()
    # same partition of the core points
    pairs_got = {}
    for p, l, c in zip(pids, label, core):
        if c:
            pairs_got.setdefault(got[p][0], set()).add(l)
    assert all(len(v) == 1 for v in pairs_got.values())
    assert len(pairs_got) == len(set(label[core]))
    # non-core points: clustered iff within eps of a core point
    xy = pdf[["x", "y"]].to_numpy()
    for i, p in enumerate(pids):
        if not core[i]:
            near_core = (((xy[core] - xy[i]) ** 2).sum(1) <= eps * eps).any()
            assert (got[p][0] is not None) == bool(near_core)


def test_geohash_known_value(spark):
    v = spark.range(1).select(D.geohash(F.lit(57.64911), F.lit(10.40744), 8).alias("g")).first()["g"]
    assert v == "u4pruydq"
