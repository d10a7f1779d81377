"""DBSCAN's links between crowded cells equal a comparison point by point."""

import math
import random

from addresskit.operators import dbscan as D


def test_crowded_cells_are_linked_by_finer_boxes_not_point_by_point(spark, monkeypatch):
    """Two crowded columns a little under, and two a little over eps apart, and one pair that only two far corners decide."""
    rnd = random.Random(3)
    eps, side = 10.0, 10.0 / math.sqrt(2.0)

    def column(x, n=400, y0=0.1, y1=6.9):
        return [(x, rnd.uniform(y0, y1)) for _ in range(n)]

    cells = {"0:0": column(0.5), "2:0": column(2 * side + 0.1) + [(2 * side + 0.1, 3.0)] * 50, "0:5": column(0.5, y0=5 * side + 0.1, y1=5 * side + 7),
             "2:5": column(0.5 + eps + 1e-6 + 4.2, y0=5 * side + 0.1, y1=5 * side + 7)}
    cells["2:0"] = [(min(x, 0.5 + eps - 0.001), y) for x, y in cells["2:0"]]
    rows = [(float(x), float(y), int(math.floor(x / side)), int(math.floor(y / side))) for pts in cells.values() for x, y in pts]
    p = spark.createDataFrame(rows, "x double, y double, cx long, cy long").selectExpr("x", "y", "cx", "cy", "concat_ws(':', cx, cy) AS cid").cache()
    ids = sorted(r.cid for r in p.select("cid").distinct().collect())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "cid string, nid string")
    by_cell = {}
    for x, y, cx, cy in rows:
        by_cell.setdefault(f"{cx}:{cy}", []).append((x, y))
    want = sorted((a, b) for a in ids for b in ids if a < b and any(
        (px - qx) * (px - qx) + (py - qy) * (py - qy) <= eps * eps for px, py in by_cell[a] for qx, qy in by_cell[b]))
    got = sorted(tuple(r) for r in D.linked_pairs(pairs, p, side, eps).collect())
    assert want and len(want) < len(ids) * (len(ids) - 1) / 2 and got == want
    for few, levels in [(0, 30), (10**9, 1)]:  # boxes alone, points alone
        monkeypatch.setattr(D, "FEW_PAIRS", few)
        monkeypatch.setattr(D, "MAX_LEVEL", levels if few else 8)
        assert sorted(tuple(r) for r in D.linked_pairs(pairs, p, side, eps).collect()) == want
