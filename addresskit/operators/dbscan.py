"""Density clustering (W9) on a planar grid, and geohash cells.

DBSCAN with radius ``eps`` and ``min_pts`` over points (key, x, y):

* cells of side eps/sqrt(2) have diameter eps, so all points of one cell are
  neighbours of each other. A cell holding >= min_pts points makes all of
  them core without looking at any pair;
* a point in a sparser cell counts its neighbours cell by cell over the 5x5
  stencil: cells entirely within eps add their count, cells entirely beyond
  add nothing, and only the cells cut by the circle are checked point by
  point;
* core cells (cells with a core point) are linked when their core points'
  bounding boxes are within eps everywhere; boxes farther than eps apart are
  not linked; the remaining cell pairs are decided on 4x4 sub-cell boxes
  (bounded per cell pair): a sub-box pair within eps everywhere links them,
  and only sub-box pairs that are neither certain nor excluded are cut into
  4x4 again, or checked point by point once they hold few points;
* clusters are connected components of the core-cell graph, found by
  min-label propagation with pointer jumping, checkpointed each round;
* a non-core point joins the smallest cluster label among core points within
  eps (ties are order-dependent in DBSCAN; the smallest label makes it
  deterministic), otherwise it is noise (label null).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STENCIL = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3)]
SUB_CELLS = 4
FEW_PAIRS = 1024
MAX_LEVEL = 12


def _cut(df: DataFrame) -> DataFrame:
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _box_dist2(ax0, ax1, ay0, ay1, bx0, bx1, by0, by1):
    """(min, max) squared distance between two axis-aligned boxes."""
    dx_min = F.greatest(F.lit(0.0), bx0 - ax1, ax0 - bx1)
    dy_min = F.greatest(F.lit(0.0), by0 - ay1, ay0 - by1)
    dx_max = F.greatest(ax1 - bx0, bx1 - ax0)
    dy_max = F.greatest(ay1 - by0, by1 - ay0)
    return dx_min * dx_min + dy_min * dy_min, dx_max * dx_max + dy_max * dy_max


def _box_dist(*sides):
    """(min, max) distance between two axis-aligned boxes."""
    return tuple(F.sqrt(d) for d in _box_dist2(*sides))


def _stencil(df: DataFrame) -> DataFrame:
    offs = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in STENCIL])
    return df.withColumn("_o", F.explode(offs)).withColumn("ncx", F.col("cx") + F.col("_o.dx")) \
        .withColumn("ncy", F.col("cy") + F.col("_o.dy")).drop("_o")


def linked_pairs(open_pairs: DataFrame, points: DataFrame, side: float, eps: float) -> DataFrame:
    """The cell pairs (cid, nid) of ``open_pairs`` that hold two points within ``eps``; ``points`` has x, y, cx, cy, cid.

    The bounding boxes of a pair's sub-cells decide it or leave sub-cell pairs open; those are cut into 4x4 again, and a
    cell pair drops out as soon as one of its box pairs is certain. Few points are compared one by one, and boxes of
    equal points are always decided, so the work follows the circle's resolution and not the square of the points.
    """
    found = None
    pairs = open_pairs.select("cid", "nid", F.lit(0).cast("long").alias("sid"), F.lit(0).cast("long").alias("nsid"))
    p = points.withColumn("sid", F.lit(0).cast("long"))
    level = 0
    while True:
        level += 1
        t = side / SUB_CELLS ** level
        def part(v, c):
            return F.floor((F.col(v) - F.col(c) * side) / t).cast("long")

        p = p.withColumn("psid", F.col("sid")).withColumn("sid", F.shiftleft(part("x", "cx"), 32) + part("y", "cy"))
        boxes = _cut(p.groupBy("cid", "psid", "sid").agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.count(F.lit(1)).alias("n")))
        other = boxes.select(F.col("cid").alias("nid"), F.col("psid").alias("npsid"), F.col("sid").alias("nsid"),
                             F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"),
                             F.col("y1").alias("by1"), F.col("n").alias("bn"))
        sp = pairs.select("cid", "nid", F.col("sid").alias("psid"), F.col("nsid").alias("npsid")) \
            .join(boxes, ["cid", "psid"]).join(other, ["nid", "npsid"])
        smin, smax = _box_dist2(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), F.col("bx0"), F.col("bx1"),
                                F.col("by0"), F.col("by1"))
        sp = sp.withColumn("_min", smin).withColumn("_max", smax).filter(F.col("_min") <= eps * eps)
        sp = _cut(sp.select("cid", "nid", "psid", "npsid", "sid", "nsid", "_max", (F.col("n") * F.col("bn")).alias("_pairs")))
        certain = sp.filter(F.col("_max") <= eps * eps).select("cid", "nid").distinct()
        rest = sp.join(certain, ["cid", "nid"], "left_anti")
        few = rest.filter(F.col("_pairs") <= FEW_PAIRS) if level < MAX_LEVEL else rest
        pa = few.select("cid", "nid", "psid", "npsid", "sid", "nsid").join(
            p.select("cid", "psid", "sid", F.col("x").alias("ax"), F.col("y").alias("ay")), ["cid", "psid", "sid"])
        pb = p.select(F.col("cid").alias("nid"), F.col("psid").alias("npsid"), F.col("sid").alias("nsid"),
                      F.col("x").alias("bx"), F.col("y").alias("by"))
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        checked = pa.join(pb, ["nid", "npsid", "nsid"]).filter(dx * dx + dy * dy <= eps * eps).select("cid", "nid")
        linked = _cut(certain.unionByName(checked).distinct())
        found = linked if found is None else found.unionByName(linked)
        if level == MAX_LEVEL:
            return found
        rest = rest.filter(F.col("_pairs") > FEW_PAIRS).join(linked, ["cid", "nid"], "left_anti")
        pairs = _cut(rest.select("cid", "nid", "sid", "nsid"))
        if pairs.limit(1).count() == 0:
            return found
        used = pairs.select("cid", "sid").unionByName(
            pairs.select(F.col("nid").alias("cid"), F.col("nsid").alias("sid"))).distinct()
        p = _cut(p.drop("psid").join(used, ["cid", "sid"], "left_semi"))


def dbscan(points: DataFrame, key: str, eps: float, min_pts: int) -> DataFrame:
    """Return (key, cluster, is_core); ``points`` has ``key``, x, y (metres)."""
    s = eps / math.sqrt(2.0)
    p = points.select(key, "x", "y").withColumn("cx", F.floor(F.col("x") / s).cast("long")) \
        .withColumn("cy", F.floor(F.col("y") / s).cast("long"))
    p = _cut(p)
    cells = p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("cnt"))
    dense = cells.filter(F.col("cnt") >= min_pts).select("cx", "cy", F.lit(True).alias("dense"))
    p = p.join(dense, ["cx", "cy"], "left").withColumn("dense", F.coalesce("dense", F.lit(False)))

    # neighbour counts for points of sparse cells
    sparse = _stencil(p.filter(~F.col("dense")).select(key, "x", "y", "cx", "cy"))
    nb = sparse.join(cells.withColumnRenamed("cx", "ncx").withColumnRenamed("cy", "ncy"), ["ncx", "ncy"])
    x0, y0 = F.col("ncx") * s, F.col("ncy") * s
    dmin, dmax = _box_dist(F.col("x"), F.col("x"), F.col("y"), F.col("y"), x0, x0 + s, y0, y0 + s)
    nb = nb.withColumn("_dmin", dmin).withColumn("_dmax", dmax).filter(F.col("_dmin") <= eps)
    whole = nb.filter(F.col("_dmax") <= eps).groupBy(key).agg(F.sum("cnt").alias("n_whole"))
    part = nb.filter(F.col("_dmax") > eps).select(key, F.col("x").alias("px"), F.col("y").alias("py"), "ncx", "ncy")
    others = p.select(F.col(key).alias("_other"), F.col("x").alias("ox"), F.col("y").alias("oy"),
                      F.col("cx").alias("ncx"), F.col("cy").alias("ncy"))
    pairs = part.join(others, ["ncx", "ncy"])
    close = (F.col("px") - F.col("ox")) ** 2 + (F.col("py") - F.col("oy")) ** 2 <= eps * eps
    n_part = pairs.filter(close).groupBy(key).agg(F.count(F.lit(1)).alias("n_part"))
    counts = p.filter(~F.col("dense")).select(key).join(whole, key, "left").join(n_part, key, "left")
    sparse_core = counts.filter(F.coalesce("n_whole", F.lit(0)) + F.coalesce("n_part", F.lit(0)) >= min_pts) \
        .select(key, F.lit(True).alias("sc"))
    p = p.join(sparse_core, key, "left").withColumn("is_core", F.col("dense") | F.coalesce("sc", F.lit(False)))
    p = _cut(p.drop("sc"))

    core = p.filter("is_core")
    boxes = core.groupBy("cx", "cy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                                         F.max("y").alias("y1"))
    boxes = _cut(boxes.withColumn("cid", F.concat_ws(":", "cx", "cy")))
    a = _stencil(boxes.select("cx", "cy", "cid", "x0", "x1", "y0", "y1"))
    b = boxes.select(F.col("cx").alias("ncx"), F.col("cy").alias("ncy"), F.col("cid").alias("nid"),
                     F.col("x0").alias("bx0"), F.col("x1").alias("bx1"), F.col("y0").alias("by0"),
                     F.col("y1").alias("by1"))
    ab = a.join(b, ["ncx", "ncy"]).filter(F.col("cid") < F.col("nid"))
    bmin, bmax = _box_dist(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), F.col("bx0"), F.col("bx1"),
                           F.col("by0"), F.col("by1"))
    ab = ab.withColumn("_min", bmin).withColumn("_max", bmax).filter(F.col("_min") <= eps)
    sure = ab.filter(F.col("_max") <= eps).select("cid", "nid")
    open_pairs = _cut(ab.filter(F.col("_max") > eps).select("cid", "nid"))
    core_points = core.select("x", "y", "cx", "cy", F.concat_ws(":", "cx", "cy").alias("cid"))
    edges = _cut(sure.unionByName(linked_pairs(open_pairs, core_points, s, eps)).distinct())

    # connected components: min-label propagation with pointer jumping
    und = edges.unionByName(edges.select(F.col("nid").alias("cid"), F.col("cid").alias("nid")))
    label = _cut(boxes.select("cid", F.col("cid").alias("label")))
    while True:  # converges: labels only decrease, pointer jumping halves chain lengths
        nbr = und.join(label.withColumnRenamed("cid", "nid").withColumnRenamed("label", "nl"), "nid") \
            .groupBy("cid").agg(F.min("nl").alias("nl"))
        new = label.join(nbr, "cid", "left").select("cid", F.least("label", F.coalesce("nl", "label")).alias("label"))
        # pointer jumping: adopt the label of your label
        jump = new.alias("n").join(new.alias("m"), F.col("n.label") == F.col("m.cid"), "left").select(
            F.col("n.cid").alias("cid"), F.least(F.col("n.label"), F.coalesce(F.col("m.label"), F.col("n.label")))
            .alias("label"))
        jump = _cut(jump)
        changed = jump.join(label.withColumnRenamed("label", "old"), "cid").filter(F.col("label") != F.col("old"))
        label = jump
        if changed.limit(1).count() == 0:
            break

    cell_label = label.withColumnRenamed("cid", "cell")
    core_lab = core.select(key, F.concat_ws(":", "cx", "cy").alias("cell")).join(cell_label, "cell") \
        .select(key, F.col("label").alias("cluster"))
    # border points: smallest label among core points within eps
    border = _stencil(p.filter(~F.col("is_core")).select(key, "x", "y", "cx", "cy"))
    cpl = core.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("ncx"),
                      F.col("cy").alias("ncy"), F.concat_ws(":", "cx", "cy").alias("cell")).join(cell_label, "cell")
    bl = border.join(cpl, ["ncx", "ncy"]).filter(
        (F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 <= eps * eps) \
        .groupBy(key).agg(F.min("label").alias("cluster"))
    out = p.select(key, "is_core").join(core_lab.unionByName(bl), key, "left")
    return out.select(key, "cluster", "is_core")


BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, precision: int = 8) -> Column:
    """Geohash text of ``precision`` characters (interleaved lon/lat bits, base-32)."""
    bits = precision * 5
    lon_bits = (bits + 1) // 2
    lat_bits = bits // 2
    lo = F.least(F.floor((lon + 180.0) / 360.0 * (2 ** lon_bits)).cast("long"), F.lit(2 ** lon_bits - 1))
    la = F.least(F.floor((lat + 90.0) / 180.0 * (2 ** lat_bits)).cast("long"), F.lit(2 ** lat_bits - 1))
    code = F.lit(0).cast("long")
    for i in range(bits):
        # bit i from the left: even positions take longitude bits, odd take latitude bits
        if i % 2 == 0:
            b = F.shiftright(lo, lon_bits - 1 - i // 2).bitwiseAND(1)
        else:
            b = F.shiftright(la, lat_bits - 1 - i // 2).bitwiseAND(1)
        code = code + F.shiftleft(b, bits - 1 - i)
    alphabet = F.array(*[F.lit(ch) for ch in BASE32])
    chars = [F.element_at(alphabet, (F.shiftright(code, 5 * (precision - 1 - k)).bitwiseAND(31) + 1).cast("int"))
             for k in range(precision)]
    return F.concat(*chars)
