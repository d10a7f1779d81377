"""Distance and containment joins on a planar grid.

Spark has no spatial join, and a distance predicate alone plans as a nested
loop. The joins here are equi-joins on integer grid cells: points are keyed by
their cell once (never duplicated); each request is exploded to the cells its
radius can reach (cells wholly outside the circle are pruned on the request
side), joined on the cell key, then tested exactly. Cells can be salted: a
point lands in one of ``salt`` sub-buckets and the request side is replicated
``salt`` times, so a hot cell (a city centre holding a large share of the
register) is spread over ``salt`` join tasks instead of one; AQE's skew-join
split covers whatever skew remains. Where only the k nearest are asked for
(``nearest``), cell counts first bound how far each request has to look, so
the pairs follow k and not the radius. Per-request top-k is a ``row_number``
window whose constant bound lets Spark insert a partial WindowGroupLimit
before the shuffle, so at most k rows per request and map task move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G


def with_xy(df: DataFrame, lat: str = "latitude", lon: str = "longitude", prefix: str = "") -> DataFrame:
    return df.withColumn(f"{prefix}x", G.mercator_x(F.col(lon))).withColumn(f"{prefix}y", G.mercator_y(F.col(lat)))


def point_cells(points: DataFrame, cell_m: float, salt: int = 1, key: str = "gnaf_pid") -> DataFrame:
    """Key each point (columns x, y) by its grid cell and salt bucket."""
    out = points.withColumn("cell_x", G.grid_cell(F.col("x"), cell_m)).withColumn(
        "cell_y", G.grid_cell(F.col("y"), cell_m))
    s = F.pmod(F.xxhash64(F.col(key)), F.lit(salt)).cast("int") if salt > 1 else F.lit(0)
    return out.withColumn("salt", s)


def request_cells(requests: DataFrame, radius: Column, cell_m: float, salt: int = 1) -> DataFrame:
    """Explode requests (columns rx, ry) to every cell within ``radius`` (and every salt bucket)."""
    n = F.ceil(radius / F.lit(cell_m)).cast("int")
    cx = G.grid_cell(F.col("rx"), cell_m)
    cy = G.grid_cell(F.col("ry"), cell_m)
    r = (
        requests.withColumn("_r", radius.cast("double"))
        .withColumn("_n", n)
        .withColumn("cell_x", F.explode(F.sequence(cx - F.col("_n"), cx + F.col("_n"))))
        .withColumn("cell_y", F.explode(F.sequence(cy - F.col("_n"), cy + F.col("_n"))))
    )
    # prune cells whose nearest point is farther than the radius
    x0 = F.col("cell_x") * cell_m
    y0 = F.col("cell_y") * cell_m
    ddx = F.greatest(x0 - F.col("rx"), F.lit(0.0), F.col("rx") - (x0 + cell_m))
    ddy = F.greatest(y0 - F.col("ry"), F.lit(0.0), F.col("ry") - (y0 + cell_m))
    r = r.filter(ddx * ddx + ddy * ddy <= F.col("_r") * F.col("_r"))
    if salt > 1:
        r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    else:
        r = r.withColumn("salt", F.lit(0))
    return r.drop("_n")


def within_distance(requests: DataFrame, points: DataFrame, radius: Column, cell_m: float = 500.0,
                    salt: int = 1, key: str = "gnaf_pid") -> DataFrame:
    """All (request, point) pairs with planar distance <= radius, with column ``distance_m``.

    ``requests`` needs rx, ry; ``points`` needs x, y and ``key``.
    """
    rc = request_cells(requests, radius, cell_m, salt)
    pc = point_cells(points, cell_m, salt, key)
    j = rc.hint("merge").join(pc, ["cell_x", "cell_y", "salt"])
    d = G.planar_distance(F.col("rx"), F.col("ry"), F.col("x"), F.col("y"))
    return j.withColumn("distance_m", d).filter(F.col("distance_m") <= F.col("_r")).drop(
        "cell_x", "cell_y", "salt", "_r")


LEVELS = [16.0 * 2 ** i for i in range(7)]  # metres: cell sizes among which each request picks its own


def with_reach(requests: DataFrame, points: DataFrame, radius: Column, k_max: int, k: Column | None = None,
               by: str = "request_id") -> DataFrame:
    """Requests (rx, ry) with ``reach``: a radius that holds the k nearest points, at most ``radius``; and ``cell_m``.

    The points of every cell are counted at all levels. If a request's cell, or it and the eight around it, hold k points,
    the k nearest are no farther than its farthest corner; the least of these distances is taken. A metre more
    covers ties of rounded distances. k is the greatest among the rows of ``by``, which are ranked together.
    """
    levels = F.explode(F.array(*[F.lit(s) for s in LEVELS])).alias("cell_m")

    def cell(of, x, y):
        return of.withColumn("cell_x", G.grid_cell(F.col(x), F.col("cell_m"))).withColumn("cell_y", G.grid_cell(F.col(y), F.col("cell_m")))

    at = ["cell_m", "cell_x", "cell_y"]
    cells = cell(points.select("x", "y", levels), "x", "y").groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = cells.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).select(
        "cell_m", (F.col("cell_x") + F.col("_i")).alias("cell_x"), (F.col("cell_y") + F.col("_j")).alias("cell_y"), "n",
        F.when((F.col("_i") == 0) & (F.col("_j") == 0), F.col("n")).alias("own"))
    around = around.groupBy(*at).agg(F.sum("n").alias("n"), F.coalesce(F.sum("own"), F.lit(0)).alias("own"))

    most = F.lit(k_max) if k is None else F.least(F.max(k).over(Window.partitionBy(by)), F.lit(k_max))
    r = requests.withColumn("_k", most.cast("long"))
    spots = cell(r.select("rx", "ry", "_k").distinct().select("*", levels), "rx", "ry")
    s = F.col("cell_m")

    def side(c, i):  # from the request to the farther side of its cell, in cells
        off = F.col(c) / s - F.col(i)
        return F.greatest(off, 1 - off)

    def corner(more):
        return F.sqrt(F.pow(side("rx", "cell_x") + more, 2) + F.pow(side("ry", "cell_y") + more, 2)) * s + 1

    found = spots.hint("merge").join(around, at).where("n >= _k").groupBy("rx", "ry", "_k").agg(
        F.min(F.when(F.col("own") >= F.col("_k"), corner(0)).otherwise(corner(1))).alias("_reach"))
    r = r.hint("merge").join(found, ["rx", "ry", "_k"], "left")
    r = r.withColumn("reach", F.least(radius.cast("double"), F.col("_reach"))).drop("_reach", "_k")
    fits = [F.when(F.col("reach") <= 2 * size, F.lit(size)) for size in LEVELS]
    return r.withColumn("cell_m", F.coalesce(*fits, F.lit(LEVELS[-1])))


def nearest(requests: DataFrame, points: DataFrame, radius: Column, tie: list[Column], k_max: int,
            k: Column | None = None, by: str = "request_id") -> DataFrame:
    """The (request, point) pairs of ``within_distance`` that can be among the first k of a request, nearest first.

    Work follows the pairs that are near, not those within the radius: a request looks no farther than its ``reach``, in
    cells of about that size. Of points in one place only the first ``k_max`` by ``tie`` (the order of equally
    distant points) can be among the first. ``top_k`` then ranks the pairs exactly.
    """
    from ..session import checkpoint_dir

    place = Window.partitionBy("x", "y").orderBy(*tie)
    pts = points.where("x IS NOT NULL AND y IS NOT NULL").withColumn("_place", F.row_number().over(place))
    pts = pts.where(F.col("_place") <= k_max).drop("_place")
    checkpoint_dir(requests.sparkSession)
    reached = with_reach(requests, pts, radius, k_max, k, by).checkpoint(eager=True)
    used = [row[0] for row in reached.select("cell_m").distinct().collect()]  # some of LEVELS
    if not used:
        used = LEVELS[:1]
    rc = request_cells(reached, F.col("reach"), F.col("cell_m")).drop("salt", "reach")
    pc = pts.withColumn("cell_m", F.explode(F.array(*[F.lit(s) for s in used])))
    pc = point_cells(pc, F.col("cell_m")).drop("salt")
    # an exploded side is far larger than estimated: never broadcast
    j = rc.hint("merge").join(pc, ["cell_m", "cell_x", "cell_y"])
    d = G.planar_distance(F.col("rx"), F.col("ry"), F.col("x"), F.col("y"))
    return j.withColumn("distance_m", d).where(F.col("distance_m") <= F.col("_r")).drop("cell_m", "cell_x", "cell_y", "_r")


def top_k(df: DataFrame, by: str, order: list[Column], k_max: int, k: Column | None = None) -> DataFrame:
    """Per-``by`` top-k: constant bound first (partial limit before the shuffle), then the row's own k."""
    w = Window.partitionBy(by).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k_max)
    if k is not None:
        out = out.filter(F.col("rank") <= k)
    return out


def rings(boundaries_long: DataFrame, key: str = "boundary_id") -> DataFrame:
    """Polygon rings from vertex rows: array<struct<x,y>> ordered by vertex number, plus the bbox."""
    r = boundaries_long.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("vertex_no", "x", "y"))).alias("_v"),
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
    )
    return r.withColumn("ring", F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))).drop("_v")


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Crossing-number test as one higher-order expression (no Python)."""
    n = F.size(ring)

    def edge(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, F.pmod(i + 1, n) + 1)
        # CASE keeps the division away from horizontal edges
        straddles = (a["y"] > py) != (b["y"] > py)
        left_of = px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(straddles, F.when(left_of, ~acc).otherwise(acc)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), edge)


EDGE = 1e-6  # of a cell: more than a computed crossing can be from the true one
FLAT = 1e-3  # of a cell: an edge that rises less counts with its whole width


def polygon_index(boundaries_long: DataFrame, cell: float = 0.05, key: str = "boundary_id") -> DataFrame:
    """Rows ``key, cell_x, cell_y, inside, ys, edges`` from vertex rows (``vertex_no, x, y``); no ring travels.

    A ray to the right of a point crosses three kinds of edges, seen from the point's cell and row of cells. Edges that
    reach the cell's columns inside the row are listed (``edges``) and tested. Edges wholly to the right count whenever the
    point's y is between their ends, and along a chain of such edges all inner vertices cancel: what is left is the
    parity of those that cross the whole row (``inside``) and the y of the chain's ends inside the row (``ys``). A cell
    without edges and ys is wholly inside or, without a row, wholly outside. The work grows with the cells that the edges
    pass and the cells inside, and no polygon's vertices meet in one row.
    """
    order = Window.partitionBy(key).orderBy("vertex_no")
    ends = Window.partitionBy(key).orderBy("vertex_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = boundaries_long.select(
        key, "vertex_no", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(order), F.first("x").over(ends)).alias("x2"),
        F.coalesce(F.lead("y").over(order), F.first("y").over(ends)).alias("y2"),
        F.coalesce(F.lead("vertex_no").over(order), F.first("vertex_no").over(ends)).alias("next_no"))

    def row(c):
        return F.floor(c / cell).cast("long")

    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = e.withColumn("cell_y", F.explode(F.sequence(row(low), row(high))))

    def x_at(y):
        return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))

    flat = high - low < FLAT * cell
    xa, xb = x_at(F.greatest(low, F.col("cell_y") * cell)), x_at(F.least(high, (F.col("cell_y") + 1) * cell))
    left = F.when(flat, F.least("x1", "x2")).otherwise(F.least(xa, xb)) - EDGE * cell
    right = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(xa, xb)) + EDGE * cell
    # first: the first column the edge reaches in this row; it is wholly to the right of all columns before
    e = e.withColumn("first", row(left)).withColumn("last", row(right))
    for end in ("1", "2"):
        e = e.withColumn(f"up{end}", row(F.col(f"y{end}")) > F.col("cell_y")).withColumn(f"in{end}", row(F.col(f"y{end}")) == F.col("cell_y"))

    listed = e.select(key, "cell_y", F.explode(F.sequence("first", "last")).alias("cell_x"), F.struct("x1", "y1", "x2", "y2").alias("edge"))
    listed = listed.groupBy(key, "cell_x", "cell_y").agg(F.collect_list("edge").alias("edges"))
    # a vertex inside the row belongs to two edges of the row and counts where only one of them is wholly to the right
    v = e.where("in1").select(key, "cell_y", F.col("vertex_no").alias("v"), F.col("y1").alias("y"), "first").unionByName(
        e.where("in2").select(key, "cell_y", F.col("next_no").alias("v"), F.col("y2").alias("y"), "first"))
    v = v.groupBy(key, "cell_y", "v", "y").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b")
    v = v.select(key, "cell_y", "y", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("cell_x"))
    ys = v.groupBy(key, "cell_x", "cell_y").agg(F.collect_list("y").alias("ys"))

    # edges with one end above the row: every column before their first sees them
    turns = e.where("up1 <> up2").groupBy(key, "cell_y", "first").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    span = e.groupBy(key, "cell_y").agg(F.min("first").alias("a"))
    # between two turns the parity is the same: one row a stretch, then its cells
    later = Window.partitionBy(key, "cell_y").orderBy("first")
    after = Window.partitionBy(key, "cell_y").orderBy(F.col("first").desc())
    stretch = turns.join(span, [key, "cell_y"]).select(
        key, "cell_y", F.coalesce(F.lag("first").over(later), F.col("a")).alias("from"), (F.col("first") - 1).alias("to"),
        (F.row_number().over(after) % 2 == 1).alias("odd")).where("odd AND `from` <= `to`")
    inside = stretch.select(key, "cell_y", F.explode(F.sequence("from", "to")).alias("cell_x"), F.lit(True).alias("inside"))

    by = [key, "cell_x", "cell_y"]
    return inside.join(listed, by, "full").join(ys, by, "full").select(
        *by, F.coalesce("inside", F.lit(False)).alias("inside"),
        F.coalesce("ys", F.array().cast("array<double>")).alias("ys"),
        F.coalesce("edges", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")).alias("edges"))


def contains_join(points: DataFrame, index: DataFrame, cell: float = 0.05) -> DataFrame:
    """The rows of ``points`` (px, py) joined to the ``polygon_index`` rows of the polygons that they are in.

    The same answer as the crossing-number test of the whole ring, from the point's cell alone.
    """
    pts = points.withColumn("cell_x", F.floor(F.col("px") / cell).cast("long")).withColumn(
        "cell_y", F.floor(F.col("py") / cell).cast("long"))
    j = pts.join(index, ["cell_x", "cell_y"])
    px, py = F.col("px"), F.col("py")

    def crossed(e):
        straddles = (e["y1"] > py) != (e["y2"] > py)
        return F.when(straddles, px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)

    odd = (F.size(F.filter("edges", crossed)) + F.size(F.filter("ys", lambda y: y > py))) % 2 == 1
    return j.where(odd != F.col("inside")).drop("cell_x", "cell_y", "inside", "ys", "edges")
