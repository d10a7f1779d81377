"""The polygon cell index against the crossing-number test of whole rings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from addresskit.operators import spatial as S


def star(rng, name, n, cx, cy, size, wild=0.7):
    """A ring of ``n`` vertices around a centre, with radii that jump: concave, many rises and falls in one row of cells."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
    radii = [size * (1 - wild * rng.random()) for _ in turns]
    return [(name, i, cx + r * math.cos(t), cy + r * math.sin(t)) for i, (t, r) in enumerate(zip(turns, radii))]


def crossings(ring, px, py):
    odd = False
    for (_, _, x1, y1), (_, _, x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def compare(spark, rings, points, cell):
    vertices = spark.createDataFrame([v for r in rings for v in r], "boundary_id string, vertex_no long, x double, y double").repartition(5)
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, px double, py double")
    index = S.polygon_index(vertices, cell)
    got = sorted(tuple(r) for r in S.contains_join(pts, index, cell).select("id", "boundary_id").collect())
    assert got == sorted((i, r[0][0]) for i, p in enumerate(points) for r in rings if crossings(r, *p))
    return index


@pytest.mark.parametrize("cell", [0.02, 0.3, 5.0])
def test_overlapping_concave_polygons(spark, cell):
    rng = random.Random(11)
    rings = [star(rng, f"s{i}", n, rng.uniform(-1, 1), rng.uniform(-1, 1), 1.0) for i, n in enumerate((3, 4, 40, 200))]
    points = [(rng.uniform(-2.2, 2.2), rng.uniform(-2.2, 2.2)) for _ in range(400)]
    points += [(r[k][2], r[k][3]) for r in rings for k in range(0, len(r), 9)]  # vertices themselves
    compare(spark, rings, points, cell)


def test_a_polygon_of_ten_thousand_vertices(spark):
    rng = random.Random(12)
    ring = star(rng, "big", 10_000, 0.3, -0.2, 2.0, 0.3)
    points = [(rng.uniform(-2, 2.5), rng.uniform(-2.4, 2)) for _ in range(250)]
    index = compare(spark, [ring], points, 0.05)
    inner = index.where("inside AND size(edges) = 0").count()
    assert inner > 1000 and index.agg(F.max(F.size("edges"))).first()[0] < 400  # nothing holds the ring


def test_edges_on_cell_borders_and_flat_edges(spark):
    square = [("q", 0, 0.0, 0.0), ("q", 1, 1.0, 0.0), ("q", 2, 1.0, 1.0), ("q", 3, 0.0, 1.0)]
    comb = [("c", 0, 0.0, 0.0), ("c", 1, 2.0, 0.0), ("c", 2, 2.0, 0.75), ("c", 3, 1.5, 0.75), ("c", 4, 1.5, 0.25), ("c", 5, 1.0, 0.25),
            ("c", 6, 1.0, 0.75), ("c", 7, 0.5, 0.75), ("c", 8, 0.5, 0.25), ("c", 9, 0.0, 0.25)]
    closed = [("z", i, x, y) for i, (x, y) in enumerate([(0.1, 0.1), (0.9, 0.1000001), (0.9, 0.9), (0.1, 0.9), (0.1, 0.1)])]
    at = [i / 8 for i in range(-1, 18)]
    compare(spark, [square, comb, closed], [(x, y) for x in at for y in at], 0.25)
    compare(spark, [square, comb, closed], [(x, y) for x in at for y in at], 0.1)
