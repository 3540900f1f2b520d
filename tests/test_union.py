"""Unions of polygons against an exact sum over slabs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridimpact.operators import union

SCHEMA = f"g int, note string, rings {union.RINGS}"
Ring = list[tuple[float, float]]


def rect(a: float, b: float, c: float, d: float) -> Ring:
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def brute_area(polygons: list[list[Ring]]) -> float:
    """Between two neighbouring heights of corners and crossings, the union's width changes evenly."""
    edges = [[(p, q) for ring in rings for p, q in zip(ring, ring[1:], strict=False)] for rings in polygons]
    every = [e for shape in edges for e in shape]
    heights = {y for e in every for _, y in e}
    for i, ((ax, ay), (bx, by)) in enumerate(every):
        for (cx, cy), (dx, dy) in every[:i]:
            turn = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if turn:
                t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
                if 0 <= t <= 1:
                    heights.add(ay + t * (by - ay))
    total, ys = 0.0, sorted(heights)
    for low, high in zip(ys, ys[1:], strict=False):
        y, spans = (low + high) / 2, []
        for shape in edges:
            xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in shape if (ay > y) != (by > y))
            spans += list(zip(xs[::2], xs[1::2], strict=True))
        reach = float("-inf")
        for a, b in sorted(spans):
            total += max(0.0, b - max(a, reach)) * (high - low)
            reach = max(reach, b)
    return total


def frame(spark, shapes: list[tuple[int, list[Ring]]]):
    rows = [(g, "x", [[(float(x), float(y)) for x, y in ring] for ring in rings]) for g, rings in shapes]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


HOLED = [rect(0, 0, 4, 4), [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]]
CASES = {
    0: ([[rect(0, 0, 2, 2)], [rect(1, 1, 3, 3)]], 7.0, 12.0, 1),  # overlap
    1: ([[rect(0, 0, 4, 4)], [rect(1, 1, 2, 2)]], 16.0, 16.0, 1),  # one inside the other
    2: ([[rect(0, 0, 1, 1)], [rect(1, 0, 2, 1)]], 2.0, 6.0, 1),  # a whole side in common
    3: ([HOLED, [rect(2, 2, 5, 2.5)]], 13.0, 28.0, 2),  # into a hole
    4: ([[rect(0, 0, 1, 1)], [rect(1, 1, 2, 2)]], 2.0, 8.0, 2),  # a corner in common
    5: ([[rect(0, 0, 1, 1)], [rect(0, 0, 1, 1)]], 1.0, 4.0, 1),  # the same twice
    6: ([HOLED, [rect(1, 1, 3, 3)]], 16.0, 16.0, 1),  # fills a hole
    7: ([[rect(0, 0, 3, 1)], [rect(1, 0.5, 2, 1)], [rect(2, 1, 3, 2)]], 4.0, 10.0, 1),  # part of a side in common, inside and outside
    8: ([[rect(0, 0, 3, 1)], [rect(0, 2, 3, 3)], [rect(0, 0, 1, 3)], [rect(2, 0, 3, 3)]], 8.0, 16.0, 2),  # a frame around a hole
}


@pytest.mark.parametrize("step", [0.3, 10.0])
def test_unions_of_rectangles(spark, step):
    df = frame(spark, [(g, rings) for g, (shapes, *_) in CASES.items() for rings in shapes])
    edges = union.union_edges(df, ["g"], step)
    got = {r.g: (r.area, r.length) for r in union.areas(edges, ["g"]).collect()}
    for g, (_, area, length, _) in CASES.items():
        assert got[g] == (pytest.approx(area), pytest.approx(length)), g
    whole = {r.g: r.rings for r in union.dissolved(df, ["g"], step).collect()}
    for g, (shapes, area, _, n) in CASES.items():
        rings = [[(p.x, p.y) for p in ring] for ring in whole[g]]
        assert len(rings) == n and all(r[0] == r[-1] for r in rings), g
        assert brute_area([rings]) == pytest.approx(area) == brute_area(shapes)


def test_unions_of_oblique_shapes(spark):
    rng = random.Random(3)
    shapes = []
    for g in range(6):
        for _ in range(2 + 3 * g):
            x, y, size = rng.uniform(0, 3), rng.uniform(0, 3), rng.choice([0.3, 1, 3])
            corners = [(x + size * rng.uniform(-1, 1), y + size * rng.uniform(-1, 1)) for _ in range(3)]
            shapes.append((g, [[*corners, corners[0]]]))
    shapes.append((5, HOLED))
    df = frame(spark, shapes)
    whole = {r.g: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in union.dissolved(df, ["g"], 0.4).collect()}
    got = {r.g: r.area for r in union.areas(union.union_edges(df, ["g"], 0.4), ["g"]).collect()}
    for g in range(6):
        want = brute_area([rings for h, rings in shapes if h == g])
        assert got[g] == pytest.approx(want, abs=1e-6) and brute_area([whole[g]]) == pytest.approx(want, abs=1e-6)


def test_odd_polygons(spark):
    none = frame(spark, [])
    assert union.dissolved(none, ["g"]).count() == 0
    shapes = frame(spark, [(1, [rect(0, 0, 1, 1)]), (1, [[(5, 5), (5, 5), (5, 5)]]), (1, []), (2, [[(0, 0), (1, 1), (0, 0)]])])
    missing = shapes.union(spark.createDataFrame([(None, "x", [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)]]), (1, "x", None)], SCHEMA))
    assert [(r.g, r.area) for r in union.areas(union.union_edges(missing, ["g"]), ["g"]).collect()] == [(1, 1.0)]
    assert union.areas(union.union_edges(shapes, []), []).first().area == 1.0


def test_cells_that_edges_pass(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.uniform(-3, 3) for _ in range(4))) for i in range(60)] + [(60, 0.0, 0.0, 0.0, 2.0), (61, -1.0, 1.0, 2.5, 1.0), (62, 0.5, 0.5, 0.5, 0.5)]
    edges = spark.createDataFrame(rows, "i int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.i, r["_cx"], r["_cy"]) for r in union.passed_cells(edges, 0.25).collect()}
    seen = {(i, int((x1 + t / 500 * (x2 - x1)) // 0.25), int((y1 + t / 500 * (y2 - y1)) // 0.25)) for i, x1, y1, x2, y2 in rows for t in range(501)}
    assert seen <= got
    assert len(got) <= 1.6 * len(seen)  # a long oblique edge goes along its line, not over its box


def test_no_products(spark):
    plan = union.union_edges(frame(spark, [(0, [rect(0, 0, 1, 1)])]), ["g"]).groupBy().agg(F.sum("x1"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_edges_are_compared_inside_a_shape(spark):
    """Shapes heaped on each other: what is compared is what lies near the union's boundary, with the same union."""
    rng = random.Random(5)
    shapes = []
    for _ in range(150):
        x, y, a, b = rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(1, 1.4), rng.uniform(1, 1.4)
        shapes.append([[(x, y), (x + a, y + 0.1), (x + a - 0.2, y + b), (x - 0.1, y + b - 0.1), (x, y)]])
    df = frame(spark, [(0, s) for s in shapes])
    edges = union.edges_of(df.withColumn("shape", F.xxhash64("rings")), ["g", "shape"]).withColumn("id", F.monotonically_increasing_id())
    covered = union.covered_cells(edges, ["g"], 0.1).cache()
    levels = sorted(r["_k"] for r in covered.select("_k").distinct().collect())
    dealt = union.passed_cells(edges, 0.1)
    open_ = union.uncovered(dealt, covered, levels, ["g"])
    assert open_.count() < dealt.count() / 3
    for r in covered.collect():  # corners of a cell lie inside one and the same shape
        size = 0.1 * 2 ** r["_k"]
        corners = [((r["_cx"] + i) * size, (r["_cy"] + j) * size) for i in (0, 1) for j in (0, 1)]
        assert any(all(sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(s[0], s[0][1:], strict=False)) % 2 for x, y in corners) for s in shapes)
    assert union.areas(union.union_edges(df, ["g"], 0.4), ["g"]).first().area == pytest.approx(brute_area(shapes), abs=1e-6)
