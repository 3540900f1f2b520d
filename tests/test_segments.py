"""Nearest segments against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridimpact.operators import hazard, segments

SEGMENTS = "g int, x1 double, y1 double, x2 double, y2 double"


def distance(px: float, py: float, s: tuple) -> float:
    _, a, b, c, e = s
    dx, dy = c - a, e - b
    size = dx * dx + dy * dy
    u = max(0.0, min(1.0, ((px - a) * dx + (py - b) * dy) / size)) if size else 0.0
    return ((px - a - u * dx) ** 2 + (py - b - u * dy) ** 2) ** 0.5


def lines(rng: random.Random, n: int, lengths: list[float]) -> list[tuple]:
    out = []
    for k in range(n):
        x, y, size = rng.gauss(0, 1) * rng.choice([0.001, 5]), rng.gauss(3, 1), rng.choice(lengths)
        out.append((k % 3, x, y, x + rng.uniform(-size, size), y + rng.uniform(-size, size)))
    return out


@pytest.mark.parametrize(("n", "broadcast"), [(4, 50_000), (700, 50_000), (700, 1)])
def test_nearest_segments(spark, monkeypatch, n, broadcast):
    monkeypatch.setattr(segments, "BROADCAST_NODES", broadcast)
    rng = random.Random(n)
    segs = lines(rng, n, [0, 0.01, 0.1, 3]) + [(0, 1.0, 1.0, 1.0, 1.0)] * 40
    points = [(i % 4, rng.uniform(-6, 6), rng.uniform(-2, 8)) for i in range(150)] + [(0, 1.0, 1.0), (0, 1.0, 1.0), (1, None, 2.0)]
    found = segments.nearest_segment(spark.createDataFrame(points, "g int, x double, y double"), spark.createDataFrame([*segs, (1, None, 0.0, 0.0, 0.0)], SEGMENTS), ["g"])
    rows = found.collect()
    want = {p: min(distance(p[1], p[2], s) for s in segs if s[0] == p[0]) for p in points if p[1] is not None and p[0] < min(3, n)}
    assert len(rows) == len(want) and {(r.g, r.x, r.y): r.dist for r in rows} == pytest.approx(want)


def test_few_segments_are_compared_wherever_they_lie(spark):
    """Short segments, nearly all of them in one corner: a point meets a few leaves, not the corner."""
    rng = random.Random(2)
    corner = [(0, x, y, x + 1e-6, y) for x, y in ((rng.random() / 1000, rng.random() / 1000) for _ in range(6000))]
    wide = [(0, x, y, x + 0.01, y) for x, y in ((rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(300))]
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(60)] + [(rng.random() / 1000, rng.random() / 1000) for _ in range(60)]
    df = spark.createDataFrame(points, "x double, y double")
    found = segments.nearest_segment(df, spark.createDataFrame(corner + wide, SEGMENTS).drop("g"))
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.agg(F.max("compared")).first()[0] <= 30 * segments.LEAF
    rows = {(r.x, r.y): r.dist for r in found.collect()}
    assert rows == pytest.approx({p: min(distance(*p, s) for s in corner + wide) for p in points})


def test_odd_segments(spark):
    none = spark.createDataFrame([], SEGMENTS)
    points = spark.createDataFrame([(0, 1.0, 2.0)], "g int, x double, y double")
    assert segments.nearest_segment(points, none, ["g"]).count() == 0
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0)], SEGMENTS)
    assert [tuple(r) for r in segments.nearest_segment(points, one, ["g"]).collect()] == [(1.0, 2.0, 0, pytest.approx(5**0.5), 1)]


def test_cells_of_storms_without_a_line_or_a_place(spark):
    cells = spark.createDataFrame([("a", 0.0, 1.0, "s"), ("b", None, 1.0, "s"), ("c", 0.0, 0.0, "t"), ("d", 0.0, 0.0, "p")], "id string, x double, y double, sid string")
    track = spark.createDataFrame([("s", 1, 0.0, 0.0), ("s", 2, 3.0, 0.0), ("p", 1, 3.0, 4.0)], "sid string, n int, x double, y double")
    out = {r.id: r.track_distance for r in hazard.track_distance(cells, track, "sid", "n").collect()}
    assert out == {"a": pytest.approx(111.1), "b": None, "d": pytest.approx(555.5)}
