"""The strongest wind of each storm at each cell, by bounds instead of all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridimpact.operators import hazard

TRACK = "sid string, x double, y double, peak double, radius_km double"


def test_few_pairs_are_scored(spark, monkeypatch):
    """2,000 centres in reach of each of 300 cells: 600,000 pairs."""
    seen = spark.sparkContext.accumulator(0)

    def counted(km, peak, radius, profile=hazard.holland_wind):
        one = F.udf(lambda wind: (seen.add(1), wind)[1], "double")
        return one(profile(km, peak, radius))

    rng = random.Random(1)
    cells = [(i, rng.uniform(0.0, 0.5), rng.uniform(0.0, 0.5)) for i in range(300)]
    track = [(f"s{i % 2}", rng.uniform(0.0, 0.5), rng.uniform(0.0, 0.5), rng.uniform(30.0, 130.0), rng.uniform(10.0, 60.0)) for i in range(2000)]
    monkeypatch.setattr(hazard, "holland_wind", counted)
    got = {(r.id, r.sid): r.wind_speed for r in hazard.wind_field(spark.createDataFrame(cells, "id int, x double, y double"), spark.createDataFrame(track, TRACK), "sid", 100.0).collect()}
    assert seen.value < 120_000
    for i, x, y in cells[:40]:
        for sid in ("s0", "s1"):
            best = 0.0
            for s, sx, sy, peak, radius in track:
                d = math.hypot(x - sx, y - sy)
                if s == sid and d <= 100.0 / 111.1:
                    v = (radius / max(d * 111.1, 1e-3)) ** 1.5
                    best = max(best, peak * math.sqrt(v * math.exp(1 - v)))
            assert got[i, sid] == pytest.approx(best)


def test_odd_centres(spark):
    """Missing storms, places, peaks and radii, numbers that are none, and centres that come late although they are the only ones in reach."""
    rng, nan = random.Random(2), float("nan")
    cells = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(40)] + [(40, None, 0.5), (41, 2.0, 2.0), (42, 0.0, 0.0)]
    odd = lambda often, *values: rng.choice(values) if rng.random() < often else None
    track = []
    for i in range(300):
        sid = rng.choice(["a", "b", None])
        peak = rng.choice([nan, -50.0, None, 0.0]) if rng.random() < 0.05 else rng.uniform(20, 90)
        radius = rng.choice([nan, -3.0, None, float("inf")]) if rng.random() < 0.05 and i % 2 else rng.uniform(1, 20)
        track.append((sid, odd(0.97, rng.uniform(0.2, 1)), rng.uniform(0.2, 1), peak, radius))
    track += [("late", 0.35 + 0.001 * i, 0.35, 90.0 - i, 5.0) for i in range(40)] + [("late", 0.02, 0.02, 1.0, 5.0)] + [("none", 2.0, 2.1, None, 5.0)]
    c, t = spark.createDataFrame(cells, "id int, x double, y double"), spark.createDataFrame(track, TRACK)
    plain = c.crossJoin(t.withColumnsRenamed({"x": "sx", "y": "sy"})).withColumn("d", F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)).where(F.col("d") <= 40.0 / 111.1)
    want = plain.groupBy("id", "sid").agg(F.max(hazard.holland_wind(F.col("d") * hazard.KM_A_DEGREE, F.col("peak"), F.col("radius_km"))).alias("w")).collect()
    digits = lambda rows: sorted(((r[0], r[1], r[2] if r[2] is None else f"{r[2]:.9g}") for r in rows), key=repr)
    got = digits(hazard.wind_field(c, t, "sid", 40.0).collect())
    assert got == digits(want) and {"late", "none", None, "a"} <= {r[1] for r in got}
