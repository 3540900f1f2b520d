"""Winds from pressure and motion, and reports at several levels."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridimpact.operators import hazard, impact


def ring(n: int, x: float, y: float, radius: float) -> list[tuple]:
    return [(k, x + radius * math.cos(2 * math.pi * k / n), y + radius * math.sin(2 * math.pi * k / n)) for k in range(n)]


def field(spark, cells: list[tuple], track: list[tuple]) -> dict:
    start = dt.datetime(2020, 1, 1)
    rows = [("s", start + dt.timedelta(hours=h), x, y, pc, 1010.0, 40.0) for h, x, y, pc in track]
    points = spark.createDataFrame(rows, "sid string, ts timestamp, x double, y double, central_hpa double, outer_hpa double, radius_km double")
    return {r.id: r.wind_speed for r in hazard.gradient_wind_field(spark.createDataFrame(cells, "id int, x double, y double"), points, "sid", "ts").collect()}


def test_a_storm_that_stands_still_has_the_same_wind_all_around(spark):
    winds = field(spark, ring(12, 0.0, 15.0, 0.5), [(0, 0.0, 15.0, 950.0)])
    assert len(winds) == 12 and max(winds.values()) == pytest.approx(min(winds.values())) and 30 < winds[0] < 70
    far, near = field(spark, [(0, 2.0, 15.0), (1, 0.36, 15.0), (2, 0.01, 15.0)], [(0, 0.0, 15.0, 950.0)]), winds[0]
    assert far[1] > near > far[0] > 0 and far[1] > far[2]  # strongest at the radius of maximum wind
    assert field(spark, [(0, 0.5, 15.0)], [(0, 0.0, 15.0, 1010.0)])[0] == pytest.approx(0.0, abs=1e-6)  # no deficit, no wind


@pytest.mark.parametrize("north", [True, False])
def test_motion_makes_one_side_stronger(spark, north):
    y = 15.0 if north else -15.0
    winds = field(spark, [(0, 0.0, y + 0.5), (1, 0.0, y - 0.5)], [(0, 0.0, y, 950.0)])
    moving = field(spark, [(0, 0.0, y + 0.5), (1, 0.0, y - 0.5)], [(0, 0.0, y, 950.0), (6, -20.0, y, 950.0)])  # to the west
    assert winds[0] == pytest.approx(winds[1])
    right, left = (0, 1) if north else (1, 0)  # the pole's side of a storm that goes west
    assert moving[right] > moving[left] + 10


def test_published_values(spark):
    """The profile by hand: at the radius of maximum wind, a deficit of 60 hPa at 15 degrees, at 5 m/s."""
    power = 0.6 * (1 - 60 / 215)
    b = -4.4e-5 * 3600 + 0.01 * 60 - 0.014 * 15 + 0.15 * 5**power + 1
    f = 40_000 * 7.292e-5 * math.sin(math.radians(15))
    shape = hazard.shape_parameter(F.lit(60.0), F.lit(-15.0), F.lit(5.0))
    row = spark.range(1).select(shape.alias("b"), hazard.gradient_wind(F.lit(40.0), F.lit(40.0), F.lit(60.0), F.lit(15.0), shape).alias("v")).first()
    assert row.b == pytest.approx(b) and row.v == pytest.approx(math.sqrt(b / 1.15 * 6000 * math.exp(-1) + f * f) - f)


LEVELS = ["country", "adm1", "adm2", "cell"]


def spread(spark, cells: list[tuple], reports: list[tuple]) -> dict:
    c = spark.createDataFrame(cells, "country string, adm1 string, adm2 string, cell int, w double")
    r = spark.createDataFrame(reports, "event string, country string, adm1 string, adm2 string, amount double")
    out = impact.reconciled(c, r, LEVELS, "w").collect()
    assert len({(x.event, x.cell) for x in out}) == len(out)
    return {(x.event, x.cell): x.amount for x in out}


def test_lower_levels_add_up_to_what_is_reported(spark):
    cells = [("A", "A1", "A11", 1, 1.0), ("A", "A1", "A11", 2, 3.0), ("A", "A1", "A12", 3, 4.0), ("A", "A2", "A21", 4, 8.0), ("A", "A3", "A31", 5, 0.0), ("B", "B1", "B11", 6, 2.0)]
    reports = [
        ("whole", "A", None, None, 160.0),  # by weight
        ("rest", "A", None, None, 100.0), ("rest", "A", "A1", None, 40.0), ("rest", "A", "A1", "A12", 30.0),  # A1 as reported, A12 inside it, the rest to A2
        ("more", "A", None, None, 50.0), ("more", "A", "A1", None, 60.0), ("more", "A", "A2", None, 40.0),  # too much below: scaled
        ("below", "A", "A1", "A11", 8.0), ("below", "A", "A1", "A11", 4.0), ("below", "A", "A2", None, 5.0),  # nothing about the country: what is below
        ("none", "B", None, None, None),
    ]
    got = spread(spark, cells, reports)
    assert [got["whole", k] for k in range(1, 6)] == pytest.approx([10, 30, 40, 80, 0])
    assert [got["rest", k] for k in range(1, 6)] == pytest.approx([2.5, 7.5, 30, 60, 0])
    assert [got["more", k] for k in range(1, 6)] == pytest.approx([3.75, 11.25, 15, 20, 0])
    assert [got["below", k] for k in range(1, 6)] == pytest.approx([3, 9, 0, 5, 0])
    assert not any(e == "none" or (e, k) == ("whole", 6) for e, k in got)


def test_totals_of_all_levels(spark):
    rng = random.Random(1)
    rows = [(rng.choice("AB"), rng.choice("xyz"), rng.choice([None, "p"]), float(rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame(rows, "country string, adm1 string, adm2 string, v double")
    want: dict = defaultdict(float)
    for c, a, b, v in rows:
        for key in ((1, c, None, None), (2, c, a, None), (3, c, a, b)):
            want[key] += v
    got = {(r.depth, r.country, r.adm1, r.adm2): r.total for r in impact.totals_by_level(df, ["country", "adm1", "adm2"], "v").collect()}
    assert got == want
