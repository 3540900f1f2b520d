"""Files as tables, and the commands from stage tables to metrics."""

from __future__ import annotations

import datetime as dt
import sqlite3
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

from gridimpact import cli
from gridimpact.ml import models
from gridimpact.operators.assemble import FEATURES
from gridimpact.sources import files, rasters


def polygon(*rings):
    body = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        body += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    return body


def test_geopackage(spark, tmp_path):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    many = struct.pack("<BII", 1, 6, 2) + polygon(square) + polygon([(x + 5, y) for x, y in square])
    db = sqlite3.connect(tmp_path / "units.gpkg")
    db.execute("CREATE TABLE units (fid INTEGER PRIMARY KEY, geom BLOB, GID_0 TEXT, GID_1 TEXT)")
    head = b"GP\0\1" + struct.pack("<i", 4326)
    boxed = b"GP\0\3" + struct.pack("<i4d", 4326, 0, 2, 0, 2)
    db.executemany("INSERT INTO units VALUES (?, ?, ?, ?)", [(1, head + polygon(square), "A", "A.1"), (2, boxed + many, "A", "A.2"), (3, None, "B", None)])
    db.commit()
    db.close()
    out = files.geopackage(spark, str(tmp_path / "units.gpkg"), "units", ["GID_0", "GID_1"]).orderBy("GID_1").collect()
    assert [(r.GID_0, r.GID_1, len(r.rings)) for r in out] == [("B", None, 0), ("A", "A.1", 1), ("A", "A.2", 2)]
    assert [tuple(p) for p in out[1].rings[0]] == square
    df = files.geopackage(spark, str(tmp_path / "units.gpkg"), "units", ["GID_0"])
    assert {r.GID_0: len(r.rings) for r in files.merged_parts(df, ["GID_0"]).collect()} == {"A": 3, "B": 0}


def write_tiff(path, band: np.ndarray, block: tuple[int, int], packed: bool, tiled: bool, differences: bool = False, west: float = 10.0, north: float = 50.0, step: float = 0.25) -> None:
    """A raster of 32-bit numbers; block: columns and rows."""
    w, h = block
    whole = np.full((-(-band.shape[0] // h) * h, -(-band.shape[1] // w) * w), -9999, "<i4")
    whole[: band.shape[0], : band.shape[1]] = band
    bodies = []
    for top in range(0, whole.shape[0], h):
        for left in range(0, whole.shape[1], w):
            part = whole[top : top + h, left : left + w]
            if not tiled:
                part = part[: band.shape[0] - top, : band.shape[1]]
            if differences:
                part = np.diff(part, axis=1, prepend=0).astype("<i4")
            bodies.append(zlib.compress(part.tobytes()) if packed else part.tobytes())
    places = np.cumsum([8, *map(len, bodies)])[:-1].tolist()
    at = 8 + sum(map(len, bodies))
    extra = struct.pack("<3d", step, step, 0) + struct.pack("<6d", 0, 0, 0, west, north, 0) + b"-9999\0\0\0" + struct.pack(f"<{len(bodies)}I", *places) + struct.pack(f"<{len(bodies)}I", *map(len, bodies))
    listed = lambda values, place: (len(values), values[0] if len(values) == 1 else place)
    spots, lengths = listed(places, at + 80), listed(list(map(len, bodies)), at + 80 + 4 * len(bodies))
    shape = [(322, 3, 1, w), (323, 3, 1, h), (324, 4, *spots), (325, 4, *lengths)] if tiled else [(273, 4, *spots), (278, 3, 1, h), (279, 4, *lengths)]
    entries = [(256, 3, 1, band.shape[1]), (257, 3, 1, band.shape[0]), (258, 3, 1, 32), (259, 3, 1, 8 if packed else 1), (277, 3, 1, 1), (317, 3, 1, 2 if differences else 1), (339, 3, 1, 2), *shape]
    entries += [(33550, 12, 3, at), (33922, 12, 6, at + 24), (42113, 2, 6, at + 72)]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + struct.pack("<I", 0)
    path.write_bytes(struct.pack("<2sHI", b"II", 42, at + len(extra)) + b"".join(bodies) + extra + directory)


@pytest.mark.parametrize(("packed", "tiled", "differences"), [(False, False, False), (True, False, True), (True, True, False), (False, True, True)])
def test_rasters_are_read_block_by_block(spark, tmp_path, packed, tiled, differences):
    rng = np.random.default_rng(1)
    band = rng.integers(-50, 50, (37, 53)).astype("<i4")
    band[5, 7] = -9999
    write_tiff(tmp_path / "t.tif", band, (16, 8) if tiled else (53, 4), packed, tiled, differences)
    write_tiff(tmp_path / "u.tif", band[:3, :2], (16, 16) if tiled else (2, 3), packed, tiled, differences, west=100.0)
    (tmp_path / "notes.txt").write_text("no raster")
    df = rasters.geotiff(spark, str(tmp_path), partition_bytes=300)
    assert df.rdd.getNumPartitions() >= 5  # of one file
    got = {(r.tile, r.row, r.col): (r.lon, r.lat, r.value) for r in df.collect()}
    want = {("t.tif", i, j): (10 + (j + 0.5) * 0.25, 50 - (i + 0.5) * 0.25, float(band[i, j])) for i in range(37) for j in range(53) if band[i, j] != -9999}
    want |= {("u.tif", i, j): (100 + (j + 0.5) * 0.25, 50 - (i + 0.5) * 0.25, float(band[i, j])) for i in range(3) for j in range(2)}
    assert got == want
    box = df.where("lon BETWEEN 12 AND 13 AND lat > 46 AND lat < 47.5 AND value > 0")
    assert {(r.tile, r.row, r.col) for r in box.collect()} == {k for k, (x, y, v) in want.items() if 12 <= x <= 13 and 46 < y < 47.5 and v > 0}
    alone = df.where("tile = 'u.tif' AND row <= 1")
    assert {(r.tile, r.row, r.col) for r in alone.collect()} == {k for k in want if k[0] == "u.tif" and k[1] <= 1}


def test_a_box_plans_only_its_blocks(tmp_path):
    band = np.arange(64 * 64, dtype="<i4").reshape(64, 64)
    write_tiff(tmp_path / "t.tif", band, (16, 16), True, True)
    plan = lambda filters: (lambda r: (list(r.pushFilters(filters)), [k for p in r.partitions() for k in p.numbers])[1])(rasters.RasterReader({"path": str(tmp_path / "t.tif"), "partition_bytes": "1"}))
    assert plan([]) == list(range(16))
    assert plan([GreaterThanOrEqual(("lon",), 10 + 16 * 0.25), LessThan(("lon",), 10 + 32 * 0.25)]) == [1, 5, 9, 13]
    assert plan([GreaterThan(("lat",), 50 - 16 * 0.25), EqualTo(("col",), 40)]) == [2]
    assert plan([EqualTo(("tile",), "other.tif")]) == [] and plan([EqualTo(("value",), 3.0)]) == list(range(16))


def test_commands(spark, tmp_path, monkeypatch):
    cells = [(f"{c}_{k:05d}", c, f"{c}.{k % 2}") for c in ("AAA", "BBB") for k in range(4)]
    events = [(f"e{k}", f"s{k}", c) for k, c in enumerate(["AAA", "AAA", "BBB", "BBB", "AAA"])]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / name))
    own = [(i, c, u, e, s) for e, s, ec in events for i, c, u in cells if c == ec]
    save("wind", [(i, c, s, 30.0 + k, 5.0) for k, (i, c, u, e, s) in enumerate(own)], "id string, iso3 string, sid string, wind_speed double, track_distance double")
    save("admin", [(i, c, u, None) for i, c, u in cells], "id string, iso3 string, GID_1 string, GID_2 string")
    hit = lambda u: 500.0 if u.endswith("0") else 0.0
    save("impact", [(i, c, c, u, None, e, s, "ADM1", hit(u), 20.0 if hit(u) else 0.0) for i, c, u, e, s in own], "id string, iso3 string, GID_0 string, GID_1 string, GID_2 string, `DisNo.` string, sid string, level string, `Total Affected` double, perc_affected_pop_grid_region double")
    save("rain", [(own[0][0], own[0][1], own[0][4], 12.0)], "id string, iso3 string, sid string, rainfall_max_24h double")
    save("storms", [(c, s, e) for e, s, c in events], "GID_0 string, sid string, `DisNo.` string")
    save("history", [(own[1][0], own[1][1], own[1][3], 2)], "id string, iso3 string, `DisNo.` string, N_events_5_years int")
    static = [f for f in FEATURES if f not in ("wind_speed", "rainfall_max_24h", "N_events_5_years")]
    save("static", [(i, c, *(float(k + j) for j in range(len(static)))) for k, (i, c, _) in enumerate(cells)], "id string, iso3 string, " + ", ".join(f"{f} double" for f in static))
    save("regions", [("AAA", "Caribbean"), ("BBB", "Melanesia")], "iso3 string, region string")
    save("reports", [(e, 2000 + k, 5, None) for k, (e, _, _) in enumerate(events)], "`DisNo.` string, `Start Year` int, `Start Month` int, `Start Day` int")

    at = lambda name: str(tmp_path / name)
    cli.main(["dataset", at("in"), at("training")])
    table = spark.read.parquet(at("training"))
    assert table.count() == len(own) and table.where("rainfall_max_24h IS NULL OR N_events_5_years IS NULL").count() == 0

    quick = replace(models.STAGE, rounds=2)
    monkeypatch.setitem(models.MODELS, "2-stage-XGBoost", lambda: models.TwoStage(key="GID_1", options=quick))
    for name in ("historical", "2-stage-XGBoost"):
        cli.main(["models", at("training"), at("in/regions"), at("in/reports"), at("predictions"), "--model", name, "--strategy", "geo_constrained"])
    predictions = spark.read.parquet(at("predictions"))
    assert {tuple(r) for r in predictions.groupBy("method").count().collect()} == {("historical", 10), ("2-stage-XGBoost", 10)}
    cli.main(["evaluate", at("predictions"), at("metrics")])
    assert spark.read.parquet(at("metrics")).count() == 4
