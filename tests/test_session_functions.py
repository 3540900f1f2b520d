"""Functions of a session against the column expressions with the same rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridimpact.functions import scalar, session


def test_functions_follow_the_same_rules(spark):
    session.register(spark, "t_")
    rows = [("AAA", 7, 190.5, 0.0, 2004, 2, 29, "ID12_S10_W005_RP100"), ("B", 123456, -179.9, 15.0, 2003, 2, 29, "ID3_N05_E130_RP10.tif"), (None, None, None, None, None, 1, None, "other"), ("C", 0, 180.0, 15.1, 1999, 12, None, None)]
    df = spark.createDataFrame(rows, "c string, n int, lon double, v double, y int, m int, d int, tile string")
    lat, lon = scalar.tile_corner(F.col("tile"))
    want = df.select(
        scalar.cell_id(F.col("c"), F.col("n")), scalar.cell_index(F.col("lon"), -180.0), scalar.wrap_longitude(F.col("lon")), scalar.share(F.col("v"), F.col("n")),
        scalar.category(F.col("v")), scalar.day_of(F.col("y"), F.col("m"), F.col("d")), lat, lon,
    ).collect()
    df.createOrReplaceTempView("t_rows")
    got = spark.sql(
        "SELECT t_cell_id(c, n), t_cell_index(lon, -180D, 0.1D), t_wrap_longitude(lon), t_share_of(v, n), t_impact_category(v), t_day_of(y, m, d), t_tile_latitude(tile), t_tile_longitude(tile) FROM t_rows"
    ).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    cells = spark.sql("SELECT lon_idx, lat_idx FROM t_box_cells(-0.05D, 0.0D, 0.15D, 0.05D, 0.1D)").collect()
    assert {tuple(r) for r in cells} == {(k, 900) for k in (1799, 1800, 1801)}
