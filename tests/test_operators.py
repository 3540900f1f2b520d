"""Hand-made cases of the core operators."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gridimpact.functions import scalar
from gridimpact.ml import events, metrics
from gridimpact.ml.models import attributions_of, leave_one_out, model_of
from gridimpact.operators import assemble, grid, hazard, history, impact, spatial, zonal
from gridimpact.sources import tables


def day(text):
    return dt.date.fromisoformat(text)


def test_prior_events_do_not_count_the_same_day(spark):
    rows = [("A", "2010-01-01"), ("A", "2012-02-29"), ("A", "2012-02-29"), ("A", "2015-01-01"), ("A", "2017-02-28"), ("B", "2020-01-01"), (None, "2020-01-01")]
    df = spark.createDataFrame([(g, day(d), i) for i, (g, d) in enumerate(rows)], "g string, d date, i int")
    out = {r.i: r.n_prior for r in history.prior_events(df, "g", "d").collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 0}


def test_admin_literals(spark):
    texts = ["[{'adm1_code': 12}, {'adm2_code': 3}]", "[{'adm2_code': 3, 'n': None}]", None, "bad", "[]", "[{'adm1_code': 12.0, 'whole': True, 'n': 'so: None'}]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, `Admin Units` string")
    out = [(r.level, r.codes) for r in impact.parsed_reports(df).orderBy("i").collect()]
    assert out == [("ADM1", [12]), ("ADM2", [3]), ("ADM0", []), ("ADM0", []), ("ADM0", []), ("ADM1", [12])]


def test_impact_share(spark):
    cells = spark.createDataFrame([("c1", "A", 10.0), ("c2", "A", 0.0), ("c3", "B", 30.0)], "id string, unit string, population double")
    reports = spark.createDataFrame([("e", "A", 5.0), ("e", "A", 5.0), ("e", "B", 0.0), ("none", "B", 0.0)], "event string, unit string, amount double")
    out = {(r.event, r.id): r.perc_affected_pop_grid_region for r in impact.impact_share(cells, reports, "event", ["unit"], "amount").collect()}
    assert out == {("e", "c1"): 50.0, ("e", "c2"): 0.0, ("e", "c3"): 0.0}


def test_expansion_gives_each_unit_once(spark):
    units = spark.createDataFrame([("X", "A1"), ("X", "A2"), ("X", "B1"), ("Y", "Q")], "country string, unit string")
    ev = spark.createDataFrame([("e", "X"), ("n", "X")], "event string, country string")
    reported = spark.createDataFrame([("e", "A1", 100.0), ("e", "A2", 100.0), ("n", None, 7.0)], "event string, unit string, amount double")
    out = {(r.event, r.unit): r.amount for r in impact.expanded(ev, reported, units, "event", "country", "unit", "amount").collect()}
    assert out == {("e", "A1"): 100.0, ("e", "A2"): 100.0, ("e", "B1"): 0.0, ("n", "A1"): 7.0, ("n", "A2"): 7.0, ("n", "B1"): 7.0}


def test_null_keys_join(spark):
    a = spark.createDataFrame([(1, "g", None)], "id int, g1 string, g2 string")
    b = spark.createDataFrame([("g", None, 9), ("g", "x", 8)], "g1 string, g2 string, v int")
    assert [r.v for r in assemble.null_safe_join(a, b, ["g1", "g2"]).collect()] == [9]
    assert "BroadcastNestedLoopJoin" not in assemble.null_safe_join(a, b, ["g1", "g2"])._jdf.queryExecution().toString()


def test_densified_length_and_values(spark):
    track = spark.createDataFrame([("s", i, 3.0 * i) for i in range(4)] + [("one", 0, 5.0)], "sid string, t int, v double")
    rows = hazard.densified(track, ["sid"], "t", ["v"]).orderBy("sid", "step").collect()
    assert [r.v for r in rows if r.sid == "s"] == pytest.approx(list(range(10)))
    assert [r.v for r in rows if r.sid == "one"] == [5.0]


def test_inverse_distance(spark):
    cells = spark.createDataFrame([(1, "X", 0.0, 0.0, 10.0), (2, "X", 2.0, 0.0, 30.0), (3, "X", 1.0, 0.0, None), (4, "Y", 0.0, 0.0, None)], "pid int, iso3 string, x double, y double, v double")
    out = {r.pid: r.v for r in spatial.inverse_distance_fill(cells, "v", ["iso3"]).collect()}
    assert out[3] == pytest.approx(20) and out[4] is None and out[1] == 10


def test_nearest_is_exact(spark):
    import random

    rng = random.Random(3)
    points = [(i, rng.gauss(0, 5), rng.gauss(0, 1)) for i in range(60)]
    sites = [(i, rng.gauss(0, 1), rng.gauss(0, 9)) for i in range(80)]
    out = spatial.nearest(spark.createDataFrame(points, "pid int, x double, y double"), spark.createDataFrame(sites, "site int, sx double, sy double"), 3).collect()
    for pid, x, y in points:
        want = sorted((math.dist((x, y), s[1:]), s[0]) for s in sites)[:3]
        assert [s for _, s in want] == [r.site for r in sorted((r for r in out if r.pid == pid), key=lambda r: r["rank"])]


def test_class_shares_and_first_pixel(spark):
    px = spark.createDataFrame([("c", k) for k in (21, 22, 30, 11)] + [("none", 128)], "cell string, class int")
    out = {r.cell: (r.urban, r.rural, r.water) for r in zonal.class_shares(px, ["cell"]).collect()}
    assert out == {"c": (0.75, 0.25, 0.0), "none": (None, None, None)}
    raw = spark.createDataFrame([("c", 1.0, 0.0, 9.0), ("c", 2.0, 5.0, 8.0), ("c", 2.0, 4.0, 70.0), ("f", 1.0, 1.0, 29999.0)], "cell string, lat double, lon double, v double")
    assert [(r.cell, r.value) for r in zonal.first_pixel(raw, ["cell"], "v").collect()] == [("c", 7.0)]


def test_identifiers_bins_tiles_dates(spark):
    df = spark.createDataFrame([("PHL", 7), ("PHL", 123456)], "iso3 string, n int")
    assert [r[0] for r in df.select(scalar.cell_id(F.col("iso3"), F.col("n"))).collect()] == ["PHL_00007", "PHL_123456"]
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.1, 15.0, 15.1)], "v double")
    assert [r[0] for r in v.select(scalar.category(F.col("v"))).collect()] == [0, 0, 1, 1, 2]
    t = spark.createDataFrame([("ID12_S10_E120_RP10_depth_reclass.tif",), ("x",)], "n string")
    assert [tuple(r) for r in t.select(*scalar.tile_corner(F.col("n"))).collect()] == [(-10, 120), (None, None)]
    d = spark.createDataFrame([(2001, 2, 30), (2001, 2, None), (None, 1, 1)], "y int, m int, d int")
    assert [r[0] for r in d.select(scalar.day_of(F.col("y"), F.col("m"), F.col("d"))).collect()] == [None, day("2001-02-01"), None]


def test_grid_size_and_polygon_with_hole(spark):
    assert grid.global_grid(spark).count() == 6_480_000
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    poly = spark.createDataFrame([("A", [ring(0.0, 3.0), ring(1.0, 2.0)])], "unit string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "pid int, x double, y double")
    assert [r.pid for r in spatial.point_in_polygon(pts, poly).collect()] == [1]


def test_wind_profile(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 20, 30, 50, 100)], "d double").select(hazard.holland_wind(F.col("d"), F.lit(50.0), F.lit(30.0)).alias("w"))
    w = [r.w for r in df.collect()]
    assert w[2] == pytest.approx(50) and w[0] < w[1] < w[2] > w[3] > w[4]


def test_rain_window(spark):
    rain = spark.createDataFrame([("c", "2020-01-01", 10.0), ("c", "2020-01-01", 20.0), ("c", "2020-01-02", 5.0), ("c", "2020-02-02", 99.0)], "id string, t string, v double")
    storms = spark.createDataFrame([("s", day("2020-01-02"))], "sid string, landfalldate date")
    assert [r.rainfall_max_24h for r in hazard.rain_maximum(rain, storms, "sid", ["id"], "t", "v").collect()] == [30.0]


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)], "y double, p double")
    m = metrics.binary_metrics(rows, "y", "p", thresholds=[0.0, 15.0]).orderBy("threshold").collect()
    assert (m[0].precision, m[0].recall, m[0].fpr) == (0.5, 0.5, 0.5) and m[0].csi == pytest.approx(1 / 3)
    assert (m[1].precision, m[1].recall, m[1].f1, m[1].csi) == (0, 0, 0, 0)


def test_event_filter(spark):
    rows = [("all", "X", "u1", 200.0, "ADM1"), ("all", "X", "u2", 200.0, "ADM1"), ("one", "Y", "u", 200.0, "ADM1"), ("some", "X", "u1", 200.0, "ADM1"), ("some", "X", "u2", 0.0, "ADM1"), ("nat", "X", "u1", 300.0, "ADM0"), ("nat", "X", "u2", 0.0, "ADM0")]
    df = spark.createDataFrame(rows, "e string, c string, u string, a double, l string")
    assert {r.e for r in events.usable_events(df, "e", "c", "u", "a", "l").collect()} == {"one", "some"}


def test_balance_and_folds(spark):
    df = spark.createDataFrame([(i, int(i < 2)) for i in range(102)], "k int, t int")
    out = events.balanced(df, "t", 3, "k")
    assert out.where("t = 1").count() == 2 and out.where("t = 0").count() == 6
    assert out.collect() == events.balanced(df, "t", 3, "k").collect()
    ev = spark.createDataFrame([("a", day("2001-01-01"), "N"), ("b", day("2002-01-01"), "N"), ("c", day("2003-01-01"), None)], "event string, date date, basin string")
    pairs = lambda s: {tuple(r) for r in events.folds(ev, s).collect()}
    assert pairs("walk_forward") == {("b", "a"), ("c", "a"), ("c", "b")}
    assert pairs("geo_constrained") == {("a", "b"), ("b", "a")}
    assert all(a != b for a, b in pairs("global")) and len(pairs("global")) == 6
    with pytest.raises(ValueError):
        events.folds(ev, "other")


def test_roll_up_drops_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "b", 2.0)], "`DisNo.` string, b string, v double")
    assert [r.v for r in events.rolled_up(df, ["DisNo.", "b"], [], ["v"], []).collect()] == [2.0]


def test_default_two_stage_model_finds_its_keys(spark):
    rows = [(f"e{i % 4}", f"s{i % 4}", f"u{i % 5}", float(i), float(max(0, i - 20))) for i in range(60)]
    df = spark.createDataFrame(rows, "`DisNo.` string, sid string, GID_1 string, wind_speed double, perc_affected_pop_grid_region double")
    model = model_of("2-stage-XGBoost")
    assert model.key is None
    model.features, model.options = ["wind_speed"], replace(model.options, rounds=2)  # one set of options for both stages
    out = model.train_and_predict(df, df).collect()
    assert len(out) == 60 and all(r.prediction_perc == 0 for r in out if r.predicted_bin == 0) and any(r.prediction_perc > 0 for r in out)


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(5)
    rows = [(g, rng.choice([rng.gauss(0, 1), 1e9, float(rng.randint(0, 3)), None])) for g in ("a", "b", None) for _ in range(rng.randint(50, 60))] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: statistics.median(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None, "one")}
    assert {r.g: r.median for r in metrics.medians(df, ["g"], "v").collect()} == pytest.approx(want)
    assert [r.median for r in metrics.medians(df, [], "v", most=3).collect()] == pytest.approx([statistics.median(v for _, v in rows if v is not None)])
    assert metrics.medians(df.where("false"), [], "v").count() == 0
    assert [r.v for r in assemble.median_filled(df.where("g = 'none'"), "v").collect()] == [None]


def test_balance_is_by_hash_and_needs_no_single_sort(spark):
    import hashlib

    df = spark.createDataFrame([(i, i % 3, int(i % 50 == 0)) for i in range(2000)], "a int, b int, t int")
    out = {r.a for r in events.balanced(df, "t", 3, ["a", "b"]).where("t = 0").collect()}
    assert out == set(sorted((i for i in range(2000) if i % 50), key=lambda i: hashlib.md5(f"42:{i}:{i % 3}".encode()).hexdigest())[:120])


def test_nearest_with_sites_in_one_place(spark):
    sites = [(i, 0.0, 0.0) for i in range(500)] + [(500 + i, 1e-6 * i, 1e-6) for i in range(500)] + [(2000, 50.0, 50.0)]
    points = [(1, 0.0, 0.0), (2, 49.0, 50.0), (3, 25.0, 25.1)]
    out = spatial.nearest(spark.createDataFrame(points, "pid int, x double, y double"), spark.createDataFrame(sites, "site int, sx double, sy double"), 2).collect()
    for pid, x, y in points:
        want = sorted((math.dist((x, y), s[1:]), s[0]) for s in sites)[:2]
        assert [s for _, s in want] == [r.site for r in sorted((r for r in out if r.pid == pid), key=lambda r: r["rank"])]


def test_points_on_shared_heights_and_repeated_points(spark):
    shape = [[(0.0, 0.0), (2.0, 1.0), (1.0, 3.0), (-1.0, 1.0), (0.0, 0.0)]]
    poly = spark.createDataFrame([("A", shape), ("A", shape)], "unit string, rings array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.5, 1.0), (2, -2.0, 1.0), (3, 1.9, 1.0), (4, None, 1.0)], "pid int, x double, y double")
    assert sorted(r.pid for r in spatial.point_in_polygon(pts, poly, 0.5).collect()) == [1, 1, 3]


def test_models_and_leave_one_out(spark):
    rows = spark.createDataFrame([(f"e{i % 3}", f"c{i % 2}", day(f"200{i % 3}-01-01"), "N", float(i)) for i in range(12)], "`DisNo.` string, iso3 string, date date, cyclone_basin string, perc_affected_pop_grid_region double")
    out = leave_one_out(rows, model_of("historical"), "walk_forward", method="historical")
    assert {r.event for r in out.collect()} == {"e1", "e2"} and out.count() == 8
    with pytest.raises(ValueError):
        model_of("nothing")


def test_attributions_add_up():
    import numpy as np

    nodes = [(0, 0.5, 1, 2, 0.0, 10.0, True), (-1, 0.0, -1, -1, 1.0, 6.0, False), (1, 0.5, 3, 4, 0.0, 4.0, False), (-1, 0.0, -1, -1, 2.0, 1.0, False), (-1, 0.0, -1, -1, 5.0, 3.0, False)]
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])
    phi, base = attributions_of([(2.0, nodes)], x)
    assert base == pytest.approx(2 * (0.6 * 1 + 0.4 * (0.25 * 2 + 0.75 * 5)))
    assert (phi.sum(1) + base).tolist() == pytest.approx([2.0, 4.0, 10.0])


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("A", float("nan"), ""), ("B", 1.0, "x")], "iso3 string, v double, s string")
    assert [tuple(r) for r in tables.with_nulls(df).orderBy("iso3").collect()] == [("A", None, None), ("B", 1.0, "x")]
    path = str(tmp_path / "stage")
    tables.write_stage(df, path, ["iso3"])
    tables.write_stage(spark.createDataFrame([("B", 2.0, "y")], df.schema), path, ["iso3"])
    assert {(r.iso3, r.s) for r in spark.read.parquet(path).collect()} == {("A", ""), ("B", "y")}  # A's partition stays, B's is replaced
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    assert tables.csv(spark, str(tmp_path / "csv"), "iso3 string, v double, s string").count() == 2
    tables.write_csv(df, str(tmp_path / "out"))
    tables.write_csv(df, str(tmp_path / "out"), append=True)
    assert tables.csv(spark, str(tmp_path / "out"), "iso3 string, v double, s string").groupBy("iso3").count().where("count = 2").count() == 2
    with pytest.raises(ValueError):
        tables.require(df, ["region"])
    assert [r.iso3 for r in tables.country_list(df, "iso3", ["FJI"]).collect()] == ["FJI"]


def test_stream_equals_batch(spark, tmp_path):
    from gridimpact.streaming.daily import daily_sums

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = daily_sums(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), ["user_id"], "ts", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.day): round(r.daily, 6) for r in spark.sql("SELECT * FROM daily").collect()}
    assert got == {(r.user_id, r.day): round(r.daily, 6) for r in daily_sums(source, ["user_id"], "ts", "value").collect()}


def test_first_of_each_key_takes_the_first_of_equal_rows_in_the_table(spark, tmp_path):
    """Rows with equal order come out as in DuckDB, which keeps the one read first and passes over missing values."""
    import duckdb

    from gridimpact.plans.queries import ORACLES, QUERIES

    c = duckdb.connect(config={"threads": 1})
    c.sql(f"COPY (SELECT i % 7 AS l_partkey, CASE WHEN i % 7 < 6 THEN (i * 31) % 5 END AS l_orderkey, (i % 2)::INT AS l_linenumber, CASE WHEN i % 3 > 0 THEN (i * 7919 % 1009)::DOUBLE END AS l_quantity FROM range(20000) t(i)) TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    c.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    got = QUERIES["first_of_each_key"](spark, str(tmp_path)).select("k", "l_orderkey", "q").collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(ORACLES["first_of_each_key"]).fetchall())


def test_grid_ids_numbers_the_whole_grid(spark):
    """All 6,480,000 cells are numbered, not only those with customers."""
    from gridimpact.plans.queries import QUERIES

    rows = QUERIES["grid_ids"](spark, "/root/testdata/sf0.001").cache()
    once = rows.select("iso3", "lat_idx", "n", "low", "high").distinct()
    assert once.agg(F.sum("n")).first()[0] >= 6_480_000
    assert once.groupBy("iso3").agg((F.max("high") + 1).alias("most"), F.sum("n").alias("n")).where("most <> n").isEmpty()
    assert rows.where("id IS NOT NULL AND NOT number BETWEEN low AND high").isEmpty() and rows.where("id IS NOT NULL").count() == 150
