"""Joins by distance and place, over buckets instead of all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.operators.grid import edges_of
from gridimpact.sources.tables import settled


def _bucket(v: str, size: float) -> Column:
    return F.floor(F.col(v) / size).cast("long")


def _near(points: DataFrame, sites: DataFrame, by: list[str], size: float) -> DataFrame:
    """Pairs whose buckets touch, so all pairs up to `size` apart are among them; adds dist."""
    around = F.sequence(F.lit(-1), F.lit(1))
    p = points.withColumn("_bx", F.explode(F.transform(around, lambda d: _bucket("x", size) + d))).withColumn("_by", F.explode(F.transform(around, lambda d: _bucket("y", size) + d)))
    s = sites.withColumns({"_bx": _bucket("sx", size), "_by": _bucket("sy", size)})
    pairs = p.join(s, [*by, "_bx", "_by"]).drop("_bx", "_by")
    return pairs.withColumn("dist", F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)))


def nearest(points: DataFrame, sites: DataFrame, k: int = 1, by: list[str] | None = None) -> DataFrame:
    """points (pid, x, y) with their k nearest sites (site, sx, sy, ...) of the same `by`: dist and rank, ties by site.

    Buckets double in size until k sites lie within one bucket's width, so every answer is exact; the number of
    rounds is the logarithm of the extent, and each takes only the points that are still open.
    """
    by = by or []
    points, sites = points.where("x IS NOT NULL AND y IS NOT NULL"), sites.where("sx IS NOT NULL AND sy IS NOT NULL")
    extent = points.select("x", "y").union(sites.select("sx", "sy")).agg(*(f(c) for c in "xy" for f in (F.min, F.max))).first()
    n = sites.count()
    if extent[0] is None or not n:
        return _near(points, sites, by, 1.0).withColumn("rank", F.lit(1)).where(F.lit(False))
    span = max(extent[1] - extent[0], extent[3] - extent[2], 1e-9)
    size = span / max(1.0, math.sqrt(n / k))
    same = Window.partitionBy(*by, "sx", "sy").orderBy("site")
    sites = sites.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k).drop("_n")  # no more of one place can be among the k nearest
    fullest = lambda s: sites.groupBy(*by, _bucket("sx", s), _bucket("sy", s)).count().agg(F.max("count")).first()[0]
    most = fullest(size)
    while most > 64 * k and (fewer := fullest(size / 4)) < most:  # sites that lie close together need smaller buckets to start with
        size, most = size / 4, fewer
    order = Window.partitionBy("pid").orderBy("dist", "site")
    found, open_ = None, points
    while True:
        last = size >= 2 * span
        ranked = _near(open_, sites, by, size).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if last:
            done = ranked
        else:
            ranked = settled(ranked, f"nearest-{k}")
            full = ranked.where((F.col("rank") == k) & (F.col("dist") <= size)).select("pid")
            done = ranked.join(full, "pid", "left_semi")
            open_ = settled(open_.join(full, "pid", "left_anti"), "open")
        found = done if found is None else found.unionByName(done)
        if last or open_.isEmpty():
            return found
        size *= 2


def inverse_distance_fill(cells: DataFrame, value: str, by: list[str], k: int = 8) -> DataFrame:
    """cells (pid, x, y) with missing values taken from the k nearest known ones, weighted by 1 / (distance + 1e-10).

    Where a `by` has no known value, the value stays missing.
    """
    known = cells.where(F.col(value).isNotNull()).select(*by, F.col("pid").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(value).alias("_v"))
    missing = cells.where(F.col(value).isNull()).select("pid", "x", "y", *by)
    weight = 1 / (F.col("dist") + 1e-10)
    filled = nearest(missing, known, k, by).groupBy("pid").agg((F.sum(weight * F.col("_v")) / F.sum(weight)).alias("_f"))
    return cells.join(filled, "pid", "left").withColumn(value, F.coalesce(value, "_f")).drop("_f")


def nearest_match(points: DataFrame, sites: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each point's nearest site of the same `by`; points without one stay, unmatched."""
    best = nearest(points, sites, 1, by).select("pid", "site", "dist")
    return points.join(best, "pid", "left")


def within(points: DataFrame, sites: DataFrame, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs up to `radius` apart: points inside the buffers of sites."""
    return _near(points, sites, by or [], radius).where(F.col("dist") <= radius)


#: Copies of the sites that come up in a round, so that one crowded bucket is worked on in several tasks.
SALTS = 8


def strongest_within(points: DataFrame, sites: DataFrame, radius: float, of: str, score: Column, bound: Column, first: int = 8) -> DataFrame:
    """pid, `of` and best: for each point (pid, x, y) and each `of` of the sites (of, sx, sy, ...) with one up to `radius` away, the largest score of these pairs.

    score is an expression over a pair and its dist; bound, over a site, is never below its score at any distance, and NaN where the score may be. Sites of a
    bucket come up in the order of their bounds, a few first and four times as many in each round; a point leaves a bucket when it has a score that
    the next bound there does not exceed. So the answer is that of all pairs, and the pairs made are few unless bounds hardly differ.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["_bx", "_by"]
    around = F.sequence(F.lit(-1), F.lit(1))
    in_reach = lambda df: df.withColumn("_bx", F.explode(F.transform(around, lambda d: _bucket("x", radius) + d))).withColumn("_by", F.explode(F.transform(around, lambda d: _bucket("y", radius) + d)))
    order = Window.partitionBy("_of", *at).orderBy(F.desc_nulls_last("_bound"))
    placed = sites.where("sx IS NOT NULL AND sy IS NOT NULL").withColumns({"_bx": _bucket("sx", radius), "_by": _bucket("sy", radius), "_bound": bound, "_of": F.struct(of)})  # a struct: a missing name is a name as well
    placed = settled(placed.withColumn("_rank", F.row_number().over(order)), "bounded")
    salted = lambda df, salt, keys: df.withColumn("_salt", salt).repartition(n, *keys)
    dist = F.sqrt(F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2))
    near = F.col("dist") <= radius
    open_, known, states, seen, upto = in_reach(points.select("pid", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")), [], [], 0, first
    while True:
        keys = [*at, *known, "_salt"]
        some = salted(placed.where(F.col("_rank").between(seen + 1, upto)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))), keys)
        pairs = salted(open_, F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int"), keys).join(some, keys).withColumn("dist", dist)
        before = F.max("_best") if known else F.lit(None)
        state = pairs.groupBy("pid", "x", "y", "_of").agg(F.greatest(F.max(F.when(near, score)), before.cast("double")).alias("_best"), F.max(near).alias("_met"))
        states.append(settled(state, "strongest"))
        coming = settled(placed.where(F.col("_rank") == upto + 1).select("_of", *at, F.col("_bound").alias("_next")), "coming")
        waiting = in_reach(states[-1]).join(coming, [*at, "_of"]) if coming.head(1) else None
        waiting = waiting.where(F.col("_best").isNull() | (F.col("_next") > F.col("_best"))).select("pid", "x", "y", *at, "_of", "_best") if waiting is not None else None
        if waiting is None or waiting.isEmpty():
            break
        open_, known, seen, upto = waiting, ["_of"], upto, upto * 4
    found = states[0]
    for state in states[1:]:
        found = found.unionByName(state)
    return found.groupBy("pid", "_of").agg(F.max("_best").alias("best"), F.max("_met").alias("_met")).where("_met").select("pid", F.col("_of").getField(of).alias(of), "best")


def tiles_near(tiles: DataFrame, cells: DataFrame, country: str, buffer: float = 3.0) -> DataFrame:
    """Tiles (pid, x, y: the place in the name) inside the buffer around a country's cells (site, sx, sy)."""
    return within(tiles, cells.select(country, "site", "sx", "sy"), buffer).select(country, "pid").distinct()


def rounded_lookup(rows: DataFrame, places: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """rows with the columns of a table of unique places, found by coordinates rounded to `digits`; rows without a place keep nulls."""
    rounded = lambda k: F.round(F.col(k), digits)
    named = places.select(*(rounded(k).alias(f"_r_{k}") for k in keys), *(c for c in places.columns if c not in keys))
    return rows.join(named, [rounded(k) == F.col(f"_r_{k}") for k in keys], "left").drop(*(f"_r_{k}" for k in keys))


def buffer_max(points: DataFrame, sites: DataFrame, value: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """Every point with the largest value among the sites within `radius`; missing where there is none."""
    top = within(points, sites, radius, by).groupBy("pid").agg(F.max(value).alias(value))
    return points.join(top, "pid", "left")


def point_in_polygon(points: DataFrame, polygons: DataFrame, step: float = 1.0) -> DataFrame:
    """points (pid, x, y) joined to polygons (unit, rings) that hold them.

    Points meet polygons in the buckets of their boxes, and then only the edges of that polygon at their own height; an odd number of
    crossings is inside. Polygons are never copied to points. A polygon of many edges has lower rows, so that some edges share one however many there are.
    """
    xs = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p["y"])))
    reach = lambda v: F.sequence(F.floor(F.array_min(v) / step).cast("long"), F.floor(F.array_max(v) / step).cast("long"))
    shapes = polygons.withColumn("_shape", F.xxhash64("unit", "rings")).dropDuplicates(["_shape"])
    n_edges = F.aggregate(F.transform("rings", lambda ring: F.size(ring)), F.lit(0), lambda a, n: a + n)
    height = F.least(F.lit(step), (F.array_max(ys) - F.array_min(ys)) * 8 / F.greatest(n_edges, F.lit(1)))
    shapes = shapes.withColumn("_h", F.when(height > 0, height).otherwise(step))
    boxes = shapes.withColumn("_bx", F.explode(reach(xs))).select("_shape", "_h", "_bx", F.explode(reach(ys)).alias("_by"))
    places = points.select("x", "y").distinct().withColumns({"_bx": _bucket("x", step), "_by": _bucket("y", step)}).join(boxes, ["_bx", "_by"]).drop("_bx")
    places = places.withColumn("_by", F.floor(F.col("y") / F.col("_h")).cast("long"))
    edges = edges_of(shapes, ["_shape", "_h"])
    edges = edges.withColumn("_by", F.explode(F.sequence(*(F.floor(f("y1", "y2") / F.col("_h")).cast("long") for f in (F.least, F.greatest))))).drop("_h")
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    inside = places.join(edges, ["_shape", "_by"]).where(cross).groupBy("x", "y", "_shape").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").drop("_n")
    return points.join(inside, ["x", "y"]).join(shapes.drop("rings", "_h"), "_shape").drop("_shape").select(*points.columns, *(c for c in polygons.columns if c != "rings"))


def centroids(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """x and y of each polygon's centre of area, holes taken out (their rings run against the outer ones); of its vertices where it has no area."""
    e = edges_of(polygons, keys)
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    moment = lambda c: F.sum((F.col(f"{c}1") + F.col(f"{c}2")) * cross)
    sums = e.groupBy(*keys).agg(F.sum(cross).alias("_a"), *(moment(c).alias(f"_m{c}") for c in "xy"), *(F.avg(f"{c}1").alias(f"_v{c}") for c in "xy"))
    return sums.select(*keys, *(F.coalesce(F.try_divide(F.col(f"_m{c}"), 3 * F.col("_a")), F.col(f"_v{c}")).alias(c) for c in "xy"))


def match_units(points: DataFrame, polygons: DataFrame, by: str, step: float = 1.0) -> DataFrame:
    """The unit that holds each point, or else the nearest unit's centre in the same country; how tells which."""
    held = point_in_polygon(points, polygons.drop(by), step).groupBy("pid").agg(F.min("unit").alias("unit"))
    centres = centroids(polygons, [by, "unit"]).withColumnsRenamed({"unit": "site", "x": "sx", "y": "sy"})
    rest = nearest_match(points.join(held, "pid", "left_anti"), centres, [by]).select("pid", F.col("site").alias("unit"), F.lit("nearest").alias("how"))
    return points.join(held.withColumn("how", F.lit("inside")).unionByName(rest), "pid", "left")
