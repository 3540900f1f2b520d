"""The grid of cells, and which cells a polygon or a line touches.

A polygon is array<array<struct<x,y>>>: closed rings, holes among them, by the even-odd rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridimpact.functions.scalar import cell_id, cell_index


def global_grid(spark: SparkSession, step: float = 0.1) -> DataFrame:
    """lon_idx, lat_idx, Longitude, Latitude (of the centre) of all cells, by longitude first."""
    n_lon, n_lat = round(360 / step), round(180 / step)
    n = spark.range(n_lon * n_lat)
    cells = n.select(F.floor(F.col("id") / n_lat).cast("int").alias("lon_idx"), (F.col("id") % n_lat).cast("int").alias("lat_idx"))
    return with_centres(cells, step)


def with_centres(cells: DataFrame, step: float = 0.1) -> DataFrame:
    """Centres from the indexes, divided last so that no rounding error adds up."""
    per = round(1 / step)
    centre = lambda i, start: F.round((F.col(i) + 0.5) / per + start, 9)
    return cells.withColumns({"Longitude": centre("lon_idx", -180.0), "Latitude": centre("lat_idx", -90.0)})


def with_ids(cells: DataFrame, country: str = "iso3") -> DataFrame:
    """A number for each cell of a country in the order of its indexes, and the identifier made of both."""
    order = Window.partitionBy(country).orderBy("lon_idx", "lat_idx")
    numbered = cells.withColumn("number", (F.row_number().over(order) - 1).cast("int"))
    return numbered.withColumn("id", cell_id(F.col(country), F.col("number")))


def _edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, i + 1).alias("q")))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Whether a ray from the point crosses the rings an odd number of times."""

    def crosses(e: Column) -> Column:
        spans = (e["p"]["y"] > y) != (e["q"]["y"] > y)
        return spans & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])

    count = lambda ring: F.size(F.filter(_edges(ring), crosses))
    return F.aggregate(F.transform(rings, count), F.lit(0), lambda a, n: a + n) % 2 == 1


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, low: Column, right: Column, high: Column) -> tuple[Column, Column]:
    """The part of a segment inside a box, as its start and end in 0..1; nothing is inside where start > end."""
    start, end = F.lit(0.0), F.lit(1.0)
    for a, d, lo, hi in ((x1, x2 - x1, left, right), (y1, y2 - y1, low, high)):
        t1, t2 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        outside = (d == 0) & ((a < lo) | (a > hi))
        start = F.when(outside, 2.0).otherwise(F.greatest(start, F.coalesce(F.least(t1, t2), F.lit(0.0))))
        end = F.least(end, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
    return start, end


def _box(step: float) -> tuple[Column, Column, Column, Column]:
    left, low = F.col("lon_idx") * step - 180.0, F.col("lat_idx") * step - 90.0
    return left, low, left + step, low + step


def edges_of(polygons: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """keys and x1, y1, x2, y2 of every edge."""
    each = polygons.select(*keys, F.explode(rings).alias("_ring")).where(F.size("_ring") > 1).select(*keys, F.explode(_edges(F.col("_ring"))).alias("_e"))
    return each.select(*keys, F.col("_e.p.x").alias("x1"), F.col("_e.p.y").alias("y1"), F.col("_e.q.x").alias("x2"), F.col("_e.q.y").alias("y2"))


def _reach(a: str, b: str, start: float, step: float, around: int = 0) -> Column:
    return F.sequence(F.least(cell_index(F.col(a), start, step), cell_index(F.col(b), start, step)) - around, F.greatest(cell_index(F.col(a), start, step), cell_index(F.col(b), start, step)) + around)


def land_cells(polygons: DataFrame, country: str = "iso3", rings: str = "rings", step: float = 0.1) -> DataFrame:
    """Cells that a country's polygons touch, once for each country; boxes are not clipped.

    Every edge goes to the cells it crosses, which are the border; inside, the edges that cross the middle of a row of cells pair up along
    the row. The work is edges plus cells, never edges times cells.
    """
    shapes = polygons.select(country, F.xxhash64(rings).alias("_shape"), rings).dropDuplicates([country, "_shape"])
    edges = edges_of(shapes, [country, "_shape"], rings)
    border = edges.withColumn("lat_idx", F.explode(_reach("y1", "y2", -90.0, step, 1)))
    slope = F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(0.0))
    held = lambda v: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), v))
    at = lambda v, end: F.when(F.col("y1") == F.col("y2"), F.col(end)).otherwise(F.col("x1") + (held(v) - F.col("y1")) * slope)
    low = F.col("lat_idx") * step - 90.0
    border = border.withColumns({"_from": at(low, "x1"), "_till": at(low + step, "x2")})  # where the edge is while it is in the row
    border = border.withColumn("lon_idx", F.explode(_reach("_from", "_till", -180.0, step, 1)))
    start, end = clipped(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *_box(step))
    border = border.where(start <= end).select(country, "lon_idx", "lat_idx")

    rows = edges.withColumn("lat_idx", F.explode(_reach("y1", "y2", -90.0, step, 1))).withColumn("_y", (F.col("lat_idx") + 0.5) / round(1 / step) - 90.0)
    rows = rows.where((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y")))
    rows = rows.withColumn("_x", (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    row = Window.partitionBy(country, "_shape", "lat_idx").orderBy("_x")
    spans = rows.select(country, "lat_idx", F.row_number().over(row).alias("_n"), "_x", F.lead("_x").over(row).alias("_to")).where("_n % 2 = 1")
    inside = spans.withColumn("lon_idx", F.explode(_reach("_x", "_to", -180.0, step, 1))).withColumn("_c", (F.col("lon_idx") + 0.5) / round(1 / step) - 180.0)
    inside = inside.where((F.col("_c") >= F.col("_x")) & (F.col("_c") < F.col("_to"))).select(country, "lon_idx", "lat_idx")
    return border.union(inside).distinct()


def line_length_by_cell(segments: DataFrame, keys: list[str], step: float = 0.1, metre_a_degree: float = 111_195.0) -> DataFrame:
    """Metres of segments (x1, y1, x2, y2) inside each cell: the length of a country's boundary, land borders too."""
    reach = lambda a, b, start: F.sequence(F.least(cell_index(F.col(a), start, step), cell_index(F.col(b), start, step)), F.greatest(cell_index(F.col(a), start, step), cell_index(F.col(b), start, step)))
    cells = segments.withColumn("lon_idx", F.explode(reach("x1", "x2", -180.0))).withColumn("lat_idx", F.explode(reach("y1", "y2", -90.0)))
    start, end = clipped(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), *_box(step))
    middle = F.radians((F.col("y1") + F.col("y2")) / 2)
    whole = F.sqrt(F.pow((F.col("x2") - F.col("x1")) * F.cos(middle), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) * metre_a_degree
    inside = cells.withColumn("m", whole * F.greatest(end - start, F.lit(0.0))).where("m > 0")
    return inside.groupBy(*keys, "lon_idx", "lat_idx").agg(F.sum("m").alias("coast_length_meters")).withColumn("with_coast", F.lit(1))
