"""Storm tracks, wind, rain and landfall."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.operators.segments import nearest_segment

#: Fixed value: kilometres that a degree counts for.
KM_A_DEGREE = 111.1


def densified(track: DataFrame, keys: list[str], order: str, values: list[str], between: int = 2) -> DataFrame:
    """`between` points on a straight line inside each gap; step counts from 0 for each track, the last point occurs once."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = track.select(*keys, *(F.col(v).cast("double").alias(v) for v in values), (F.row_number().over(w) - 1).alias("_n"), *(F.lead(F.col(v).cast("double")).over(w).alias(f"_{v}") for v in values), F.lead(F.lit(1)).over(w).alias("_more"))
    part = F.explode(F.when(F.col("_more").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(between))))
    rows = rows.withColumn("_k", part)
    at = lambda v: F.when(F.col("_more").isNull(), F.col(v)).otherwise(F.col(v) + (F.col(f"_{v}") - F.col(v)) * F.col("_k") / (between + 1))
    return rows.select(*keys, ((between + 1) * F.col("_n") + F.col("_k")).cast("int").alias("step"), *(at(v).alias(v) for v in values))


def landfall(points: DataFrame, keys: list[str], on_land: Column, time: str, distance: str | None = None) -> DataFrame:
    """First and last time of each track and its landfall: the first point on land, or else the one nearest to land."""
    first = F.min(F.when(on_land, F.col(time)))
    near = F.min_by(time, F.struct(distance, time)) if distance else F.lit(None).cast("timestamp")
    rows = points.groupBy(*keys).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.coalesce(first, near).alias("landfall"))
    return rows.select(*keys, F.to_date("start").alias("startdate"), F.to_date("end").alias("enddate"), F.to_date("landfall").alias("landfalldate"), F.date_format("landfall", "HH:mm:ss").alias("landfall_time"))


def storm_metadata(track: DataFrame, land: DataFrame, events: DataFrame, keys: list[str], time: str, step: float = 1.0) -> DataFrame:
    """Days and landfall of each track from the country's polygons (unit, rings), with the event of each storm where there is one.

    track: keys, x, y, time; events: keys, event. The distance to land is needed only for storms that never touch it, and is that to the nearest of
    the country's edges.
    """
    from gridimpact.operators.grid import edges_of
    from gridimpact.operators.spatial import point_in_polygon

    held = point_in_polygon(track.select("x", "y").distinct(), land, step).select("x", "y").distinct().withColumn("_in", F.lit(True))
    rows = track.join(held, ["x", "y"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    landed = rows.where("_in").select(*keys).distinct()
    offshore = rows.join(landed, keys, "left_anti").select("x", "y").distinct()
    far = nearest_segment(offshore, edges_of(land, [])).select("x", "y", F.col("dist").alias("_far"))
    return landfall(rows.join(far, ["x", "y"], "left"), keys, F.col("_in"), time, "_far").join(events, keys, "left")


def track_distance(cells: DataFrame, track: DataFrame, sid: str, order: str) -> DataFrame:
    """Kilometres from each cell (id, x, y, sid) to the nearest segment of its storm's line (sid, x, y); cells of a storm without a line drop out."""
    w = Window.partitionBy(sid).orderBy(order)
    segments = track.select(sid, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.row_number().over(w).alias("n"))
    segments = segments.where("x2 IS NOT NULL OR n = 1").withColumns({"x2": F.coalesce("x2", "x1"), "y2": F.coalesce("y2", "y1")})
    found = nearest_segment(cells, segments, [sid]).drop("compared")
    known = cells.join(segments.select(sid).distinct(), sid, "left_semi")
    return known.join(found, ["x", "y", sid], "left").groupBy("id", sid).agg((F.min("dist") * KM_A_DEGREE).alias("track_distance"))


def holland_wind(distance_km: Column, peak: Column, radius_km: Column, b: float = 1.5) -> Column:
    """Wind at a distance from the centre: the peak at the radius of maximum wind, falling off on both sides."""
    x = F.pow(radius_km / F.greatest(distance_km, F.lit(1e-3)), F.lit(b))
    return peak * F.sqrt(x * F.exp(1 - x))


def _bounded(bound: Column) -> Column:
    """A bound with room for rounding; NaN for a radius whose profile may be no number."""
    r = F.col("radius_km")
    return F.when((r < 0) | (r > 1e100) | F.isnan(r), float("nan")).otherwise(bound * (1 + 1e-9))


def wind_field(cells: DataFrame, track: DataFrame, sid: str, cutoff_km: float = 300.0) -> DataFrame:
    """The strongest wind of each storm at each cell within `cutoff_km`; cells (id, x, y), track (sid, x, y, peak, radius_km).

    A published radial profile stands in for the wind model; values differ from other models'. No wind is above its centre's peak.
    """
    from gridimpact.operators.spatial import strongest_within

    centres = track.select(sid, F.col("x").alias("sx"), F.col("y").alias("sy"), "peak", "radius_km")
    wind = holland_wind(F.col("dist") * KM_A_DEGREE, F.col("peak"), F.col("radius_km"))
    bound = _bounded(F.greatest("peak", F.lit(0.0)))
    return strongest_within(cells.select(F.col("id").alias("pid"), "x", "y"), centres, cutoff_km / KM_A_DEGREE, sid, wind, bound).select(F.col("pid").alias("id"), sid, F.col("best").alias("wind_speed"))


#: Density of air (kg/m3), the earth's rotation (1/s), and the coefficients and bounds of the published shape parameter of 2008.
AIR, ROTATION = 1.15, 7.292e-5
SHAPE = {"deficit2": -4.4e-5, "deficit": 0.01, "latitude": -0.014, "speed": 0.15, "one": 1.0, "power": 0.6, "power_deficit": 215.0, "least": 1.0, "most": 2.5}


def shape_parameter(deficit_hpa: Column, lat: Column, speed: Column) -> Column:
    """How peaked the profile is: from the pressure deficit, the latitude and the speed of the storm (m/s)."""
    c = SHAPE
    power = c["power"] * (1 - deficit_hpa / c["power_deficit"])
    b = c["deficit2"] * deficit_hpa * deficit_hpa + c["deficit"] * deficit_hpa + c["latitude"] * F.abs(lat) + c["speed"] * F.pow(speed, power) + c["one"]
    return F.greatest(F.lit(c["least"]), F.least(F.lit(c["most"]), b))


def gradient_wind(distance_km: Column, radius_km: Column, deficit_hpa: Column, lat: Column, b: Column) -> Column:
    """Wind (m/s) in balance with the pressure field and the earth's rotation at a distance from the centre; 0 without a deficit."""
    r = F.greatest(distance_km, F.lit(1e-3)) * 1000
    turn = r * ROTATION * F.abs(F.sin(F.radians(lat)))  # r f / 2
    x = F.pow(radius_km * 1000 / r, b)
    return F.sqrt(b / AIR * x * (F.greatest(deficit_hpa, F.lit(0.0)) * 100) * F.exp(-x) + turn * turn) - turn


def gradient_wind_field(cells: DataFrame, track: DataFrame, sid: str, time: str, cutoff_km: float = 300.0) -> DataFrame:
    """The strongest wind (m/s) of each storm at each cell within `cutoff_km`, from pressure and motion.

    cells: id, x, y; track: sid, time, x, y, central_hpa, outer_hpa, radius_km. The wind goes round the centre (against the clock north of the equator);
    the storm's own motion, from its displacement to the next point (the last: from the one before), is added as a vector, in full up to the radius of
    maximum wind and less beyond as the distance grows. A storm that stands still has the same wind all around. No wind is above that of the pressure at
    the radius of maximum wind without the earth's rotation, plus the storm's speed.
    """
    from gridimpact.operators.spatial import strongest_within

    w = Window.partitionBy(sid).orderBy(time)
    step = lambda c: F.coalesce(F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w), F.lit(0.0))
    seconds = F.unix_timestamp(time)
    passed = F.coalesce(F.lead(seconds).over(w) - seconds, seconds - F.lag(seconds).over(w))
    metres = KM_A_DEGREE * 1000
    points = track.select(
        sid, F.col("x").alias("sx"), F.col("y").alias("sy"), "radius_km", (F.col("outer_hpa") - F.col("central_hpa")).alias("deficit"),
        F.coalesce(F.try_divide(step("x") * F.cos(F.radians("y")) * metres, passed), F.lit(0.0)).alias("u"), F.coalesce(F.try_divide(step("y") * metres, passed), F.lit(0.0)).alias("v"),
    )
    km = F.col("dist") * KM_A_DEGREE
    deficit, speed = F.greatest("deficit", F.lit(0.0)), F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    b = shape_parameter(deficit, F.col("sy"), speed)
    round_ = gradient_wind(km, F.col("radius_km"), F.col("deficit"), F.col("sy"), b)
    east, north = (F.coalesce(F.try_divide(F.col(c) - F.col(f"s{c}"), F.col("dist")), F.lit(0.0)) for c in "xy")
    sense = F.when(F.col("sy") < 0, -1.0).otherwise(1.0)
    part = F.least(F.lit(1.0), F.col("radius_km") / F.greatest(km, F.lit(1e-3)))
    wind = F.sqrt(F.pow(-sense * round_ * north + part * F.col("u"), 2) + F.pow(sense * round_ * east + part * F.col("v"), 2))
    bound = _bounded(F.sqrt(b / AIR * deficit * 100 * math.exp(-1)) + speed)
    return strongest_within(cells.select(F.col("id").alias("pid"), "x", "y"), points, cutoff_km / KM_A_DEGREE, sid, wind, bound).select(F.col("pid").alias("id"), sid, F.col("best").alias("wind_speed"))


def window_days(day: Column, around: int = 2) -> Column:
    return F.sequence(F.date_sub(day, around), F.date_add(day, around))


def rain_maximum(rain: DataFrame, storms: DataFrame, sid: str, keys: list[str], time: str, value: str, around: int = 2) -> DataFrame:
    """Largest daily sum within `around` days of each storm's landfall; rain and storms meet on the day."""
    days = storms.select(sid, F.explode(window_days(F.col("landfalldate"), around)).alias("day"))
    daily = rain.groupBy(*keys, F.to_date(time).alias("day")).agg(F.sum(value).alias("daily"))
    return daily.join(days, "day").groupBy(*keys, sid).agg(F.max("daily").alias("rainfall_max_24h"))
