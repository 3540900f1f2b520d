"""From raster pixels to values of cells. Pixels carry their cell's key, computed, so no spatial join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.functions.scalar import NO_CLASS, RURAL, URBAN, WATER


def population_sum(pixels: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum of the positive pixels; 0 where there are none."""
    return pixels.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("population"))


def tiled_mean(pixels: DataFrame, keys: list[str], tile: str, value: str, name: str, missing: tuple[float, ...] = (-32768.0, -9999.0)) -> DataFrame:
    """Mean for each cell and tile, then the unweighted mean over tiles."""
    known = F.when(~F.col(value).isin(*missing), F.col(value))
    by_tile = pixels.groupBy(*keys, tile).agg(F.avg(known).alias("m"))
    return by_tile.groupBy(*keys).agg(F.avg("m").alias(name))


def touched_sum(pixels: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Sum over all touched pixels; missing where no pixel has a value."""
    return pixels.groupBy(*keys).agg(F.sum(value).alias(name))


def tiles_max(pixels: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Maximum over all tiles, missing values skipped."""
    return pixels.groupBy(*keys).agg(F.max(value).alias(name))


def class_shares(pixels: DataFrame, keys: list[str], of: str = "class") -> DataFrame:
    """Shares of urban, rural and water pixels among those of the three groups; missing where there are none."""
    kinds = {"urban": URBAN, "rural": RURAL, "water": WATER}
    valid = F.nullif(F.col(of), F.lit(NO_CLASS))
    counts = pixels.groupBy(*keys).agg(*(F.count_if(valid.isin(*c)).alias(k) for k, c in kinds.items()))
    total = F.col("urban") + F.col("rural") + F.col("water")
    return counts.select(*keys, *(F.try_divide(F.col(k).cast("double"), total).alias(k) for k in kinds))


def clipped(pixels: DataFrame, low: tuple[float, float], high: tuple[float, float], value: str, missing: float = NO_CLASS) -> DataFrame:
    """Pixels (lon, lat) inside a box, edges included, with the missing value as null."""
    inside = F.col("lon").between(low[0], high[0]) & F.col("lat").between(low[1], high[1])
    return pixels.where(inside).withColumn(value, F.nullif(F.col(value), F.lit(missing)))


def first_pixel(pixels: DataFrame, keys: list[str], value: str, fill: float = 29_999.0, scale: float = 10.0) -> DataFrame:
    """The value of each cell's north-western pixel (lat, lon), scaled; cells where that is a fill value drop out."""
    first = pixels.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("lat"), F.col("lon"))).alias("v"))
    return first.where(F.col("v") < fill).select(*keys, (F.col("v") / scale).alias("value"))


def touched_cells(pixels: DataFrame, half: float, step: float = 0.1) -> DataFrame:
    """Pixels (lon, lat) repeated for every cell that their footprint overlaps."""
    reach = lambda c, start: F.sequence(F.floor(F.round((F.col(c) - half - start) / step, 9)).cast("int"), (F.ceil(F.round((F.col(c) + half - start) / step, 9)) - 1).cast("int"))
    return pixels.withColumn("lon_idx", F.explode(reach("lon", -180.0))).withColumn("lat_idx", F.explode(reach("lat", -90.0)))


def terrain(pixels: DataFrame, tile: list[str], width: Column | float, height: Column | float, value: str = "value") -> DataFrame:
    """Slope in degrees (third-order finite differences) and mean absolute difference to the eight neighbours, from a raster (row, col).

    Each pixel is sent to its neighbours and gathered by place, one shuffle; edges use the neighbours there are, the pixel itself standing in for missing ones.
    """
    offsets = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    sent = pixels.select(*tile, "row", "col", value, F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in offsets))).alias("o"))
    sent = sent.select(*tile, (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), value, -F.col("o.dr").alias("dr"), -F.col("o.dc").alias("dc")).toDF(*tile, "row", "col", value, "dr", "dc")
    pick = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col(value)))
    around = sent.groupBy(*tile, "row", "col").agg(*(pick(r, c).alias(f"v{r + 1}{c + 1}") for r, c in offsets)).where("v11 IS NOT NULL")
    at = lambda r, c: F.coalesce(F.col(f"v{r}{c}"), F.col("v11"))
    across = (at(0, 2) + 2 * at(1, 2) + at(2, 2)) - (at(0, 0) + 2 * at(1, 0) + at(2, 0))
    down = (at(2, 0) + 2 * at(2, 1) + at(2, 2)) - (at(0, 0) + 2 * at(0, 1) + at(0, 2))
    slope = F.degrees(F.atan(F.sqrt(F.pow(across / (8 * F.lit(width)), 2) + F.pow(down / (8 * F.lit(height)), 2))))
    others = [at(r + 1, c + 1) for r, c in offsets if (r, c) != (0, 0)]
    rugged = sum((F.abs(o - F.col("v11")) for o in others[1:]), F.abs(others[0] - F.col("v11"))) / 8
    return around.select(*tile, "row", "col", slope.alias("slope"), rugged.alias("ruggedness"))


#: Countries on both sides of the antimeridian.
SPLIT_COUNTRIES = ("USA", "FJI", "NZL", "KIR", "RUS")


def country_tiles(cells: DataFrame, country: str = "iso3", size: float = 5.0) -> DataFrame:
    """Tiles of `size` degrees that a country's cells (Longitude, Latitude) fall into; both sides of the antimeridian by themselves."""
    side = F.when(F.col(country).isin(*SPLIT_COUNTRIES), F.col("Longitude") > 0).otherwise(F.lit(True))
    box = cells.groupBy(country, side.alias("east")).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("Longitude", "Latitude")))
    reach = lambda c, start: F.sequence(F.floor((F.col(f"lo_{c}") - start) / size).cast("int"), F.floor((F.col(f"hi_{c}") - start) / size).cast("int"))
    return box.withColumn("tile_x", F.explode(reach("Longitude", -180.0))).withColumn("tile_y", F.explode(reach("Latitude", -90.0))).select(country, "tile_x", "tile_y").distinct()
