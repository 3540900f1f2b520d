"""Streams of readings: daily sums and running maxima. An addition; batch tables use the operators for rain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_sums(readings: DataFrame, keys: list[str], time: str, value: str, late: str = "1 day") -> DataFrame:
    """Sum for each key and day; a day is final once the watermark has passed it. Works on batch tables too."""
    readings = readings.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant
    day = readings.withWatermark(time, late).groupBy(F.window(time, "1 day"), *keys).agg(F.sum(value).alias("daily"))
    return day.select(*keys, F.to_date("window.start").alias("day"), "daily")


def unique_readings(readings: DataFrame, id_col: str, time: str, late: str = "1 day") -> DataFrame:
    """Each reading once, if its repeats come within the time allowed for late ones."""
    readings = readings.withColumn(time, F.col(time).cast("timestamp"))
    return readings.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])
