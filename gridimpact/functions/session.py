"""The rules of the domain as functions of a session, for queries written in SQL alone. Catalyst puts their bodies in place, so they cost what an expression costs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridimpact.functions.scalar import SEVERE

#: name and arguments, what it returns, and the body; the same rules as in functions.scalar.
FUNCTIONS = {
    "cell_id(iso3 STRING, number BIGINT)": ("STRING", "format_string('%s_%05d', iso3, number)"),
    "cell_index(degrees DOUBLE, start DOUBLE, step DOUBLE)": ("INT", "CAST(floor(round((degrees - start) / step, 9)) AS INT)"),
    "wrap_longitude(lon DOUBLE)": ("DOUBLE", "CASE WHEN lon > 180 THEN lon - 360 ELSE lon END"),
    "share_of(part DOUBLE, whole DOUBLE)": ("DOUBLE", "coalesce(try_divide(part, whole), 0D)"),
    "impact_category(value DOUBLE)": ("INT", f"CASE WHEN value <= 0 THEN 0 WHEN value <= {SEVERE} THEN 1 WHEN value > {SEVERE} THEN 2 END"),
    "day_of(year INT, month INT, day INT)": ("DATE", "CASE WHEN year IS NOT NULL AND month IS NOT NULL THEN CAST(try_to_timestamp(format_string('%04d-%02d-%02d', year, month, coalesce(day, 1)), 'yyyy-MM-dd') AS DATE) END"),
    "tile_latitude(name STRING)": ("INT", r"CASE regexp_extract(name, r'^ID\d+_([NS])(\d+)_([EW])(\d+)_RP10', 1) WHEN 'S' THEN -1 ELSE 1 END * try_cast(regexp_extract(name, r'^ID\d+_([NS])(\d+)_([EW])(\d+)_RP10', 2) AS INT)"),
    "tile_longitude(name STRING)": ("INT", r"CASE regexp_extract(name, r'^ID\d+_([NS])(\d+)_([EW])(\d+)_RP10', 3) WHEN 'W' THEN -1 ELSE 1 END * try_cast(regexp_extract(name, r'^ID\d+_([NS])(\d+)_([EW])(\d+)_RP10', 4) AS INT)"),
}
#: Table functions: the cells that a box may touch, and the edges of a polygon's rings.
TABLES = {
    "box_cells(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, step DOUBLE)": (
        "lon_idx INT, lat_idx INT",
        """SELECT lon_idx, lat_idx FROM (SELECT explode(sequence(CAST(floor(round((x1 + 180) / step, 9)) AS INT), CAST(floor(round((x2 + 180) / step, 9)) AS INT))) AS lon_idx)
           CROSS JOIN (SELECT explode(sequence(CAST(floor(round((y1 + 90) / step, 9)) AS INT), CAST(floor(round((y2 + 90) / step, 9)) AS INT))) AS lat_idx)""",
    ),
}


def register(spark: SparkSession, prefix: str = "gi_") -> SparkSession:
    """Makes the functions known to the session, under names with a prefix."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURNS TABLE({columns}) RETURN {body}")
    return spark
