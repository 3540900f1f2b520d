"""Every core operator applied to the tables at hand, and the same in SQL.

The tables have no geography, so stand-ins carry the operators: a nation is a country, a customer or supplier a cell, an order an event, a
user's events a storm track, the first components of an embedding a place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridimpact.functions import scalar
from gridimpact.ml import events as ev
from gridimpact.ml import metrics as me
from gridimpact.operators import assemble, grid, hazard, history, impact, spatial, union, zonal
from gridimpact.sources.tables import country_list, not_done, parquet, split_known

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(column: Column | str, digits: int = 4) -> Column:
    return F.round(column, digits)


# --- history ------------------------------------------------------------------------------------------------------

_DAYS = """days AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, count(*) AS n
              FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"""
    WITH {_DAYS}
    SELECT a.nation, a.day, a.n AS n_events, CAST(coalesce((SELECT sum(b.n) FROM days b
           WHERE b.nation = a.nation AND b.day >= a.day - INTERVAL 5 YEAR AND b.day < a.day), 0) AS INTEGER) AS n_prior
    FROM days a
""")
def prior_events_5y(spark: SparkSession, d: str) -> DataFrame:
    """Events of a country in the five years before each of its event days."""
    orders = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    events = orders.groupBy(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n_events"))
    return history.prior_counts(events, "nation", "day", "n_events")


@query("""
    WITH months AS (SELECT DISTINCT c_nationkey AS nation, date_trunc('month', o_orderdate)::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey),
    counts AS (SELECT a.nation, a.day, (SELECT count(*) FROM months b WHERE b.nation = a.nation AND b.day >= a.day - INTERVAL 5 YEAR AND b.day < a.day)::INTEGER AS n_prior
               FROM months a)
    SELECT s_suppkey AS cell, nation, day, n_prior FROM supplier JOIN counts ON s_nationkey = nation
""")
def event_count_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """The country's count on every cell of the country."""
    orders = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    months = orders.select(F.col("c_nationkey").alias("nation"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).distinct()
    counts = history.prior_events(months, "nation", "day")
    cells = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), F.col("s_nationkey").alias("nation"))
    return history.broadcast_to_cells(cells, counts, "nation").select("cell", "nation", "day", "n_prior")


@query("""
    WITH events_ AS (SELECT o_orderkey, o_custkey FROM orders), meta AS (SELECT o_orderkey, max(l_shipdate)::DATE AS landfalldate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT e.o_orderkey AS event, o_custkey AS storm, landfalldate FROM events_ e LEFT JOIN meta USING (o_orderkey)
""")
def events_with_dates(spark: SparkSession, d: str) -> DataFrame:
    """Events with the landfall date of their storm, where it is known."""
    orders = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("storm"))
    lines = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), "l_shipdate")
    meta = lines.join(orders.select("event"), "event", "left_semi").groupBy("event").agg(F.to_date(F.max("l_shipdate")).alias("landfalldate"))
    return orders.join(meta, "event", "left")


# --- rain and tracks ----------------------------------------------------------------------------------------------

@query("""
    WITH daily AS (SELECT l_suppkey AS cell, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    storms AS (SELECT DISTINCT o_orderstatus || '-' || o_orderpriority AS sid, max(CAST(o_orderdate AS DATE)) AS landfalldate FROM orders GROUP BY 1)
    SELECT cell, sid, max(q) AS rainfall_max_24h FROM daily JOIN storms ON day BETWEEN landfalldate - INTERVAL 2 DAY AND landfalldate + INTERVAL 2 DAY GROUP BY ALL
""")
def daily_sum_window_max(spark: SparkSession, d: str) -> DataFrame:
    """Largest daily sum of each cell within two days of each storm's landfall."""
    rain = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), "l_shipdate", "l_quantity")
    storms = parquet(spark, d, "orders").groupBy(F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("sid")).agg(F.max(F.to_date("o_orderdate")).alias("landfalldate"))
    return hazard.rain_maximum(rain, storms, "sid", ["cell"], "l_shipdate", "l_quantity")


@query("""
    WITH wide AS (SELECT l_suppkey AS cell, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS n,
                         sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT cell, a, n, r, greatest(a, n, r) AS top FROM wide
""")
def pivot_row_maximum(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide, and the row's maximum without missing values."""
    wide = parquet(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return wide.toDF("cell", "a", "n", "r").withColumn("top", F.greatest("a", "n", "r"))


@query("""
    WITH p AS (SELECT user_id, value, row_number() OVER w - 1 AS n, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    e AS (SELECT *, unnest(CASE WHEN nxt IS NULL THEN [0] ELSE [0, 1, 2] END) AS k FROM p)
    SELECT user_id, CAST(3 * n + k AS INTEGER) AS step, round(CASE WHEN nxt IS NULL THEN value ELSE value + (nxt - value) * k / 3 END, 6) AS value FROM e
""")
def track_densify(spark: SparkSession, d: str) -> DataFrame:
    """Two points inside every gap of a track."""
    track = parquet(spark, d, "events").select("user_id", "ts", "value")
    return hazard.densified(track, ["user_id"], "ts", ["value"]).withColumn("value", r("value", 6))


@query("""
    SELECT user_id, min(ts)::DATE AS startdate, max(ts)::DATE AS enddate, coalesce(min(ts) FILTER (event_type = 'purchase'), arg_min(ts, (value, ts)))::DATE AS landfalldate,
           strftime(coalesce(min(ts) FILTER (event_type = 'purchase'), arg_min(ts, (value, ts))), '%H:%M:%S') AS landfall_time
    FROM events GROUP BY user_id
""")
def landfall_first(spark: SparkSession, d: str) -> DataFrame:
    """First and last day of a track, and its first point on land or else the nearest."""
    return hazard.landfall(parquet(spark, d, "events"), ["user_id"], F.col("event_type") == "purchase", "ts", "value")


_PLACES = """place AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v, CAST(embedding[4] AS DOUBLE) AS w FROM embeddings)"""


def _places(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return parquet(spark, d, "embeddings").select("vec_id", "label", part(0).alias("x"), part(1).alias("y"), part(2).alias("v"), part(3).alias("w"))


@query(f"""
    WITH {_PLACES}, track AS (SELECT label AS sid, vec_id AS n, x, y, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM place WINDOW q AS (PARTITION BY label ORDER BY vec_id)),
    seg AS (SELECT sid, x AS x1, y AS y1, x2 - x AS dx, y2 - y AS dy FROM track WHERE x2 IS NOT NULL),
    t AS (SELECT p.vec_id, p.label AS sid, p.x - s.x1 AS px, p.y - s.y1 AS py, dx, dy, greatest(0, least(1, coalesce(((p.x - s.x1) * dx + (p.y - s.y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t
          FROM place p JOIN seg s ON p.label = s.sid)
    SELECT vec_id AS id, sid, round(min(sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)) * 111.1, 4) AS track_distance FROM t GROUP BY ALL
""")
def track_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each cell from its storm's line."""
    p = _places(spark, d)
    cells = p.select(F.col("vec_id").alias("id"), F.col("label").alias("sid"), "x", "y")
    track = p.select(F.col("label").alias("sid"), F.col("vec_id").alias("n"), "x", "y")
    return hazard.track_distance(cells, track, "sid", "n").withColumn("track_distance", r("track_distance"))


@query(f"""
    WITH {_PLACES}, c AS (SELECT label AS sid, x, y, 30 + 100 * abs(v) AS peak, 2 + 10 * abs(w) AS rad FROM place),
    d AS (SELECT p.vec_id AS id, c.sid, peak, rad, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS dist FROM place p JOIN c ON sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) <= 10 / 111.1)
    SELECT id, sid, round(max(peak * sqrt((rad / greatest(dist * 111.1, 1e-3)) ** 1.5 * exp(1 - (rad / greatest(dist * 111.1, 1e-3)) ** 1.5))), 4) AS wind_speed FROM d GROUP BY ALL
""")
def wind_field(spark: SparkSession, d: str) -> DataFrame:
    """The strongest wind of each storm at each cell in reach."""
    p = _places(spark, d)
    track = p.select(F.col("label").alias("sid"), "x", "y", (30 + 100 * F.abs("v")).alias("peak"), (2 + 10 * F.abs("w")).alias("radius_km"))
    return hazard.wind_field(p.select(F.col("vec_id").alias("id"), "x", "y"), track, "sid", 10.0).withColumn("wind_speed", r("wind_speed"))


@query(f"""
    WITH {_PLACES}, p AS (SELECT vec_id, label, 20 + 5 * x AS x, 10 + 40 * v + 2 * y AS y, 1010.0 AS pn, 1010 - 90 * abs(w) * 3 AS pc, 20 + 60 * abs(v) AS rad, TIMESTAMP '2020-01-01' + INTERVAL 1 HOUR * vec_id AS ts FROM place),
    t AS (SELECT *, coalesce(lead(x) OVER q - x, x - lag(x) OVER q, 0) AS dx, coalesce(lead(y) OVER q - y, y - lag(y) OVER q, 0) AS dy, coalesce(epoch(lead(ts) OVER q) - epoch(ts), epoch(ts) - epoch(lag(ts) OVER q)) AS dt FROM p WINDOW q AS (PARTITION BY label ORDER BY ts)),
    m AS (SELECT label AS sid, x AS sx, y AS sy, rad, pn - pc AS dp, coalesce(dx * cos(radians(y)) * 111100 / nullif(dt, 0), 0) AS u, coalesce(dy * 111100 / nullif(dt, 0), 0) AS v FROM t),
    c AS (SELECT p.vec_id AS id, m.*, p.x - sx AS ex, p.y - sy AS ey, sqrt((p.x - sx) ** 2 + (p.y - sy) ** 2) AS dist FROM p JOIN m ON sqrt((p.x - sx) ** 2 + (p.y - sy) ** 2) <= 60 / 111.1),
    b AS (SELECT *, greatest(1, least(2.5, -4.4e-5 * dp * dp + 0.01 * dp - 0.014 * abs(sy) + 0.15 * sqrt(u * u + v * v) ** (0.6 * (1 - dp / 215)) + 1)) AS b, greatest(dist * 111.1, 1e-3) AS km FROM c),
    g AS (SELECT *, km * 1000 * 7.292e-5 * abs(sin(radians(sy))) AS f, (rad / km) ** b AS h FROM b),
    w AS (SELECT *, sqrt(b / 1.15 * h * dp * 100 * exp(-h) + f * f) - f AS wind, least(1, rad / km) AS part, coalesce(ex / nullif(dist, 0), 0) AS e, coalesce(ey / nullif(dist, 0), 0) AS n, CASE WHEN sy < 0 THEN -1 ELSE 1 END AS s FROM g)
    SELECT id, sid, round(max(sqrt((-s * wind * n + part * u) ** 2 + (s * wind * e + part * v) ** 2)), 3) AS wind_speed FROM w GROUP BY ALL
""")
def gradient_wind_field(spark: SparkSession, d: str) -> DataFrame:
    """The strongest wind of each storm at each cell in reach, from pressure, latitude and motion."""
    p = _places(spark, d).select(
        "vec_id", "label", (20 + 5 * F.col("x")).alias("x"), (10 + 40 * F.col("v") + 2 * F.col("y")).alias("y"), F.lit(1010.0).alias("outer_hpa"), (1010 - 90 * F.abs("w") * 3).alias("central_hpa"),
        (20 + 60 * F.abs("v")).alias("radius_km"), F.expr("timestampadd(HOUR, vec_id, TIMESTAMP '2020-01-01')").alias("ts"),
    )
    track = p.withColumnRenamed("label", "sid").drop("vec_id")
    return hazard.gradient_wind_field(p.select(F.col("vec_id").alias("id"), "x", "y"), track, "sid", "ts", 60.0).withColumn("wind_speed", r("wind_speed", 3))


@query("""
    WITH c AS (SELECT 'N' || c_nationkey AS iso3, c_custkey, ((c_custkey * 37) % 3700)::DOUBLE / 10 AS lon, ((c_custkey * 53) % 1700)::DOUBLE / 10 - 85 AS lat, c_acctbal FROM customer),
    w AS (SELECT *, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS l FROM c),
    b AS (SELECT iso3, unnest(range(floor(round((l + 180) / 0.1::DOUBLE, 9))::INT, floor(round((l + 180.25) / 0.1::DOUBLE, 9))::INT + 1)) AS lon_idx, lat, c_custkey, c_acctbal FROM w),
    t AS (SELECT iso3, lon_idx, unnest(range(floor(round((lat + 90) / 0.1::DOUBLE, 9))::INT, floor(round((lat + 90.15) / 0.1::DOUBLE, 9))::INT + 1)) AS lat_idx, c_custkey, c_acctbal FROM b)
    SELECT iso3, printf('%s_%05d', iso3, lat_idx) AS band, CASE WHEN c_acctbal / 100 <= 0 THEN 0 WHEN c_acctbal / 100 <= 15 THEN 1 ELSE 2 END AS category, count(*) AS n_cells, count(DISTINCT lon_idx) AS n_columns,
           round(coalesce(sum(c_acctbal) / nullif(count(*), 0), 0), 4) AS mean, max(make_date(2000 + c_custkey % 20, 1 + c_custkey % 12, 1)) AS last_day
    FROM t GROUP BY ALL
""")
def cells_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """Boxes at customers' places as cells, by rules that the session knows; Spark SQL and nothing else."""
    from gridimpact.functions.session import register

    return register(spark).sql(
        """
        WITH c AS (SELECT concat('N', c_nationkey) AS iso3, c_custkey, c_acctbal, gi_wrap_longitude((c_custkey * 37) % 3700 / 10D) AS lon, (c_custkey * 53) % 1700 / 10D - 85 AS lat FROM {customer})
        , t AS (SELECT iso3, lon_idx, gi_cell_id(iso3, lat_idx) AS band, gi_impact_category(c_acctbal / 100) AS category, c_acctbal,
                       gi_day_of(CAST(2000 + c_custkey % 20 AS INT), CAST(1 + c_custkey % 12 AS INT), NULL) AS day FROM c, LATERAL gi_box_cells(lon, lat, lon + 0.25D, lat + 0.15D, 0.1D)),
        s AS (SELECT iso3, band, category, count(*) AS n_cells, count(DISTINCT lon_idx) AS n_columns, sum(c_acctbal) AS balance, max(day) AS last_day FROM t GROUP BY 1, 2, 3)
        SELECT iso3, band, category, n_cells, n_columns, round(gi_share_of(balance, n_cells), 4) AS mean, last_day FROM s
        """,
        customer=parquet(spark, d, "customer"),
    )


# --- neighbours ---------------------------------------------------------------------------------------------------

@query(f"""
    WITH {_PLACES}, m AS (SELECT a.vec_id AS pid, b.vec_id AS site, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM place a JOIN place b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
    SELECT pid, site, round(dist, 6) AS dist FROM m QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, site) = 1
""")
def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    """Each point's nearest site of the same country."""
    p = _places(spark, d)
    points = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pid"), "x", "y", "label")
    sites = p.where("vec_id % 2 = 1").select(F.col("vec_id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), "label")
    return spatial.nearest_match(points, sites, ["label"]).where("site IS NOT NULL").select("pid", "site", r("dist", 6).alias("dist"))


@query(f"""
    WITH {_PLACES}, k AS (SELECT a.vec_id AS pid, b.v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM place a JOIN place b ON a.label = b.label AND a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) <= 8),
    f AS (SELECT pid, sum(v / (dist + 1e-10)) / sum(1 / (dist + 1e-10)) AS filled FROM k GROUP BY pid)
    SELECT vec_id AS pid, label, round(CASE WHEN vec_id % 7 = 0 THEN filled ELSE v END, 6) AS value FROM place LEFT JOIN f ON vec_id = pid
""")
def idw_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing values from the eight nearest known ones of the country."""
    cells = _places(spark, d).select(F.col("vec_id").alias("pid"), "x", "y", "label", F.when(F.col("vec_id") % 7 != 0, F.col("v")).alias("value"))
    return spatial.inverse_distance_fill(cells, "value", ["label"]).select("pid", "label", r("value", 6).alias("value"))


@query(f"""
    WITH {_PLACES}
    SELECT a.vec_id AS pid, round(max(b.v), 6) AS surge FROM place a LEFT JOIN place b ON b.vec_id % 3 = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02 GROUP BY 1
""")
def buffer_join_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest value within a radius."""
    p = _places(spark, d)
    sites = p.where("vec_id % 3 = 0").select(F.col("vec_id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("v").alias("surge"))
    return spatial.buffer_max(p.select(F.col("vec_id").alias("pid"), "x", "y"), sites, "surge", 0.02).select("pid", r("surge", 6).alias("surge"))


@query(f"""
    WITH {_PLACES}, known AS (SELECT DISTINCT label FROM place WHERE vec_id % 11 = 0 AND label % 2 = 0), k AS (SELECT a.vec_id AS pid, b.v, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist
      FROM place a JOIN place b ON a.label = b.label AND b.label % 2 = 0 AND b.vec_id % 11 = 0 AND a.vec_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) <= 8),
    f AS (SELECT pid, sum(v / (dist + 1e-10)) / sum(1 / (dist + 1e-10)) AS filled FROM k GROUP BY pid)
    SELECT vec_id AS pid, round(coalesce(CASE WHEN vec_id % 11 = 0 AND label % 2 = 0 THEN v ELSE filled END, 0), 6) AS surge FROM place LEFT JOIN f ON vec_id = pid
""")
def surge_complete_grid(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated where the country has a value, 0 elsewhere, on all cells."""
    known = (F.col("vec_id") % 11 == 0) & (F.col("label") % 2 == 0)
    cells = _places(spark, d).select(F.col("vec_id").alias("pid"), "x", "y", "label", F.when(known, F.col("v")).alias("surge"))
    filled = spatial.inverse_distance_fill(cells, "surge", ["label"])
    return filled.select("pid", r(F.coalesce("surge", F.lit(0.0)), 6).alias("surge"))


@query(f"""
    WITH {_PLACES}
    SELECT DISTINCT b.label AS country, a.vec_id AS tile FROM place a JOIN place b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.03
""")
def tiles_near_country(spark: SparkSession, d: str) -> DataFrame:
    """Tiles inside the buffer around a country."""
    p = _places(spark, d)
    cells = p.select(F.col("vec_id").alias("site"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("label").alias("country"))
    return spatial.tiles_near(p.select(F.col("vec_id").alias("pid"), "x", "y"), cells, "country", 0.03).withColumnRenamed("pid", "tile")


_SQUARES = """u AS (SELECT * FROM (VALUES ('A', -0.3, -0.3, 0.0, 0.0), ('B', 0.0, -0.3, 0.3, 0.0), ('C', -0.3, 0.0, 0.0, 0.3)) t(unit, x1, y1, x2, y2))"""


def _squares(spark: SparkSession) -> DataFrame:
    boxes = [("A", -0.3, -0.3, 0.0, 0.0), ("B", 0.0, -0.3, 0.3, 0.0), ("C", -0.3, 0.0, 0.0, 0.3)]
    ring = lambda a, b, c, e: [[(a, b), (c, b), (c, e), (a, e), (a, b)]]
    return spark.createDataFrame([(u, "X", ring(*b)) for u, *b in boxes], "unit string, iso3 string, rings array<array<struct<x:double,y:double>>>")


@query(f"WITH {_PLACES}, {_SQUARES} SELECT vec_id AS pid, unit FROM place JOIN u ON x >= x1 AND x < x2 AND y >= y1 AND y < y2")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Points inside polygons."""
    points = _places(spark, d).select(F.col("vec_id").alias("pid"), "x", "y")
    return spatial.point_in_polygon(points, _squares(spark), 0.1).select("pid", "unit")


@query(f"""
    WITH {_PLACES}, {_SQUARES}, i AS (SELECT vec_id AS pid, x, y, unit FROM place LEFT JOIN u ON x >= x1 AND x < x2 AND y >= y1 AND y < y2),
    c AS (SELECT unit, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM u),
    n AS (SELECT pid, arg_min(c.unit, (sqrt((x - cx) ** 2 + (y - cy) ** 2), c.unit)) AS near FROM i CROSS JOIN c GROUP BY pid)
    SELECT pid, coalesce(unit, near) AS unit, CASE WHEN unit IS NULL THEN 'nearest' ELSE 'inside' END AS how FROM i JOIN n USING (pid)
""")
def admin_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The unit around a point, or else the nearest one of the country."""
    points = _places(spark, d).select(F.col("vec_id").alias("pid"), F.lit("X").alias("iso3"), "x", "y")
    return spatial.match_units(points, _squares(spark), "iso3", 0.1).select("pid", "unit", "how")


# --- impact -------------------------------------------------------------------------------------------------------

@query("""
    WITH e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS event FROM orders),
    reported AS (SELECT CAST(o_orderdate AS DATE) AS event, c_nationkey AS unit, max(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT e.event, n_nationkey AS unit, coalesce(amount, 0) AS amount FROM e CROSS JOIN nation LEFT JOIN reported ON reported.event = e.event AND unit = n_nationkey
""")
def impact_expand_zero_fill(spark: SparkSession, d: str) -> DataFrame:
    """Every event (a day) with every unit: the largest amount reported or 0."""
    orders = parquet(spark, d, "orders").withColumn("event", F.to_date("o_orderdate"))
    reported = orders.join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("event", F.col("c_nationkey").alias("unit")).agg(F.max("o_totalprice").alias("amount"))
    units = parquet(spark, d, "nation").select(F.lit("X").alias("country"), F.col("n_nationkey").alias("unit"))
    events = orders.select("event").distinct().withColumn("country", F.lit("X"))
    return impact.expanded(events, reported, units, "event", "country", "unit", "amount").select("event", "unit", "amount")


#: Customers as cells of segments of nations of regions; orders as reports about regions, nations or segments.
_REPORTS = """cells AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_mktsegment AS segment, c_custkey AS cell, greatest(c_acctbal, 0) + 1 AS w FROM customer JOIN nation ON c_nationkey = n_nationkey),
    o AS (SELECT year(o_orderdate)::INT AS event, region, nation, segment, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN segment = 'BUILDING' OR (o_orderpriority = '2-HIGH' AND nation % 3 > 0) THEN 2 ELSE 3 END AS d,
                 o_totalprice * CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) % 2 = 0 THEN 20 ELSE 1 END AS amount FROM orders JOIN cells ON o_custkey = cell),
    k3 AS (SELECT event, region, nation, segment, sum(amount)::DOUBLE AS own FROM o WHERE d = 3 GROUP BY ALL),
    k2 AS (SELECT event, region, nation, coalesce(a.own, b.own) AS own FROM (SELECT event, region, nation, sum(amount)::DOUBLE AS own FROM o WHERE d = 2 GROUP BY ALL) a FULL JOIN (SELECT event, region, nation, sum(own) AS own FROM k3 GROUP BY ALL) b USING (event, region, nation)),
    k1 AS (SELECT event, region, coalesce(a.own, b.own) AS share FROM (SELECT event, region, sum(amount)::DOUBLE AS own FROM o WHERE d = 1 GROUP BY ALL) a FULL JOIN (SELECT event, region, sum(own) AS own FROM k2 GROUP BY ALL) b USING (event, region)),
    """


def _share_sql(name: str, above: str, known: str | None, keys: str, up: str) -> str:
    """The shares of the units of a level from those of the level above."""
    joined = f"LEFT JOIN {known} USING (event, {keys})" if known else ""
    own = "own" if known else "NULL::DOUBLE AS own"
    return f"""{name}_w AS (SELECT {keys}, sum(w)::DOUBLE AS w FROM cells GROUP BY ALL),
    {name}_r AS (SELECT event, {keys}, w, share, {own} FROM {name}_w JOIN {above} USING ({up}) {joined}),
    {name}_f AS (SELECT *, coalesce(sum(own) OVER q, 0) AS r, coalesce(sum(w) FILTER (own IS NULL) OVER q, 0) AS f FROM {name}_r WINDOW q AS (PARTITION BY event, {up})),
    {name} AS (SELECT event, {keys}, CASE WHEN r > share OR f <= 0 THEN coalesce(own * share / nullif(r, 0), 0) ELSE coalesce(own, (share - r) * w / nullif(f, 0)) END AS share FROM {name}_f)"""


_SHARES = ",".join([_share_sql("s2", "k1", "k2", "region, nation", "region"), _share_sql("s3", "s2", "k3", "region, nation, segment", "region, nation"), _share_sql("s4", "s3", None, "region, nation, segment, cell", "region, nation, segment")])


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    cells = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = cells.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("cell"), (F.greatest("c_acctbal", F.lit(0.0)) + 1).alias("w"))
    o = parquet(spark, d, "orders").join(cells, F.col("o_custkey") == F.col("cell")).withColumn("event", F.year("o_orderdate"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    depth = F.when(urgent, 1).when((F.col("segment") == "BUILDING") | ((F.col("o_orderpriority") == "2-HIGH") & (F.col("nation") % 3 > 0)), 2).otherwise(3)
    amount = F.col("o_totalprice") * F.when(urgent & (F.col("event") % 2 == 0), 20).otherwise(1)
    reports = o.select("event", "region", F.when(depth > 1, F.col("nation")).alias("nation"), F.when(depth > 2, F.col("segment")).alias("segment"), amount.alias("amount"))
    return impact.reconciled(cells, reports, ["region", "nation", "segment", "cell"], "w")


@query(f"WITH {_REPORTS} {_SHARES} SELECT event, region, nation, segment, cell, round(share, 2) AS amount FROM s4")
def report_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Reports at three levels spread over cells, so that every level adds up to what is reported."""
    return _reconciled(spark, d).withColumn("amount", r("amount", 2))


@query(f"""
    WITH {_REPORTS} {_SHARES}
    SELECT event, region, nation, segment, CAST(4 - grouping(region) - grouping(nation) - grouping(segment) AS INTEGER) AS depth, round(sum(share), 2) AS total FROM s4
    GROUP BY GROUPING SETS ((event), (event, region), (event, region, nation), (event, region, nation, segment))
""")
def totals_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the reconciled amounts for every level in one aggregate."""
    return impact.totals_by_level(_reconciled(spark, d), ["event", "region", "nation", "segment"], "amount").withColumn("total", r("total", 2))


@query("""
    WITH rows_ AS (SELECT o_custkey AS event, o_orderkey AS unit, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS name, o_totalprice AS amount FROM orders),
    best AS (SELECT event, arg_max(name, (amount)) FILTER (name IS NOT NULL) AS best FROM rows_ GROUP BY event)
    SELECT event, unit, coalesce(name, best) AS name FROM rows_ JOIN best USING (event)
""")
def fill_event_columns(spark: SparkSession, d: str) -> DataFrame:
    """An event's columns from its most affected row that has them."""
    name = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus"))
    rows = parquet(spark, d, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("unit"), name.alias("name"), F.col("o_totalprice").alias("amount"))
    return impact.filled_from_largest(rows, "event", "amount", ["name"]).select("event", "unit", "name")


_MONTHS = """m AS (SELECT date_trunc('month', o_orderdate)::DATE AS event, c_nationkey AS unit, max(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query(f"""
    WITH {_MONTHS}, cells AS (SELECT c_custkey AS id, c_nationkey AS unit, greatest(c_acctbal, 0) AS population FROM customer),
    j AS (SELECT m.event, id, population, amount FROM cells JOIN m USING (unit)),
    t AS (SELECT event, sum(population) AS total FROM j WHERE amount > 0 AND population > 0 GROUP BY event)
    SELECT event, id, round(CASE WHEN amount > 0 AND population > 0 THEN 100 * amount / total ELSE 0 END, 4) AS perc FROM j JOIN t USING (event)
""")
def impact_share(spark: SparkSession, d: str) -> DataFrame:
    """The reported amount in per cent of the people in the affected region."""
    orders = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("event", F.to_date(F.date_trunc("month", "o_orderdate")))
    events = orders.groupBy("event", F.col("c_nationkey").alias("unit")).agg(F.max("o_totalprice").alias("amount"))
    cells = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("unit"), F.greatest("c_acctbal", F.lit(0.0)).alias("population"))
    shares = impact.impact_share(cells, events, "event", ["unit"], "amount")
    return shares.select("event", "id", r("perc_affected_pop_grid_region").alias("perc"))


_LITERALS = """CASE o_orderkey % 5 WHEN 0 THEN '[{''adm1_code'': ' || o_custkey || '}, {''adm2_code'': 3}]' WHEN 1 THEN '[{''adm2_code'': ' || o_custkey || ', ''name'': None}]'
               WHEN 2 THEN 'bad' WHEN 3 THEN '[]' END"""


@query("""
    SELECT o_orderkey AS event, CASE o_orderkey % 5 WHEN 0 THEN 'ADM1' WHEN 1 THEN 'ADM2' ELSE 'ADM0' END AS level,
           CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey AS INTEGER) END AS code, CASE WHEN o_orderkey % 5 < 2 THEN c_mktsegment END AS unit_name
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
""")
def reported_units(spark: SparkSession, d: str) -> DataFrame:
    """Lists of units parsed, exploded and located."""
    kind, key = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("[{'adm1_code': "), key, F.lit("}, {'adm2_code': 3}]"))).when(kind == 1, F.concat(F.lit("[{'adm2_code': "), key, F.lit(", 'name': None}]")))
    text = text.when(kind == 2, "bad").when(kind == 3, "[]")
    reports = impact.parsed_reports(parquet(spark, d, "orders").select(F.col("o_orderkey").alias("event"), text.alias("Admin Units")))
    names = parquet(spark, d, "customer").select(F.explode(F.array(F.lit("ADM1"), F.lit("ADM2"))).alias("unit_level"), F.col("c_custkey").alias("unit_code"), F.col("c_mktsegment").alias("unit_name"))
    return impact.located_reports(reports, names).select("event", "level", "code", "unit_name")


@query("""
    SELECT o_orderkey AS event, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END, p.patch) AS sid FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS patch FROM lineitem GROUP BY 1) p ON l_orderkey = o_orderkey
""")
def patched_storm_ids(spark: SparkSession, d: str) -> DataFrame:
    """Missing storm keys from a table by event."""
    events = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("sid"))
    patch = parquet(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.min("l_suppkey").alias("sid"))
    return impact.patched_keys(events, patch, "event", "sid")


# --- assembly -----------------------------------------------------------------------------------------------------

@query("""
    WITH n AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END AS g1, n_name FROM nation),
    c AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 5 END AS g1 FROM customer)
    SELECT id, c.g1, n_name FROM c JOIN n ON c.g1 IS NOT DISTINCT FROM n.g1
""")
def null_safe_admin_join(spark: SparkSession, d: str) -> DataFrame:
    """Missing units match missing units, and the join stays an equi-join."""
    units = parquet(spark, d, "nation").select(F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey")).alias("g1"), "n_name")
    cells = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey") % 5).alias("g1"))
    return assemble.null_safe_join(cells, units, ["g1"])


@query("""
    WITH l AS (SELECT l_partkey, sum(l_quantity) AS rain, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1), s AS (SELECT l_partkey, max(s_acctbal) AS surge FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_tax > 0.06 GROUP BY 1)
    SELECT p_partkey AS id, p_size AS elev, coalesce(rain, 0) AS rain, coalesce(n, 0) AS n, coalesce(surge, 0) AS surge FROM part LEFT JOIN l ON p_partkey = l.l_partkey LEFT JOIN s ON p_partkey = s.l_partkey
""")
def static_layer_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Layers by cell, one after another, missing values filled."""
    lines = parquet(spark, d, "lineitem")
    cells = parquet(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("elev"))
    rain = lines.where("l_discount > 0.05").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("rain"), F.count(F.lit(1)).alias("n"), F.lit(0).alias("elev"))
    surge = lines.where("l_tax > 0.06").join(parquet(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("id")).agg(F.max("s_acctbal").alias("surge"))
    return assemble.joined_layers(cells, [rain, surge], ["id"], {"rain": 0.0, "n": 0, "surge": 0.0})


@query("""
    WITH reg AS (SELECT n_regionkey AS country, n_nationkey AS region, avg(c_acctbal) AS hdi FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 > 0 GROUP BY ALL),
    nat AS (SELECT n_regionkey AS country, avg(c_acctbal) AS hdi FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT s_suppkey AS id, round(coalesce(reg.hdi, nat.hdi), 4) AS hdi FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN reg ON reg.region = n_nationkey AND reg.country = n_regionkey LEFT JOIN nat ON nat.country = n_regionkey
""")
def hdi_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The region's value or else the country's."""
    nation = parquet(spark, d, "nation").select(F.col("n_regionkey").alias("country"), F.col("n_nationkey").alias("region"))
    people = parquet(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("region"))
    regional = people.where("region % 3 > 0").groupBy("country", "region").agg(F.avg("c_acctbal").alias("hdi"))
    national = people.groupBy("country").agg(F.avg("c_acctbal").alias("hdi"))
    rows = parquet(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("region")).select(F.col("s_suppkey").alias("id"), "country", "region")
    return assemble.with_fallback(rows, regional, national, ["region"], "country", "hdi").select("id", r("hdi").alias("hdi"))


@query("""
    WITH m AS (SELECT c_custkey AS id, c_nationkey AS iso3, CASE WHEN c_custkey % 3 = 0 OR c_nationkey % 2 = 0 AND c_custkey % 4 > 0 THEN c_mktsegment END AS unit FROM customer),
    k AS (SELECT iso3, avg(CASE WHEN unit IS NULL THEN 0 ELSE 1 END) AS rate FROM m GROUP BY 1)
    SELECT id, iso3, CASE WHEN rate >= 0.5 THEN unit END AS unit, rate < 0.5 AS national FROM m JOIN k USING (iso3)
""")
def admin_match_rate(spark: SparkSession, d: str) -> DataFrame:
    """Countries in which too few cells match fall back to national level."""
    c = parquet(spark, d, "customer")
    cells = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("iso3"))
    matched = c.where("c_custkey % 3 = 0 OR (c_nationkey % 2 = 0 AND c_custkey % 4 > 0)").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("unit"))
    return assemble.admin_of_cells(cells, matched).select("id", "iso3", "unit", "national")


@query("""
    WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal END AS shdi FROM customer)
    SELECT id, round(coalesce(shdi, (SELECT median(shdi) FROM c)), 4) AS shdi FROM c
""")
def median_fill(spark: SparkSession, d: str) -> DataFrame:
    """Missing values as the median of the column."""
    rows = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_acctbal")).alias("shdi"))
    return assemble.median_filled(rows, "shdi").select("id", r("shdi").alias("shdi"))


@query("SELECT DISTINCT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def countries_in_use(spark: SparkSession, d: str) -> DataFrame:
    """All countries that occur."""
    used = parquet(spark, d, "nation").join(parquet(spark, d, "customer").where("c_acctbal < 0"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return country_list(used, "n_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < DATE '2001-01-01')")
def work_left(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a stage has still to do."""
    done = parquet(spark, d, "lineitem").where("l_shipdate < DATE '2001-01-01'").withColumnRenamed("l_orderkey", "o_orderkey")
    return not_done(parquet(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("""
    SELECT o_custkey AS sid, true AS found, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) GROUP BY 1
    UNION ALL SELECT c_custkey, false, 0 FROM customer WHERE c_acctbal > 9000 AND c_custkey NOT IN (SELECT o_custkey FROM orders)
""")
def archive_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of the wanted storms, and the storms that the archive lacks."""
    keys = parquet(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("sid"))
    found, lacking = split_known(keys, parquet(spark, d, "orders").withColumnRenamed("o_custkey", "sid"), "sid")
    tracks = found.groupBy("sid").agg(F.lit(True).alias("found"), F.count(F.lit(1)).alias("n"))
    return tracks.unionByName(lacking.select("sid", F.lit(False).alias("found"), F.lit(0).cast("long").alias("n")))


# --- grid and rasters ---------------------------------------------------------------------------------------------

@query("""
    WITH c AS (SELECT DISTINCT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS iso3, CAST(c_custkey * 7919 % 3600 AS INTEGER) AS lon_idx, CAST(c_custkey * 104729 % 1800 AS INTEGER) AS lat_idx FROM customer),
    g AS (SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso3, CAST(i // 1800 AS INTEGER) AS lon_idx, CAST(i % 1800 AS INTEGER) AS lat_idx FROM range(6480000) t(i) JOIN nation ON n_nationkey = i // 1800 % 25),
    a AS (SELECT * FROM g UNION SELECT * FROM c),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY iso3 ORDER BY lon_idx, lat_idx) - 1 AS INTEGER) AS number, round((lon_idx + 0.5)::DOUBLE / 10 - 180, 6) AS lon, round((lat_idx + 0.5)::DOUBLE / 10 - 90, 6) AS lat FROM a),
    i AS (SELECT *, printf('%s_%05d', iso3, number) AS id FROM n),
    s AS (SELECT iso3, lat_idx, lat, count(*) AS n, min(number) AS low, max(number) AS high, min(id) AS first_id, max(id) AS last_id, round(sum(lon), 4) AS lon_sum FROM i GROUP BY ALL)
    SELECT s.*, own.lon_idx, own.lon, own.number, own.id FROM s LEFT JOIN (SELECT i.* FROM i JOIN c USING (iso3, lon_idx, lat_idx)) own ON own.iso3 = s.iso3 AND own.lat_idx = s.lat_idx
""")
def grid_ids(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid, its columns dealt to nations, and the cells where a country has customers: all numbered, told by row of cells, and each cell with customers."""
    key, iso3 = F.col("c_custkey").cast("long"), lambda c: F.format_string("N%02d", c).alias("iso3")
    own = parquet(spark, d, "customer").select(iso3("c_nationkey"), (key * 7919 % 3600).cast("int").alias("lon_idx"), (key * 104729 % 1800).cast("int").alias("lat_idx"))
    nation = parquet(spark, d, "nation").select("n_nationkey", iso3("n_nationkey"))
    whole = grid.global_grid(spark).join(F.broadcast(nation), F.col("lon_idx") % 25 == F.col("n_nationkey")).select("iso3", "lon_idx", "lat_idx")
    once = whole.withColumn("_own", F.lit(False)).unionByName(own.withColumn("_own", F.lit(True))).groupBy("iso3", "lon_idx", "lat_idx").agg(F.bool_or("_own").alias("_own"))
    cells = grid.with_ids(grid.with_centres(once)).withColumns({"lon": r("Longitude", 6), "lat": r("Latitude", 6)})
    held = F.collect_list(F.when(F.col("_own"), F.struct("lon_idx", "lon", "number", "id"))).alias("_held")  # cells of one row of a country: at most 3,600
    rows = cells.groupBy("iso3", "lat_idx", "lat").agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), r(F.sum("lon")).alias("lon_sum"), held,
    )
    return rows.select("iso3", "lat_idx", "lat", "n", "low", "high", "first_id", "last_id", "lon_sum", F.explode_outer("_held").alias("_c")).select("*", "_c.*").drop("_c")


_PIXELS = """p AS (SELECT CAST(floor(round((CAST(embedding[1] AS DOUBLE) + 180) / 0.05, 9)) AS INTEGER) AS lon_idx, label, CAST(embedding[3] AS DOUBLE) AS v, vec_id FROM embeddings)"""


@query(f"""
    WITH {_PIXELS}, t AS (SELECT lon_idx, label, avg(CASE WHEN vec_id % 9 > 0 THEN v END) AS m FROM p GROUP BY ALL),
    e AS (SELECT lon_idx, avg(m) AS mean_elev FROM t GROUP BY 1)
    SELECT p.lon_idx, round(coalesce(sum(CASE WHEN v > 0 THEN v END), 0), 6) AS population, round(any_value(mean_elev), 6) AS mean_elev, round(sum(v), 6) AS landslide, round(max(v), 6) AS flood FROM p JOIN e USING (lon_idx) GROUP BY 1
""")
def zonal_sum_mean_max(spark: SparkSession, d: str) -> DataFrame:
    """Sum of positive pixels, mean over tiles, sum and maximum of each cell."""
    part = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pixels = parquet(spark, d, "embeddings").select(scalar.cell_index(part(0), -180.0, 0.05).alias("lon_idx"), "label", part(2).alias("v"), F.when(F.col("vec_id") % 9 > 0, part(2)).otherwise(F.lit(-9999.0)).alias("e"))
    layers = [zonal.population_sum(pixels, ["lon_idx"], "v"), zonal.tiled_mean(pixels, ["lon_idx"], "label", "e", "mean_elev"), zonal.touched_sum(pixels, ["lon_idx"], "v", "landslide"), zonal.tiles_max(pixels, ["lon_idx"], "v", "flood")]
    out = assemble.joined_layers(layers[0], layers[1:], ["lon_idx"])
    return out.select("lon_idx", *(r(c, 6).alias(c) for c in ("population", "mean_elev", "landslide", "flood")))


@query("""
    WITH p AS (SELECT user_id AS cell, CASE event_type WHEN 'view' THEN 21 WHEN 'click' THEN 12 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 30 ELSE 128 END AS class FROM events),
    c AS (SELECT cell, count(*) FILTER (class IN (21, 22, 23, 30)) AS u, count(*) FILTER (class IN (11, 12, 13)) AS r, count(*) FILTER (class = 10) AS w FROM p GROUP BY 1)
    SELECT cell, round(u / nullif(u + r + w, 0), 6) AS urban, round(r / nullif(u + r + w, 0), 6) AS rural, round(w / nullif(u + r + w, 0), 6) AS water FROM c
""")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the three groups of classes."""
    of = F.create_map(*(F.lit(x) for x in ("view", 21, "click", 12, "purchase", 10, "signup", 30)))
    pixels = parquet(spark, d, "events").select(F.col("user_id").alias("cell"), F.coalesce(F.try_element_at(of, F.col("event_type")), F.lit(128)).alias("class"))
    return zonal.class_shares(pixels, ["cell"]).select("cell", *(r(c, 6).alias(c) for c in ("urban", "rural", "water")))


@query("""
    WITH p AS (SELECT l_suppkey AS cell, l_linenumber AS lat, l_orderkey AS lon, l_extendedprice AS raw FROM lineitem), f AS (SELECT cell, arg_min(raw, (-lat, lon, raw)) AS v FROM p GROUP BY 1)
    SELECT cell, round(v / 10, 4) AS value FROM f WHERE v < 29999
""")
def first_pixel(spark: SparkSession, d: str) -> DataFrame:
    """The north-western pixel of each cell, scaled, without fill values."""
    pixels = parquet(spark, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("lat"), F.struct("l_orderkey", "l_extendedprice").alias("lon"), F.col("l_extendedprice").alias("raw"))
    return zonal.first_pixel(pixels, ["cell"], "raw").select("cell", r("value").alias("value"))


@query("""
    WITH p AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, p_retailprice AS v FROM part),
    n AS (SELECT a.row, a.col, a.v, o.dr, o.dc, coalesce(b.v, a.v) AS w FROM p a CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) x(dr) CROSS JOIN (VALUES (-1), (0), (1)) y(dc)) o LEFT JOIN p b ON b.row = a.row + o.dr AND b.col = a.col + o.dc),
    g AS (SELECT row, col, sum(CASE WHEN dc = 1 THEN (2 - abs(dr)) * w WHEN dc = -1 THEN -(2 - abs(dr)) * w ELSE 0 END) AS dx, sum(CASE WHEN dr = 1 THEN (2 - abs(dc)) * w WHEN dr = -1 THEN -(2 - abs(dc)) * w ELSE 0 END) AS dy, sum(abs(w - v)) / 8 AS tri FROM n GROUP BY ALL)
    SELECT row, col, round(degrees(atan(sqrt((dx / 720) ** 2 + (dy / 720) ** 2))), 4) AS slope, round(tri, 4) AS ruggedness FROM g
""")
def terrain_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope and ruggedness from the neighbours."""
    pixels = parquet(spark, d, "part").select(F.lit(0).alias("tile"), F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_retailprice").alias("value"))
    return zonal.terrain(pixels, ["tile"], 90.0, 90.0).select("row", "col", r("slope").alias("slope"), r("ruggedness").alias("ruggedness"))


@query("""
    WITH f AS (SELECT o_orderkey AS k, 'ID' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_S' ELSE '_N' END || (o_orderkey % 90) || CASE WHEN o_orderkey % 3 = 0 THEN '_W' ELSE '_E' END || (o_orderkey % 180) || CASE WHEN o_orderkey % 7 = 0 THEN '_other' ELSE '_RP10_depth_reclass.tif' END AS name FROM orders)
    SELECT k, name, CASE WHEN k % 7 > 0 THEN CAST(CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * (k % 90) AS INTEGER) END AS lat, CASE WHEN k % 7 > 0 THEN CAST(CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END * (k % 180) AS INTEGER) END AS lon FROM f
""")
def tile_name_parse(spark: SparkSession, d: str) -> DataFrame:
    """The corner of a tile from its file name."""
    k = F.col("k")
    name = F.concat(F.lit("ID"), k, F.when(k % 2 == 0, "_S").otherwise("_N"), k % 90, F.when(k % 3 == 0, "_W").otherwise("_E"), k % 180, F.when(k % 7 == 0, "_other").otherwise("_RP10_depth_reclass.tif"))
    rows = parquet(spark, d, "orders").select(F.col("o_orderkey").alias("k")).withColumn("name", name)
    lat, lon = scalar.tile_corner(F.col("name"))
    return rows.withColumns({"lat": lat, "lon": lon})


@query("""
    WITH c AS (SELECT c_nationkey AS iso3, (c_custkey % 3600) / 10.0 - 180 AS lon, (c_custkey % 1200) / 10.0 - 60 AS lat FROM customer), b AS (SELECT iso3, min(lon) AS x1, max(lon) AS x2, min(lat) AS y1, max(lat) AS y2 FROM c GROUP BY 1),
    t AS (SELECT iso3, unnest(range(floor((x1 + 180) / 5)::INT, floor((x2 + 180) / 5)::INT + 1)) AS tile_x, y1, y2 FROM b)
    SELECT DISTINCT CAST(iso3 AS VARCHAR) AS iso3, CAST(tile_x AS INTEGER) AS tile_x, CAST(unnest(range(floor((y1 + 90) / 5)::INT, floor((y2 + 90) / 5)::INT + 1)) AS INTEGER) AS tile_y FROM t
""")
def country_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that a country reaches."""
    k = F.col("c_custkey")
    cells = parquet(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("iso3"), (k % 3600 / 10.0 - 180).alias("Longitude"), (k % 1200 / 10.0 - 60).alias("Latitude"))
    return zonal.country_tiles(cells)


# --- events, folds, metrics ---------------------------------------------------------------------------------------

_EVENTS = """rows_ AS (SELECT date_trunc('month', o_orderdate)::DATE AS event, n_regionkey AS country, n_nationkey AS unit, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 250000 ELSE 0 END AS amount,
                            CASE WHEN o_orderkey % 2 = 0 THEN 'ADM1' ELSE 'ADM0' END AS level FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
    WITH {_EVENTS}, u AS (SELECT event, country, unit, bool_or(amount > 0) AS hit FROM rows_ GROUP BY ALL), s AS (SELECT event, country, avg(hit::INT) AS share FROM u GROUP BY ALL), n AS (SELECT country, count(DISTINCT unit) AS n FROM rows_ GROUP BY 1)
    SELECT DISTINCT event FROM s JOIN n USING (country) WHERE (share < 1 OR n = 1) AND event IN (SELECT event FROM rows_ WHERE amount > 100) AND event IN (SELECT event FROM rows_ WHERE level <> 'ADM0')
""")
def usable_events(spark: SparkSession, d: str) -> DataFrame:
    """Events that pass the three filters."""
    o = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("event"), F.col("n_regionkey").alias("country"), F.col("n_nationkey").alias("unit"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") - 250000).otherwise(F.lit(0.0)).alias("amount"), F.when(F.col("o_orderkey") % 2 == 0, "ADM1").otherwise("ADM0").alias("level"))
    return ev.usable_events(rows, "event", "country", "unit", "amount", "level")


@query("""
    SELECT o_orderpriority AS level, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS basin, l_returnflag AS unit, round(avg(l_discount), 6) AS mean_elev, max(l_extendedprice) AS wind, round(sum(l_quantity), 2) AS population
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL
""")
def region_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Means, maxima and sums of regions, without rows that lack a key."""
    lines = parquet(spark, d, "lineitem").join(parquet(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_orderpriority").alias("level"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("basin"), F.col("l_returnflag").alias("unit"), F.col("l_discount").alias("mean_elev"), F.col("l_extendedprice").alias("wind"), F.col("l_quantity").alias("population"))
    out = ev.rolled_up(rows, ["level", "basin", "unit"], ["mean_elev"], ["wind"], ["population"])
    return out.withColumns({"mean_elev": r("mean_elev", 6), "population": r("population", 2)})


def _fold_sql(on: str) -> str:
    return f"""
        WITH e AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS event, date_trunc('month', o_orderdate)::DATE AS date, strftime(o_orderdate, '%m') AS basin FROM orders)
        SELECT t.event AS test_event, r.event AS train_event FROM e t JOIN e r ON {on}
    """


def _months(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return parquet(spark, d, "orders").select(F.date_format(day, "yyyy-MM").alias("event"), F.to_date(F.date_trunc("month", day)).alias("date"), F.date_format(day, "MM").alias("basin"))


@query(_fold_sql("t.event <> r.event"))
def folds_global(spark: SparkSession, d: str) -> DataFrame:
    return ev.folds(_months(spark, d), "global")


@query(_fold_sql("r.date < t.date"))
def folds_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return ev.folds(_months(spark, d), "walk_forward")


@query(_fold_sql("t.basin = r.basin AND t.event <> r.event"))
def folds_same_basin(spark: SparkSession, d: str) -> DataFrame:
    return ev.folds(_months(spark, d), "geo_constrained")


@query("""
    WITH t AS (SELECT c_nationkey AS region, c_acctbal AS y FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 3), m AS (SELECT region, median(y) AS m FROM t GROUP BY 1)
    SELECT c_custkey AS id, round(greatest(coalesce(m, (SELECT median(y) FROM t)), 0), 4) AS prediction FROM customer LEFT JOIN m ON region = c_nationkey WHERE c_custkey % 2 = 1
""")
def regional_median(spark: SparkSession, d: str) -> DataFrame:
    """The region's median, or else that of all."""
    rows = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("y"))
    out = me.regional_median(rows.where("id % 2 = 0 AND region <> 3"), rows.where("id % 2 = 1"), "region", "y")
    return out.select("id", r("prediction_perc").alias("prediction"))


_SCORES = "s AS (SELECT l_returnflag AS method, l_quantity - 20 AS y, l_extendedprice / 4000 - 8 AS p FROM lineitem)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), (F.col("l_quantity") - 20).alias("y"), (F.col("l_extendedprice") / 4000 - 8).alias("p"))


@query(f"""
    WITH {_SCORES}, e AS (SELECT method, y, p, t.threshold FROM s CROSS JOIN (VALUES (0.0::DOUBLE), (15.0::DOUBLE)) t(threshold)),
    c AS (SELECT method, threshold, count(*) FILTER (y > threshold AND p > threshold) AS tp, count(*) FILTER (y <= threshold AND p <= threshold) AS tn, count(*) FILTER (y <= threshold AND p > threshold) AS fp,
                 count(*) FILTER (y > threshold AND p <= threshold) AS fn, avg(abs(y - p)) AS mean_e, median(abs(y - p)) AS med_e FROM e GROUP BY ALL)
    SELECT method, threshold, tp, tn, fp, fn, round(mean_e, 6) AS mean_abs_error, round(med_e, 6) AS median_abs_error, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
           round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS csi FROM c
""")
def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts and ratios at both thresholds, for each model."""
    out = me.binary_metrics(_scores(spark, d), "y", "p", ["method"])
    ratios = ["mean_abs_error", "median_abs_error", "precision", "recall", "f1", "accuracy", "specificity", "fpr", "fnr", "csi"]
    return out.withColumns({c: r(c, 6) for c in ratios})


@query(f"""
    WITH {_SCORES}, k AS (SELECT *, CASE WHEN y <= 0 THEN 0 WHEN y <= 15 THEN 1 ELSE 2 END AS a, CASE WHEN p <= 0 THEN 0 WHEN p <= 15 THEN 1 ELSE 2 END AS b FROM s)
    SELECT method, round(avg(abs(y - p)), 6) AS mae, round(median(abs(y - p)), 6) AS medae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse,
           round(1 - avg((a - b) ** 2) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS kappa FROM k GROUP BY 1
""")
def distance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors and weighted kappa, for each model."""
    return me.distance_metrics(_scores(spark, d), "y", "p", ["method"]).select("method", *(r(c, 6).alias(c) for c in ("mae", "medae", "rmse", "kappa")))


@query("""
    WITH n AS (SELECT 3 * count(*) AS n FROM labels WHERE toxic = 1)
    SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL
    SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k FROM labels WHERE toxic = 0) WHERE k <= (SELECT n FROM n)
""")
def balance_classes(spark: SparkSession, d: str) -> DataFrame:
    """All of the rare class and three times as many others."""
    return ev.balanced(parquet(spark, d, "labels").select("doc_id", "toxic"), "toxic", 3, "doc_id")


@query("""
    SELECT n_nationkey AS iso3, r_name AS region, CASE r_name WHEN 'AMERICA' THEN 'North Atlantic' WHEN 'ASIA' THEN 'Western Pacific' END AS cyclone_basin FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def region_basins(spark: SparkSession, d: str) -> DataFrame:
    """The basin of each country's region."""
    both = parquet(spark, d, "nation").join(parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    basins = {"AMERICA": "North Atlantic", "ASIA": "Western Pacific"}
    return both.select(F.col("n_nationkey").alias("iso3"), F.col("r_name").alias("region"), scalar.basin(F.col("r_name"), basins).alias("cyclone_basin"))


@query("""
    WITH p AS (SELECT event_id, CAST(2000 + event_id // 7 % 20 AS INT) AS y, CAST(event_id % 12 + 1 AS INT) AS m, CAST(CASE WHEN event_id % 4 > 0 THEN event_id % 28 + 3 ELSE 1 END AS INT) AS d FROM events)
    SELECT event_id, CASE WHEN d <= CASE WHEN m = 2 THEN CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END THEN make_date(y, m, d) END AS date FROM p
""")
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates from parts: the day defaults to 1, impossible dates are missing; leap years have their 29 February."""
    k = F.col("event_id")
    return parquet(spark, d, "events").select("event_id", scalar.day_of(2000 + F.floor(k / 7) % 20, k % 12 + 1, F.when(k % 4 > 0, k % 28 + 3)).alias("date"))


# --- geometry that is not axis-parallel -----------------------------------------------------------------------------

#: A triangle with a hole, and a unit of two parts; holes run against their outer rings.
_SHAPES = {
    "T": [[(-0.3137, -0.2219), (0.0541, -0.1723), (-0.1213, 0.2127), (-0.3137, -0.2219)], [(-0.2011, -0.1209), (-0.1307, 0.0217), (-0.0703, -0.1031), (-0.2011, -0.1209)]],
    "W": [[(0.0617, -0.2023), (0.2911, -0.1319), (0.1733, -0.0127), (0.0617, -0.2023)], [(0.0229, 0.0431), (0.2117, 0.0923), (0.1109, 0.2719), (-0.0523, 0.2039), (0.0229, 0.0431)]],
}
_EDGES = "e AS (SELECT * FROM (VALUES {}) t(unit, x1, y1, x2, y2))".format(
    ", ".join(f"('{u}', {p[0]}::DOUBLE, {p[1]}::DOUBLE, {q[0]}::DOUBLE, {q[1]}::DOUBLE)" for u, rings in _SHAPES.items() for ring in rings for p, q in zip(ring, ring[1:], strict=False))
)
_INSIDE = "i AS (SELECT vec_id AS pid, unit FROM place JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"
_CENTRES = "c AS (SELECT unit, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy FROM e GROUP BY 1)"


def _shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, "X", rings) for u, rings in _SHAPES.items()], "unit string, iso3 string, rings array<array<struct<x:double,y:double>>>")


@query(f"""
    WITH {_PLACES}, {_EDGES}, {_INSIDE}, {_CENTRES}, n AS (SELECT vec_id AS pid, arg_min(unit, (sqrt((x - cx) ** 2 + (y - cy) ** 2), unit)) AS near FROM place CROSS JOIN c GROUP BY 1)
    SELECT pid, coalesce(unit, near) AS unit, CASE WHEN unit IS NULL THEN 'nearest' ELSE 'inside' END AS how FROM n LEFT JOIN i USING (pid)
""")
def admin_bridge_oblique(spark: SparkSession, d: str) -> DataFrame:
    """Units of points, by oblique polygons and else by the nearest centre."""
    points = _places(spark, d).select(F.col("vec_id").alias("pid"), F.lit("X").alias("iso3"), "x", "y")
    return spatial.match_units(points, _shapes(spark), "iso3", 0.05).select("pid", "unit", "how")


#: A rectangle around each place, on a net of hundredths so that many touch, overlap and nest; the largest hold many others.
_RECTANGLES = """box AS (SELECT vec_id, label, round(x, 2) AS x1, round(y, 2) AS y1, round(round(x, 2) + 0.01 + round(abs(v) / 4, 2), 2) AS x2, round(round(y, 2) + 0.01 + round(abs(w) / 4, 2), 2) AS y2 FROM place)"""


def _rectangles(spark: SparkSession, d: str) -> DataFrame:
    p = _places(spark, d).select("vec_id", "label", r("x", 2).alias("x1"), r("y", 2).alias("y1"), "v", "w")
    p = p.select("vec_id", "label", "x1", "y1", r(F.col("x1") + 0.01 + r(F.abs("v") / 4, 2), 2).alias("x2"), r(F.col("y1") + 0.01 + r(F.abs("w") / 4, 2), 2).alias("y2"))
    corner = lambda i, k: F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{k}").alias("y"))
    return p.withColumn("rings", F.array(F.array(corner(1, 1), corner(2, 1), corner(2, 2), corner(1, 2), corner(1, 1))))


@query(f"""
    WITH {_PLACES}, {_RECTANGLES}, xs AS (SELECT DISTINCT label, unnest([x1, x2]) AS x FROM box), ys AS (SELECT DISTINCT label, unnest([y1, y2]) AS y FROM box),
    xi AS (SELECT label, x AS a, lead(x) OVER (PARTITION BY label ORDER BY x) AS b FROM xs), yi AS (SELECT label, y AS c, lead(y) OVER (PARTITION BY label ORDER BY y) AS d FROM ys),
    cell AS (SELECT DISTINCT label, a, b, c, d FROM xi JOIN yi USING (label) JOIN box USING (label) WHERE x1 <= a AND b <= x2 AND y1 <= c AND d <= y2)
    SELECT label, round(sum((b - a) * (d - c)), 6) AS area FROM cell GROUP BY 1
""")
def union_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of the union of each group's rectangles, which overlap, nest and touch."""
    edges = union.union_edges(_rectangles(spark, d), ["label"], 0.02)
    return union.areas(edges, ["label"]).select("label", r("area", 6).alias("area"))


@query(f"""
    WITH {_PLACES}, {_RECTANGLES}, h AS (SELECT vec_id AS pid, x + 0.0013 AS x, y + 0.0017 AS y FROM place)
    SELECT pid, b.label FROM h JOIN box b ON x > x1 AND x < x2 AND y > y1 AND y < y2 GROUP BY ALL
""")
def dissolved_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The dissolved groups that hold each point: rings stitched from the union's boundary, asked by the even-odd rule."""
    points = _places(spark, d).select(F.col("vec_id").alias("pid"), (F.col("x") + 0.0013).alias("x"), (F.col("y") + 0.0017).alias("y"))
    whole = union.dissolved(_rectangles(spark, d), ["label"], 0.02).select(F.col("label").alias("unit"), "rings")
    return spatial.point_in_polygon(points, whole, 0.05).select("pid", F.col("unit").alias("label"))


#: An oblique triangle at each place, and its edges.
_TRIANGLES = """tri AS (SELECT vec_id, label, x AS ax, y AS ay, x + 0.02 + abs(v) / 8 AS bx, y + w / 16 AS "by", x - v / 16 AS cx, y + 0.03 + abs(w) / 8 AS cy FROM place),
    e AS (SELECT vec_id, label, ax AS x1, ay AS y1, bx AS x2, "by" AS y2 FROM tri UNION ALL SELECT vec_id, label, bx, "by", cx, cy FROM tri UNION ALL SELECT vec_id, label, cx, cy, ax, ay FROM tri)"""


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, v, w = (F.col(c) for c in "xyvw")
    a, b, c = at(x, y), at(x + 0.02 + F.abs(v) / 8, y + w / 16), at(x - v / 16, y + 0.03 + F.abs(w) / 8)
    return _places(spark, d).select("vec_id", "label", F.array(F.array(a, b, c, a)).alias("rings"))


@query(f"""
    WITH {_PLACES}, {_TRIANGLES} SELECT label, round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS x, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS y FROM e GROUP BY 1
""")
def polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Centres of area of groups of oblique triangles."""
    return spatial.centroids(_triangles(spark, d), ["label"]).select("label", r("x", 6).alias("x"), r("y", 6).alias("y"))


@query(f"""
    WITH {_PLACES}, {_RECTANGLES}, c AS (SELECT label, unnest(range(floor((x1 + 0.005 + 180) * 10)::INT, floor((x2 + 0.005 + 180) * 10)::INT + 1)) AS lon_idx, y1, y2 FROM box)
    SELECT DISTINCT label AS iso3, CAST(lon_idx AS INTEGER) AS lon_idx, CAST(unnest(range(floor((y1 + 0.005 + 90) * 10)::INT, floor((y2 + 0.005 + 90) * 10)::INT + 1)) AS INTEGER) AS lat_idx FROM c
""")
def land_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that a group's rectangles touch."""
    moved = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] + 0.005).alias("x"), (p["y"] + 0.005).alias("y"))))  # off the lines between cells
    return grid.land_cells(_rectangles(spark, d).select(F.col("label").alias("iso3"), moved.alias("rings")))


def _passes_sql(step: str) -> str:
    """Each edge (vec_id, label, x1 to y2) with the cells of its box: from which share of it (s) to which (t) it is inside."""
    part = lambda a, b, low: f"CASE WHEN {a} = {b} THEN {{}} ELSE {{}}(({low} - {a}) / ({b} - {a}), ({low} + {step}::DOUBLE - {a}) / ({b} - {a})) END"
    return f"""k AS (SELECT *, unnest(range(floor((least(x1, x2) + 180) / {step}::DOUBLE)::INT, floor((greatest(x1, x2) + 180) / {step}::DOUBLE)::INT + 1)) AS lon_idx FROM e),
    m AS (SELECT *, unnest(range(floor((least(y1, y2) + 90) / {step}::DOUBLE)::INT, floor((greatest(y1, y2) + 90) / {step}::DOUBLE)::INT + 1)) AS lat_idx FROM k),
    g AS (SELECT *, lon_idx * {step}::DOUBLE - 180 AS l, lat_idx * {step}::DOUBLE - 90 AS b FROM m),
    q AS (SELECT *, greatest(0, {part("x1", "x2", "l").format(0, "least")}, {part("y1", "y2", "b").format(0, "least")}) AS s, least(1, {part("x1", "x2", "l").format(1, "greatest")}, {part("y1", "y2", "b").format(1, "greatest")}) AS t FROM g)"""


@query(f"""
    WITH {_PLACES}, {_TRIANGLES}, {_passes_sql("0.1")}
    SELECT label AS iso3, CAST(lon_idx AS INTEGER) AS lon_idx, CAST(lat_idx AS INTEGER) AS lat_idx, 1 AS with_coast,
           round(sum((t - s) * sqrt(((x2 - x1) * cos(radians((y1 + y2) / 2))) ** 2 + (y2 - y1) ** 2) * 111195.0), 2) AS coast_length_meters FROM q WHERE t > s GROUP BY ALL
""")
def coast_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of the boundary in each cell, of oblique triangles."""
    edges = grid.edges_of(_triangles(spark, d), ["label"]).withColumnRenamed("label", "iso3")
    return grid.line_length_by_cell(edges, ["iso3"]).withColumn("coast_length_meters", r("coast_length_meters", 2))


@query(f"""
    WITH {_PLACES}, {_TRIANGLES}, {_passes_sql("0.01")}, border AS (SELECT DISTINCT label, lon_idx, lat_idx FROM q WHERE s <= t),
    w AS (SELECT vec_id, label, min(least(x1, x2)) AS lo, max(greatest(x1, x2)) AS hi, min(least(y1, y2)) AS lob, max(greatest(y1, y2)) AS hib FROM e GROUP BY ALL),
    wk AS (SELECT *, unnest(range(floor((lo + 180) * 100)::INT, floor((hi + 180) * 100)::INT + 1)) AS lon_idx FROM w), wm AS (SELECT *, unnest(range(floor((lob + 90) * 100)::INT, floor((hib + 90) * 100)::INT + 1)) AS lat_idx FROM wk),
    c AS (SELECT vec_id, label, lon_idx, lat_idx, (lon_idx + 0.5)::DOUBLE / 100 - 180 AS px, (lat_idx + 0.5)::DOUBLE / 100 - 90 AS py FROM wm),
    inner_ AS (SELECT c.vec_id, c.label, lon_idx, lat_idx FROM c JOIN e ON c.vec_id = e.vec_id AND (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
    SELECT DISTINCT label AS iso3, CAST(lon_idx AS INTEGER) AS lon_idx, CAST(lat_idx AS INTEGER) AS lat_idx FROM (SELECT label, lon_idx, lat_idx FROM border UNION ALL SELECT label, lon_idx, lat_idx FROM inner_)
""")
def land_cells_oblique(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a hundredth of a degree that oblique triangles touch."""
    return grid.land_cells(_triangles(spark, d).select(F.col("label").alias("iso3"), "rings"), step=0.01)


@query(f"""
    WITH {_PLACES}, {_EDGES}, t AS (SELECT vec_id, label AS sid, x, y, TIMESTAMP '2020-01-01' + INTERVAL 1 HOUR * vec_id AS ts FROM place),
    i AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, unit FROM t JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)),
    f AS (SELECT vec_id, min(sqrt((x - x1 - k * (x2 - x1)) ** 2 + (y - y1 - k * (y2 - y1)) ** 2)) AS far FROM
          (SELECT t.*, e.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS k FROM t CROSS JOIN e) GROUP BY 1),
    s AS (SELECT sid, min(ts) AS a, max(ts) AS z, coalesce(min(ts) FILTER (i.vec_id IS NOT NULL), arg_min(ts, (far, ts))) AS l FROM t LEFT JOIN i USING (vec_id) JOIN f USING (vec_id) GROUP BY 1),
    ev AS (SELECT DISTINCT label AS sid, 'e' || label AS event FROM place WHERE label % 2 = 0)
    SELECT s.sid, a::DATE AS startdate, z::DATE AS enddate, l::DATE AS landfalldate, strftime(l, '%H:%M:%S') AS landfall_time, event FROM s LEFT JOIN ev USING (sid)
""")
def storm_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Landfall from the country's polygons: the first point inside, or else the one nearest to land; with the storm's event."""
    p = _places(spark, d)
    track = p.select("vec_id", F.col("label").alias("sid"), "x", "y", F.expr("timestampadd(HOUR, vec_id, TIMESTAMP '2020-01-01')").alias("ts"))
    events = p.where("label % 2 = 0").select(F.col("label").alias("sid"), F.concat(F.lit("e"), "label").alias("event")).distinct()
    return hazard.storm_metadata(track, _shapes(spark), events, ["sid"], "ts", 0.05).select("sid", "startdate", "enddate", "landfalldate", "landfall_time", "event")


@query("""
    WITH p AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 10, 6) AS lon, round(CAST(embedding[2] AS DOUBLE) * 10, 6) AS lat, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings),
    c AS (SELECT vec_id, v, unnest(range(floor(round((lon - 0.03 + 180) / 0.1, 9))::BIGINT, ceil(round((lon + 0.03 + 180) / 0.1, 9))::BIGINT)) AS lon_idx, lat FROM p),
    t AS (SELECT v, lon_idx, unnest(range(floor(round((lat - 0.03 + 90) / 0.1, 9))::BIGINT, ceil(round((lat + 0.03 + 90) / 0.1, 9))::BIGINT)) AS lat_idx FROM c)
    SELECT CAST(lon_idx AS INTEGER) AS lon_idx, CAST(lat_idx AS INTEGER) AS lat_idx, round(sum(v), 6) AS landslide_risk_sum, round(max(v), 6) AS flood_risk FROM t GROUP BY ALL
""")
def all_touched_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sum and maximum over all pixels whose footprint touches a cell."""
    part = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pixels = parquet(spark, d, "embeddings").select(r(part(0) * 10, 6).alias("lon"), r(part(1) * 10, 6).alias("lat"), part(2).alias("v"))
    cells = zonal.touched_cells(pixels, 0.03)
    out = assemble.joined_layers(zonal.touched_sum(cells, ["lon_idx", "lat_idx"], "v", "landslide_risk_sum"), [zonal.tiles_max(cells, ["lon_idx", "lat_idx"], "v", "flood_risk")], ["lon_idx", "lat_idx"])
    return out.select("lon_idx", "lat_idx", r("landslide_risk_sum", 6).alias("landslide_risk_sum"), r("flood_risk", 6).alias("flood_risk"))


@query("""
    WITH c AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'FJI' WHEN 1 THEN 'NZL' ELSE 'PHL' END AS iso3, CASE WHEN c_custkey % 2 = 0 THEN 170 + c_custkey % 10 ELSE -180 + c_custkey % 8 END + 0.5 AS lon, (c_custkey % 120) / 10.0 - 20 AS lat FROM customer),
    b AS (SELECT iso3, CASE WHEN iso3 = 'PHL' THEN true ELSE lon > 0 END AS east, min(lon) AS x1, max(lon) AS x2, min(lat) AS y1, max(lat) AS y2 FROM c GROUP BY 1, 2),
    t AS (SELECT iso3, unnest(range(floor((x1 + 180) / 5)::INT, floor((x2 + 180) / 5)::INT + 1)) AS tile_x, y1, y2 FROM b)
    SELECT DISTINCT iso3, CAST(tile_x AS INTEGER) AS tile_x, CAST(unnest(range(floor((y1 + 90) / 5)::INT, floor((y2 + 90) / 5)::INT + 1)) AS INTEGER) AS tile_y FROM t
""")
def antimeridian_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of countries on both sides of the antimeridian: each side by itself, others as one box."""
    k = F.col("c_custkey")
    iso3 = F.when(F.col("c_nationkey") % 3 == 0, "FJI").when(F.col("c_nationkey") % 3 == 1, "NZL").otherwise("PHL")
    lon = F.when(k % 2 == 0, 170 + k % 10).otherwise(-180 + k % 8) + 0.5
    return zonal.country_tiles(parquet(spark, d, "customer").select(iso3.alias("iso3"), lon.alias("Longitude"), (k % 120 / 10.0 - 20).alias("Latitude")))


@query("""
    WITH c AS (SELECT n_nationkey, (c_custkey * 7 % 3600) / 10.0 AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_nationkey AS country, round(min(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END), 6)::DOUBLE AS low, round(max(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END), 6)::DOUBLE AS high,
           min(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) < 0 AND max(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END) > 0 AS crosses FROM c GROUP BY 1
""")
def wrapped_longitudes(spark: SparkSession, d: str) -> DataFrame:
    """Longitudes of 0 to 360 on both sides of zero, and which countries lie on both."""
    c = parquet(spark, d, "customer").select(F.col("c_nationkey").alias("country"), scalar.wrap_longitude(F.col("c_custkey") * 7 % 3600 / 10.0).alias("lon"))
    out = c.groupBy("country").agg(F.min("lon").alias("low"), F.max("lon").alias("high"))
    return out.select("country", r("low", 6).alias("low"), r("high", 6).alias("high"), scalar.crosses_zero(F.col("low"), F.col("high")).alias("crosses"))


@query("""
    SELECT event_id, round(value - 20, 6) AS lon, CAST(user_id % 160 - 80 AS DOUBLE) AS lat, nullif(event_id % 130, 128) AS class FROM events WHERE value - 20 BETWEEN -10.5 AND 30 AND user_id % 160 - 80 BETWEEN -60 AND 60
""")
def clipped_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels inside a country's box, fill values masked."""
    pixels = parquet(spark, d, "events").select("event_id", (F.col("value") - 20).alias("lon"), (F.col("user_id") % 160 - 80).cast("double").alias("lat"), (F.col("event_id") % 130).alias("class"))
    return zonal.clipped(pixels, (-10.5, -60.0), (30.0, 60.0), "class").withColumn("lon", r("lon", 6))


@query("""
    WITH p AS (SELECT c_custkey AS id, c_custkey % 360 - 180 AS lon, c_custkey % 160 - 80 AS lat FROM customer)
    SELECT id, round(radians(lon) * 6378137, 3) AS x, round(ln(tan(radians(45 + lat / 2))) * 6378137, 3) AS y, lon::DOUBLE AS lon, lat::DOUBLE AS lat FROM p
""")
def web_map_places(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to metres of web maps and back."""
    k = F.col("c_custkey")
    x, y = scalar.to_mercator(k % 360 - 180, k % 160 - 80)
    rows = parquet(spark, d, "customer").select(k.alias("id"), x.alias("x"), y.alias("y"))
    lon, lat = scalar.from_mercator(F.col("x"), F.col("y"))
    return rows.select("id", r("x", 3).alias("x"), r("y", 3).alias("y"), (r(lon, 6) + 0.0).alias("lon"), (r(lat, 6) + 0.0).alias("lat"))


@query("""
    WITH p AS (SELECT c_custkey AS id, round(c_acctbal / 7, 6) AS lat, round(c_nationkey / 3.0, 6)::DOUBLE AS lon FROM customer), u AS (SELECT lat, lon, min(id) AS idx FROM p GROUP BY ALL)
    SELECT id, idx FROM p JOIN u USING (lat, lon)
""")
def rounded_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cells looked up in a table of unique places, by coordinates rounded to six digits."""
    cells = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 7).alias("lat"), (F.col("c_nationkey") / 3).alias("lon"))
    places = cells.groupBy(r("lat", 6).alias("lat"), r("lon", 6).alias("lon")).agg(F.min("id").alias("idx"))
    return spatial.rounded_lookup(cells, places, ["lat", "lon"]).select("id", "idx")


# --- strings ------------------------------------------------------------------------------------------------------

@query("""
    SELECT o_orderkey, split_part(replace(f, '.tif', ''), '_', 2) AS tile, CAST(substring(sid, 1, 4) AS INTEGER) AS year, o_orderpriority || substring(sid, 1, 4) AS typhoon,
           starts_with(f, '3B-HHR') AND ends_with(f, '.tif') AS wanted, lower(trim(' ' || o_orderpriority || '  ')) = '1-urgent' AS urgent
    FROM (SELECT *, strftime(o_orderdate, '%Y%j') || 'N' || o_custkey AS sid, CASE WHEN o_orderkey % 3 = 0 THEN '3B-HHR_' ELSE 'srtm_' END || o_custkey || '_x' || CASE WHEN o_orderkey % 2 = 0 THEN '.tif' ELSE '.zip' END AS f FROM orders)
""")
def file_and_storm_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts of file names, the year in a storm's key, names with years, and names compared without case and blanks."""
    k = F.col("o_orderkey")
    sid = F.concat(F.date_format("o_orderdate", "yyyyDDD"), F.lit("N"), F.col("o_custkey"))
    name = F.concat(F.when(k % 3 == 0, "3B-HHR_").otherwise("srtm_"), F.col("o_custkey"), F.lit("_x"), F.when(k % 2 == 0, ".tif").otherwise(".zip"))
    rows = parquet(spark, d, "orders").select("o_orderkey", "o_orderpriority", sid.alias("sid"), name.alias("f"))
    return rows.select(
        "o_orderkey", scalar.name_part(F.col("f"), ".tif", 2).alias("tile"), scalar.year_of_storm(F.col("sid")).alias("year"), scalar.named_storm(F.col("o_orderpriority"), F.col("sid")).alias("typhoon"),
        scalar.has_form(F.col("f"), "3B-HHR", ".tif").alias("wanted"), scalar.same_name(F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")), F.lit("1-Urgent")).alias("urgent"),
    )


# --- expansion, national targets, the training table --------------------------------------------------------------

_UNITS = """u AS (SELECT DISTINCT 'R' || n_regionkey AS "GID_0", 'N' || n_nationkey AS "GID_1", 'N' || n_nationkey || '.' || (c_custkey % 3) AS "GID_2" FROM customer JOIN nation ON c_nationkey = n_nationkey),
    rep AS (SELECT o_orderkey AS event, 'R' || n_regionkey AS "GID_0", CASE o_orderkey % 4 WHEN 0 THEN 'ADM1' WHEN 1 THEN 'ADM2' WHEN 2 THEN 'ADM0' ELSE 'ADM1' END AS level, CASE WHEN o_orderkey % 4 <> 2 THEN 'N' || n_nationkey END AS "GID_1",
                   CASE WHEN o_orderkey % 4 = 1 THEN 'N' || n_nationkey || '.' || (c_custkey % 3) END AS "GID_2", o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _level_reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation, customer = parquet(spark, d, "nation"), parquet(spark, d, "customer")
    cells = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    gid0, gid1 = F.concat(F.lit("R"), "n_regionkey"), F.concat(F.lit("N"), "n_nationkey")
    gid2 = F.concat(gid1, F.lit("."), F.col("c_custkey") % 3)
    units = cells.select(gid0.alias("GID_0"), gid1.alias("GID_1"), gid2.alias("GID_2")).distinct()
    kind = F.col("o_orderkey") % 4
    o = parquet(spark, d, "orders").join(cells, F.col("o_custkey") == F.col("c_custkey"))
    level = F.when(kind == 1, "ADM2").when(kind == 2, "ADM0").otherwise("ADM1")
    reports = o.select(F.col("o_orderkey").alias("event"), gid0.alias("GID_0"), level.alias("level"), F.when(kind != 2, gid1).alias("GID_1"), F.when(kind == 1, gid2).alias("GID_2"), F.col("o_totalprice").alias("amount"))
    return units, reports


@query(f"""
    WITH {_UNITS}
    SELECT rep.event, u."GID_0", u."GID_1", u."GID_2", CASE WHEN level = 'ADM0' OR (level = 'ADM1' AND rep."GID_1" = u."GID_1") OR (level = 'ADM2' AND rep."GID_1" = u."GID_1" AND rep."GID_2" = u."GID_2") THEN amount ELSE 0 END AS amount
    FROM rep JOIN u ON rep."GID_0" = u."GID_0"
""")
def impact_expand_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Every event with every second-level unit of its country; which keys match depends on the report's level."""
    units, reports = _level_reports(spark, d)
    return impact.expanded_by_level(reports, reports, units, "event", "amount")


@query("""
    WITH i AS (SELECT l_suppkey AS sid, CASE WHEN l_partkey % 5 = 0 THEN 'A' ELSE 'B' END AS iso3, 'g' || l_linenumber AS g1, l_extendedprice AS a, l_quantity AS p FROM lineitem)
    SELECT sid, iso3, 'G' || iso3 AS "GID_0", arg_min('L' || substring(g1, 2), g1) AS level, max(a) AS "Total Affected", max(p) AS perc_affected_pop_grid_region FROM i GROUP BY 1, 2
""")
def national_impact(spark: SparkSession, d: str) -> DataFrame:
    """One target for each storm of a country without units."""
    iso3 = F.when(F.col("l_partkey") % 5 == 0, "A").otherwise("B")
    rows = parquet(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("sid"), iso3.alias("iso3"), F.concat(F.lit("G"), iso3).alias("GID_0"), F.concat(F.lit("g"), "l_linenumber").alias("GID_1"), F.lit(None).cast("string").alias("GID_2"),
        F.concat(F.lit("L"), "l_linenumber").alias("level"), F.col("l_extendedprice").alias("Total Affected"), F.col("l_quantity").alias("perc_affected_pop_grid_region"),
    )
    return assemble.national_impact(rows)


_STAGES = """c AS (SELECT 'c' || c_custkey AS id, 'N' || c_nationkey AS iso3, CASE WHEN c_nationkey % 4 = 0 THEN 'N' || c_nationkey ELSE 'N' || c_nationkey || '.' || (c_custkey % 3) END AS g1, c_acctbal AS bal FROM customer),
    w AS (SELECT DISTINCT 'c' || o_custkey AS id, 'N' || c_nationkey AS iso3, 's' || (o_orderkey % 40) AS sid, (o_orderkey % 40) + 0.5 AS wind_speed FROM orders JOIN customer ON o_custkey = c_custkey),
    i AS (SELECT 's' || (l_orderkey % 40) AS sid, 'N' || s_nationkey AS iso3, 'C' || s_nationkey AS g0, 'N' || s_nationkey || '.' || (l_linenumber % 3) AS g1, 'ADM1' AS level, max(l_extendedprice) AS total, max(l_quantity) AS perc FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    r AS (SELECT 'c' || o_custkey AS id, 'N' || c_nationkey AS iso3, 's' || (o_orderkey % 40) AS sid, max(o_totalprice) AS rain FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL),
    e AS (SELECT DISTINCT 's' || (l_orderkey % 40) AS sid, 'N' || s_nationkey AS iso3, 'd' || (l_orderkey % 40) || s_nationkey AS dis FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    h AS (SELECT c.id, c.iso3, e.dis, length(e.dis) AS n FROM c JOIN e ON c.iso3 = e.iso3 WHERE length(c.id) % 2 = 0)"""


def _stage_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    of = lambda prefix, c: F.concat(F.lit(prefix), c)
    storm = lambda c: of("s", F.col(c) % 40)
    customer = parquet(spark, d, "customer")
    orders = parquet(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = parquet(spark, d, "lineitem").join(parquet(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    iso, cell, none = of("N", F.col("c_nationkey")), of("c", F.col("c_custkey")), F.lit(None).cast("string")
    unit = F.when(F.col("c_nationkey") % 4 == 0, iso).otherwise(F.concat(iso, F.lit("."), F.col("c_custkey") % 3))
    place = of("N", F.col("s_nationkey"))
    storms = lines.select(storm("l_orderkey").alias("sid"), place.alias("GID_0"), F.concat(F.lit("d"), F.col("l_orderkey") % 40, F.col("s_nationkey")).alias("DisNo.")).distinct()
    admin = customer.select(cell.alias("id"), iso.alias("iso3"), unit.alias("GID_1"), none.alias("GID_2"))
    return {
        "wind": orders.select(cell.alias("id"), iso.alias("iso3"), storm("o_orderkey").alias("sid"), (F.col("o_orderkey") % 40 + 0.5).alias("wind_speed")).distinct(),
        "admin": admin,
        "impact": lines.groupBy(storm("l_orderkey").alias("sid"), place.alias("iso3"), of("C", F.col("s_nationkey")).alias("GID_0"), F.concat(place, F.lit("."), F.col("l_linenumber") % 3).alias("GID_1"), none.alias("GID_2"), F.lit("ADM1").alias("level"))
        .agg(F.max("l_extendedprice").alias("Total Affected"), F.max("l_quantity").alias("perc_affected_pop_grid_region")),
        "rain": orders.where("o_orderstatus = 'F'").groupBy(cell.alias("id"), iso.alias("iso3"), storm("o_orderkey").alias("sid")).agg(F.max("o_totalprice").alias("rainfall_max_24h")),
        "storms": storms,
        "history": admin.join(storms.withColumnRenamed("GID_0", "iso3"), "iso3").where("length(id) % 2 = 0").select("id", "iso3", "`DisNo.`", F.length("`DisNo.`").alias("N_events_5_years")),
        "static": customer.select(cell.alias("id"), iso.alias("iso3"), F.col("c_acctbal").alias("population")),
    }


@query(f"""
    WITH {_STAGES}, nat AS (SELECT iso3 FROM c GROUP BY 1 HAVING bool_and(g1 = iso3)), d AS (SELECT w.*, c.g1 FROM w JOIN c USING (id, iso3)),
    t AS (SELECT d.id, d.iso3, d.sid, wind_speed, d.g1, i.g0, level, total, perc FROM d JOIN i ON d.sid = i.sid AND d.g1 = i.g1 WHERE d.iso3 NOT IN (FROM nat)
          UNION ALL SELECT d.id, d.iso3, d.sid, wind_speed, d.g1, k.g0, level, total, perc FROM d JOIN (SELECT sid, iso3, min(g0) AS g0, min(level) AS level, max(total) AS total, max(perc) AS perc FROM i GROUP BY 1, 2) k ON d.sid = k.sid AND d.iso3 = k.iso3 WHERE d.iso3 IN (FROM nat))
    SELECT t.id, t.iso3, t.sid, wind_speed, t.g1 AS unit, g0 AS country, level, total AS affected, perc, coalesce(rain, 0) AS rain, e.dis AS event, CAST(coalesce(n, 0) AS INTEGER) AS n_events, bal AS population
    FROM t LEFT JOIN r USING (id, iso3, sid) LEFT JOIN e ON t.sid = e.sid AND t.iso3 = e.iso3 LEFT JOIN h ON h.id = t.id AND h.iso3 = t.iso3 AND h.dis = e.dis JOIN c ON c.id = t.id
""")
def training_table(spark: SparkSession, d: str) -> DataFrame:
    """The training table from its stages: units, targets by unit or by country, rain, event, history and static layers."""
    return _training_columns(assemble.training_table(**_stage_tables(spark, d), join_on="admin"))


def _training_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "iso3", "sid", "wind_speed", F.col("GID_1").alias("unit"), F.col("GID_0").alias("country"), "level", F.col("`Total Affected`").alias("affected"), F.col("perc_affected_pop_grid_region").alias("perc"),
        F.col("rainfall_max_24h").alias("rain"), F.col("`DisNo.`").alias("event"), F.col("N_events_5_years").alias("n_events"), "population",
    )


@query(f"""
    WITH {_STAGES}, j AS (SELECT 's' || ((o_orderkey + 1) % 40) AS sid, 'c' || o_custkey AS id, 'C' || c_nationkey AS g0, 'ADM1' AS level, max(o_totalprice) AS total, max(o_totalprice) / 10000 AS perc FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    t AS (SELECT w.*, c.g1, g0, level, total, perc FROM w JOIN c USING (id, iso3) JOIN j ON j.sid = w.sid AND j.id = w.id)
    SELECT t.id, t.iso3, t.sid, wind_speed, t.g1 AS unit, g0 AS country, level, total AS affected, perc, coalesce(rain, 0) AS rain, e.dis AS event, CAST(coalesce(n, 0) AS INTEGER) AS n_events, bal AS population
    FROM t LEFT JOIN r USING (id, iso3, sid) LEFT JOIN e ON t.sid = e.sid AND t.iso3 = e.iso3 LEFT JOIN h ON h.id = t.id AND h.iso3 = t.iso3 AND h.dis = e.dis JOIN c ON c.id = t.id
""")
def training_table_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """The training table with targets joined on the cell, the default of the command."""
    orders = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    cells = orders.groupBy(
        F.concat(F.lit("s"), (F.col("o_orderkey") + 1) % 40).alias("sid"), F.concat(F.lit("c"), "o_custkey").alias("id"), F.concat(F.lit("N"), "c_nationkey").alias("iso3"), F.concat(F.lit("C"), "c_nationkey").alias("GID_0"),
        none.alias("GID_1"), none.alias("GID_2"), F.lit("ADM1").alias("level"),
    ).agg(F.max("o_totalprice").alias("Total Affected"), (F.max("o_totalprice") / 10000).alias("perc_affected_pop_grid_region"))
    return _training_columns(assemble.training_table(**_stage_tables(spark, d) | {"impact": cells}, join_on="id"))


_PREPARED = """x AS (SELECT 'e' || strftime(o_orderdate, '%Y%m') || n_regionkey AS event, 's' || strftime(o_orderdate, '%Y%m') AS sid, CASE WHEN o_orderkey % 2 = 0 THEN 'ADM1' ELSE 'ADM0' END AS level, 'C' || n_regionkey AS g0, 'u' || n_nationkey AS g1, 'I' || n_regionkey AS iso3,
            CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice - 250000 ELSE 0 END AS total, o_totalprice / 10000 AS perc, o_orderkey % 50 AS wind, c_acctbal AS bal, date_trunc('month', o_orderdate)::DATE AS month, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _training_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    month, key = F.date_format("o_orderdate", "yyyyMM"), F.col("o_orderkey")
    event = F.concat(F.lit("e"), month, "n_regionkey")
    rows = o.select(
        event.alias("DisNo."), F.concat(F.lit("s"), month).alias("sid"), F.when(key % 2 == 0, "ADM1").otherwise("ADM0").alias("level"), F.concat(F.lit("C"), "n_regionkey").alias("GID_0"), F.concat(F.lit("u"), "n_nationkey").alias("GID_1"),
        F.concat(F.lit("I"), "n_regionkey").alias("iso3"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") - 250000).otherwise(F.lit(0.0)).alias("Total Affected"),
        (F.col("o_totalprice") / 10000).alias("perc_affected_pop_grid_region"), (key % 50).cast("double").alias("wind_speed"), F.col("c_acctbal").alias("population"), key.alias("_row"),
        *(F.lit(1.0).alias(c) for c in [*ev.MEANS, "rainfall_max_24h", "N_events_5_years"]),
    )
    regions = parquet(spark, d, "region").select(F.concat(F.lit("I"), "r_regionkey").alias("iso3"), F.when(F.col("r_regionkey") % 2 == 0, "Caribbean").otherwise("Melanesia").alias("region"))
    reports = o.select(event.alias("DisNo."), F.year("o_orderdate").alias("Start Year"), F.month("o_orderdate").alias("Start Month"), F.lit(None).cast("int").alias("Start Day")).distinct()
    return rows, regions, reports


@query(f"""
    WITH {_PREPARED}, u AS (SELECT event, g0, g1, bool_or(total > 0) AS hit FROM x GROUP BY ALL), s AS (SELECT event, g0, avg(hit::INT) AS share FROM u GROUP BY ALL), n AS (SELECT g0, count(DISTINCT g1) AS n FROM x GROUP BY 1),
    k AS (SELECT DISTINCT event FROM s JOIN n USING (g0) WHERE (share < 1 OR n = 1) AND event IN (SELECT event FROM x WHERE total > 100) AND event IN (SELECT event FROM x WHERE level <> 'ADM0'))
    SELECT event, sid, level, g0, g1, iso3, CASE WHEN n_regionkey % 2 = 0 THEN 'North Atlantic' ELSE 'South Pacific' END AS basin, month AS date, max(wind)::DOUBLE AS wind_speed, max(total) AS affected, max(perc) AS perc, round(sum(bal), 2) AS population FROM x
    WHERE event IN (FROM k) GROUP BY ALL
""")
def prepared_training(spark: SparkSession, d: str) -> DataFrame:
    """The model's rows: usable events with basin and date, rolled up to regions."""
    out = ev.prepared(*_training_rows(spark, d))
    return out.select(
        F.col("`DisNo.`").alias("event"), "sid", "level", F.col("GID_0").alias("g0"), F.col("GID_1").alias("g1"), "iso3", F.col("cyclone_basin").alias("basin"), "date", "wind_speed",
        F.col("`Total Affected`").alias("affected"), F.col("perc_affected_pop_grid_region").alias("perc"), r("population", 2).alias("population"),
    )


@query("""
    WITH x AS (SELECT 'e' || strftime(o_orderdate, '%Y') AS event, date_trunc('year', o_orderdate)::DATE AS date, c_nationkey AS iso3, o_totalprice - 200000 AS y FROM orders JOIN customer ON o_custkey = c_custkey),
    t AS (SELECT DISTINCT event, date FROM x), m AS (SELECT t.event, x.iso3, median(y) AS m FROM t JOIN x ON x.date < t.date GROUP BY ALL), g AS (SELECT t.event, median(y) AS m FROM t JOIN x ON x.date < t.date GROUP BY 1)
    SELECT x.event, x.iso3, x.y, greatest(coalesce(m.m, g.m), 0) AS prediction FROM x JOIN g USING (event) LEFT JOIN m ON m.event = x.event AND m.iso3 = x.iso3
""")
def leave_one_out_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each year predicted by the medians of the years before it."""
    from gridimpact.ml.models import Historical, leave_one_out

    o = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.concat(F.lit("e"), F.year("o_orderdate")).alias("DisNo."), F.to_date(F.date_trunc("year", "o_orderdate")).alias("date"), F.lit("N").alias("cyclone_basin"), F.col("c_nationkey").alias("iso3"), (F.col("o_totalprice") - 200000).alias("y"))
    return leave_one_out(rows, Historical(target="y"), "walk_forward", method="historical").select("event", "iso3", "y", F.col("prediction_perc").alias("prediction"))


@query(f"""
    WITH {_SCORES}, k AS (SELECT *, CASE WHEN y <= 0 THEN 0 WHEN y <= 15 THEN 1 ELSE 2 END AS a, CASE WHEN p <= 0 THEN 0 WHEN p <= 15 THEN 1 ELSE 2 END AS b FROM s),
    c AS (SELECT method, t.threshold, count(*) FILTER (y > threshold AND p > threshold) AS tp, count(*) FILTER (y <= threshold AND p > threshold) AS fp FROM s CROSS JOIN (VALUES (0.0::DOUBLE), (15.0::DOUBLE)) t(threshold) GROUP BY ALL),
    e AS (SELECT method, round(avg(abs(y - p)), 6) AS mae, round(1 - avg((a - b) ** 2) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS kappa FROM k GROUP BY 1)
    SELECT method, threshold, tp, fp, mae, kappa FROM c JOIN e USING (method)
""")
def all_models(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of metrics of all models in one table."""
    return me.all_models(_scores(spark, d), "y", "p").select("method", "threshold", "tp", "fp", r("mae", 6).alias("mae"), r("kappa", 6).alias("kappa"))


@query("""
    WITH e AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS event, date_trunc('month', o_orderdate)::DATE AS date, strftime(o_orderdate, '%m') AS basin FROM orders)
    SELECT event, date, basin, (SELECT count(*) FROM e b WHERE b.date < a.date) AS n_train FROM e a
""")
def ranked_events(spark: SparkSession, d: str) -> DataFrame:
    """How many events a walk-forward model of each event is trained on."""
    return ev.ranked_events(_months(spark, d)).select("event", "date", "basin", "n_train")


@query("""
    WITH p AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)
    SELECT k, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, arg_min(q, (l_orderkey, l_linenumber)) AS q FROM p GROUP BY 1
""")
def first_of_each_key(spark: SparkSession, d: str) -> DataFrame:
    """The first values of each key in a stated order; of rows that are equal in it, those that stand first in the table."""
    place = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "row_index")]
    rows = parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), *place)
    return assemble.first_known_by(rows, ["k"], ["l_orderkey", "l_linenumber", "_file_path", "_row_index"], ["l_orderkey", "q"])


# --- models -------------------------------------------------------------------------------------------------------

#: Rows with two features of which one is sometimes missing, and all data where splits may fall.
_TREE_ROWS = """x AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 5 <> 0 THEN p_size::DOUBLE END AS f0, (p_partkey % 7)::DOUBLE AS f1,
              CASE WHEN p_partkey % 5 = 0 THEN 40 WHEN p_size > 30 THEN p_size - 20 ELSE p_partkey % 7 END::DOUBLE AS y FROM part),
    b AS (SELECT round(avg(y), 9) AS base FROM x), cuts AS (SELECT DISTINCT 0 AS f, f0 AS c FROM x WHERE f0 IS NOT NULL UNION SELECT DISTINCT 1, f1 FROM x WHERE f1 IS NOT NULL)"""


def _level_sql(rows: str, k: int) -> str:
    """The best split of each node of `rows` (row_id, node, f0, f1, g) as s{k}, and the rows in the nodes below as n{k}."""
    return f"""u{k} AS (SELECT node, 0 AS f, f0 AS v, g FROM {rows} UNION ALL SELECT node, 1, f1, g FROM {rows}),
    a{k} AS (SELECT node, f, c, sum(g) FILTER (v <= c) AS kg, count(*) FILTER (v <= c) AS kh, sum(g) FILTER (v IS NULL) AS mg, count(*) FILTER (v IS NULL) AS mh, sum(g) AS tg, count(*) AS th FROM u{k} JOIN cuts USING (f) GROUP BY ALL),
    d{k} AS (SELECT node, f, c, side, coalesce(kg, 0) + side * coalesce(mg, 0) AS lg, kh + side * mh AS lh, tg, th FROM a{k} CROSS JOIN (VALUES (1), (0)) v(side)),
    s{k} AS (SELECT *, lg ** 2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg ** 2 / (th + 1) AS gain FROM d{k} WHERE lh >= 1 AND th - lh >= 1
             QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, c, side DESC) = 1),
    n{k} AS (SELECT r.row_id, 2 * r.node + CASE WHEN coalesce(CASE s.f WHEN 0 THEN f0 ELSE f1 END <= s.c, s.side = 1) THEN 1 ELSE 2 END AS node, f0, f1, g FROM {rows} r JOIN s{k} s ON r.node = s.node AND s.gain > 1e-6)"""


def _tree(spark: SparkSession, d: str):
    """A model of one tree of two levels, its features, and the rows."""
    from gridimpact.ml.boosting import Boosting
    from gridimpact.ml.models import Boosted

    key = F.col("p_partkey")
    size = F.when(key % 5 == 0, F.lit(40.0)).when(F.col("p_size") > 30, F.col("p_size") - 20.0).otherwise(key % 7)
    rows = parquet(spark, d, "part").select(key.alias("row_id"), F.when(key % 5 != 0, F.col("p_size").cast("double")).alias("f0"), (key % 7).cast("double").alias("f1"), size.cast("double").alias("y"))
    one = Boosting(rounds=1, depth=2, step=0.5, subsample=1.0, columns=1.0, gamma=0.0)
    return Boosted(["f0", "f1"], "y", "row_id", one).fit(rows), rows


@query(f"""
    WITH {_TREE_ROWS}, r0 AS (SELECT row_id, 0 AS node, f0, f1, base - y AS g FROM x, b), {_level_sql("r0", 0)}, {_level_sql("n0", 1)}
    SELECT node, f AS feature, c AS threshold, side = 1 AS missing_left, round(gain, 3) AS gain, th::DOUBLE AS cover FROM (FROM s0 UNION ALL FROM s1) WHERE gain > 1e-6
""")
def tree_splits(spark: SparkSession, d: str) -> DataFrame:
    """The splits of a boosted tree, with the side that missing values go to and what each gains."""
    forest = _tree(spark, d)[0].forest
    f, cut, left, cover = (x[0, 0] for x in (forest.feature, forest.cut, forest.missing_left, forest.cover))
    score = lambda k: (forest.value[0, 0, k] / 0.5) ** 2 * (cover[k] + 1)  # noqa: E731  G^2 / (H + 1)
    rows = [(k, int(f[k]), float(forest.cuts[f[k]][cut[k]]), bool(left[k]), float(score(2 * k + 1) + score(2 * k + 2) - score(k)), float(cover[k])) for k in range(len(f)) if f[k] >= 0]
    return spark.createDataFrame(rows, "node int, feature int, threshold double, missing_left boolean, gain double, cover double").withColumn("gain", r("gain", 3))


@query(f"""
    WITH {_TREE_ROWS}, r0 AS (SELECT row_id, 0 AS node, f0, f1, base - y AS g FROM x, b), {_level_sql("r0", 0)}, {_level_sql("n0", 1)},
    leaf AS (SELECT row_id, coalesce(n1.node, n0.node, 0) AS node, r0.g FROM r0 LEFT JOIN n0 USING (row_id) LEFT JOIN n1 USING (row_id)),
    v AS (SELECT node, -0.5 * sum(leaf.g) / (count(*) + 1) AS value FROM leaf GROUP BY 1)
    SELECT row_id, round(greatest(base + value, 0), 4) AS prediction FROM leaf JOIN v USING (node), b
""")
def tree_predict(spark: SparkSession, d: str) -> DataFrame:
    """What a boosted tree predicts, with rows of which a feature is missing."""
    model, rows = _tree(spark, d)
    return model.predict(rows).select("row_id", r("prediction_perc").alias("prediction"))


# No SQL can say a hundred rounds: the tests recompute these in plain Python.


def _learning(spark: SparkSession, d: str) -> DataFrame:
    """A target that depends on two of four columns, 0 for most rows; some values are missing."""
    key = F.col("p_partkey")
    p = parquet(spark, d, "part").select(
        key.alias("row_id"), F.col("p_size").cast("double").alias("size"), F.when(key % 13 != 0, F.col("p_retailprice") / 100).alias("price"), F.when(key % 6 != 0, (key % 7).cast("double")).alias("a"), (key % 11).cast("double").alias("b"),
        F.when(F.col("p_size") > 30, F.col("p_size") - 30 + key % 7).otherwise(0).cast("double").alias("y"),
    )
    return p


_FEATURES = ["size", "price", "a", "b"]


@query()
def two_stage_predict(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage predictions of the odd rows from the even ones."""
    from gridimpact.ml.models import TwoStage

    rows = _learning(spark, d)
    out = TwoStage(_FEATURES, "y", "row_id").train_and_predict(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"))
    return out.select("row_id", r("predicted_proba", 6).alias("predicted_proba"), "predicted_bin", r("prediction_perc").alias("prediction_perc"))


@query()
def shap_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Attributions of a boosted regressor; base and attributions add up to the prediction."""
    from gridimpact.ml.models import STAGE, Boosted, attributions

    rows = _learning(spark, d)
    model = Boosted(_FEATURES, "y", "row_id", STAGE).fit(rows)
    shap = attributions(rows, model.forest, _FEATURES, "row_id")
    both = model.predict(rows).select("row_id", F.col("prediction_perc").alias("prediction")).join(shap, "row_id")
    return both.select("row_id", *(r(f"shap_{c}", 6).alias(f"shap_{c}") for c in _FEATURES), r("total", 6).alias("total"), r("prediction", 6).alias("prediction"))


@query()
def boosted_predict(spark: SparkSession, d: str) -> DataFrame:
    """The boosted baseline: predictions of the odd rows from the even ones, not below 0."""
    from gridimpact.ml.models import Boosted

    rows = _learning(spark, d)
    out = Boosted(["size", "a"], "y", "row_id").train_and_predict(rows.where("row_id % 2 = 0"), rows.where("row_id % 2 = 1"))
    return out.select("row_id", r("prediction_perc").alias("prediction_perc"))


@query()
def top_features(spark: SparkSession, d: str) -> DataFrame:
    """The three features with the largest mean absolute attribution."""
    from gridimpact.ml.models import ranked_features

    return ranked_features(shap_attributions(spark, d), _FEATURES)


@query()
def leave_one_out_boosted(spark: SparkSession, d: str) -> DataFrame:
    """Each year and region predicted by a two-stage model of the earlier years, all models trained in one job."""
    from gridimpact.ml.models import TwoStage, leave_one_out

    o = parquet(spark, d, "orders").join(parquet(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.groupBy(
        F.concat_ws("-", F.year("o_orderdate"), "n_regionkey").alias("DisNo."), F.to_date(F.date_trunc("year", "o_orderdate")).alias("date"), F.col("n_regionkey").cast("string").alias("cyclone_basin"),
        F.col("n_nationkey").alias("GID_1"), F.month("o_orderdate").alias("month"),
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.max("c_acctbal").alias("balance"), F.avg(F.when(F.col("o_orderstatus") == "F", F.day("o_orderdate"))).alias("status"),
        F.greatest(F.max("o_totalprice") / 10000 - 30, F.lit(0.0)).alias("y"),
    )
    model = TwoStage(["n", "balance", "status", "month"], "y", ["DisNo.", "GID_1", "month"])
    return leave_one_out(rows, model, "walk_forward", method="two-stage").select("event", F.col("GID_1").alias("unit"), "month", "predicted_bin", r("prediction_perc").alias("prediction"))
