"""Earlier events of the same country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prior_events(events: DataFrame, group: str, day: str, years: int = 5) -> DataFrame:
    """group, day and events of that group in the `years` before the day; events of the day itself do not count.

    events: a row for each event, already distinct. Days are counted before the window, so a country with very many events is sorted by day only.
    """
    events = events.where(F.col(day).isNotNull() & F.col(group).isNotNull()).withColumn("_d", F.to_date(day))
    counted = prior_counts(events.groupBy(group, "_d").agg(F.count(F.lit(1)).alias("_n")), group, "_d", "_n", years)
    return events.join(counted.drop("_n"), [group, "_d"]).drop("_d")


def prior_counts(days: DataFrame, group: str, day: str, n: str, years: int = 5) -> DataFrame:
    """days (a row for each group and date, with its number of events) with the number of those in the `years` before."""
    earlier = f"sum(`{n}`) OVER (PARTITION BY `{group}` ORDER BY `{day}` RANGE BETWEEN INTERVAL '{years}' YEAR PRECEDING AND CURRENT ROW) - `{n}`"
    return days.select(group, day, n, F.expr(earlier).cast("int").alias("n_prior"))


def broadcast_to_cells(cells: DataFrame, counts: DataFrame, country: str) -> DataFrame:
    """Every cell of a country with every event of it; the small side is broadcast only if Spark finds it small enough."""
    return cells.join(counts, country)
