"""Earlier events of the same group on a stream, as keyed state that forgets what is too old."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for this state.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def years_before(day: dt.date, years: int) -> dt.date:
    """The same day some years ago; 29 February becomes the 28th where there is none."""
    return (pd.Timestamp(day) - pd.DateOffset(years=years)).date()


def counted(days: dict[dt.date, int], changed: set[dt.date], years: int) -> list[tuple[dt.date, int, int]]:
    """Day, its events and those of the years before it, of every day whose numbers new events at the changed days touch."""
    order = sorted(days)
    total, sums = 0, []  # events before each day
    for day in order:
        sums.append(total)
        total += days[day]
    out, low = [], 0
    first = min(changed)
    for k, day in enumerate(order):
        begin = years_before(day, years)
        while order[low] < begin:
            low += 1
        if day in changed or (day > first and any(begin <= c < day for c in changed)):
            out.append((day, days[day], sums[k] - sums[low]))
    return out


class _Prior(StatefulProcessor):
    """A count for each day of a group; a timer for each day ends it when no event that is still accepted can need it."""

    def __init__(self, years: int):
        self.years = years

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day date", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: Counter = Counter()
        for part in rows:
            new.update(pd.to_datetime(part["day"]).dt.date)
        days = {k[0]: v[0] for k, v in self.days.iterator()} if self.days.exists() else {}
        for day, n in new.items():
            if day not in days:
                until = pd.Timestamp(day) + pd.DateOffset(years=self.years) + pd.Timedelta(days=2)
                self.handle.registerTimer(int(until.timestamp() * 1000))
            days[day] = days.get(day, 0) + n
            self.days.updateValue((day,), (days[day],))
        found = counted(days, set(new), self.years)
        yield pd.DataFrame({"key": [key[0]] * len(found), "day": [x[0] for x in found], "n_events": [x[1] for x in found], "n_prior": [x[2] for x in found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms") - pd.DateOffset(years=self.years) - pd.Timedelta(days=1)
        for day in [k[0] for k in self.days.keys()] if self.days.exists() else []:
            if pd.Timestamp(day) < limit:
                self.days.removeKey((day,))
        yield from ()

    def close(self) -> None:
        pass


def prior_events(events: DataFrame, group: str, time: str, years: int = 5, late: str = "30 days") -> DataFrame:
    """group, day, n_events and n_prior of each day whose numbers a batch changes, for update mode; the last row of a day is its result.

    Both numbers only grow as late events come in (up to `late`), so the largest are the last. The state of a group has a number for each day of the
    years that count, however many events there are. Rows without a group or a time are left out.
    """
    known = events.where(F.col(group).isNotNull() & F.col(time).isNotNull()).select(F.col(group).alias("key"), F.col(time).cast("timestamp").alias("instant"))
    known = known.withWatermark("instant", late).withColumn("day", F.to_date("instant"))
    kind = events.schema[group].dataType.simpleString()
    out = known.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Prior(years), outputStructType=f"key {kind}, day date, n_events long, n_prior long", outputMode="Update", timeMode="EventTime"
    )
    return out.withColumnRenamed("key", group)


def latest(updates: DataFrame, group: str) -> DataFrame:
    """The result of each day from all updates so far."""
    return updates.groupBy(group, "day").agg(F.max("n_events").alias("n_events"), F.max("n_prior").alias("n_prior"))
