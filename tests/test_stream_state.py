"""Earlier events on a stream against the same on a table."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from gridimpact.operators import history
from gridimpact.streaming import prior_events as stream


def batch(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame(rows, "nation string, at timestamp").withColumn("day", F.to_date("at"))
    n = {(r.nation, r.day): r.n for r in df.groupBy("nation", "day").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = {(r.nation, r.day): r.n_prior for r in history.prior_events(df, "nation", "day").collect()}
    return {k: (n[k], prior[k]) for k in n}


def test_days_that_new_events_touch():
    day = dt.date
    days = {day(2000, 2, 29): 2, day(2004, 2, 28): 1, day(2005, 2, 28): 4, day(2005, 3, 1): 1}
    assert stream.counted(days, {day(2000, 2, 29)}, 5) == [(day(2000, 2, 29), 2, 0), (day(2004, 2, 28), 1, 2), (day(2005, 2, 28), 4, 3)]
    assert stream.counted(days, {day(2005, 3, 1)}, 5) == [(day(2005, 3, 1), 1, 5)]


def test_stream_equals_table_with_late_rows_and_forgets(spark, tmp_path):
    for k, v in stream.STORE.items():
        spark.conf.set(k, v)
    rng, start, rows = random.Random(1), dt.datetime(2001, 1, 1), []
    for _ in range(500):
        rows.append((rng.choice(["A", "A", "A", "B", "C"]), start + dt.timedelta(days=rng.randrange(9 * 365), hours=rng.randrange(24))))
    rows.sort(key=lambda r: r[1] + dt.timedelta(days=rng.randrange(25)))  # out of order by less than is allowed
    for k in range(5):
        part = rows[100 * k : 100 * k + 100] + ([(None, start), ("A", None)] if k == 0 else [])
        spark.createDataFrame(part, "nation string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema("nation string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    updates: list = []
    q = stream.prior_events(source, "nation", "at").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    q = q.foreachBatch(lambda df, _: updates.extend(df.collect())).start()
    try:
        q.processAllAvailable()
        removed = sum(p["stateOperators"][0]["numRowsRemoved"] for p in q.recentProgress if p["stateOperators"])
    finally:
        q.stop()
    got = spark.createDataFrame([tuple(r) for r in updates], "nation string, day date, n_events long, n_prior long")
    assert {(r.nation, r.day): (r.n_events, r.n_prior) for r in stream.latest(got, "nation").collect()} == batch(spark, rows)
    assert removed > 50 and len(updates) >= len({(r[0], r[1].date()) for r in rows})  # nine years came in, five are kept
