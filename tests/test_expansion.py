"""Cells and units times events: the product is made once, at the end, and never shuffled."""

from __future__ import annotations

import itertools
import random

from gridimpact.operators import impact


def run(spark, df) -> tuple[list, int]:
    """The rows of df, and how many records its stages shuffled."""
    context = spark.sparkContext
    group = f"shuffled-{id(df)}"
    context.setJobGroup(group, group)
    rows = df.collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(i) for i in context.statusTracker().getJobIdsForGroup(group)]
    store = context._jsc.sc().statusStore()
    return rows, sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in {i for job in jobs for i in job.stageIds})


def test_cells_times_events_are_not_shuffled(spark):
    cells = spark.createDataFrame([(i, f"u{i % 4}", float(i % 7)) for i in range(400)], "id int, unit string, population double")
    events = spark.createDataFrame([(e, f"u{u}", 1.0 + e) for e in range(60) for u in range(4)], "event int, unit string, amount double")
    rows, shuffled = run(spark, impact.impact_share(cells, events, "event", ["unit"], "amount"))
    assert len(rows) == 24_000 and shuffled < 6_000
    people = sum(i % 7 for i in range(400))
    assert all(abs(x.perc_affected_pop_grid_region - (100 * (1 + x.event) / people if x.id % 7 else 0)) < 1e-9 for x in rows)


def test_shares_of_cells_in_several_units(spark):
    """A cell counts once for an event, by its largest population in the units that the event reaches; units may be missing."""
    rng = random.Random(3)
    units = [("A", "a"), ("A", None), (None, "b"), ("B", "b"), (None, None)]
    cells = [(rng.choice([*range(30), None]), *rng.choice(units), rng.choice([None, 0.0, -1.0, *map(float, range(1, 9))])) for _ in range(150)]
    events = [(e, *u, rng.choice([None, 0.0, 5.0, 8.0])) for e in [*range(12), None] for u in units if rng.random() < 0.6]
    out = impact.impact_share(
        spark.createDataFrame(cells, "id int, g1 string, g2 string, population double").repartition(3),
        spark.createDataFrame([*events, events[0]], "event int, g1 string, g2 string, amount double"), "event", ["g1", "g2"], "amount",
    )
    assert out.columns == ["event", "id", "g1", "g2", "population", "amount", "perc_affected_pop_grid_region"]
    most: dict = {}
    pairs = [(c, e) for c, e in itertools.product(cells, events) if c[1:3] == e[1:3]]
    hit = lambda c, e: (e[3] or 0) > 0 and (c[3] or 0) > 0
    for c, e in pairs:
        if hit(c, e):
            most[e[0], c[0]] = max(most.get((e[0], c[0]), 0), c[3])
    total: dict = {}
    for (e, _), p in most.items():
        total[e] = total.get(e, 0) + p
    want = [(e[0], *c, e[3], round(100 * e[3] / total[e[0]] if hit(c, e) else 0.0, 9)) for c, e in pairs if e[0] is not None and e[0] in total]
    assert sorted(((*x[:6], round(x[6], 9)) for x in out.collect()), key=repr) == sorted(want, key=repr)


LEVELS = "event int, GID_0 string, level string, GID_1 string, GID_2 string, amount double"


def by_level(events, reported, units) -> list:
    """(event, GID_0, GID_1, GID_2, amount) by brute force, as the operator's text says."""
    out = []
    for e, g0 in {r[:2] for r in events}:
        for u in units:
            if g0 is None or u[0] != g0:
                continue
            found = {0: [], 1: [], 2: []}
            for event, _, level, g1, g2, amount in reported:
                depth = {"ADM1": 1, "ADM2": 2}.get(level, 0)
                if None not in (event, level, amount) and event == e and (depth < 1 or None is not g1 == u[1]) and (depth < 2 or None is not g2 == u[2]):
                    found[depth].append(amount)
            out.append((e, *u, next((max(found[d]) for d in (2, 1, 0) if found[d]), 0.0)))
    return sorted(out, key=repr)


def test_events_times_units_are_not_shuffled(spark):
    units = [("R", f"N{i % 5}", f"N{i % 5}.{i}") for i in range(40)]
    reports = [(e, "R", ("ADM0", "ADM1", "ADM2")[e % 3], units[e % 40][1], units[e % 40][2], 1.0 + e) for e in range(500)]
    df = spark.createDataFrame(reports, LEVELS)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is with large tables
    try:
        rows, shuffled = run(spark, impact.expanded_by_level(df, df, spark.createDataFrame(units, "GID_0 string, GID_1 string, GID_2 string"), "event", "amount"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(rows) == 20_000 and shuffled < 5_000
    assert sorted(map(tuple, rows), key=repr) == by_level(reports, reports, units)


def test_reports_of_any_form_reach_their_units(spark):
    """Events of several countries and levels, missing keys, repeated reports, reports of unknown events."""
    rng = random.Random(5)
    units = [(g0, g1, g2) for g0 in ("X", "Y") for g1 in ("a", "b", None) for g2 in ("1", "2", None)]
    pick = lambda *values: rng.choice(values)
    reports = [(pick(*range(15), None), pick("X", "Y", None), pick("ADM0", "ADM1", "ADM2", "ADM2", None), pick("a", "b", None), pick("1", "2", None), pick(None, 0.0, -1.0, 2.0, 3.0)) for _ in range(120)]
    events = [r for r in reports if (r[0] or 0) % 2 == 0]
    df, half = (spark.createDataFrame(x, LEVELS).repartition(3) for x in (reports, events))
    of = spark.createDataFrame([*units, units[0]], "GID_0 string, GID_1 string, GID_2 string")
    for given, rows in ((df, reports), (half, events)):
        out = impact.expanded_by_level(given, df, of, "event", "amount")
        assert out.columns == ["event", "GID_0", "GID_1", "GID_2", "amount"]
        assert sorted(map(tuple, out.collect()), key=repr) == by_level(rows, reports, units)
