"""From reported disasters to every admin unit of a country, and on to its cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.functions.scalar import admin_units


def parsed_reports(reports: DataFrame, units: str = "Admin Units") -> DataFrame:
    """level and codes of each report."""
    level, codes = admin_units(F.col(units))
    return reports.withColumns({"level": level, "codes": codes})


def located_reports(reports: DataFrame, names: DataFrame) -> DataFrame:
    """A row for each reported unit with its attributes; reports without units, and unknown units, stay with nulls."""
    each = reports.withColumn("code", F.explode_outer("codes")).drop("codes")
    return each.join(names, (each.level == names.unit_level) & (each.code == names.unit_code), "left").drop("unit_level", "unit_code")


def patched_keys(events: DataFrame, patch: DataFrame, key: str, column: str) -> DataFrame:
    """events with missing values of a column taken from a table by key."""
    found = patch.select(key, F.col(column).alias("_patch"))
    return events.join(found, key, "left").withColumn(column, F.coalesce(column, "_patch")).drop("_patch")


def expanded(events: DataFrame, reported: DataFrame, units: DataFrame, event: str, country: str, unit: str, amount: str) -> DataFrame:
    """Every event with every unit of its country: the reported amount, or 0.

    events: a row each (event, country, ...); reported: event, unit, amount (a null unit stands for the whole country).
    """
    all_ = events.join(units.select(country, unit), country)
    part = reported.where(F.col(unit).isNotNull()).groupBy(event, unit).agg(F.max(amount).alias("_part"))
    whole = reported.where(F.col(unit).isNull()).groupBy(event).agg(F.max(amount).alias("_whole"))
    rows = all_.join(part, [event, unit], "left").join(whole, event, "left")
    return rows.withColumn(amount, F.coalesce("_part", "_whole", F.lit(0.0))).drop("_part", "_whole")


def expanded_by_level(events: DataFrame, reported: DataFrame, units: DataFrame, event: str, amount: str) -> DataFrame:
    """Every event with every second-level unit (GID_0, GID_1, GID_2) of its country: the reported amount, or 0.

    events: a row each (event, GID_0); reported: event, level, GID_1, GID_2, amount. A report reaches all units that it names: ADM1 those
    below its GID_1, ADM2 those of its GID_1 and GID_2, any other level the whole country. An event has one level.

    What is said of an event comes together, at most once for each unit, before the event meets units, so their product is not shuffled. A table that
    is both events and reported is read once. Units are a fixed table (some ten thousand in the world) and are broadcast.
    """
    level, first, second, said = (F.col(c) for c in ("level", "GID_1", "GID_2", amount))
    depth = F.when(level == "ADM1", 1).when(level == "ADM2", 2).when(level.isNotNull(), 0)
    reaches = F.col(event).isNotNull() & said.isNotNull() & ((depth == 0) | ((depth == 1) & first.isNotNull()) | ((depth == 2) & first.isNotNull() & second.isNotNull()))
    parts = {"_depth": depth, "_g1": F.when(depth > 0, first), "_g2": F.when(depth > 1, second), "_amount": said}
    parts = {name: F.when(reaches, part).alias(name) for name, part in parts.items()}
    if events is reported:
        rows = events.select(event, "GID_0", *parts.values())
    else:
        none = F.lit(None).cast(events.schema["GID_0"].dataType).alias("GID_0")
        rows = events.select(event, "GID_0").unionByName(reported.select(event, none, *parts.values()), allowMissingColumns=True)
    keys = [event, "GID_0", "_depth", "_g1", "_g2"]
    most = rows.repartition(*keys).groupBy(*keys).agg(F.max("_amount").alias("_amount"))  # dealt first: keys hardly repeat in a task
    report = F.when(F.col("_depth").isNotNull(), F.struct("_depth", "_amount", "_g1", "_g2"))
    each = most.repartition(event).groupBy(event).agg(F.collect_set("GID_0").alias("_countries"), F.collect_list(report).alias("_said"))
    below = units.select("GID_0", "GID_1", "GID_2").distinct().groupBy("GID_0", "GID_1").agg(F.collect_list(F.struct("GID_2")).alias("_below"))
    rows = each.select(event, F.explode("_countries").alias("GID_0"), "_said").join(F.broadcast(below), "GID_0")
    rows = rows.withColumn("_said", F.filter("_said", lambda r: (r["_depth"] == 0) | (r["_g1"] == F.col("GID_1"))))
    rows = rows.select(event, "GID_0", "GID_1", "_said", F.explode("_below").alias("_unit")).select(event, "GID_0", "GID_1", "_unit.GID_2", "_said")
    of_unit = F.array_max(F.filter("_said", lambda r: (r["_depth"] < 2) | (r["_g2"] == F.col("GID_2"))))  # the deepest, then the largest
    return rows.select(event, "GID_0", "GID_1", "GID_2", F.coalesce(of_unit["_amount"], F.lit(0.0)).alias(amount))


def filled_from_largest(rows: DataFrame, event: str, amount: str, columns: list[str]) -> DataFrame:
    """Columns of an event's rows taken from its row with the largest amount that has them."""
    best = rows.groupBy(event).agg(*(F.max_by(c, F.struct(F.col(c).isNotNull(), F.col(amount))).alias(f"_{c}") for c in columns))
    return rows.join(best, event).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def affected_population(cells: DataFrame, events: DataFrame, event: str, units: list[str], amount: str) -> DataFrame:
    """Per event: the population of all cells in units with an amount above 0, each cell once, by its largest population in them (_affected).

    Cells never meet events. Populations are added up for cells of the same units, in the order in which a cell's units count; an event takes from each
    such list the first unit that it reaches. So the rows that meet events are as many as there are combinations of units, not cells.
    """
    people = cells.where("population > 0").select("id", *units, "population").repartition("id")
    each = people.groupBy("id", *units).agg(F.max("population").alias("_p"))
    lists = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_p", F.struct(*units).alias("_u"))), asc=False).alias("_l"))
    sums = lists.select(F.col("_l._u").alias("_units"), F.posexplode("_l._p").alias("_at", "_p")).groupBy("_units", "_at").agg(F.sum("_p").alias("_p"))
    sums = sums.withColumn("_u", F.get("_units", "_at")).alias("c")
    hit = events.distinct().where(F.col(amount) > 0).select(event, *units).distinct().alias("e")
    met = sums.join(hit, [F.col(f"c._u.{u}").eqNullSafe(F.col(f"e.{u}")) for u in units])
    first = met.groupBy(f"e.{event}", "c._units").agg(F.min_by("_p", "_at").alias("_p"))
    return first.groupBy(event).agg(F.sum("_p").alias("_affected"))


def impact_share(cells: DataFrame, events: DataFrame, event: str, units: list[str], amount: str) -> DataFrame:
    """Per event and cell: the amount in per cent of the population of all affected cells, 0 in the others.

    cells: id, units, population; events: event, units, amount, a row for each event and unit. Null units are equal. Events
    without an affected populated cell drop out. The share is of the whole affected region, not of the cell.
    """
    totals = events.distinct().join(affected_population(cells, events, event, units, amount), event)
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # both are small beside their product: whichever is not broadcast keeps many parts
    cell, ev = cells.repartition(n, "id", *units).alias("c"), totals.repartition(n, event, *units).alias("e")
    on = [F.col(f"c.{u}").eqNullSafe(F.col(f"e.{u}")) for u in units]
    hit = (F.col(f"e.{amount}") > 0) & (F.col("c.population") > 0)
    share = F.when(hit, 100 * F.col(f"e.{amount}") / F.col("e._affected")).otherwise(F.lit(0.0))
    others = [x for x in events.columns if x not in units and x != event]
    return cell.join(ev, on).select(f"e.{event}", "c.*", *(F.col(f"e.{x}") for x in others), share.alias("perc_affected_pop_grid_region"))


def totals_by_level(cells: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Sums of a value for every level of a hierarchy (from the whole down) in one aggregate: the levels, depth (how many of them count) and total.

    Columns below a row's depth are NULL; depth tells them from keys that are missing themselves.
    """
    sets = [[F.col(c) for c in levels[:k]] for k in range(1, len(levels) + 1)]
    depth = sum(((1 - F.grouping(c)).cast("int") for c in levels), F.lit(0))
    return cells.groupingSets(sets, *(F.col(c) for c in levels)).agg(depth.alias("depth"), F.sum(value).alias("total"))


def reconciled(cells: DataFrame, reports: DataFrame, levels: Sequence[str], weight: str, event: str = "event") -> DataFrame:
    """event, cell and amount: reports given at several levels, spread over cells so that they add up to what is reported.

    cells: the levels (the whole first, the cell last) and a weight. reports: event, the levels above the cell (NULL below the level that the report is
    about) and amount. A unit without a report of its own has what is reported inside it. From the top down, units for which something is known take
    that, the others of the same unit above share the rest by weight; where what is known adds up to more, or nothing is left that could take the
    rest, it is scaled to the amount above. Units without any weight take nothing; events that nothing is reported for do not occur.
    """
    above = list(levels[:-1])
    depth = sum((F.col(c).isNotNull().cast("int") for c in above), F.lit(0))
    said = reports.where(F.col("amount").isNotNull()).groupBy(event, *above).agg(F.sum("amount").cast("double").alias("amount")).withColumn("_d", depth)
    known: dict[int, DataFrame] = {}
    for k in range(len(above), 0, -1):  # from below
        keys = [event, *above[:k]]
        own = said.where(F.col("_d") == k).select(*keys, F.col("amount").alias("_own"))
        if k < len(above):
            inside = known[k + 1].groupBy(*keys).agg(F.sum("_own").alias("_in"))
            own = own.join(inside, keys, "full").select(*keys, F.coalesce("_own", "_in").alias("_own"))
        known[k] = own
    weights = cells.groupBy(*levels).agg(F.sum(weight).cast("double").alias("_w"))
    shares = known[1].withColumnRenamed("_own", "_share")
    for k in range(1, len(levels)):  # from above
        keys, up = list(levels[: k + 1]), list(levels[:k])
        rows = weights.groupBy(*keys).agg(F.sum("_w").alias("_w")).join(shares, up)
        rows = rows.join(known[k + 1], [event, *keys], "left") if k < len(above) else rows.withColumn("_own", F.lit(None).cast("double"))
        w = Window.partitionBy(event, *up)
        free = F.sum(F.when(F.col("_own").isNull(), F.col("_w"))).over(w)
        rows = rows.withColumns({"_r": F.coalesce(F.sum("_own").over(w), F.lit(0.0)), "_f": F.coalesce(free, F.lit(0.0))})
        scaled = F.coalesce(F.col("_own") * F.try_divide(F.col("_share"), F.col("_r")), F.lit(0.0))
        rest = F.coalesce("_own", (F.col("_share") - F.col("_r")) * F.try_divide(F.col("_w"), F.col("_f")))
        shares = rows.select(event, *keys, F.when((F.col("_r") > F.col("_share")) | (F.col("_f") <= 0), scaled).otherwise(rest).alias("_share"))
    return shares.withColumnRenamed("_share", "amount")
