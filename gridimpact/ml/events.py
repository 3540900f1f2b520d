"""Which events are used, the roll-up to regions, balancing, and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What becomes of the columns of the training table when cells become regions.
MEANS = [
    "coast_length_meters", "with_coast", "mean_elev", "mean_slope", "mean_rug", "urban", "rural", "water", "storm_tide_rp_0010", "landslide_risk_sum",
]
MAXIMA = ["wind_speed", "rainfall_max_24h", "perc_affected_pop_grid_region", "Total Affected", "N_events_5_years"]
ROLL_UP = ["DisNo.", "sid", "level", "GID_0", "GID_1", "iso3", "cyclone_basin", "date"]


def usable_events(rows: DataFrame, event: str, country: str, unit: str, amount: str, level: str, least: float = 100.0) -> DataFrame:
    """Events with a large enough report, below national level, that spare a region of the country or whose country has just one."""
    q = lambda c: F.col(f"`{c}`")
    known = rows.where(q(unit).isNotNull() & q(country).isNotNull())
    large = rows.where(q(amount) > least).select(q(event)).distinct()
    local = rows.where(q(level) != "ADM0").select(q(event)).distinct()
    by_unit = known.groupBy(q(event), q(country), q(unit)).agg(F.bool_or(q(amount) > 0).alias("hit"))
    share = by_unit.groupBy(q(event), q(country)).agg(F.avg(F.coalesce("hit", F.lit(False)).cast("int")).alias("share"))
    sizes = known.groupBy(q(country)).agg(F.count_distinct(q(unit)).alias("n"))
    spared = share.join(sizes, country).where("share < 1 OR n = 1").select(q(event)).distinct()
    return large.join(local, event, "left_semi").join(spared, event, "left_semi")


def rolled_up(rows: DataFrame, keys: list[str], means: list[str], maxima: list[str], sums: list[str]) -> DataFrame:
    """Rows of regions; rows with a missing key have no region and drop out."""
    q = lambda c: F.col(f"`{c}`")
    known = rows.na.drop(subset=keys) if not any("." in k for k in keys) else rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    aggs = [F.avg(q(c)).alias(c) for c in means] + [F.max(q(c)).alias(c) for c in maxima] + [F.sum(q(c)).alias(c) for c in sums]
    return known.groupBy(*(q(k) for k in keys)).agg(*aggs)


def prepared(rows: DataFrame, regions: DataFrame, reports: DataFrame, aggregate: bool = True) -> DataFrame:
    """The training table with basin and date, of usable events, rolled up to first-level regions if asked."""
    from gridimpact.functions.scalar import basin, day_of

    named = regions.select("iso3", "region", basin(F.col("region")).alias("cyclone_basin"))
    dates = reports.select("`DisNo.`", day_of(F.col("Start Year"), F.col("Start Month"), F.col("Start Day")).alias("date")).distinct()
    rows = rows.distinct().join(named, "iso3", "left")
    events = usable_events(rows, "DisNo.", "GID_0", "GID_1", "Total Affected", "level")
    rows = rows.join(events, "DisNo.", "left_semi").join(dates, "DisNo.", "left")
    return rolled_up(rows, ROLL_UP, MEANS, MAXIMA, ["population"]) if aggregate else rows


def balanced(rows: DataFrame, target: str, times: float, key: str | Sequence[str], seed: int = 42) -> DataFrame:
    """All rows of class 1, and the rows of class 0 with the smallest keyed hashes, `times` as many as class 1 at most.

    The hash makes the choice the same in every run. Counts by the first four digits say where the limit falls, and only the rows of
    that one 65,536th are put in order; rows with equal keys are chosen in any order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.md5(F.concat_ws(":", F.lit(seed), *(F.col(f"`{k}`").cast("string") for k in keys)))
    ones = rows.where(F.col(target) == 1)
    zeros = rows.where(F.col(target) == 0).withColumn("_o", order).withColumn("_p", F.substring("_o", 1, 4))
    limit = int(times * ones.count())
    before, edge = 0, None
    for part in zeros.groupBy("_p").count().orderBy("_p").collect():  # at most 65,536 rows
        if before + part["count"] > limit:
            edge = part["_p"]
            break
        before += part["count"]
    if edge is not None:
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_o", *(F.col(f"`{k}`") for k in keys)))
        last = zeros.where(F.col("_p") == edge).withColumn("_n", place).where(F.col("_n") <= limit - before).drop("_n")
        zeros = zeros.where(F.col("_p") < edge).unionByName(last)
    return ones.unionByName(zeros.drop("_o", "_p"))


def chosen_models(rows: DataFrame, models: str, target: str, times: float, key: Sequence[str], out: str, seed: int = 42, all_without: bool = False) -> DataFrame:
    """rows with those of their models (an array of numbers) that they are balanced into, in a new column.

    For each model by itself, all rows of class 1 and the rows of class 0 with the smallest keyed hashes, `times` as many as class 1
    at most; rows with equal keys come or go together. all_without: a model without class 1 takes all of class 0. One limit for each model is found
    for all of them at once: from counts by the hash's first digits, then in order among the rows of one 65,536th.
    """
    own = F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in key))
    rows = rows.withColumn("_o", F.md5(own))
    pairs = rows.select(F.explode(models).alias("m"), F.col(target).alias("y"), "_o", F.substring("_o", 1, 4).alias("p"))
    counts = pairs.groupBy("m", "p").agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros"))  # at most 65,536 rows a model
    w = Window.partitionBy("m")
    limit = F.floor(F.lit(times) * F.sum("ones").over(w))
    placed = counts.select("m", "p", "zeros", limit.alias("limit"), (F.sum("zeros").over(w.orderBy("p")) - F.col("zeros")).alias("before"))
    edges = placed.where("zeros > 0 AND before <= limit AND before + zeros > limit" + (" AND limit > 0" if all_without else ""))
    found = {e.m: [e.p, e.limit - e.before] for e in edges.collect()}  # a row for each model
    if found:
        near = pairs.where("y = 0").join(F.broadcast(edges.select("m", "p", (F.col("limit") - F.col("before")).alias("need"))), ["m", "p"])
        ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy("_o"))).where("n <= need")
        for e in ranked.groupBy("m").agg(F.max("_o").alias("last")).collect():
            found[e.m][0] = e.last
    if not found:
        return rows.withColumn(out, F.col(models)).drop("_o")
    last = F.array(*(F.lit(found[m][0] if m in found else "~") for m in range(max(found) + 1)))  # the largest hash that a model takes; all hashes are below "~"
    takes = lambda m: (F.col(target) == 1) | (F.col("_o") <= F.coalesce(F.get(last, m), F.lit("~")))
    return rows.withColumn(out, F.filter(models, takes)).drop("_o")


def folds(events: DataFrame, strategy: str) -> DataFrame:
    """test_event and train_event of leave-one-out folds; events: event, date, basin. Events without a fold to train on do not occur."""
    e = events.distinct()
    test, train = (e.toDF(*(f"{side}_{c}" for c in ("event", "date", "basin"))) for side in ("test", "train"))
    if strategy == "global":
        on = F.col("test_event") != F.col("train_event")
    elif strategy == "walk_forward":
        on = F.col("train_date") < F.col("test_date")
    elif strategy == "geo_constrained":
        on = (F.col("test_basin") == F.col("train_basin")) & (F.col("test_event") != F.col("train_event"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return test.join(train, on).select("test_event", "train_event")


def ranked_events(events: DataFrame) -> DataFrame:
    """Events in order of date, with the number of strictly earlier ones: enough to say how large each walk-forward fold is."""
    by_day = events.distinct().groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_day.withColumn("n_train", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return events.distinct().join(earlier.select("date", "n_train"), "date")
