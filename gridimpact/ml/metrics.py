"""Metrics of predictions as one aggregate over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridimpact.functions.scalar import SEVERE, category, share
from gridimpact.sources.tables import settled


#: Values of a group that one task puts in order, and into how many parts a sketch divides the rest.
MOST_VALUES, PARTS = 50_000, 256
#: Groups whose brackets are sent to all tasks, so that rows stay where they are and a group is not brought into one task.
MOST_GROUPS = 20_000


def medians(rows: DataFrame, by: Sequence[str], value: str | Column, out: str = "median", most: int = MOST_VALUES) -> DataFrame:
    """The exact median of each group (one row where there is no `by`), groups without a value left out.

    No task puts more than `most` different values of a group in order, however they are distributed (see `in_the_middle`).
    """
    keys = [f"_k{i}" for i in range(len(by) + 1)]
    v = F.col(value) if isinstance(value, str) else value
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=False)), F.lit(0).alias(keys[-1]), v.cast("double").alias("_v")).where("_v IS NOT NULL")
    near = in_the_middle(rows, keys, most)
    w = Window.partitionBy(*keys).orderBy("_v")
    near = near.withColumn("_before", F.col("_before") + F.sum("_c").over(w) - F.col("_c"))
    holds = (F.col("_before") < F.floor(F.col("_n") / 2) + 1) & (F.col("_before") + F.col("_c") >= F.floor((F.col("_n") + 1) / 2))
    low, high = F.min("_v"), F.max("_v")
    return near.where(holds).groupBy(*keys).agg(((low + high) / 2).alias(out)).select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=False)), out)


def in_the_middle(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, _v, _c: the different values around the median of each group with their counts, _before (how many rows lie below them all) and _n.

    While a group has more than `most` of them, a mergeable sketch of its quantiles brackets the middle, counts tell what lies below and inside the bracket, and
    only what is inside goes on. Ranks decide, so a few huge values don't matter.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    told = sizes.agg(F.max("_n"), F.count(F.lit(1))).first()
    small = F.broadcast if told[1] <= MOST_GROUPS else lambda groups: groups  # a row for each group
    if (told[0] or 0) <= most:
        counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        return counts.select("*", F.lit(0).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    wide = float("inf")
    state = sizes.select(*keys, "_n", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_in"), F.lit(-wide).alias("_lo"), F.lit(wide).alias("_hi"), F.lit(most + 1).cast("long").alias("_different"))
    ranks = F.array(*(F.lit(k / PARTS) for k in range(PARTS + 1)))
    while True:
        inside = _null_safe(rows, small(state), keys).where("_v >= _lo AND _v <= _hi")
        sketch = inside.where(F.col("_different") > most).groupBy(*keys).agg(F.percentile_approx("_v", ranks, F.lit(20 * PARTS)).alias("_q"))
        middle = (F.col("_n") / 2 - F.col("_before")) / F.col("_in") * PARTS
        at = lambda k: F.get("_q", F.greatest(F.lit(0), F.least(F.lit(PARTS), k)).cast("int"))
        guess = _null_safe(state, sketch, keys).select(*keys, at(F.floor(middle) - 1).alias("_lo2"), at(F.ceil(middle) + 1).alias("_hi2"))
        counted = _null_safe(inside, small(guess), keys).groupBy(*keys).agg(
            F.count_if(F.col("_v") < F.col("_lo2")).alias("_below"), F.count_if(F.col("_v").between(F.col("_lo2"), F.col("_hi2"))).alias("_in2"),
            F.approx_count_distinct(F.when(F.col("_v").between(F.col("_lo2"), F.col("_hi2")), F.col("_v"))).alias("_d2"), F.first("_lo2").alias("_lo2"), F.first("_hi2").alias("_hi2"),
        )
        named = counted.withColumnsRenamed({k: f"_r{k}" for k in keys})
        both = state.join(named, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], "left").drop(*(f"_r{k}" for k in keys))
        below = F.col("_before") + F.col("_below")
        good = F.coalesce((below < F.floor((F.col("_n") + 1) / 2)) & (below + F.col("_in2") >= F.floor(F.col("_n") / 2) + 1), F.lit(False))  # the middle is inside
        pick = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
        shrunk = (good & (F.col("_in2") < F.col("_in"))).alias("_shrunk")
        state = settled(both.select(*keys, "_n", pick(below, "_before"), pick(F.col("_in2"), "_in"), pick(F.col("_lo2"), "_lo"), pick(F.col("_hi2"), "_hi"), pick(F.col("_d2"), "_different"), shrunk), "medians")
        left = state.agg(F.max("_different").alias("most"), F.bool_or("_shrunk").alias("shrunk")).first()
        state = state.drop("_shrunk")
        if left.most <= most or not left.shrunk:
            break
    inside = _null_safe(rows, small(state), keys).where("_v >= _lo AND _v <= _hi")
    return inside.groupBy(*keys, "_v", "_before", "_n").agg(F.count(F.lit(1)).alias("_c"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]).drop(*(f"_r{k}" for k in keys))


def binary_metrics(rows: DataFrame, target: str, predicted: str, by: Sequence[str] = (), thresholds: Sequence[float] = (0.0, SEVERE)) -> DataFrame:
    """A row for each threshold (and each `by`): counts, ratios (0 where the denominator is) and absolute errors."""
    each = rows.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    real, said = F.col(target) > F.col("threshold"), F.col(predicted) > F.col("threshold")
    error = F.abs(F.col(target) - F.col(predicted))
    c = each.groupBy(*by, "threshold").agg(
        F.count_if(real & said).alias("tp"), F.count_if(~real & ~said).alias("tn"), F.count_if(~real & said).alias("fp"), F.count_if(real & ~said).alias("fn"),
        F.avg(error).alias("mean_abs_error"),
    )
    middle = medians(rows, by, error, "median_abs_error")  # the same at every threshold
    c = _null_safe(c, middle, by) if by else c.crossJoin(F.broadcast(middle))  # one row
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return c.withColumns(
        {
            "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, tp + tn + fp + fn),
            "specificity": share(tn, tn + fp), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp), "csi": share(tp, tp + fp + fn),
        }
    )


def distance_metrics(rows: DataFrame, target: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median absolute error, root mean square error, and quadratically weighted kappa of the three categories."""
    d = F.col(target) - F.col(predicted)
    r, p = category(F.col(target)), category(F.col(predicted))
    sums = rows.groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg((r - p) * (r - p)).alias("_o"), F.avg(r * r).alias("_rr"), F.avg(p * p).alias("_pp"), F.avg(r).alias("_r"), F.avg(p).alias("_p"),
    )
    middle = medians(rows, by, F.abs(d), "medae")
    sums = _null_safe(sums, middle, by) if by else sums.crossJoin(F.broadcast(middle))  # one row
    expected = F.col("_rr") + F.col("_pp") - 2 * F.col("_r") * F.col("_p")  # weights are squares, so expectations do
    return sums.withColumn("kappa", 1 - F.try_divide(F.col("_o"), expected)).drop("_o", "_rr", "_pp", "_r", "_p")


def all_models(predictions: DataFrame, target: str, predicted: str) -> DataFrame:
    """Both kinds of metrics for each model (method) of one table of predictions."""
    return binary_metrics(predictions, target, predicted, ["method"]).join(distance_metrics(predictions, target, predicted, ["method"]), "method")


def regional_median(train: DataFrame, test: DataFrame, region: str, target: str, out: str = "prediction_perc", by: Sequence[str] = ()) -> DataFrame:
    """The region's median in the training rows (of each `by`), or else that of all, and not below 0."""
    own = medians(train.where(F.col(region).isNotNull()), [*by, region], target, "_m")
    whole = medians(train, by, target, "_all")
    rows = test.join(own, [*by, region], "left")
    rows = rows.join(whole, list(by), "left") if by else rows.join(F.broadcast(whole), how="left")  # one row
    return rows.withColumn(out, F.greatest(F.coalesce("_m", "_all"), F.lit(0.0))).drop("_m", "_all")
