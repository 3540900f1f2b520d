"""Exact medians of values with heavy tails."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridimpact.ml import metrics


def groups() -> dict:
    rng = random.Random(1)
    return {
        "tail": [rng.random() for _ in range(4000)] + [1e9, 1e300, -1e250],
        "pareto": [rng.paretovariate(0.3) for _ in range(3001)],
        "same": [7.0] * 2500,
        "half": [1.0] * 1500 + [2.0] * 1500,
        "edge": [0.0] * 2000 + [rng.random() for _ in range(2001)],
        "few": [3.0, 1.0],
        "one": [5.0],
        None: [rng.gauss(0, 1) for _ in range(2222)],
        "steps": [float(k % 997) for k in range(3000)],
    }


@pytest.mark.parametrize("most", [20, 300, 50_000])
def test_medians_are_exact_and_few_values_are_put_in_order(spark, most):
    rows = [(k, v) for k, values in groups().items() for v in values]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([*rows, ("none", None)], "k string, v double").repartition(6)
    got = {r.k: r.median for r in metrics.medians(df, ["k"], "v", most=most).collect()}
    assert got == {k: pytest.approx(statistics.median(v)) for k, v in groups().items()}
    known = df.where("v IS NOT NULL").select(F.col("k").alias("_k0"), F.lit(0).alias("_k1"), F.col("v").alias("_v"))
    near = metrics.in_the_middle(known, ["_k0", "_k1"], most)
    if most < 50_000:
        assert near.groupBy("_k0", "_k1").count().agg(F.max("count")).first()[0] <= 1.1 * most  # distinct values are counted by a sketch
    assert metrics.medians(df, [], "v", most=most).collect()[0].median == pytest.approx(statistics.median([v for _, v in rows]))
    assert metrics.medians(df.where("false"), ["k"], "v", most=most).count() == 0


def test_a_large_group_is_not_brought_into_one_task(spark, monkeypatch):
    """Rows meet the brackets of a few groups where they are: nothing puts a whole group in order."""
    monkeypatch.setattr(metrics.F, "broadcast", lambda df, f=metrics.F.broadcast: asked.append(df) or f(df))
    asked: list = []
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).cast("double").alias("v"))
    got = {r.g: r.m for r in metrics.medians(rows, ["g"], "v", "m", most=100).collect()}
    own = {g: sorted(i * 7919 % 3001 for i in range(3000) if i % 2 == g) for g in (0, 1)}
    assert got == {g: (v[749] + v[750]) / 2 for g, v in own.items()}
    assert len(asked) >= 3
