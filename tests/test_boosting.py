"""Boosted trees against a plain recomputation, both ways of growing them, and all folds at once against one fit for each."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridimpact.ml import boosting, events, models
from gridimpact.ml.boosting import Boosting, Spec
from gridimpact.plans import queries

NAN = float("nan")
DATA = "/root/testdata/sf0.001"


def plain_forest(x: list[list[float]], y: list[float], hashes: list[int], objective: str, o: Boosting, cuts: list | None = None) -> tuple[float, list[dict]]:
    """Base and trees (node: (feature, threshold, missing left) or value), by loops over all cuts (else values) of all features."""
    cuts = cuts or [sorted({v[f] for v in x if v[f] == v[f]}) for f in range(len(x[0]))]
    mean = round(sum(y) / len(y), 9)
    base = mean if objective == "squared" else math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    margin, trees = [base] * len(y), []
    score = lambda g, h: g * g / (h + o.ridge)
    for t in range(o.rounds):
        columns = sorted(np.random.default_rng([o.seed, t]).permutation(len(x[0]))[: max(1, int(o.columns * len(x[0])))].tolist())
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [(q if objective == "logistic" else m) - v for q, m, v in zip(p, margin, y, strict=True)]
        h = [q * (1 - q) if objective == "logistic" else 1.0 for q in p]
        use = boosting._drawn(np.array(hashes, np.int64), o, t)
        tree: dict = {}

        def grow(k: int, rows: list[int], depth: int, g=g, h=h, columns=columns, tree=tree) -> float:
            """Adds the node and gives what its split gains, -1 for a leaf."""
            total_g, total_h = sum(g[i] for i in rows), sum(h[i] for i in rows)
            tree[k] = -o.step * total_g / (total_h + o.ridge)
            best = (1e-6, None)
            for f in columns if depth < o.depth else []:
                for cut in cuts[f]:
                    for side in (True, False):
                        left = [i for i in rows if (x[i][f] <= cut if x[i][f] == x[i][f] else side)]
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        if lh >= o.least_weight and total_h - lh >= o.least_weight:
                            gain = score(lg, lh) + score(total_g - lg, total_h - lh) - score(total_g, total_h)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut, side), left)
            if best[1] is None:
                return -1
            value, tree[k] = tree[k], best[1]
            inside = set(best[2])
            below = [grow(2 * k + 1, best[2], depth + 1), grow(2 * k + 2, [i for i in rows if i not in inside], depth + 1)]
            if below == [-1, -1] and best[0] < o.gamma:
                tree[k] = value
                del tree[2 * k + 1], tree[2 * k + 2]
                return -1
            return best[0]

        grow(0, [i for i in range(len(y)) if use[i]], 0)
        trees.append(tree)
        margin = [m + plain_value(tree, r) for m, r in zip(margin, x, strict=True)]
    return base, trees


def plain_value(tree: dict, row: list[float]) -> float:
    k = 0
    while isinstance(tree[k], tuple):
        f, cut, side = tree[k]
        k = 2 * k + (1 if (row[f] <= cut if row[f] == row[f] else side) else 2)
    return tree[k]


def odd_rows(n: int = 150) -> list[tuple]:
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 9)), float(rng.integers(0, 4)), float(rng.integers(0, 30))
        y = 12.0 if i % 7 == 0 else (a + 5 * (b > 1) if c > 18 else 0.0)
        rows.append((i, NAN if i % 7 == 0 else a, None if i % 11 == 3 else b, c, y))
    return rows


SCHEMA = "row_id int, a double, b double, c double, y double"


@pytest.mark.parametrize("objective", ["squared", "logistic"])
@pytest.mark.parametrize("group_rows", [10_000, 10])
def test_trees_equal_a_plain_recomputation(spark, objective, group_rows):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    o = Boosting(rounds=6 if group_rows > 10 else 2, depth=3, step=0.3, gamma=0.8, least_weight=2.0, seed=5, group_rows=group_rows)
    cuts = boosting.cut_points(df, ["a", "b", "c"], o.bins)
    label = F.col("y") if objective == "squared" else (F.col("y") > 0).cast("int")
    table = boosting.prepared(df, ["a", "b", "c"], cuts, [label], F.col("row_id").cast("string"), F.array(F.lit(0)))
    forest = boosting.train(table, cuts, [Spec(objective)], o)
    hashes = {r.row_id: r.h for r in df.select("row_id", F.xxhash64(F.col("row_id").cast("string")).alias("h")).collect()}
    x = [[NAN if v is None else v for v in r[1:4]] for r in rows]
    y = [r[4] if objective == "squared" else float(r[4] > 0) for r in rows]
    base, trees = plain_forest(x, y, [hashes[r[0]] for r in rows], objective, o)
    assert forest.base[0] == pytest.approx(base)
    for t, tree in enumerate(trees):
        got = {k: (int(forest.feature[t, 0, k]), float(cuts[forest.feature[t, 0, k]][forest.cut[t, 0, k]]), bool(forest.missing_left[t, 0, k])) for k in range(15) if forest.feature[t, 0, k] >= 0}
        assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in tree.items() if isinstance(v, tuple)}, t
    want = [base + sum(plain_value(t, r) for t in trees) for r in x]
    want = want if objective == "squared" else [1 / (1 + math.exp(-w)) for w in want]
    out = df.withColumn("p", boosting.predicted(df, forest, ["a", "b", "c"], F.lit(0))).select("row_id", "p").collect()
    assert [p for _, p in sorted(out)] == pytest.approx(want, abs=1e-6)


def test_both_ways_give_the_same_bits_and_models_do_not_touch_each_other(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    two = Boosting(rounds=12, depth=3, step=0.3)
    own = F.when(F.col("row_id") % 3 == 0, F.array(F.lit(0), F.lit(2))).when(F.col("row_id") % 3 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0)))
    cuts = boosting.cut_points(df, ["a", "b", "c"], 128)
    table = boosting.prepared(df, ["a", "b", "c"], cuts, [F.col("y")], F.col("row_id").cast("string"), own)
    specs = [Spec("squared")] * 3
    grouped, levels = boosting.train(table, cuts, specs, two), boosting.train(table, cuts, specs, replace(two, group_rows=1))
    alone = boosting.train(boosting.prepared(df.where("row_id % 3 <> 2"), ["a", "b", "c"], cuts, [F.col("y")], F.col("row_id").cast("string"), F.array(F.lit(0))), cuts, specs[:1], two)
    for c in boosting.ARRAYS:
        assert np.array_equal(getattr(grouped, c), getattr(levels, c))
        assert np.array_equal(getattr(grouped, c)[:, 2], getattr(alone, c)[:, 0])
    assert np.isnan(grouped.base[1])  # no rows
    out = df.withColumn("p", boosting.predicted(df, grouped, ["a", "b", "c"], F.lit(1))).where("p IS NOT NULL")
    assert out.count() == 0


def test_odd_training_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    out = models.Boosted(["a", "b"], "y", "row_id", Boosting(rounds=2)).train_and_predict(none, spark.createDataFrame(odd_rows(5), SCHEMA))
    assert [r.prediction_perc for r in out.collect()] == [0.0] * 5 or all(r.prediction_perc is None or r.prediction_perc == 0.0 for r in out.collect())
    same = spark.createDataFrame([(i, None, NAN, 1.0, None if i % 2 else 3.0) for i in range(20)], SCHEMA)
    out = models.Boosted(["a", "b", "c"], "y", "row_id", Boosting(rounds=3)).train_and_predict(same, same)
    assert {r.prediction_perc for r in out.collect()} == {3.0}
    with pytest.raises(ValueError, match="bins"):
        boosting.cut_points(same, ["a"], 255)


def test_cut_points_of_many_values(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("v"))
    (cuts,) = boosting.cut_points(df, ["v"], 50)
    assert 40 <= len(cuts) <= 50 and cuts[-1] == 4999
    sizes = np.diff(np.concatenate([[0], np.searchsorted(np.arange(5000), cuts, "right")]))
    assert sizes.max() <= 2 * 5000 / 50


def test_models_are_balanced_each_by_itself(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(300)] + [(1000, None)]
    own = F.when(F.col("row_id") < 100, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    df = spark.createDataFrame(rows, "row_id int, hit int").withColumn("m", own)
    got = events.chosen_models(df, "m", "hit", 2, ["row_id"], "chosen").select("row_id", "hit", F.explode("chosen").alias("c")).where("hit IS NOT NULL").collect()
    for m, (low, high) in enumerate([(0, 100), (0, 300), (100, 300)]):
        inside = [r for r in rows if low <= r[0] < high and r[1] is not None]
        ones = {r[0] for r in inside if r[1]}
        hashed = spark.createDataFrame(inside, "row_id int, hit int").select("row_id", F.md5(F.concat_ws(":", F.lit(42), "row_id")).alias("o")).collect()
        zeros = [i for _, i in sorted((r.o, r.row_id) for r in hashed if r.row_id not in ones)][: 2 * len(ones)]
        assert {r.row_id for r in got if r.c == m} == ones | set(zeros)
    nothing = events.chosen_models(df.where("hit = 0"), "m", "hit", 2, ["row_id"], "chosen").where("size(chosen) > 0").count()
    whole = events.chosen_models(df.where("hit = 0"), "m", "hit", 2, ["row_id"], "chosen", all_without=True).where("size(chosen) = 2").count()
    assert (nothing, whole) == (0, 270)


@pytest.mark.parametrize("strategy", ["global", "walk_forward", "geo_constrained"])
def test_all_folds_at_once_equal_one_fit_for_each(spark, strategy):
    rows = [(f"e{i % 6}", f"200{i % 6}-01-01", "NA" if i % 6 < 4 else "SP", i, float(i % 5), None if i % 4 == 0 else float(i % 9), 20.0 * (i % 3 == 0) + i % 4) for i in range(90)]
    df = spark.createDataFrame(rows, "`DisNo.` string, date string, cyclone_basin string, id int, wind double, rain double, y double").withColumn("date", F.to_date("date"))
    model = lambda: models.TwoStage(["wind", "rain"], "y", "id", Boosting(rounds=4, depth=2, step=0.3, gamma=0.1))
    got = {r.id: (r.event, r.predicted_proba, r.prediction_perc) for r in models.leave_one_out(df, model(), strategy, method="x").collect()}
    e = [(f"e{k}", k, "NA" if k < 4 else "SP") for k in range(6)]
    inside = {"global": lambda t, o: t[0] != o[0], "walk_forward": lambda t, o: o[1] < t[1], "geo_constrained": lambda t, o: t[0] != o[0] and t[2] == o[2]}[strategy]
    want = {}
    for t in e:
        fold = [o[0] for o in e if inside(t, o)]
        if fold:
            out = model().train_and_predict(df.where(F.col("`DisNo.`").isin(fold)), df.where(F.col("`DisNo.`") == t[0]))
            want |= {r.id: (t[0], r.predicted_proba, r.prediction_perc) for r in out.collect()}
    assert got == want and len(got) == (75 if strategy == "walk_forward" else 90)


def test_number_of_jobs_does_not_depend_on_the_number_of_events(spark):
    def jobs(n: int) -> int:
        rows = [(f"e{i % n}", f"{2000 + i % n}-01-01", "NA", i, float(i % 5), 20.0 * (i % 3 == 0)) for i in range(60)]
        df = spark.createDataFrame(rows, "`DisNo.` string, date string, cyclone_basin string, id int, wind double, y double").withColumn("date", F.to_date("date")).repartition(2)
        spark.sparkContext.setJobGroup(f"folds{n}", "")
        models.leave_one_out(df, models.TwoStage(["wind"], "y", "id", Boosting(rounds=3, depth=2)), "global").collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{n}"))

    few, many = jobs(4), jobs(20)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == pytest.approx(many, abs=6)


def test_queries_of_models_against_a_plain_recomputation(spark):
    """The registered queries with all their rounds."""
    rows = {r.row_id: r for r in queries._learning(spark, DATA).collect()}
    x = lambda r: [NAN if r[f] is None else r[f] for f in queries._FEATURES]
    hashes = {r.row_id: r.h for r in queries._learning(spark, DATA).select("row_id", F.xxhash64(F.col("row_id").cast("string")).alias("h")).collect()}
    odd, even = [r for r in rows.values() if r.row_id % 2], [r for r in rows.values() if r.row_id % 2 == 0]
    o = replace(models.BASELINE, rounds=100)
    two = lambda r: [r.size, NAN if r.a is None else r.a]
    base, trees = plain_forest([two(r) for r in even], [r.y for r in even], [hashes[r.row_id] for r in even], "squared", o)
    want = {r.row_id: round(max(base + sum(plain_value(t, two(r)) for t in trees), 0), 4) for r in odd}
    got = {r.row_id: r.prediction_perc for r in queries.QUERIES["boosted_predict"](spark, DATA).collect()}
    assert got == pytest.approx(want, abs=2e-4)

    every = list(rows.values())
    base, trees = plain_forest([x(r) for r in every], [r.y for r in every], [hashes[r.row_id] for r in every], "squared", models.STAGE, [c.tolist() for c in boosting.cut_points(queries._learning(spark, DATA), queries._FEATURES, models.STAGE.bins)])
    shap = {r.row_id: r for r in queries.QUERIES["shap_attributions"](spark, DATA).collect()}
    assert {i: r.total for i, r in shap.items()} == pytest.approx({r.row_id: base + sum(plain_value(t, x(r)) for t in trees) for r in every}, abs=1e-5)
    means = {f: sum(abs(r[f"shap_{f}"]) for r in shap.values()) / len(shap) for f in queries._FEATURES}
    top = [(r.feature, r.importance) for r in queries.QUERIES["top_features"](spark, DATA).collect()]
    assert [f for f, _ in top] == sorted(means, key=lambda f: (-means[f], f))[:3] and [v for _, v in top] == pytest.approx([means[f] for f, _ in top])


def test_single_attributions_are_shapley_values():
    """By the definition: the mean over all orders of the features, unknown ones following the training rows' shares."""
    from itertools import permutations

    nodes = [(0, 0.5, 1, 2, 0.0, 10.0, False), (1, 1.5, 3, 4, 0.0, 6.0, True), (2, 0.5, 5, 6, 0.0, 4.0, False)] + [(-1, 0.0, -1, -1, v, c, False) for v, c in ((1.0, 2.0), (4.0, 4.0), (-2.0, 3.0), (7.0, 1.0))]

    def value(row: list[float], known: set[int], k: int = 0) -> float:
        f, t, left, right, v, cover, missing_left = nodes[k]
        if f < 0:
            return v
        if f in known:
            return value(row, known, left if (row[f] <= t if row[f] == row[f] else missing_left) else right)
        return sum(nodes[c][5] / cover * value(row, known, c) for c in (left, right))

    rows = [[0.0, 1.0, 0.0], [1.0, NAN, 1.0], [NAN, 2.0, NAN], [0.0, NAN, 0.0]]
    phi, base = models.attributions_of([(1.0, nodes)], np.array(rows))
    assert base == pytest.approx(value(rows[0], set()))
    for row, got in zip(rows, phi, strict=True):
        want = [0.0] * 3
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += (value(row, set(order[: i + 1])) - value(row, set(order[:i]))) / 6
        assert got.tolist() == pytest.approx(want)


def test_a_barrier_stage_grows_the_trees_of_levels(spark, monkeypatch):
    """Large models grow in one job, and come out as they do level by level."""
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 23).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("b"), (F.col("id") % 7).cast("double").alias("y"))
    options = boosting.Boosting(rounds=3, depth=3, step=0.3, gamma=0.1, group_rows=1)
    cuts, specs = boosting.cut_points(rows, ["a", "b"], 16), [boosting.Spec("squared"), boosting.Spec("logistic", 1), boosting.Spec("squared")]
    table = boosting.prepared(rows, ["a", "b"], cuts, [F.col("y"), (F.col("y") > 3).cast("int")], F.col("id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))
    together = boosting.train(table, cuts, specs, options)
    monkeypatch.setattr(boosting, "_together", None)
    monkeypatch.setattr(boosting, "EXCHANGED", 0)
    levels = boosting.train(table, cuts, specs, options)
    for c in boosting.ARRAYS:
        assert (getattr(together, c) == getattr(levels, c)).all(), c
    assert (together.feature >= 0).any()
