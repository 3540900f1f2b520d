"""Two-stage boosted model, baselines, leave-one-event-out runs, and attributions of trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.functions.scalar import SEVERE
from gridimpact.ml.boosting import Boosting, Forest, Spec, cut_points, number, predicted, train
from gridimpact.ml.boosting import prepared as binned_rows
from gridimpact.ml.events import chosen_models, folds
from gridimpact.ml.metrics import regional_median
from gridimpact.operators.assemble import FEATURES
from gridimpact.sources.tables import settled

#: What tells rows of the training table apart, of cells or of regions.
KEYS = ("DisNo.", "sid", "id", "GID_0", "GID_1", "GID_2")
TARGET = "perc_affected_pop_grid_region"
#: Boosting rounds, depth, learning rate, gamma and sampling of both stages.
STAGE = Boosting(rounds=100, depth=4, step=0.01, subsample=0.8, columns=0.8, gamma=0.5, least_weight=1.0, seed=0)
#: The same for the baselines.
BASELINE = Boosting(rounds=100, depth=4, step=0.01, subsample=1.0, columns=1.0, gamma=0.0, least_weight=1.0, seed=42)


def _key(rows: DataFrame, key: str | Sequence[str] | None) -> list[str]:
    return [key] if isinstance(key, str) else list(key or [c for c in KEYS if c in rows.columns] or rows.columns)


def _written_key(columns: Sequence[str]) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))


@dataclass
class TwoStage:
    """A classifier finds affected rows, a regressor trained on affected rows says how much; the others are 0.

    Both stages, for all models asked for, grow in one training job: the model of fold k is the pair of forest models 2k and 2k + 1.
    """

    features: list[str] = field(default_factory=lambda: list(FEATURES))
    target: str = TARGET
    key: str | Sequence[str] | None = None  # columns that tell rows apart; else those of KEYS that there are
    options: Boosting = STAGE
    u1: float = 3
    u2: float = 3

    def fit(self, rows: DataFrame, n_models: int = 1, models: Column | None = None) -> TwoStage:
        """models: the places of the models that a row trains (all of them by default)."""
        key = _key(rows, self.key)
        y = F.col(f"`{self.target}`")
        own = F.sequence(F.lit(0), F.lit(n_models - 1)) if models is None else models
        rows = rows.withColumns({"_m": own, "_hit": (y > 0).cast("int"), "_severe": (y >= SEVERE).cast("int")})
        first = chosen_models(rows, "_m", "_hit", self.u1, key, "_first")
        some = F.when(F.col("_hit") == 1, F.col("_m")).otherwise(F.array().cast("array<int>"))
        both = chosen_models(first.withColumn("_some", some), "_some", "_severe", self.u2, key, "_second", all_without=True)
        places = F.concat(F.transform("_first", lambda m: 2 * m), F.transform("_second", lambda m: 2 * m + 1))
        specs = [Spec(*s) for _ in range(n_models) for s in (("logistic", 0), ("squared", 1))]
        cuts = cut_points(rows, self.features, self.options.bins)
        self.forest = train(binned_rows(both, self.features, cuts, [F.col("_hit"), y], _written_key(key), places), cuts, specs, self.options)
        return self

    def predict(self, test: DataFrame, model: Column | None = None) -> DataFrame:
        """model: the place of each row's model (the first by default)."""
        own = F.lit(0) if model is None else model
        rows = test.withColumn("predicted_proba", predicted(test, self.forest, self.features, 2 * own))
        rows = rows.withColumn("predicted_bin", (F.col("predicted_proba") >= 0.5).cast("int"))
        amount = predicted(test, self.forest, self.features, F.when(F.col("predicted_bin") == 1, 2 * own + 1))
        return rows.withColumn("prediction_perc", F.when(F.col("predicted_bin") == 1, amount).when(F.col("predicted_bin") == 0, F.lit(0.0)))

    def train_and_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.fit(train).predict(test)


@dataclass
class Boosted:
    """A boosted regressor on a few features, not below 0."""

    features: list[str]
    target: str = TARGET
    key: str | Sequence[str] | None = None
    options: Boosting = BASELINE

    def fit(self, rows: DataFrame, n_models: int = 1, models: Column | None = None) -> Boosted:
        own = F.sequence(F.lit(0), F.lit(n_models - 1)) if models is None else models
        cuts = cut_points(rows, self.features, self.options.bins)
        table = binned_rows(rows, self.features, cuts, [F.col(f"`{self.target}`")], _written_key(_key(rows, self.key)), own)
        self.forest = train(table, cuts, [Spec("squared")] * n_models, self.options)
        return self

    def predict(self, test: DataFrame, model: Column | None = None) -> DataFrame:
        amount = predicted(test, self.forest, self.features, F.lit(0) if model is None else model)
        return test.withColumn("prediction_perc", F.greatest(amount, F.lit(0.0)))

    def train_and_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return self.fit(train).predict(test)


@dataclass
class Historical:
    """The median of the region."""

    region: str = "iso3"
    target: str = TARGET

    def train_and_predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return regional_median(train, test, self.region, self.target)

    def by_fold(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """The same for the test rows of many folds (_fold) at once, by the training rows of each."""
        return regional_median(train, test, self.region, self.target, by=["_fold"])


MODELS: dict[str, Callable] = {
    "2-stage-XGBoost": TwoStage,
    "historical": Historical,
    "wind_exposed": lambda: Boosted(["wind_speed", "population"]),
    "wind_historical": lambda: Boosted(["wind_speed", "population", "N_events_5_years"]),
}


def model_of(name: str):
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}; one of {', '.join(MODELS)}")
    return MODELS[name]()


def leave_one_out(rows: DataFrame, model, strategy: str, event: str = "DisNo.", date: str = "date", basin: str = "cyclone_basin", method: str = "") -> DataFrame:
    """Predictions of each event by a model trained on its fold; events without a fold to train on have none.

    All folds are trained in one job: folds are pairs of events (some hundreds squared, however many rows there are), and each row of the
    training table carries the folds that its event is in.
    """
    rows = settled(rows.withColumn("_event", F.col(f"`{event}`")), "folds")
    events = rows.select(F.col("_event").alias("event"), F.col(date).alias("date"), F.col(basin).alias("basin")).distinct()
    pairs = settled(folds(events, strategy).distinct(), "pairs")
    named = sorted(r.test_event for r in pairs.select("test_event").distinct().collect())  # as many as there are events
    spark = rows.sparkSession
    places = spark.createDataFrame(list(enumerate(named)), f"_fold int, test_event {events.schema['event'].dataType.simpleString()}")
    placed = pairs.join(F.broadcast(places), "test_event")
    inside = placed.groupBy(F.col("train_event").alias("_event")).agg(F.array_sort(F.collect_set("_fold")).alias("_folds"))  # at most one entry for each event
    train = rows.join(inside, "_event", "left").withColumn("_folds", F.coalesce("_folds", F.array().cast("array<int>")))
    test = rows.join(F.broadcast(places.withColumnRenamed("test_event", "_event")), "_event")
    if hasattr(model, "by_fold"):
        out = model.by_fold(train.select("*", F.explode("_folds").alias("_fold")), test)
    elif named:
        out = model.fit(train.drop("_event"), len(named), F.col("_folds")).predict(test, F.col("_fold"))
    else:
        out = test.withColumn("prediction_perc", F.lit(None).cast("double"))
    return out.withColumns({"method": F.lit(method), "event": F.col("_event")}).drop("_event", "_fold", "_folds")


# --- attributions -------------------------------------------------------------------------------------------------


def _leaves(nodes: list[tuple], at: int = 0, path: tuple = ()) -> Iterator[tuple[float, dict[int, tuple[list, float]]]]:
    """Value of each leaf, and for each feature on its path the tests and the share of training rows that they let through."""
    feature, threshold, left, right, value, rows, missing_left = nodes[at]
    if feature < 0:
        tests: dict[int, tuple[list, float]] = {}
        for f, t, below, missing, share in path:
            known, s = tests.get(f, ([], 1.0))
            tests[f] = ([*known, (t, below, missing)], s * share)
        yield value, tests
        return
    for child, below in ((left, True), (right, False)):
        yield from _leaves(nodes, child, (*path, (feature, threshold, below, missing_left == below, nodes[child][5] / rows)))


def _games(trees: list[tuple[float, list[tuple]]]) -> tuple[list[tuple[list[int], list[list], np.ndarray]], float]:
    """For each leaf the features on its path, their tests, and the Shapley values [which features pass, feature]; and the base.

    A tree is a sum over its leaves, and a leaf's game is a product with a factor for each feature on the path: 0 or 1 if the feature is
    known, the share of training rows if not. A path has few features, so the subsets are summed exactly, once for each set of features that pass.
    """
    games, base = [], 0.0
    for weight, nodes in trees:
        for value, tests in _leaves(nodes):
            used = list(tests)
            share = np.array([tests[f][1] for f in used])
            base += weight * value * float(share.prod())
            m = len(used)
            passes = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
            table = np.zeros((2**m, m))
            for i in range(m):
                rest = [j for j in range(m) if j != i]
                for r in range(m):
                    part = factorial(r) * factorial(m - r - 1) / factorial(m)
                    for known in combinations(rest, r):
                        others = np.prod([share[j] for j in rest if j not in known])
                        table[:, i] += weight * value * part * others * passes[:, list(known)].prod(1) * (passes[:, i] - share[i])
            games.append((used, [tests[f][0] for f in used], table))
    return games, base


def attributions_of(trees: list[tuple[float, list[tuple]]], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values of each row's features, and the base."""
    games, base = _games(trees)
    return _attributed(games, x), base


def _attributed(games: list[tuple[list[int], list[list], np.ndarray]], x: np.ndarray) -> np.ndarray:
    out, missing_at = np.zeros(x.shape[::-1]), np.isnan(x.T)
    tested: dict[tuple, np.ndarray] = {}
    for used, tests, table in games:
        which = np.zeros(len(x), np.intp)
        for k, (f, own) in enumerate(zip(used, tests, strict=True)):
            key = (f, *own)
            if key not in tested:
                tested[key] = np.logical_and.reduce([np.where(missing_at[f], missing, (x[:, f] <= t) == below) for t, below, missing in own])
            which += tested[key].astype(np.intp) << k
        for k, f in enumerate(used):
            out[f] += table[which, k]
    return out.T


def attributions(rows: DataFrame, forest: Forest, features: list[str], key: str, model: int = 0) -> DataFrame:
    """key, a column for each feature, base and total: base plus the attributions is the model's margin."""
    games, base = _games(forest.nodes(model))
    shared, start = rows.sparkSession.sparkContext.broadcast(games), float(forest.base[model])
    names = [f"shap_{c}" for c in features]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = _attributed(shared.value, batch[features].to_numpy(float))
            out = pd.DataFrame(values, columns=names)
            out.insert(0, key, batch[key].to_numpy())
            out["base"] = start + base
            out["total"] = start + base + values.sum(1)
            yield out

    chosen = rows.select(key, *(number(c).alias(c) for c in features))
    kind = chosen.schema[0].dataType.simpleString()
    return chosen.mapInPandas(run, f"`{key}` {kind}, {', '.join(f'`{n}` double' for n in [*names, 'base', 'total'])}")


def ranked_features(shap: DataFrame, features: list[str], top: int = 3) -> DataFrame:
    """Features by mean absolute attribution, the first few."""
    means = shap.agg(*(F.avg(F.abs(F.col(f"`shap_{c}`"))).alias(c) for c in features))
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("importance")) for c in features))
    return means.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("importance"), "feature").limit(top)
