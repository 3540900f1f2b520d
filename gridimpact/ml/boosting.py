"""Gradient boosting on binned features, with a side for missing values, for many models in one training job.

Features are cut into bins once (a byte each, one of them for "missing"). A level of a tree is one grouped aggregate: tasks add up gradients and
Hessians by model, node, feature and bin, the shuffle brings the sums of a model together, and one row for each node comes back with
its best split. Missing values of a feature go to the side where the gain is larger. A split needs a least Hessian on both sides;
afterwards splits that gain less than gamma are taken back from the bottom up. Rows and columns are drawn anew for each tree.

All models grow side by side: a row carries the numbers of the models that it trains. So the number of Spark jobs depends on rounds and depth
alone, not on how many models (folds of a leave-one-out run, or the two stages) there are. Models of at most `group_rows` rows each are
dealt over the tasks instead, one job for all of them, and grow there by the same sums and splits. Few models of more rows grow in one barrier stage:
each task keeps its part of the rows, and tasks exchange the sums of a level. Gradients are whole numbers of a fixed
fraction, hence sums are exact: a model is the same any way, whatever the partitions, and whatever is trained beside it.

Defined results: NaN is missing; a row whose label is missing trains nothing; a model without rows predicts nothing (NULL); equal gains go
to the first feature, the lowest cut, and missing to the left.
"""

from __future__ import annotations

import json
import secrets
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.sources.tables import settled

MISSING = 255
#: Fractions that gradients are counted in.
UNITS = 1 << 30
#: Rounds after which margins are written, so that tasks apply only the trees grown since.
KEEP_EVERY = 10
#: Rows of a task when models grow level by level.
TASK_ROWS = 20_000
#: Pairs of a row and a model that are worked on at a time in a barrier stage, and bytes of a level's sums that its tasks exchange at most.
CHUNK, EXCHANGED = 200_000, 2_000_000


@dataclass(frozen=True)
class Boosting:
    """Options of a model; the defaults are those of the two-stage model."""

    rounds: int = 100
    depth: int = 4
    step: float = 0.01
    subsample: float = 0.8  # of rows, for each tree
    columns: float = 0.8  # of features, for each tree
    gamma: float = 0.5
    least_weight: float = 1.0
    ridge: float = 1.0
    seed: int = 0
    bins: int = 128
    group_rows: int = 200_000  # of the largest model that one task may grow by itself


@dataclass(frozen=True)
class Spec:
    """A model to be trained: `logistic` or `squared`, and the place of its label in the rows' labels."""

    objective: str
    label: int = 0


Split = namedtuple("Split", "node feature cut missing_left gain lg lh rg rh")


@dataclass
class Forest:
    """Trees of several models as arrays [round, model, node]; the children of node k are 2k+1 and 2k+2, and a leaf's feature is -1."""

    cuts: list[np.ndarray]
    base: np.ndarray  # [model]; NaN where a model had no rows
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    specs: list[Spec] = field(default_factory=list)

    def leaves(self, bins: np.ndarray, rows: np.ndarray, model: np.ndarray, at: int, levels: int | None = None) -> np.ndarray:
        """The node that each pair of a row (of binned features) and a model reaches in a round's tree."""
        node = np.zeros(len(rows), np.int64)
        depth = (self.feature.shape[2] + 1).bit_length() - 1
        for _ in range(depth - 1 if levels is None else levels):
            f = self.feature[at, model, node]
            b = bins[rows, f]
            left = np.where(b == MISSING, self.missing_left[at, model, node], b <= self.cut[at, model, node])
            node = np.where(f < 0, node, 2 * node + 2 - left)
        return node

    def margin(self, bins: np.ndarray, model: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(bins)), self.base[model].astype(float)
        for t in range(len(self.feature)):
            out += self.value[t, model, self.leaves(bins, rows, model, t)]
        return out

    def predict(self, x: np.ndarray, model: np.ndarray) -> np.ndarray:
        out, bins = np.full(len(x), np.nan), binned(x, self.cuts)
        own = (model >= 0) & (model < len(self.base))
        out[own] = self.margin(bins[own], model[own])
        logistic = np.array([s.objective == "logistic" for s in self.specs] or [False])
        return np.where(own & logistic[np.where(own, model, 0)], 1 / (1 + np.exp(-np.clip(out, -500, 500))), out)

    def nodes(self, model: int) -> list[tuple[float, list[tuple]]]:
        """Weight and nodes (feature, threshold, left, right, value, cover, missing goes left) of each tree of a model."""
        trees = []
        for t in range(len(self.feature)):
            out: list = []

            def flat(k: int, t: int = t, out: list = out) -> int:
                at, f = len(out), int(self.feature[t, model, k])
                out.append(None)
                if f < 0:
                    out[at] = (-1, 0.0, -1, -1, float(self.value[t, model, k]), float(self.cover[t, model, k]), False)
                else:
                    left, right = flat(2 * k + 1), flat(2 * k + 2)
                    out[at] = (f, float([*self.cuts[f], np.inf][min(int(self.cut[t, model, k]), len(self.cuts[f]))]), left, right, 0.0, float(self.cover[t, model, k]), bool(self.missing_left[t, model, k]))
                return at

            flat(0)
            trees.append((1.0, out))
        return trees


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of each value: the first cut that is not below it, one more for what is above all, MISSING for none."""
    out = np.empty(x.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f]))
    return out


def number(name: str) -> Column:
    """A feature as a number, NaN where it is missing."""
    return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Values that part the bins of each feature: all values where there are few, else values at even ranks."""
    if not 2 <= bins < MISSING:
        raise ValueError(f"bins must be 2 to {MISSING - 1}")
    known = [F.when(~F.isnan(number(c)), number(c)) for c in features]
    ranks = F.array(*(F.lit(k / bins) for k in range(1, bins + 1)))
    found = rows.agg(*(F.approx_count_distinct(k).alias(f"n{i}") for i, k in enumerate(known)), *(F.percentile_approx(k, ranks, F.lit(100 * bins)).alias(f"q{i}") for i, k in enumerate(known))).first()
    few = [i for i in range(len(features)) if (found[f"n{i}"] or 0) <= 2 * bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        each = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), known[i].alias("v")) for i in few))).alias("p")).select("p.*").where("v IS NOT NULL").distinct()
        for row in each.collect():  # at most some hundred values of each feature
            values[row.i].append(row.v)
    return [np.array(sorted(values[i] if i in values and len(values[i]) <= bins else set(found[f"q{i}"] or []))) for i in range(len(features))]


def prepared(rows: DataFrame, features: Sequence[str], cuts: list[np.ndarray], labels: Sequence[Column], key: Column, models: Column) -> DataFrame:
    """hash (of the key), bins, labels and models of the rows that train something."""
    if len(features) == 0:
        raise ValueError("no features")
    plain = rows.select(F.xxhash64(key).alias("hash"), F.array(*(number(c) for c in features)).alias("x"), F.array(*(c.cast("double") for c in labels)).alias("labels"), models.cast("array<int>").alias("models"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            own = [row.tobytes() for row in binned(x, cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), batch.column(2), batch.column(3)], ["hash", "bins", "labels", "models"])

    return plain.where("size(models) > 0").mapInArrow(run, "hash long, bins binary, labels array<double>, models array<int>")


def _pairs(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, ...]:
    """Bins, hashes and labels of a batch's rows; row, model and margin of each pair of a row and a model that it trains."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, n_features)
    lists = batch.column("models")
    sizes = np.diff(lists.offsets.to_numpy())
    labels = batch.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    margin = batch.column("margin").flatten().to_numpy(zero_copy_only=False) if "margin" in batch.schema.names else np.empty(0)
    return bins, batch.column("hash").to_numpy(), labels, np.repeat(np.arange(batch.num_rows), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), margin


def _drawn(hashes: np.ndarray, options: Boosting, at: int) -> np.ndarray:
    """Whether a tree uses each row: by the row's hash, so the same whatever else is there."""
    if options.subsample >= 1:
        return np.ones(len(hashes), bool)
    h = hashes.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + at + 1000 * options.seed)) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h >> np.uint64(11)).astype(float) / (1 << 53) < options.subsample


def gradients(objective: np.ndarray, margin: np.ndarray, label: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian in whole units; unit: what one is worth."""
    p = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    g = np.where(objective, p - label, margin - label)
    h = np.where(objective, np.maximum(p * (1 - p), 1e-16), 1.0)
    return np.rint(g / unit), np.rint(h * UNITS)


def best_splits(g: np.ndarray, h: np.ndarray, unit: float, options: Boosting, columns: np.ndarray) -> list[tuple]:
    """The best split of each node, of sums [node, drawn feature, bin] with the missing in the last bin: node, feature, cut, missing left, gain, and both sides' sums."""
    out = []
    for node in range(len(g)):
        gs, hs = g[node] * unit, h[node] / UNITS
        total_g, total_h = gs[0].sum(), hs[0].sum()
        if total_h <= 0:
            continue
        score = lambda a, b: a * a / (b + options.ridge)
        left_g, left_h = np.cumsum(gs[:, :-1], 1), np.cumsum(hs[:, :-1], 1)
        both = []
        for side in (1, 0):  # missing to the left, then to the right
            lg, lh = left_g + side * gs[:, -1:], left_h + side * hs[:, -1:]
            rg, rh = total_g - lg, total_h - lh
            gain = score(lg, lh) + score(rg, rh) - score(total_g, total_h)
            both.append(np.where((lh >= options.least_weight) & (rh >= options.least_weight), gain, -np.inf))
        gain = np.stack(both, -1)  # [feature, cut, side]: the first of the largest counts
        f, c, side = np.unravel_index(int(np.argmax(np.round(gain, 9))), gain.shape)
        if gain[f, c, side] > 1e-6:
            m = 1 - side
            lg, lh = left_g[f, c] + m * gs[f, -1], left_h[f, c] + m * hs[f, -1]
            out.append((node, int(columns[f]), int(c), bool(m), float(gain[f, c, side]), float(lg), float(lh), float(total_g - lg), float(total_h - lh)))
    return out


def drawn_columns(n: int, options: Boosting, at: int) -> np.ndarray:
    rng = np.random.default_rng([options.seed, at])
    return np.sort(rng.permutation(n)[: max(1, int(options.columns * n))])


def node_sums(bins: np.ndarray, row: np.ndarray, node: np.ndarray, values: np.ndarray, nodes: int, columns: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of values by node, drawn feature and bin, the missing last."""
    out = np.zeros((nodes, len(columns), n_bins), np.int64)
    for k, f in enumerate(columns):
        b = bins[row, f].astype(np.int64)
        b[b == MISSING] = n_bins - 1
        out[:, k] = np.bincount(node * n_bins + b, values, nodes * n_bins).reshape(nodes, n_bins).astype(np.int64)
    return out


def _level(sums: np.ndarray, unit: float, options: Boosting, columns: np.ndarray, level: int) -> list[Split]:
    """The splits of a level from the sums of gradients and Hessians; at the root also the sums of all rows, under the number -1."""
    found = [Split(*x) for x in best_splits(sums[0], sums[1], unit, options, columns)]
    if level == 0:
        found.append(Split(-1, 0, 0, False, 0.0, float(sums[0, 0, 0].sum() * unit), float(sums[1, 0, 0].sum() / UNITS), 0.0, 0.0))
    return found


def _put(forest: Forest, gain: np.ndarray, t: int, m: int, level: int, splits: list[Split], options: Boosting) -> bool:
    """Enters the splits of a level into a tree; whether there were any."""
    grew, first = False, 2**level - 1
    for r in splits:
        if r.node < 0:
            forest.cover[t, m, 0], forest.value[t, m, 0] = r.lh, -options.step * r.lg / (r.lh + options.ridge)
            continue
        grew, k = True, first + r.node
        forest.feature[t, m, k], forest.cut[t, m, k], forest.missing_left[t, m, k], gain[m, k] = r.feature, r.cut, r.missing_left, r.gain
        for child, g, h in ((2 * k + 1, r.lg, r.lh), (2 * k + 2, r.rg, r.rh)):
            forest.cover[t, m, child], forest.value[t, m, child] = h, -options.step * g / (h + options.ridge)
    return grew


def _taken_back(forest: Forest, gain: np.ndarray, t: int, options: Boosting) -> None:
    """Takes back splits with two leaves below that gain less than gamma, from the last node to the first."""
    width = forest.feature.shape[2]
    for m in range(forest.feature.shape[1]):
        for k in range(width // 2 - 1, -1, -1):
            if forest.feature[t, m, k] >= 0 and gain[m, k] < options.gamma and forest.feature[t, m, 2 * k + 1] < 0 and forest.feature[t, m, 2 * k + 2] < 0:
                forest.feature[t, m, k] = -1


def _empty(cuts: list[np.ndarray], base: np.ndarray, options: Boosting, specs: Sequence[Spec]) -> Forest:
    shape = (options.rounds, len(base), 2 ** (options.depth + 1) - 1)
    return Forest(cuts, base, np.full(shape, -1, np.int16), np.zeros(shape, np.int16), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape), list(specs))


ARRAYS = ("feature", "cut", "missing_left", "value", "cover")


def grown(bins: np.ndarray, hashes: np.ndarray, label: np.ndarray, logistic: bool, base: float, unit: float, cuts: list[np.ndarray], options: Boosting) -> Forest:
    """One model from rows at hand."""
    forest, n_bins = _empty(cuts, np.array([base]), options, []), max(len(c) for c in cuts) + 2
    known = ~np.isnan(label)
    bins, hashes, label = bins[known], hashes[known], label[known]
    rows, one, margin = np.arange(len(label)), np.zeros(len(label), np.int64), np.full(len(label), base)
    for t in range(options.rounds):
        columns, gain = drawn_columns(len(cuts), options, t), np.zeros((1, forest.feature.shape[2]))
        g, h = gradients(np.full(len(label), logistic), margin, label, np.full(len(label), unit))
        use = _drawn(hashes, options, t)
        for level in range(options.depth):
            node = forest.leaves(bins, rows, one, t, level) - (2**level - 1)
            own = use & (node >= 0)
            sums = np.stack([node_sums(bins, rows[own], node[own], v[own], 2**level, columns, n_bins) for v in (g, h)])
            if not _put(forest, gain, t, 0, level, _level(sums, unit, options, columns, level), options):
                break
        _taken_back(forest, gain, t, options)
        margin += forest.value[t, one, forest.leaves(bins, rows, one, t)]
    return forest


def train(rows: DataFrame, cuts: list[np.ndarray], specs: Sequence[Spec], options: Boosting) -> Forest:
    """The models of all specs from `prepared` rows; the rows' models are places in specs."""
    rows = settled(rows, "boosting")
    label, logistic = np.array([s.label for s in specs]), np.array([s.objective == "logistic" for s in specs])
    own_label = F.get("labels", F.get(F.array(*(F.lit(int(k)) for k in label)), F.col("m")))
    each = rows.select("hash", "bins", "labels", F.explode("models").alias("m")).withColumn("y", own_label).where("y IS NOT NULL")
    sums = {r.m: r for r in each.groupBy("m").agg(F.avg("y").alias("mean"), F.max(F.abs("y")).alias("most"), F.count("y").alias("n")).collect()}  # a row for each model
    base, unit = np.full(len(specs), np.nan), np.full(len(specs), 1.0 / UNITS)
    for m, r in sums.items():
        mean = min(max(round(r.mean, 9), 1e-6), 1 - 1e-6)
        base[m] = np.log(mean / (1 - mean)) if logistic[m] else round(r.mean, 9)  # the order of the rows is not to show
        if not logistic[m]:
            unit[m] = 2.0 ** np.ceil(np.log2(max(2 * r.most, 1e-300))) / UNITS
    if not sums:
        return _empty(cuts, base, options, specs)
    if max(r.n for r in sums.values()) <= options.group_rows:
        return _by_model(each.select("m", "hash", "bins", "y"), cuts, specs, options, logistic, base, unit)
    tasks = _slots(rows)
    if tasks and 16 * len(specs) * 2 ** (options.depth - 1) * len(drawn_columns(len(cuts), options, 0)) * (max(len(c) for c in cuts) + 2) <= EXCHANGED:
        return _together(rows, cuts, specs, options, label, logistic, base, unit, tasks)
    return _by_level(rows, cuts, specs, options, label, logistic, base, unit)


def _slots(rows: DataFrame) -> int:
    """Tasks that run at the same time for sure; 0 where executors come and go."""
    context = rows.sparkSession.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true" or context.getConf().get("spark.default.parallelism"):
        return 0
    return context.defaultParallelism // int(context.getConf().get("spark.task.cpus", "1"))


def _meeting(context: BarrierTaskContext) -> Callable[[np.ndarray], np.ndarray]:
    """What adds up an array of all tasks of a barrier stage, by connections to the first. Spark's own exchange waits in steps of a second, and there are some hundred levels."""
    first = context.partitionId() == 0
    key = secrets.token_bytes(16)
    listener = Listener(("0.0.0.0", 0), backlog=1024, authkey=key) if first else None
    place = json.loads(context.allGather(json.dumps([listener.address[1], key.hex()]) if first else "")[0])
    infos = context.getTaskInfos()
    if first:
        others = [listener.accept() for _ in infos[1:]]
        listener.close()

        def added(own: np.ndarray) -> np.ndarray:
            whole = own.copy()
            for c in others:
                whole += np.frombuffer(zlib.decompress(c.recv_bytes()), np.int64).reshape(own.shape)
            said = zlib.compress(whole.tobytes(), 1)
            for c in others:
                c.send_bytes(said)
            return whole

        return added
    one = Client((infos[0].address.rsplit(":", 1)[0], place[0]), authkey=bytes.fromhex(place[1]))

    def sent(own: np.ndarray) -> np.ndarray:
        one.send_bytes(zlib.compress(own.tobytes(), 1))
        return np.frombuffer(zlib.decompress(one.recv_bytes()), np.int64).reshape(own.shape)

    return sent


def _together(rows: DataFrame, cuts: list[np.ndarray], specs: Sequence[Spec], options: Boosting, label: np.ndarray, logistic: np.ndarray, base: np.ndarray, unit: np.ndarray, tasks: int) -> Forest:
    """All models in one barrier stage: tasks hold their rows, exchange the sums of each level, and grow the same trees from them."""
    n, n_models, n_bins = len(cuts), len(specs), max(len(c) for c in cuts) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, forest, parts = BarrierTaskContext.get(), _empty(cuts, base, options, specs), []
        added = _meeting(context)

        def take(held: list[pa.RecordBatch]) -> None:
            bins, hashes, labels, row, model, _ = _pairs(pa.Table.from_batches(held).combine_chunks().to_batches()[0], n)
            y = labels[row, label[model]]
            known = ~np.isnan(y)
            row, model = row[known], model[known]
            parts.append((bins, hashes, y[known], row, model, base[model].astype(float)))

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held, size = [*held, batch], size + len(batch.column("models").flatten())
            if size >= CHUNK:
                take(held)
                held, size = [], 0
        if held:
            take(held)
        for t in range(options.rounds):
            columns, gain = drawn_columns(n, options, t), np.zeros((n_models, forest.feature.shape[2]))
            drawn = []
            for bins, hashes, y, row, model, margin in parts:
                use = _drawn(hashes, options, t)[row]
                drawn.append((bins, row[use], model[use], gradients(logistic[model[use]], margin[use], y[use], unit[model[use]])))
            for level in range(options.depth):
                nodes = 2**level
                sums = np.zeros((2, n_models * nodes, len(columns), n_bins), np.int64)
                for bins, row, model, values in drawn:
                    node = forest.leaves(bins, row, model, t, level) - (nodes - 1)
                    own = node >= 0
                    for k, v in enumerate(values):
                        sums[k] += node_sums(bins, row[own], model[own] * nodes + node[own], v[own], n_models * nodes, columns, n_bins)
                whole = added(sums).reshape(2, n_models, nodes, len(columns), n_bins)
                present = [m for m in range(n_models) if whole[1, m].any()]
                if not any([_put(forest, gain, t, m, level, _level(whole[:, m], unit[m], options, columns, level), options) for m in present]):
                    break
            _taken_back(forest, gain, t, options)
            for bins, _, _, row, model, margin in parts:
                margin += forest.value[t, model, forest.leaves(bins, row, model, t)]
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([getattr(forest, c).tobytes()], pa.binary()) for c in ARRAYS], list(ARRAYS))

    dealt = rows.repartition(tasks)
    (one,) = dealt.mapInArrow(run, ", ".join(f"{c} binary" for c in ARRAYS), barrier=True).collect()  # the models: 60 KB each with a hundred rounds
    forest = _empty(cuts, base, options, specs)
    for c in ARRAYS:
        whole = getattr(forest, c)
        whole[:] = np.frombuffer(one[c], whole.dtype).reshape(whole.shape)
    return forest


def _by_model(each: DataFrame, cuts: list[np.ndarray], specs: Sequence[Spec], options: Boosting, logistic: np.ndarray, base: np.ndarray, unit: np.ndarray) -> Forest:
    """Each model in a task; none has more than group_rows rows."""

    def run(group: pa.Table) -> pa.Table:
        m = group.column("m")[0].as_py()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint8).reshape(-1, len(cuts))
        one = grown(bins, group.column("hash").to_numpy(), group.column("y").to_numpy(), bool(logistic[m]), float(base[m]), float(unit[m]), cuts, options)
        return pa.table({"m": pa.array([m], pa.int32()), **{c: pa.array([getattr(one, c).tobytes()], pa.binary()) for c in ARRAYS}})

    forest = _empty(cuts, base, options, specs)
    spread = each.repartition(2 * len(specs), "m")  # a task for about each model; by itself Spark would merge small ones
    for r in spread.groupBy("m").applyInArrow(run, "m int, " + ", ".join(f"{c} binary" for c in ARRAYS)).collect():  # the models: 60 KB each with a hundred rounds
        for c in ARRAYS:
            whole = getattr(forest, c)
            whole[:, r.m] = np.frombuffer(r[c], whole.dtype).reshape(whole.shape[0], whole.shape[2])
    return forest


def _by_level(rows: DataFrame, cuts: list[np.ndarray], specs: Sequence[Spec], options: Boosting, label: np.ndarray, logistic: np.ndarray, base: np.ndarray, unit: np.ndarray) -> Forest:
    """All models level by level, each level one aggregate over all rows."""
    n, forest, n_bins = len(cuts), _empty(cuts, base, options, specs), max(len(c) for c in cuts) + 2
    rows = rows.repartition(1 + rows.count() // TASK_ROWS)
    start = settled(rows.withColumn("margin", F.transform("models", lambda m: F.get(F.array(*(F.lit(float(b)) for b in np.nan_to_num(base))), m))), "boosting")

    def now(batch: pa.RecordBatch, ready: Forest, rounds: int) -> tuple[np.ndarray, ...]:
        bins, hashes, labels, row, model, margin = _pairs(batch, n)
        margin = margin.copy()
        for t in range(rounds):
            margin += ready.value[t, model, ready.leaves(bins, row, model, t)]
        return bins, hashes, labels[row, label[model]], row, model, margin

    def part(first: int, last: int) -> Forest:
        """The trees of some rounds, which tasks need."""
        return Forest(cuts, base, *(getattr(forest, c)[first:last] for c in ARRAYS))

    since = 0
    for t in range(options.rounds):
        columns, gain = drawn_columns(n, options, t), np.zeros((len(specs), forest.feature.shape[2]))
        for level in range(options.depth):
            ready, nodes = part(since, t + 1), 2**level

            def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    bins, hashes, y, row, model, margin = now(batch, ready, t - since)
                    node = ready.leaves(bins, row, model, t - since, level) - (nodes - 1)
                    use = _drawn(hashes, options, t)[row] & ~np.isnan(y) & (node >= 0)
                    row, model, node = row[use], model[use], node[use]
                    values = gradients(logistic[model], margin[use], y[use], unit[model])
                    present, own = np.unique(model, return_inverse=True)
                    if len(present):
                        both = np.stack([node_sums(bins, row, own * nodes + node, v, len(present) * nodes, columns, n_bins) for v in values])
                        for i, m in enumerate(present.tolist()):
                            total[m] = total.get(m, 0) + both[:, i * nodes : (i + 1) * nodes]
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["m", "sums"])

            def split(group: pa.Table) -> pa.Table:
                m = group.column("m")[0].as_py()
                whole = sum(np.frombuffer(x, np.int64) for x in group.column("sums").to_pylist()).reshape(2, nodes, len(columns), n_bins)
                found = _level(whole, unit[m], options, columns, level)
                return pa.table([pa.array([m] * len(found), pa.int32()), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], ["m", *Split._fields])

            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 5]
            gathered = start.mapInArrow(sums_of, "m int, sums binary").groupBy("m")  # a row for each task and model
            found: dict[int, list[Split]] = {}
            for m, *r in gathered.applyInArrow(split, "m int, node int, feature int, cut int, missing_left boolean, gain double, lg double, lh double, rg double, rh double").collect():
                found.setdefault(m, []).append(Split(*r))  # a row for each open node
            if not any([_put(forest, gain, t, m, level, own, options) for m, own in found.items()]):
                break
        _taken_back(forest, gain, t, options)
        if t + 1 < options.rounds and t + 1 - since >= KEEP_EVERY:
            ready = part(since, t + 1)

            def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margin, ends = now(batch, ready, KEEP_EVERY)[-1], batch.column("models").offsets.to_numpy()
                    margins = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(margin))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-1]), margins], batch.schema.names)

            start, since = settled(start.mapInArrow(kept, start.schema), "boosting"), t + 1
    return forest


def predicted(rows: DataFrame, forest: Forest, features: Sequence[str], model: Column) -> Column:
    """What the model of each row (its place; NULL for none) predicts: a probability where it is logistic."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # rounds x models x nodes: the size of the models, not of the rows

    @F.pandas_udf("double")
    def run(m: pd.Series, *x: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.stack([c.to_numpy(float) for c in x], 1), m.fillna(-1).to_numpy(np.int64)))

    found = run(model.cast("int"), *(number(c) for c in features))
    return F.when(~F.isnan(found), found)
