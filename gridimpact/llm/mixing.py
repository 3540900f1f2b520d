"""Document rates that bring soft domains to target weights.

Domains are the combinations of labels in a labelled table. A Gaussian naive Bayes over simple statistics, fitted on all labelled
documents with SQL aggregates, gives every document a posterior over the domains, rounded to `resolution` steps (a documented
parameter). The expected tokens of a domain are the sum of rate * tokens * posterior; nonnegative rates are found by projected
gradient steps on the squared distance from the target totals. A step needs only one small vector, so a document's rate is a
fold of its posterior over the steps so far, and documents with equal posteriors have equal rates: their tokens are added up
once, before the first step. An iteration is two aggregates over that compact table, and only sums over domains reach the
driver. Each iteration takes the best of the plain gradient step (over the largest eigenvalue of the matrix of shared tokens), longer
ones, and gradients scaled by that matrix of the documents that may move. It ends when the projected gradient vanishes; if `iterations` come first, a warning says so.

Defined results: null and empty texts have no tokens and a posterior like any other; without labelled documents there is one domain
and all rates are the number of epochs; repeated rows are separate rows and get equal rates; an empty table gives an empty
table; other columns pass through, except that `mixing_rates` replaces columns named like its outputs.
"""

from __future__ import annotations

import logging
import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import GAP, discard, let, set_aside, text_or_empty, unused, written

log = logging.getLogger(__name__)

MEASURES = ("x_words", "x_word", "x_distinct", "x_symbols", "x_upper", "x_marks")
OUTPUTS = ("n_tokens", "domains", "rate", "copies")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens (words) and the measures, which replace columns of these names."""
    t, w = unused(docs.columns, "_text", "_words")
    rows = docs.drop(*OUTPUTS, *MEASURES).withColumn(t, text_or_empty(text_col))
    rows = rows.withColumn(w, F.filter(F.split(t, GAP, -1), lambda x: x != ""))
    n, size = F.size(w), F.length(t)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    share = lambda pattern: ratio(size - F.length(F.regexp_replace(t, pattern, "")), size)
    values = {
        "x_words": F.log1p(n),
        "x_word": ratio(F.length(F.regexp_replace(t, GAP, "")), n),
        "x_distinct": ratio(F.size(F.array_distinct(w)), n),
        "x_symbols": share("[#*$%&|<>]+"),
        "x_upper": share("[A-Z]+"),
        "x_marks": share("[.,;:!?]+"),
    }
    kept = [c for c in rows.columns if c not in (t, w)]
    return rows.select(*kept, n.cast("long").alias("n_tokens"), *(v.alias(k) for k, v in values.items()))


@dataclass
class Mixer:
    names: list[str]
    log_prior: list[float]
    mean: list[list[float]]
    spread: list[list[float]]
    start: float
    lowest: float
    highest: float
    steps: list[list[float]]
    resolution: int = 1000
    natural: list[float] = field(default_factory=list)  # shares of the tokens as they are; shares of all that is asked: the targets, and what the rates give
    aim: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)
    left: float = 0.0  # the projected gradient at the end, as a root mean square of rates

    def posterior(self) -> Column:
        """array<double> over the domains, in steps of 1 / resolution, from the measures' columns."""
        if len(self.names) == 1:
            return F.array(F.lit(1.0))
        logs = []
        for prior, means, spreads in zip(self.log_prior, self.mean, self.spread, strict=True):
            log = F.lit(prior - sum(math.log(s) for s in spreads))
            for x, m, s in zip(MEASURES, means, spreads, strict=True):
                log = log - F.pow((F.col(x) - m) / s, F.lit(2.0)) / 2
            logs.append(log)
        raised = let(F.array(*logs), lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(F.greatest(v - top, F.lit(-60.0))))))
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        shares = lambda x: let(total(x), lambda t: F.transform(x, lambda v: v / t))
        steps = let(let(raised, shares), lambda x: F.transform(x, lambda v: F.round(v * self.resolution)))
        return let(steps, shares)

    def rate(self, domains: Column) -> Column:
        """The rate after all steps, from the posterior."""
        out: Column = F.lit(self.start)
        if self.steps:
            steps = F.array(*(F.array(*map(F.lit, s)) for s in self.steps))
            move = lambda s: F.aggregate(F.zip_with(s, domains, lambda a, p: a * p), F.lit(0.0), lambda a, b: a + b)
            out = F.aggregate(steps, out, lambda r, s: F.least(F.greatest(r + move(s), F.lit(self.lowest)), F.lit(self.highest)))
        return out

    def applied(self, rows: DataFrame, id_col: str) -> DataFrame:
        """rows (with measures) with domains, rate and copies: the rate's whole part, and one more by a hash of the identifier."""
        both = let(self.posterior(), lambda p: F.struct(p.alias("domains"), F.round(self.rate(p), 9).alias("rate")))
        kept = [c for c in rows.columns if c not in MEASURES]
        (m,) = unused(kept, "_mixed")
        rows = rows.withColumn(m, both).select(*kept, f"{m}.domains", f"{m}.rate")
        chance = F.pmod(F.xxhash64(id_col, F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
        return rows.withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def fit_mixer(
    table: DataFrame,
    labels: DataFrame,
    id_col: str,
    label_cols: tuple[str, ...],
    weights: dict[str, float] | None,
    temperature: float,
    epochs: float,
    lowest: float,
    highest: float | None,
    iterations: int,
    resolution: int = 1000,
    tolerance: float = 1e-5,
) -> Mixer:
    """table: id, n_tokens and the measures of all documents."""
    domain = F.concat_ws("_", *(F.concat(F.lit(c), F.col(c).cast("string")) for c in label_cols))
    known = labels.where(" AND ".join(f"`{c}` IS NOT NULL" for c in label_cols)).select(id_col, domain.alias("domain"))
    stats = table.join(known, id_col).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in MEASURES), *(F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"v_{c}") for c in MEASURES)
    )
    found = sorted(stats.collect(), key=lambda r: r.domain)  # a row for each combination of labels
    mixer = Mixer(["all"], [0.0], [], [], epochs, lowest, math.inf if highest is None else highest, [], resolution)
    if found:
        n = sum(r.n for r in found)
        mixer.names = [r.domain for r in found]
        mixer.log_prior = [math.log(r.n / n) for r in found]
        mixer.mean = [[r[f"m_{c}"] for c in MEASURES] for r in found]
        mixer.spread = [[math.sqrt(r[f"v_{c}"] + 1e-4) for c in MEASURES] for r in found]
    size = len(mixer.names)
    rows = table.groupBy(mixer.posterior().alias("domains")).agg(F.sum("n_tokens").alias("n_tokens"))
    rows = written(rows.where("n_tokens > 0"), "posteriors")  # a row for each posterior, however many documents have it
    p = lambda k: F.get("domains", F.lit(k))
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    sums = rows.agg(*(F.sum(F.col("n_tokens") * p(a) * p(b)).alias(f"m{a}_{b}") for a, b in pairs), *(F.sum(F.col("n_tokens") * p(k)).alias(f"t{k}") for k in range(size))).first()
    natural = np.array([sums[f"t{k}"] or 0.0 for k in range(size)])
    if not natural.sum():
        return mixer
    shared = np.zeros((size, size))
    for a, b in pairs:
        shared[a, b] = shared[b, a] = sums[f"m{a}_{b}"]
    aim = np.array([weights.get(name, 0.0) for name in mixer.names]) if weights else (natural / natural.sum()) ** temperature
    aim = aim / aim.sum() * epochs
    scale = natural.sum()
    mixer.natural, mixer.aim = (natural / scale).tolist(), (aim / aim.sum()).tolist()
    _descend(mixer, rows, natural / scale * epochs, aim, np.linalg.eigvalsh(shared / scale)[-1], scale, iterations, tolerance)
    return mixer


#: Lengths of plain and of scaled steps that are tried, and ridges of the latter.
PLAIN, SCALED, RIDGES = (1, 4, 16, 64, 256, 1024, 4096), (1, 2, 4, 8, 16, 64), (1e-8, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1)


def _descend(mixer: Mixer, rows: DataFrame, totals: np.ndarray, aim: np.ndarray, largest: float, scale: float, iterations: int, tolerance: float) -> None:
    """Adds steps to the mixer until the projected gradient is below `tolerance`; sums are shares of `scale`, rows: domains and n_tokens."""
    size = len(aim)
    number = lambda x: f"double('{float(x)!r}')"
    vector = lambda x: f"array({', '.join(map(number, x))})"
    along = lambda step: f"aggregate(zip_with({step}, domains, (a, p) -> a * p), 0D, (a, b) -> a + b)"
    within = lambda x: f"least(greatest({x}, {number(mixer.lowest)}), {number(mixer.highest)})"
    share = lambda x: round((x or 0.0) / scale, 12)  # noqa: E731  # the order of summation is not to show
    pairs = [(a, b) for a in range(size) for b in range(a, size)]
    fixed = f"(r <= {number(mixer.lowest)} AND g < 0) OR (r >= {number(mixer.highest)} AND g > 0)"
    state, kept = rows.withColumn("r", F.lit(float(mixer.start))), None
    for turn in range(iterations + 1):
        if turn % 10 == 0:  # so that the plan stays short
            state, old = written(state, "rates"), kept
            kept = state
            if old is not None:
                discard(old)
        gap = aim - totals
        now = state.selectExpr("domains", "n_tokens", "r", f"{along(vector(gap))} AS g")
        now = now.selectExpr("domains", "n_tokens", f"{within(f'r + g / {number(largest)}')} - r AS change", f"IF({fixed}, 0L, n_tokens) AS free")
        found = now.selectExpr("sum(n_tokens * change * change) AS change", *(f"sum(free * domains[{a}] * domains[{b}]) AS m{a}_{b}" for a, b in pairs)).first()
        mixer.left = math.sqrt(share(found.change))
        if mixer.left <= tolerance or turn == iterations:
            break
        shared = np.zeros((size, size))
        for a, b in pairs:
            shared[a, b] = shared[b, a] = share(found[f"m{a}_{b}"])
        steps = [gap / largest * x for x in PLAIN]  # the first never leads up
        steps += [x * np.linalg.solve(shared + ridge * largest * np.eye(size), gap) for ridge in RIDGES for x in SCALED]
        steps = [[round(float(x), 9) for x in step] for step in steps]
        tried = state.selectExpr("domains", "n_tokens", "r", f"posexplode(array({', '.join(map(vector, steps))})) AS (j, step)")
        tried = tried.selectExpr("j", "domains", f"n_tokens * {within(f'r + {along("step")}')} AS c")
        reached = tried.groupBy("j").agg(*(F.expr(f"sum(c * domains[{k}])").alias(f"t{k}") for k in range(size))).collect()  # a row for each step
        reached = {x.j: np.array([share(x[f"t{k}"]) for k in range(size)]) for x in reached}
        best = min(reached, key=lambda j: (round(float(((aim - reached[j]) ** 2).sum()), 15), j))
        mixer.steps.append(steps[best])
        state, totals = state.selectExpr("domains", "n_tokens", f"{within(f'r + {along(vector(steps[best]))}')} AS r"), reached[best]
    discard(kept)
    mixer.reached = (totals / aim.sum()).tolist()
    if mixer.left > tolerance:
        warnings.warn(f"mixing stops after {iterations} iterations with a projected gradient of {mixer.left:.2g}, above {tolerance:.2g}", stacklevel=2)


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_cols: tuple[str, ...] = ("quality", "toxic"),
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    epochs: float = 1.0,
    lowest: float = 0.0,
    highest: float | None = 8.0,
    iterations: int = 400,
    again: bool = True,
    resolution: int = 1000,
) -> DataFrame:
    """docs with n_tokens, domains (posterior), rate and copies. weights: a share for each domain, else natural shares to the power `temperature`.

    highest: the largest rate, None for no bound; iterations: a limit for targets that no rates within the bounds come near.
    again: read docs again for the result, with all its columns; else only the identifier is returned, from the table of measures.
    What the rates reach is logged, a line for each domain.
    """
    table = written(measured(docs).select(id_col, "n_tokens", *MEASURES), "measures")
    mixer = fit_mixer(table, labels, id_col, label_cols, weights, temperature, epochs, lowest, highest, iterations, resolution)
    for line in zip(mixer.names, mixer.natural, mixer.aim, mixer.reached, strict=False):
        log.info("domain %s: natural share %.4f, target %.4f, reached %.4f", *line)
    if not again:
        return mixer.applied(table, id_col)
    own, names = set_aside(docs, MEASURES)
    return mixer.applied(measured(own), id_col).withColumnsRenamed(names)


def mixed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with each row as often as its rate says; all columns pass through."""
    own, names = set_aside(docs, OUTPUTS)
    rated = written(mixing_rates(own, labels, **options).select(*own.columns, "copies"), "rated")
    (copy,) = unused(own.columns, "_copy")
    rows = rated.where("copies > 0").withColumn(copy, F.explode(F.expr("sequence(1, copies)"))).select(*own.columns)
    return rows.withColumnsRenamed(names)
