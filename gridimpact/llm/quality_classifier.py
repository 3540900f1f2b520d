"""Quality scores from a sparse ensemble of rules.

Simple statistics of each text are Spark columns. On a bounded labelled sample a small random forest is grown, every path
from a root to a node becomes a conjunctive rule over the statistics, and a logistic regression with a lasso penalty picks
and weighs the rules. The rules that keep a weight are compiled into one Spark column, so scoring is one pass over the text
without Python.

The fit reads at most `max_rows` labelled rows, chosen by a hash of the identifier.

Defined results: null and empty texts have statistics of zero and are scored like any other; if the rows to learn from lack a
class, every score is the share of good rows (0.5 without rows); repeated rows are separate rows; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridimpact.llm.common import GAP, bounded_sample, fold_of, set_aside, text_or_empty, unused, written

#: A condition on a statistic: its name, whether it must exceed the threshold, the threshold. A rule is a conjunction.
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]

STATISTICS = tuple(
    f"_stat_{s}"
    for s in (
        "log_words", "mean_word", "distinct_words", "distinct_lines", "symbols", "bars", "exclamations", "upper", "digits", "punctuation", "spaces", "long_words",
    )
)
OUTPUTS = ("held_out", "score", "predicted")


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep, and the statistics of the text as doubles."""
    own, words, n, chars, lines = unused(keep, "_text", "_words", "_n", "_chars", "_lines")
    text = F.col(own)
    rows = docs.select(*keep, text_or_empty(text_col).alias(own))
    rows = rows.withColumn(words, F.filter(F.split(text, GAP, -1), lambda w: w != ""))
    rows = rows.withColumns({n: F.size(words), chars: F.length(text), lines: F.split(text, "\n", -1)})
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    share = lambda pattern: ratio(F.col(chars) - F.length(F.regexp_replace(text, pattern, "")), F.col(chars))
    values = {
        "log_words": F.log1p(n),
        "mean_word": ratio(F.length(F.regexp_replace(text, GAP, "")), F.col(n)),
        "distinct_words": ratio(F.size(F.array_distinct(words)), F.col(n)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "symbols": share("[#*$%&<>]+"),
        "bars": share(r"\|+"),
        "exclamations": share("!+"),
        "upper": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "punctuation": share("[.,;:?]+"),
        "spaces": share(GAP),
        "long_words": ratio(F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]{1,24}(?=[\x20\x09-\x0D]|$)", "")), F.col(chars)),
    }
    return rows.select(*keep, *(values[s.removeprefix("_stat_")].cast("double").alias(s) for s in STATISTICS))


def tree_rules(forest, names: tuple[str, ...]) -> list[Rule]:
    """The path to every node of every tree, without repeats, in order."""
    rules: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            rules.setdefault(simplified(path))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, threshold = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, False, threshold)))
            walk(node.rightChild(), (*path, (name, True, threshold)))

    for tree in forest._java_obj.trees():
        walk(tree.rootNode(), ())
    return list(rules)


def simplified(path: Rule) -> Rule:
    """One condition for each statistic and direction."""
    tight: dict[tuple[str, bool], float] = {}
    for name, above, threshold in path:
        was = tight.get((name, above), threshold)
        tight[name, above] = max(was, threshold) if above else min(was, threshold)
    return tuple(sorted((name, above, threshold) for (name, above), threshold in tight.items()))


def holds(rule: Rule) -> Column:
    tests = [F.col(name) > threshold if above else F.col(name) <= threshold for name, above, threshold in rule]
    return reduce(lambda a, b: a & b, tests)


class RuleModel:
    def __init__(self, intercept: float, rules: list[tuple[float, Rule]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The probability of label 1 from the statistics' columns."""
        terms = [F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))


def fit(sample: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 11) -> RuleModel:
    """sample: label (0 or 1) and the statistics."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1, 0) / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)), [])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample.withColumn("label", F.col("label").cast("double")))
    forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=seed).fit(vectors)
    rules = tree_rules(forest, STATISTICS)
    table = sample.select(F.col("label").cast("double").alias("label"), *(holds(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    matrix = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="x").transform(table).select("label", "x")
    lasso = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(matrix)
    return RuleModel(lasso.intercept, [(float(w), r) for w, r in zip(lasso.coefficients.toArray(), rules, strict=True) if w])


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", folds: int = 4, held_out: int = 2, max_rows: int = 10_000, threshold: float = 0.7, keep: list[str] | None = None
) -> DataFrame:
    """id (and columns to keep), held_out, score and predicted of every document; labels of the held-out fold are never read."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col(id_col), folds) != held_out))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("label"))
    chosen = bounded_sample(known, "id", max_rows)
    rows = docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    sample = written(statistics(rows, ["label"]).coalesce(4), "sample")  # an identifier is learned from once
    model = fit(sample)
    keep = [id_col, *(c for c in keep or [] if c != id_col and c not in OUTPUTS)]
    docs, back = set_aside(docs, STATISTICS)  # columns that a statistic's name would hide
    there = {v: k for k, v in back.items()}
    (score,) = unused(docs.columns, "_score")
    scored = statistics(docs, [there.get(c, c) for c in keep]).withColumn(score, model.score())
    return scored.select(
        *(F.col(there.get(c, c)).alias(c) for c in keep),
        (fold_of(F.col(id_col), folds) == held_out).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= threshold).cast("int").alias("predicted"),
    )
