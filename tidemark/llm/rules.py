"""Quality classifier as a sparse rule ensemble (after RuleFit, Friedman and Popescu, 2008).

Statistics of the whole text are Spark columns. Shallow trees grown on labelled rows give conjunctive rules, one for each
node; an L1-penalised logistic regression over the rules keeps a few, and those are compiled back into one Spark column.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD
from tidemark.llm.langid import held_out
from tidemark.workspace import materialise

#: The classifier is fitted on a hash sample of about so many labelled rows; everything else covers all documents.
TRAIN_ROWS = 60_000

TREES, DEPTH, LEAST_ROWS = 24, 4, 12
PENALTY, STEPS = 1e-3, 400


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text, never null: a null or empty text has 0 in all of them."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.split(text, "\n")

    def chars(kept: str) -> Column:
        """How many characters are of the class ``kept``."""
        return F.char_length(F.regexp_replace(text, f"[^{kept}]+", ""))

    def per(part: Column, whole: Column) -> Column:
        return (part / F.greatest(whole, F.lit(1))).cast("double")

    n_chars, n_words = F.char_length(text), F.size(words)
    letters, sentences = chars(r"\p{L}"), chars(".!?")
    return {
        "log_chars": F.log1p(n_chars.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": per(n_chars, n_words),
        "letters": per(letters, n_chars),
        "upper_case": per(chars(r"\p{Lu}"), letters),
        "digits": per(chars(r"\p{N}"), n_chars),
        "symbols": per(chars(r"\p{S}\p{P}&&[^.,]"), n_words),
        "commas": per(chars(","), n_words),
        "sentences": per(sentences, n_words),
        "distinct_words": per(F.size(F.array_distinct(words)), n_words),
        "line_words": per(n_words, F.size(lines)),
        "distinct_lines": per(F.size(F.array_distinct(lines)), F.size(lines)),
        "capitalised": per(F.size(F.regexp_extract_all(text, F.lit(r"(?<![\p{L}])\p{Lu}\p{Ll}"), F.lit(0))), n_words),
    }


@dataclass(frozen=True)
class Rule:
    """All of ``low`` < statistic <= ``high``, for each named statistic; ``weight`` is its part in the log-odds."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float = 0.0

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(rows[f] > low) & (rows[f] <= high) for f, low, high in self.bounds])

    def column(self) -> Column:
        parts = [F.col(f) > F.lit(low) for f, low, _ in self.bounds if low > -math.inf] + [F.col(f) <= F.lit(high) for f, _, high in self.bounds if high < math.inf]
        held = parts[0]
        for part in parts[1:]:
            held = held & part
        return held


def tree_rules(description: str, names: list[str]) -> list[Rule]:
    """A rule for every node but the root of a tree in Spark's text form, the bounds on one statistic merged."""
    path: list[tuple[int, str, float, float]] = []
    found = []
    for line in description.splitlines():
        test = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if not test:
            continue
        depth, feature, value = len(test[1]), names[int(test[2])], float(test[4])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, feature, -math.inf, value) if test[3] == "<=" else (depth, feature, value, math.inf))
        bounds: dict[str, tuple[float, float]] = {}
        for _, f, low, high in path:
            was = bounds.get(f, (-math.inf, math.inf))
            bounds[f] = (max(low, was[0]), min(high, was[1]))
        found.append(Rule(tuple((f, *bounds[f]) for f in sorted(bounds))))
    return found


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log-loss plus ``penalty`` times the weights' absolute sum (FISTA)."""
    n, k = x.shape
    x = x.astype(np.float32)
    moved = np.ones(k, np.float32)
    for _ in range(20):  # power iteration for the step size
        moved = x.T @ (x @ moved) / n
        scale = float(np.linalg.norm(moved)) or 1.0
        moved /= scale
    rate = 1 / (0.25 * (scale + 1))
    w = z = np.zeros(k, np.float32)
    share = (y.sum() + 0.5) / (n + 1)
    b = c = math.log(share / (1 - share))
    t = 1.0
    for _ in range(steps):
        miss = (1 / (1 + np.exp(-(x @ z + c))) - y).astype(np.float32)
        step = z - rate * (x.T @ miss) / n
        w_next = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b_next, t_next = c - rate * float(miss.mean()), (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, b


def fit_rules(labelled: DataFrame, names: list[str], label_col: str, seed: int = 7) -> tuple[list[Rule], float]:
    """The rules with a weight and the intercept, from rows with the statistics ``names`` and a 0/1 label.

    With labels of one kind only (or none) there is no rule and the intercept is the smoothed share of label 1.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        return [], math.log(share / (1 - share))
    vectors = VectorAssembler(inputCols=names, outputCol="statistics").transform(labelled.withColumn(label_col, F.col(label_col).cast("double")))
    forest = RandomForestClassifier(labelCol=label_col, featuresCol="statistics", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="0.6", subsamplingRate=0.7, seed=seed)
    rules = sorted({r for tree in forest.fit(vectors).trees for r in tree_rules(tree.toDebugString, names)}, key=lambda r: r.bounds)
    sample = labelled.select(*names, label_col).toPandas()
    rows = {f: sample[f].to_numpy() for f in names}
    held = np.stack([r.holds(rows) for r in rules], axis=1) if rules else np.zeros((len(sample), 0))
    _, first = np.unique(held, axis=1, return_index=True)  # of rules that hold for the same rows one is enough
    chosen = [rules[i] for i in sorted(first)]
    weights, intercept = lasso_logistic(held[:, sorted(first)], sample[label_col].to_numpy())
    return [Rule(r.bounds, float(w)) for r, w in zip(chosen, weights, strict=True) if w], intercept


def rule_score(rules: list[Rule], intercept: float) -> Column:
    """The probability of label 1, over columns named as the statistics."""
    total = F.lit(intercept)
    for rule in rules:
        total = total + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, fold: int = 0, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Learns from labels of documents outside the fold only; null labels and labels without a document are left out, each of
    several labels of a document counts. Empty and null texts are scored by their zero statistics, repeated rows are each
    returned, a null id counts as empty text for the fold and has no label. Other columns are ignored.
    """
    stats = statistics(F.col("text"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = materialise(rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), *(c.alias(f) for f, c in stats.items())), "statistics")
    known = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")).dropna()
    labelled = materialise(table.where("not held_out").join(known, F.col("doc_id") == F.col("of")).select(*stats, "doc_id", "label"), "labelled")
    share = min(1.0, train_rows / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rules, intercept = fit_rules(sample, list(stats), "label")
    score = rule_score(rules, intercept)
    return table.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
