"""Quality classifier: a sparse rule ensemble.

Boosted trees over statistics of the text propose conjunctive rules (their paths); a lasso logistic
regression weighs the rules and drops most of them; what is left is compiled into one Spark column
expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import pyarrow as pa

from . import docstats, labelled, trees

#: Labelled rows that the rules are fitted on, at most.
MOST_LABELS = 20_000
TREES, DEPTH, RATE, SEED = 40, 3, 0.2, 7
PENALTY = 0.003
THRESHOLD = 0.3


@dataclass
class RuleModel:
    """Weighted conjunctions over named statistics; a score is the logistic function of their sum."""

    names: list[str]
    rules: list[tuple[tuple[int, str, float], ...]]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as an expression over columns named like the statistics."""
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            terms = [F.col(self.names[f]) <= F.lit(cut) if op == "<=" else F.col(self.names[f]) > F.lit(cut) for f, op, cut in rule]
            total = total + F.when(reduce(lambda a, b: a & b, terms), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return trees.sigmoid(trees.rule_matrix(self.rules, x) @ np.array(self.weights) + self.intercept) if self.rules else np.full(len(x), trees.sigmoid(self.intercept))


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = docstats.QUALITY) -> RuleModel:
    """Without rows of both labels the model is the share of ones (0.5 without rows)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if len(np.unique(y)) < 2:
        return RuleModel(names, [], [], float(np.log(share / (1 - share))))
    _, grown = trees.boost(x, y, TREES, DEPTH, RATE, SEED)
    rules = trees.rules_of(grown)
    intercept, w = trees.lasso_logistic(trees.rule_matrix(rules, x), y, PENALTY)
    kept = [j for j in np.flatnonzero(np.abs(w) > 1e-9)]
    return RuleModel(names, [rules[j] for j in kept], [float(w[j]) for j in kept], intercept)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", most: int = MOST_LABELS) -> RuleModel:
    rows = labelled.sample(docs, labels, label, usable, most)
    return fit(*labelled.collected(rows, docstats.quality_stats, len(docstats.QUALITY), most))


def quality_scores(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Columns of `docs` but for text, the statistics, and score double: one row per row.

    Null and empty texts have statistics of 0 and are scored like any other. A column of `docs` that has
    the name of a statistic is replaced by it, and so is a column score. Repeated rows and ties get equal scores, one row
    each; texts of any length are scored whole; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "text" and c not in docstats.QUALITY]
    extra = T.StructType([T.StructField(n, T.DoubleType()) for n in docstats.QUALITY])
    stats = labelled.with_columns(docs, extra, lambda t: [pa.array(c) for c in docstats.quality_stats(t).T], keep)
    return stats.withColumn("score", model.column())
