"""Quality of texts by a sparse ensemble of rules over statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import as_row, fold, labelled_sample, let, whole

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
# Labelled documents of each label that the rules are fitted on.
SAMPLE = 8000
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 24, 0.3, 10
PENALTY, STEPS = 2e-3, 400


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text, each defined (mostly 0) for the empty one."""
    length = F.greatest(F.length(text), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    share = lambda pattern: (F.length(text) - without(pattern)) / length
    words = F.split(text, r"[\x20\x09-\x0D]+")
    variety = let(words, lambda w: F.size(F.array_distinct(w)) / F.sqrt(F.size(w).cast("double")))
    return {
        "log_length": F.ln(length),
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "bangs": share(r"!+"),
        "bars": share(r"\|+"),
        "signs": share(r"[#$%&*<>{}\[\]\\^~@=+]+"),
        "spaces": share(r"[\x20\x09-\x0D]+"),
        "lines": share(r"\n+"),
        "repeats": (F.length(text) - without(r"(?<!\S)(\S+)\s(?=\1(?!\S))")) / length,
        "variety": variety,
        "fresh": let(words, lambda w: F.size(F.array_distinct(w)) / F.size(w)),
    }


@dataclass
class Rules:
    """Conjunctions of (statistic, above?, bound), their weights, and an intercept."""

    rules: list[tuple[tuple[str, bool, float], ...]]
    weights: list[float]
    intercept: float

    def score(self, names: dict[str, Column]) -> Column:
        """The probability of label 1, as one Spark expression."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            parts = [names[n] > bound if above else names[n] <= bound for n, above, bound in rule]
            total = total + F.when(reduce(and_, parts), F.lit(float(weight))).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """The paths to all nodes of boosted regression trees, as tuples of (column, above?, bound)."""
    bounds = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[tuple, None] = {}

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        p = 1 / (1 + np.exp(-margin[rows]))
        slope, curve = y[rows] - p, p * (1 - p)
        best = (1e-6, None, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            whole_gain = slope.sum() ** 2 / (curve.sum() + 1)
            for j, cuts in enumerate(bounds):
                if not len(cuts):
                    continue
                place = np.searchsorted(cuts, x[rows, j], side="left")
                n = np.bincount(place, minlength=len(cuts) + 1).cumsum()[:-1]
                g = np.bincount(place, slope, minlength=len(cuts) + 1).cumsum()
                h = np.bincount(place, curve, minlength=len(cuts) + 1).cumsum()
                gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1) - whole_gain
                gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                if gain.max(initial=0) > best[0]:
                    best = (gain.max(), j, cuts[int(gain.argmax())])
        if path:
            found[path] = None
        if best[1] is None:
            steps[rows] = RATE * slope.sum() / (curve.sum() + 1)
            return
        _, j, bound = best
        above = x[rows, j] > bound
        for side in (False, True):
            grow(rows[above == side], (*path, (j, side, float(bound))), depth + 1)

    for _ in range(TREES):
        steps = np.zeros(len(y))
        grow(np.arange(len(y)), (), 0)
        margin += steps
    return list(found)


def _lasso(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal steps."""
    center = z.mean(axis=0)
    z = z - center
    size = 0.25 * np.linalg.norm(np.hstack([z, np.ones((len(z), 1))]), 2) ** 2 / len(z) + 1e-9
    weights, level, pull, base, t = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ pull + base))) - y
        moved = pull - z.T @ error / len(z) / size
        new = np.sign(moved) * np.maximum(np.abs(moved) - PENALTY / size, 0)
        new_level = base - error.mean() / size
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull, base = new + (t - 1) / after * (new - weights), new_level + (t - 1) / after * (new_level - level)
        weights, level, t = new, new_level, after
    return weights, float(level - center @ weights)


def fit(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE) -> Rules:
    """Rules fitted on at most ``rows`` labelled documents of each label outside the held-out fold.

    Only their statistics, twelve numbers each, come to the driver. Without labelled documents
    there are no rules, and every text scores 0.5.
    """
    train = fold("doc_id", FOLDS) != HELD_OUT
    sample = labelled_sample(docs, marks, "quality", train, {0: rows, 1: rows})
    measures = statistics(F.col("text"))
    table = sample.select("label", "doc_id", *(c.alias(n) for n, c in measures.items())).toPandas().sort_values(["doc_id", "label"])
    names, y = list(measures), table["label"].to_numpy(float)
    if not len(y):
        return Rules([], [], 0.0)
    x = table[names].to_numpy(float)
    paths = _paths(x, y)
    if not paths:
        return Rules([], [], float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    z = np.stack([np.all([(x[:, j] > b) == side for j, side, b in path], axis=0) for path in paths], axis=1).astype(float)
    weights, intercept = _lasso(z, y)
    used = np.flatnonzero(weights)
    named = [tuple((names[j], side, bound) for j, side, bound in paths[i]) for i in used]
    return Rules(named, weights[used].tolist(), intercept)


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """``row``, all columns of ``docs``, and ``score``: the rules over the statistics of each whole text; null is empty."""
    measures = statistics(whole("text"))
    used = {name for rule in rules.rules for name, _, _ in rule}
    named = {name: f"_stat_{name}" for name in measures if name in used}
    measured = docs.select(as_row(docs), *(measures[name].alias(alias) for name, alias in named.items()))
    score = rules.score({name: F.col(alias) for name, alias in named.items()})
    return measured.select("row", score.alias("score"))


def quality(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row, the empty texts too.

    ``score`` is the probability of quality 1 from the text alone. Rows with a null id count as
    the empty id for the fold and are never learned from.
    """
    rated = scored(docs.select("doc_id", "text"), fit(docs, marks, rows))
    held_out = fold(F.col("row.doc_id"), FOLDS) == HELD_OUT
    return rated.select(
        "row.doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be of quality 1, unchanged."""
    return scored(docs, fit(docs, marks, rows)).filter(F.col("score") >= THRESHOLD).select("row.*")
