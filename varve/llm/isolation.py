"""Documents whose rule statistics are unlike those of others, by isolation forests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import whole
from varve.operators.running import running
from varve.shared import materialize, removed_after

TREES, TREE_ROWS, DEPTH = 100, 256, 8
# A share of the good documents lost weighs as much as so many times that share of the bad ones caught.
GOOD_WORTH = 100.0
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\v\f\r"
# Columns of ``rates`` by forest: length of words, symbols among them, and how much of a text repeats.
VIEWS = ((0,), (1,), (2, 3))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more, its first place included.

    Runs are numbered by their first two words, then three, and so on; once all numbers differ,
    longer runs differ too.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.array([seen.setdefault(word, len(seen)) for word in words], np.int64)
    number = ids[:n]
    for step in range(1, window):
        kinds, number = np.unique(number * len(seen) + ids[step : step + n], return_inverse=True)
        if len(kinds) == n:
            return 0
    twice = np.bincount(number)[number] > 1
    inside = np.zeros(len(ids), bool)
    for step in range(window):
        inside[step : step + n] |= twice
    return int(inside.sum())


def statistics(text: str) -> tuple[int, ...]:
    """``COUNTS`` of one whole text; bytes split at the same six blanks as the rules name."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def rates(counts: np.ndarray) -> np.ndarray:
    """What the forests split on. The length itself is left out: long documents are no anomaly."""
    n_words, chars, symbols, dup_lines, repeated, lines = counts.T.astype(float)
    words = np.maximum(n_words, 1)
    return np.stack([chars / words, symbols / words, dup_lines / np.maximum(lines, 1), repeated / words], axis=1)


def failed(counts: np.ndarray) -> np.ndarray:
    """The base rules: too few words, or too many of them repeated."""
    return (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of ``n`` rows."""
    return 0.0 if n < 2 else 2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees side by side: per tree and node the column and bound of its split, the first of its two
    children (0 for a leaf), and for a leaf the length of the path to a row in it."""

    column: np.ndarray
    bound: np.ndarray
    child: np.ndarray
    path: np.ndarray
    usual: float
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 for rows that few splits set apart."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, bound, child, path in zip(self.column, self.bound, self.child, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                right = x[rows, column[node]] > bound[node]
                node = np.where(child[node] > 0, child[node] + right, node)
            total += path[node]
        return 2.0 ** (-total / max(1, len(self.column)) / self.usual)


def grow(samples: list[np.ndarray], seed: int = 42) -> Forest:
    """A tree for each of ``samples``, of equal length; it splits a random column, of those that vary, at a random place."""
    random = np.random.default_rng(seed)
    size = 2 ** (DEPTH + 1)
    shape = (len(samples), size)
    forest = Forest(np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), 1.0)
    forest.usual = max(expected_path(len(samples[0])), 1e-9)
    for tree, sample in enumerate(samples):
        open_ = [(0, 0, sample)]
        used = 1
        while open_:
            node, depth, own = open_.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if depth == DEPTH or not len(varied):
                forest.path[tree, node] = depth + expected_path(len(own))
                continue
            column = int(random.choice(varied))
            bound = random.uniform(low[column], high[column])
            right = own[:, column] > bound
            forest.column[tree, node], forest.bound[tree, node], forest.child[tree, node] = column, bound, used
            open_ += [(used, depth + 1, own[~right]), (used + 1, depth + 1, own[right])]
            used += 2
    return forest


def best_cut(scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """The gain of the best threshold and the threshold: the bad caught, less the good lost at their weight.

    ``good`` and ``bad`` hold the share that each row is of all such rows. The threshold lies
    halfway between two scores that occur; it is infinite where no cut gains.
    """
    kinds, place = np.unique(scores, return_inverse=True)
    above = lambda share: np.bincount(place, share, len(kinds))[::-1].cumsum()[::-1]
    gain = above(bad) - GOOD_WORTH * above(good)
    best = len(gain) - 1 - int(np.argmax(gain[::-1]))
    if gain[best] <= 1e-12:
        return 0.0, np.inf
    return float(gain[best]), float((kinds[best] + kinds[best - 1]) / 2) if best else float(kinds[0])


def thresholds(scores: list[np.ndarray], good: np.ndarray) -> list[float]:
    """A threshold for each list of scores, the one that gains most first; each next one counts only the
    rows that those before it leave."""
    chosen = [np.inf] * len(scores)
    if good.all() or not good.any():
        return chosen
    left, shares = np.ones(len(good), bool), (good / good.sum(), ~good / (~good).sum())
    while True:
        cuts = [best_cut(s, *(share * left for share in shares)) if t == np.inf else (0.0, np.inf) for s, t in zip(scores, chosen)]
        best = max(range(len(cuts)), key=lambda i: cuts[i][0])
        if cuts[best][0] <= 0:
            return chosen
        chosen[best] = cuts[best][1]
        left &= scores[best] < chosen[best]


def calibrated(scored: DataFrame, forests: int) -> list[float]:
    """What ``thresholds`` finds, for a stored table of any length: ``good`` (boolean) and the list ``scores`` of each row.

    Rows are counted for each score that occurs, and the counts run on along the scores; a few numbers a forest
    come to the driver.
    """
    chosen = [np.inf] * forests
    n_good, n_bad = scored.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    while n_good and n_bad:
        left = F.lit(True)
        for at, bound in enumerate(chosen):
            left = left & (F.get("scores", F.lit(at)) < F.lit(bound))
        each = scored.select(F.posexplode("scores").alias("forest", "score"), (F.col("good") & left).alias("good"), (~F.col("good") & left).alias("bad"))
        kinds = each.groupBy("forest", "score").agg(F.count_if("good").alias("good"), F.count_if("bad").alias("bad"))
        kinds = materialize(kinds.filter(F.col("forest").isin([at for at, bound in enumerate(chosen) if bound == np.inf])))
        summed = running(kinds, ["forest"], ["score"], {"good_to": "good", "bad_to": "bad"}, whole={"goods": "good_to", "bads": "bad_to"})
        good, bad = (F.col(f"{name}s") - F.col(f"{name}_to") + F.col(name) for name in ("good", "bad"))
        cuts = summed.groupBy("forest").agg(F.max(F.struct((bad / n_bad - GOOD_WORTH * good / n_good).alias("gain"), "score")).alias("cut")).collect()
        best = max(cuts, key=lambda row: (row.cut.gain, -row.forest), default=None)
        if best is None or best.cut.gain <= 1e-12:
            break
        below = kinds.filter((F.col("forest") == best.forest) & (F.col("score") < best.cut.score)).agg(F.max("score")).first()[0]
        chosen[best.forest] = best.cut.score if below is None else (best.cut.score + below) / 2
    return chosen


def tree_samples(rows: DataFrame, trees: int = TREES, size: int = TREE_ROWS) -> list[np.ndarray]:
    """For each tree the ``COUNTS`` of ``size`` of all ``rows`` of a stored table, unique in ``doc_id``, at random (all, if fewer).

    A hash of tree and id orders the rows for each tree; the first ones are taken. Only rows that
    are early in the order of a tree come to the driver, about twice as many as it takes.
    """
    n = rows.count()
    taken, share = min(size, n), min(1.0, 2 * size / max(n, 1))
    while taken:
        place = lambda tree: F.shiftrightunsigned(F.xxhash64(F.lit("tree"), tree, "doc_id"), 11) / float(1 << 53)
        early = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.struct(tree.alias("tree"), place(tree).alias("place"))), lambda one: one["place"] < share)
        found = rows.select(F.explode(early).alias("one"), "doc_id", *COUNTS).select("one.*", "doc_id", *COUNTS).toPandas()
        found = found.sort_values(["tree", "place", "doc_id"])
        own = [part[list(COUNTS)].to_numpy(np.int64)[:taken] for _, part in found.groupby("tree")]
        if len(own) == trees and all(len(one) == taken for one in own):
            return own
        share *= 2
    return []


def labelled(table: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``counted`` that have a label and pass the base rules, with ``label``.

    An id counts once: with the least of its labels and, of its texts, the one with the least hash.
    """
    known = marks.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    usable = known.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label")).filter("label IN (0, 1)")
    first = table.join(usable, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("hash", *COUNTS)).alias("row"))
    return first.select("doc_id", "label", "row.*").filter(
        (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words"))
    )


def fit(docs: DataFrame, marks: DataFrame) -> list[Forest]:
    """A forest for each of ``VIEWS``, over all labelled documents that pass the base rules.

    Each tree takes its own ``TREE_ROWS`` of them, as the method has it; the thresholds are calibrated
    on every one. The labels serve the thresholds alone: one view may tell bad documents apart
    where the other finds only uncommon good ones. Without rows there are no forests.
    """
    with removed_after(docs.sparkSession):
        return fitted(materialize(counted(docs)), marks)


def fitted(table: DataFrame, marks: DataFrame) -> list[Forest]:
    rows = materialize(labelled(table, marks))
    samples = [rates(sample) for sample in tree_samples(rows)]
    forests = [grow([sample[:, view] for sample in samples]) for view in VIEWS] if samples else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rates(np.stack([column.to_numpy() for column in batch.columns[1:]], axis=1))
            scores = np.stack([forest.scores(x[:, view]) for forest, view in zip(forests, VIEWS)], axis=1)
            yield pa.record_batch([batch.column(0), pa.array(list(scores), pa.list_(pa.float64()))], names=["good", "scores"])

    if not forests:
        return []
    scored = rows.select((F.col("label") == 1).alias("good"), *COUNTS).mapInArrow(run, "good boolean, scores array<double>")
    return [replace(forest, threshold=bound) for forest, bound in zip(forests, calibrated(materialize(scored), len(forests)))]


def anomalies(forests: list[Forest], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest score of each row, and whether one of its scores reaches the threshold of its forest."""
    top, out = np.full(len(counts), np.nan), np.zeros(len(counts), bool)
    x = rates(counts)
    for forest, view in zip(forests, VIEWS):
        scores = forest.scores(x[:, view])
        top, out = np.fmax(top, scores), out | (scores >= forest.threshold)
    return top, out


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id``, a ``hash`` of the text and ``COUNTS`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(text.as_py()) for text in batch.column(0)], np.int64).reshape(-1, len(COUNTS))
            columns = [*batch.columns[1:], *(pa.array(column) for column in rows.T)]
            yield pa.record_batch(columns, names=[*batch.schema.names[1:], *COUNTS])

    read = docs.select(whole("text").alias("text"), "doc_id", F.xxhash64(whole("text")).alias("hash"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in read.schema.fields[1:]]
    return read.mapInArrow(run, ", ".join([*kinds, *(f"{name} bigint" for name in COUNTS)]))


def isolate(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every row as ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``anomaly`` and ``kept``.

    ``anomaly`` is the highest score of the forests over rates of the whole text; documents that pass the base
    rules go where a score reaches the threshold of its forest. Null texts are empty and fail the base rules, as
    every text of fewer than ten words does. Without labelled rows of both labels that pass them, the
    base rules alone decide (``anomaly`` is null without any). Repeated rows each get a row, a null id too.
    The counts are written down once, for the fit and the verdicts.
    """
    table = materialize(counted(docs), outlast=True)
    with removed_after(docs.sparkSession):
        forests = fitted(table, marks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([column.to_numpy() for column in batch.columns[1:]], axis=1)
            base = failed(counts)
            top, out = anomalies(forests, counts)
            columns = [*batch.columns[:-1], pa.array(base), pa.array(top, pa.float64(), from_pandas=True), pa.array(~base & ~out)]
            yield pa.record_batch(columns, names=["doc_id", *COUNTS[:-1], "base_failed", "anomaly", "kept"])

    longs = ", ".join(f"{name} bigint" for name in COUNTS[:-1])
    return table.select("doc_id", *COUNTS).mapInArrow(run, f"doc_id {kind}, {longs}, base_failed boolean, anomaly double, kept boolean")
