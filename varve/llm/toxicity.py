"""Toxic spans by a linear-chain conditional random field, and scores of whole documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import fold, labelled_sample, whole

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# Toxic documents that the field is fitted on, three times as many others, and the longest of them,
# in characters. Every fifth of them only calibrates the document scores.
SAMPLE, LONGEST, APART = 2500, 4000, 5
WEIGHTS = 1 << 20
STEPS, RATE, SHRINK = 40, 0.3, 1e-4
# How sure a feature must be, in nats beyond the number of features tried, to mark its tokens.
SURE = 8.0
SPAN = 0.5
REMEMBERED = 200_000
FLUSH = 1 << 20
EDGES = ".,;:!?\"'()[]{}<>|#$%&*…“”«»"


def features(token: str) -> list[str]:
    """The word without its outer punctuation, in lower case; its beginnings and its end."""
    word = token.lower().strip(EDGES)
    found = ["=" + word] + [f"{n}<{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n]
    return found + ([">" + word[-4:]] if len(word) > 4 else [])


def slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "surrogatepass")) % WEIGHTS


@dataclass
class Field:
    """A field over two tags, 0 for plain and 1 for toxic: the weight of each feature for tag 1, and
    exponentials of the weights of tag pairs; ``first`` is that of tag 1 at the start. A document
    scores the logistic of ``slope`` times the log odds of its highest marginal, plus ``level``."""

    weights: np.ndarray
    pairs: np.ndarray
    first: float
    slope: float = 1.0
    level: float = 0.0

    def document(self, top: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * log_odds(top) + self.level, -50, 50))))


def log_odds(p: float) -> float:
    return float(np.log(max(p, 1e-12)) - np.log(max(1 - p, 1e-12)))


def chains(lengths: np.ndarray):
    """For documents one after the other: per step, the positions of all that are still going."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    going = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    return [starts[:n] + t for t, n in enumerate(going.tolist())]


def messages(push: np.ndarray, steps: list, pairs: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages as odds of tag 1, for all documents side by side (``chains``).

    ``push`` is the exponential of each token's score for tag 1. Forward odds hold the token itself.
    """
    ahead, back = np.empty(len(push)), np.ones(len(push))
    before = None
    for at in steps:
        if before is None:
            ahead[at] = push[at] * first
        else:
            odds = ahead[before[: len(at)]]
            ahead[at] = push[at] * (pairs[0, 1] + pairs[1, 1] * odds) / (pairs[0, 0] + pairs[1, 0] * odds)
        before = at
    for now, after in zip(steps[-2::-1], steps[:0:-1]):
        odds = push[after] * back[after]
        back[now[: len(after)]] = (pairs[1, 0] + pairs[1, 1] * odds) / (pairs[0, 0] + pairs[0, 1] * odds)
    return ahead, back


def marginals(scores: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """The probability of tag 1 at every token."""
    ahead, back = messages(np.exp(np.clip(scores, -50, 50)), chains(lengths), field.pairs, field.first)
    odds = ahead * back
    return odds / (1 + odds)


def marked_features(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features that toxic documents hold far more often than chance allows.

    A feature seen in n documents, a share p of them toxic, is this unlikely under the base rate q:
    exp(-n KL(p, q)). It marks its tokens if that is below one in the number of features, by ``SURE``.
    """
    hot, cold = Counter(), Counter()
    for docs, counter in ((toxic, hot), (clean, cold)):
        for tokens in docs:
            counter.update({f for token in set(tokens) for f in features(token) if not f.startswith(">")})
    base = len(toxic) / max(1, len(toxic) + len(clean))
    least = np.log(max(1, len(hot.keys() | cold.keys()))) + SURE
    found = set()
    for feature, a in hot.items():
        n = a + cold[feature]
        p = a / n
        sure = p * np.log(p / base) + ((1 - p) * np.log((1 - p) / (1 - base)) if p < 1 else 0.0)
        if p > 0.8 and n * sure >= least:
            found.add(feature)
    return found


def train(toxic: list[list[str]], clean: list[list[str]]) -> Field:
    """A field fitted by gradient steps on whole documents.

    Documents carry labels, tokens do not: a token of a toxic document is tagged 1 if one of its
    features marks it, all other tokens 0. Without toxic or clean documents nothing is tagged.
    """
    field = Field(np.zeros(WEIGHTS), np.exp(np.array([[0.0, -4.0], [0.0, -1.0]])), np.exp(-4.0))
    marks = marked_features(toxic, clean) if toxic and clean else set()
    docs = [tokens for tokens in toxic + clean if tokens]
    if not marks or not docs:
        field.pairs[:, 1], field.first = np.exp(-8.0), np.exp(-8.0)
        return field
    index: dict[str, int] = {}
    at = np.array([index.setdefault(t, len(index)) for tokens in docs for t in tokens], np.int64)
    lengths = np.array([len(tokens) for tokens in docs], np.int64)
    owner, slots, tagged = [], [], np.zeros(len(index), bool)
    for token, i in index.items():
        own = features(token)
        tagged[i] = not marks.isdisjoint(own)
        owner += [i] * len(own)
        slots += [slot(f) for f in own]
    owner, slots = np.array(owner), np.array(slots)
    is_toxic = np.repeat(np.arange(len(docs)) < sum(1 for tokens in toxic if tokens), lengths)
    tags = (tagged[at] & is_toxic).astype(float)
    logs = np.log(field.pairs).ravel()[[1, 3]]
    first = np.log(field.first)
    params = np.concatenate([field.weights, logs, [first]])
    moment, spread = np.zeros(len(params)), np.zeros(len(params))
    ends = np.cumsum(lengths)
    inner = np.ones(len(at), bool)
    inner[ends - lengths] = False
    now = np.flatnonzero(inner)
    heads = ends - lengths
    steps = chains(lengths)
    observed = [float(((tags[now - 1] == a) & (tags[now] == 1)).sum()) for a in (0, 1)]
    for step in range(1, STEPS + 1):
        pairs, start = np.exp(np.array([[0.0, params[-3]], [0.0, params[-2]]])), np.exp(params[-1])
        by_token = np.bincount(owner, params[slots], minlength=len(index))
        push = np.exp(np.clip(by_token[at], -50, 50))
        ahead, back = messages(push, steps, pairs, start)
        p = ahead * back / (1 + ahead * back)
        before, after = ahead[now - 1], push[now] * back[now]
        joint = [pairs[0, 1] * after, before * pairs[1, 1] * after]
        total = pairs[0, 0] + pairs[1, 0] * before + joint[0] + joint[1]
        error = np.bincount(at, p - tags, minlength=len(index))
        slope = np.bincount(slots, error[owner], minlength=len(params))
        slope[-3:] = (joint[0] / total).sum() - observed[0], (joint[1] / total).sum() - observed[1], (p - tags)[heads].sum()
        slope = slope / len(docs) + SHRINK * params
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        params = params - RATE * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field(params[:WEIGHTS].astype(np.float32), np.exp(np.array([[0.0, params[-3]], [0.0, params[-2]]])), float(np.exp(params[-1])))


def fit(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field fitted on at most ``rows`` documents of each label, of at most ``longest`` characters,
    outside the held-out fold. The sample is bounded and comes to the driver."""
    usable = docs.filter(F.length(whole("text")) <= longest)
    sample = labelled_sample(usable, marks, "toxic", fold("doc_id", FOLDS) != HELD_OUT, {0: 3 * rows, 1: rows})
    table = sorted((r["doc_id"], r["label"], r["text"].split()) for r in sample.toLocalIterator())
    fitted = [row for i, row in enumerate(table) if i % APART]
    field = train(*([tokens for _, label, tokens in fitted if label == value] for value in (1, 0)))
    return calibrated(field, [(tokens, label) for i, (_, label, tokens) in enumerate(table) if i % APART == 0])


def calibrated(field: Field, docs: list[tuple[list[str], int]]) -> Field:
    """``field`` with the document scores that best tell apart documents it was not fitted on."""
    labels = np.array([label for _, label in docs], float)
    if len(set(labels.tolist())) < 2:
        return field
    scores = Scores(field.weights)
    lengths = np.array([len(tokens) for tokens, _ in docs], np.int64)
    p = marginals(np.array([scores[t] for tokens, _ in docs for t in tokens], float), lengths, field)
    parts = np.split(p, np.cumsum(lengths)[:-1])
    x = np.array([[log_odds(float(part.max(initial=0.0))), 1.0] for part in parts])
    params = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps, held near the uncalibrated score
        q = 1 / (1 + np.exp(-np.clip(x @ params, -50, 50)))
        curve = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(2)
        params = params - np.clip(np.linalg.solve(curve, x.T @ (q - labels) + 0.05 * (params - [1.0, 0.0])), -2, 2)
    field.slope, field.level = max(float(params[0]), 1e-3), float(params[1])
    return field


class Scores(dict):
    """The score of a token for tag 1; remembers a bounded number of them."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        score = float(sum(self.weights[slot(f)] for f in features(token)))
        if len(token) <= 48:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = score
        return score


def tag(texts: list[str], scores: Scores, field: Field) -> list[tuple[float, int, str]]:
    """Per text: its score, the number of tokens, and the spans of tokens over ``SPAN``."""
    words = [text.split() for text in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((scores[t] for w in words for t in w), float, int(lengths.sum()))
    p = marginals(flat, lengths, field)
    found, start = [], 0
    for text, length in zip(texts, lengths.tolist()):
        own = p[start : start + length]
        start += length
        top, spans = float(own.max(initial=0.0)), []
        if top >= SPAN:
            hit = own >= SPAN
            for i, m in enumerate(re.finditer(r"\S+", text)):
                if hit[i]:
                    spans.append(f"{m.start()}:{m.end()}")
        found.append((field.document(top) if length else 0.0, length, ",".join(spans)))
    return found


def toxicity(docs: DataFrame, marks: DataFrame, rows: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_tokens`` and ``spans`` of every row.

    The score follows from the highest marginal of tag 1 among the tokens of the whole text; a text
    without tokens scores 0.
    ``spans`` lists start:end of the toxic tokens in code points. Null texts are empty; rows with
    a null id count as the empty id for the fold and are never learned from.
    """
    field = fit(docs, marks, rows, longest)
    # Plain arrays and numbers: a broadcast class would be looked up on the executors, which need not have it.
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.pairs, field.first, field.slope, field.level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        scores = Scores(model.weights)
        for batch in batches:
            found, texts, size = [], [], 0
            for value in batch.column(1):
                texts.append(value.as_py())
                size += len(texts[-1])
                if size > FLUSH:
                    found += tag(texts, scores, model)
                    texts, size = [], 0
            found += tag(texts, scores, model)
            top, length, spans = zip(*found) if found else ((), (), ())
            arrays = [batch.column(0), pa.array(top, pa.float64()), pa.array(length, pa.int64()), pa.array(spans, pa.string())]
            yield pa.record_batch(arrays, names=["doc_id", "score", "n_tokens", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", whole("text").alias("text"))
    rated = read.mapInArrow(run, f"doc_id {kind}, score double, n_tokens bigint, spans string")
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rated.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", predicted, "n_tokens", "spans")
