"""Passages of some number of words that stand in more than one document.

Windows are ``size`` words in a row, whatever blanks part them. As in ``suffixes``, equal windows
have equal anchors (here the lowest hash among their strings of ``gram`` words) and windows that follow
each other and share one form a unit. Only units whose anchor stands in two documents can hold a shared
passage. Identical ones settle their documents; of the documents still open, the windows of the
other units are compared. Hashes only choose places: units and windows are equal if 128 bits of the
SHA-256 of their bytes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.suffixes import BASE, CHUNK, VALUES, anchored, digest, mixed, powers, text_key
from varve.llm.tables import join_same, let, whole
from varve.shared import materialize, removed_after

SIZE, GRAM = 50, 8
# Words of a piece of a text that is longer than a chunk.
PIECE = CHUNK >> 3
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def word_bounds(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[buffer], [True]])))
    return edges[::2], edges[1::2]


def rolling(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers: (sums[b] - sums[a]) * inverse[a] is the hash of the values from a to b."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    return sums, powers(pow(BASE, -1, 1 << 64), n)


def word_units(buffer: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Begin and end in bytes, and anchor hash, of the units of texts that begin at ``first``, a blank between them."""
    starts, ends = word_bounds(buffer)
    if len(starts) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums, inverse = rolling(VALUES[buffer])
    sums, inverse = rolling(mixed((sums[ends] - sums[starts]) * inverse[starts]))
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: len(starts) - gram + 1])
    owner = np.searchsorted(first, starts, side="right")
    at, windows, anchors = anchored(grams, owner, size, gram)
    return starts[at], ends[at + windows + size - 2], grams[anchors]


def word_pieces(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """Where pieces of the text begin, and the pieces: they overlap, so that each window is in one piece."""
    if len(raw) <= CHUNK:
        yield 0, raw
        return
    starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
    for i in range(0, len(starts) - size + 1, PIECE):
        begin, end = int(starts[i]), int(ends[min(i + PIECE + size - 1, len(ends)) - 1])
        yield begin, raw[begin:end]


def all_word_units(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``row``, ``doc_id``, ``text_key``, ``at``, ``length``, ``anchor``, ``content`` for every unit of every text.

    ``row`` tells repeated rows apart; it holds within the table written from this, not in a second run.
    """

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        joined = b" ".join(raw for *_, raw in parts)
        lengths = np.array([len(raw) + 1 for *_, raw in parts], np.int64)
        first = np.cumsum(lengths) - lengths
        begin, end, anchor = word_units(np.frombuffer(joined, np.uint8), first, size, gram)
        part = np.searchsorted(first, begin, side="right") - 1
        offset = np.array([at for *_, at, _ in parts], np.int64)
        columns = [
            pa.array([row for row, *_ in parts], pa.int64()).take(pa.array(part)),
            pa.array([key for _, key, *_ in parts], id_type).take(pa.array(part)),
            pa.array([key for _, _, key, *_ in parts], pa.binary()).take(pa.array(part)),
            pa.array(offset[part] + begin - first[part]),
            pa.array(end - begin),
            pa.array(anchor.view(np.int64)),
            pa.array([digest(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist())], pa.binary()),
        ]
        return pa.record_batch(columns, names=["row", "doc_id", "text_key", "at", "length", "anchor", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        parts, held = [], 0
        for batch in batches:
            id_type = batch.column(1).type
            for values in zip(*(batch.column(i) for i in range(4))):
                *names, raw = (value.as_py() for value in values)
                for at, piece in word_pieces(raw, size):
                    parts.append((*names, at, piece))
                    held += len(piece)
                    if held >= CHUNK:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    id_type = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(text), text.cast("binary").alias("raw"))
    schema = f"row bigint, doc_id {kind}, text_key binary, at bigint, length bigint, anchor bigint, content binary"
    return rows.filter(F.length("raw") >= 2 * size - 1).mapInArrow(run, schema)


def all_windows(segments: DataFrame, size: int) -> DataFrame:
    """``window``, a digest of its words, for every window of every segment, beside the segment's other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for i, raw in enumerate(batch.column("raw")):
                words = raw.as_py().split()
                windows = {digest(b" ".join(words[a : a + size])) for a in range(len(words) - size + 1)}
                found += windows
                of += [i] * len(windows)
            taken = batch.drop_columns(["raw"]).take(pa.array(of, pa.int64()))
            yield taken.append_column("window", pa.array(found, pa.binary()))

    schema = segments.drop("raw").schema.add("window", "binary")
    return segments.mapInArrow(run, schema)


def sharing(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id`` and ``text_key`` of the rows of ``docs`` in which a passage of ``size`` words stands that
    also stands in another row. Words are what blanks part; texts are compared as UTF-8 bytes."""
    names = ["doc_id", "text_key"]
    rows = [F.min("least").alias("least"), F.max("most").alias("most")]
    with removed_after(docs.sparkSession):
        every = materialize(all_word_units(docs, size, gram))
        met = every.groupBy("anchor").agg(F.min("row").alias("least"), F.max("row").alias("most")).filter("least < most")
        shared = materialize(every.join(materialize(met.select("anchor")), "anchor"))
        one = [F.first(name).alias(name) for name in (*names, "at", "length")]
        contents = materialize(
            shared.groupBy("anchor", "content").agg(F.min("row").alias("least"), F.max("row").alias("most"), *one)
        )
        copied = contents.filter("least < most").select("anchor", "content")
        settled = materialize(shared.join(copied, ["anchor", "content"]).select("row", *names).distinct())
        # Left to decide: rows none of whose units stands in another, against all units of their anchors.
        lone = contents.filter("least = most").join(settled.select(F.col("row").alias("least")), "least", "left_anti")
        open_ = materialize(lone.select("anchor").distinct())
        wanted = contents.join(open_, "anchor").groupBy(*names).agg(
            F.collect_list(F.struct("at", "length", "least", "most")).alias("units")
        )
        texts = docs.select("doc_id", text_key(whole("text")), whole("text").cast("binary").alias("raw"))
        cut = let(
            F.col("raw"),
            lambda raw: F.transform(
                "units", lambda u: u.withField("raw", F.substring(raw, u["at"].cast("int") + 1, u["length"].cast("int")))
            ),
        )
        segments = join_same(texts, wanted.hint("shuffle_hash"), names, "inner").select(*names, F.inline(cut))
        windows = materialize(all_windows(segments.drop("at", "length"), size))
        common = windows.groupBy("window").agg(*rows).filter("least < most").select("window")
        found = windows.filter("least = most").join(common, "window").select(*names)
        return materialize(settled.select(*names).unionByName(found).distinct(), outlast=True)
