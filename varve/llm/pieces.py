"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi search, and decoding."""

from __future__ import annotations

import hashlib
import weakref
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.shared import col

SPACE = "▁"
# A model file is read whole and sent to the tasks; larger ones are refused.
MODEL_BYTES = 64 << 20
# Words whose pieces a task remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 48
FLUSH = 16 << 20


def read_model(spark: SparkSession, path: str) -> bytes:
    """The bytes of a model file, by Spark's reader; at most ``MODEL_BYTES``."""
    found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MODEL_BYTES).select("content").head()
    if found is None:
        raise ValueError(f"no model of at most {MODEL_BYTES} bytes at {path}")
    return bytes(found[0])


class Words(dict):
    """The ids of a word, as bytes; remembers short words, a bounded number of them."""

    def __init__(self, search):
        super().__init__()
        self.search = search

    def __missing__(self, word: str) -> bytes:
        ids = self.search(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Pieces:
    """The pieces and scores of a model. The best segmentation of a text has the highest sum of scores.

    A character that no piece covers falls back to the pieces of its bytes, each worse than any
    other piece. On equal sums the longer last piece wins, at every position.
    """

    def __init__(self, model: bytes):
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(processor.get_piece_size())
        special = lambda i: processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)
        self.table = [processor.id_to_piece(i) for i in ids]
        self.bytes = {int(self.table[i][3:5], 16): i for i in ids if processor.is_byte(i)}
        self.of_byte = {i: byte for byte, i in self.bytes.items()}
        if len(self.bytes) != 256:
            raise ValueError("the model has no pieces for all bytes, so it cannot encode every text")
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i in ids:
            if not special(i) and i not in self.of_byte:
                scores.append(processor.get_score(i))
                self.automaton.add_word(self.table[i], (len(self.table[i]), scores[-1], i))
        self.automaton.make_automaton()
        self.fallback = min(scores) - 10.0
        usual = [s for s in scores if s > -1e6]
        # Up to here any way without byte pieces is better than every way with one.
        self.safe = int(self.fallback / min(usual + [-1.0])) - 1
        inner = lambda piece: SPACE in piece.lstrip(SPACE)
        # If no piece holds a space after another character, the best ways of words are independent.
        self.by_word = not any(inner(p) for p in self.table)
        # No cycle: a worker frees the model of a task with the task, not at some later collection.
        own = weakref.proxy(self)
        self.words = Words(lambda word: own.chunk(SPACE + word))

    def chunk(self, text: str) -> bytes:
        """The best segmentation of escaped text, as int32 ids."""
        best, last = [0.0] + [-np.inf] * len(text), [(0, 0)] * (len(text) + 1)
        if len(text) < self.safe:
            for end, (length, score, piece) in self.automaton.iter(text):
                total = best[end + 1 - length] + score
                if total > best[end + 1]:
                    best[end + 1], last[end + 1] = total, (length, piece)
        if best[-1] == -np.inf and text:
            self._with_bytes(text, best, last)
        ids, at = [], len(text)
        while at:
            length, piece = last[at]
            if length:
                ids.append(piece)
            else:
                ids += [self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            at -= length or 1
        return np.array(ids[::-1], "<i4").tobytes()

    def _with_bytes(self, text: str, best: list[float], last: list[tuple[int, int]]) -> None:
        """The same search in which every character may also be spelled by its bytes."""
        best[:], last[:] = [0.0] + [-np.inf] * len(text), [(0, 0)] * (len(text) + 1)
        done = 0

        def spell(upto: int) -> None:
            for at in range(done, upto):
                total = best[at] + self.fallback * len(text[at].encode("utf-8", "surrogatepass"))
                if total > best[at + 1]:
                    best[at + 1], last[at + 1] = total, (0, 0)

        for end, (length, score, piece) in self.automaton.iter(text):
            if end > done:
                spell(end)
                done = end
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], last[end + 1] = total, (length, piece)
        spell(len(text))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32. A space is the mark U+2581, one more stands before the text,
        and a mark that the text itself holds is spelled by bytes, so that decoding is exact."""
        if not text:
            return b""
        if SPACE in text:
            mark = np.array([self.bytes[b] for b in SPACE.encode()], "<i4").tobytes()
            first, *others = text.split(SPACE)
            parts = [self._plain(SPACE + first.replace(" ", SPACE))]
            return mark.join(parts + [self._plain(part.replace(" ", SPACE)) for part in others])
        if self.by_word and "  " not in text and text[0] != " " and text[-1] != " ":
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        return self._plain(SPACE + text.replace(" ", SPACE))

    def _plain(self, escaped: str) -> bytes:
        if not self.by_word:
            return self.chunk(escaped)
        found, run = [], ""
        head, *words = escaped.split(SPACE)
        if head:
            found.append(self.chunk(head))
        for word in words:
            run += SPACE
            if word:
                found.append(self.words[word] if run == SPACE else self.chunk(run + word))
                run = ""
        if run:
            found.append(self.chunk(run))
        return b"".join(found)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        numbers, table, spelled = ids.tolist(), self.table, self.of_byte
        if spelled.keys().isdisjoint(numbers):
            return "".join(map(table.__getitem__, numbers)).replace(SPACE, " ")[1:]
        raw = b"".join(
            bytes([spelled[i]]) if i in spelled else table[i].replace(SPACE, " ").encode("utf-8") for i in numbers
        )
        return raw[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, model: bytes, with_ids: bool = True) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array of int), ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian int32) and ``round_trip``: whether decoding the ids gave back the text, null
    where the text is null. A null or empty text has no ids. ``with_ids=False`` leaves ``ids`` out.
    An added column takes the place of a given one of its name.
    """
    keep = [name for name in docs.columns if name.lower() not in ("text", "ids", "n_tokens", "ids_sha256", "round_trip")]
    added = [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    added += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("round_trip", T.BooleanType())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(pieces: Pieces, batch: pa.RecordBatch, texts: list, ids: list[bytes], start: int) -> pa.RecordBatch:
        arrays = [batch.column(i).slice(start, len(ids)) for i in range(len(keep))]
        numbers = [np.frombuffer(one, "<i4") for one in ids]
        if with_ids:
            ends = np.cumsum([0, *map(len, numbers)], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers))))
        same = [None if text is None else pieces.decode(one) == text for text, one in zip(texts, numbers)]
        arrays += [
            pa.array([len(one) for one in numbers], pa.int64()),
            pa.array([hashlib.sha256(one).hexdigest() for one in ids]),
            pa.array(same, pa.bool_()),
        ]
        return pa.record_batch(arrays, names=[*(f"c{i}" for i in range(len(keep))), *(name for name, _ in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            start, texts, ids, size = 0, [], [], 0
            for value in batch.column(len(keep)):
                texts.append(value.as_py())
                ids.append(pieces.encode(texts[-1] or ""))
                size += len(ids[-1])
                if size > FLUSH:
                    yield rows(pieces, batch, texts, ids, start)
                    start, texts, ids, size = start + len(ids), [], [], 0
            if ids:
                yield rows(pieces, batch, texts, ids, start)

    given = docs.select(*(col(name).alias(f"c{i}") for i, name in enumerate(keep)), F.col("text").alias("text"))
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(name, kind) for name, kind in added)])
    names = keep + [name for name, _ in added]
    return given.mapInArrow(run, schema).toDF(*names)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` with ``ids`` turned back into ``text``; null ids give the empty text."""
    keep = [name for name in encoded.columns if name.lower() not in ("ids", "text")]
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(sent.value)
        for batch in batches:
            texts = [pieces.decode(np.array(one.as_py() or [], np.int32)) for one in batch.column(len(keep))]
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())]
            yield pa.record_batch(columns, names=[*(f"c{i}" for i in range(len(keep))), "text"])

    given = encoded.select(*(col(name).alias(f"c{i}") for i, name in enumerate(keep)), "ids")
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("text", T.StringType())])
    return given.mapInArrow(run, schema).toDF(*keep, "text")
