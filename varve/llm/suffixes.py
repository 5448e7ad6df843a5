"""Repeated passages by suffix sorting: every byte that a string of some length covers twice goes.

Windows are strings of ``size`` bytes. The lowest hash among the ``GRAM``-byte strings in a window is its
anchor: equal windows have equal anchors, so they meet wherever texts are placed by the anchor.
Windows that follow each other and share an anchor form a unit. Only units whose anchor occurs
twice can hold repeats; identical ones are folded into one, and what is left of an anchor is
decided by its suffix array. Rolling hashes only choose places: whether bytes are equal is decided by
the bytes themselves, or by 128 bits of their SHA-256 where equal units are folded and joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.tables import join_same, let, whole
from varve.shared import materialize

SIZE, GRAM = 400, 64
# Windows hashed at a time, a power of two; the bits that number the places of two such chunks.
CHUNK, PLACE_BITS = 1 << 20, 22
# Bytes sorted at a time, and the windows of the blocks into which larger groups are split, step by step.
SHARD, STEPS = 1 << 19, (16, 4, 1)
DIGEST = 16

_random = np.random.default_rng(42)
VALUES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least ``n`` of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, CHUNK + SIZE), base, np.uint64)
        factors[0] = 1
        held = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return held[:n]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """The same hashes with all bits stirred, so that the lowest is a random one."""
    out = hashes ^ (hashes >> np.uint64(31))
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    out ^= out >> np.uint64(33)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, from running minima of blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(grams: np.ndarray, owner: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows and place of the anchor of every unit, given the hashes of all grams and
    the text that each symbol is of."""
    # The place in the low bits: among equal hashes the leftmost counts. As many bits in every chunk, so that
    # equal windows choose alike wherever they lie.
    places = np.uint64((1 << PLACE_BITS) - 1)
    lowest = sliding_min((grams & ~places) | np.arange(len(grams), dtype=np.uint64), size - gram + 1)
    anchors = (lowest & places).astype(np.int64)
    valid = owner[: len(owner) - size + 1] == owner[size - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchors[1:] != anchors[:-1])
    starts = np.flatnonzero(new)
    before = np.cumsum(valid) - valid
    windows = np.diff(np.append(before[starts], valid.sum()))
    return starts, windows, anchors[starts]


def units(buffer: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Units of texts that lie one after the other, each of at least ``size`` bytes.

    Returns start, number of windows, distance to the anchor and anchor hash. A unit's content is all
    bytes its windows cover.
    """
    n, base = len(buffer), BASE
    inverse = powers(pow(base, -1, 1 << 64), n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(VALUES[buffer] * powers(base, n), out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    starts, windows, anchors = anchored(grams, owner, size, gram)
    return starts, windows, anchors - starts, grams[anchors]


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).digest()[:DIGEST]


def sql_digest(raw: Column) -> Column:
    return F.substring(F.unhex(F.sha2(raw, 256)), 1, DIGEST)


def text_key(text: Column) -> Column:
    """Tells rows of one id apart by their texts."""
    return sql_digest(text.cast("binary")).alias("text_key")


def all_units(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``at``, ``windows``, ``gap``, ``anchor``, ``content`` for every unit of every text.

    Texts longer than a chunk are cut into pieces that overlap, so that each window is in one piece.
    """

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(raw) for *_, raw in parts], np.int64)
        joined = b"".join(raw for *_, raw in parts)
        starts, windows, gap, anchor = units(np.frombuffer(joined, np.uint8), lengths, size, gram)
        content = [digest(joined[a:b]) for a, b in zip(starts.tolist(), (starts + windows + size - 1).tolist())]
        first = np.cumsum(lengths) - lengths
        part = np.searchsorted(first, starts, side="right") - 1
        offset = np.array([at for _, _, at, _ in parts], np.int64)
        columns = [
            pa.array([key for key, *_ in parts], id_type).take(pa.array(part)),
            pa.array([key for _, key, *_ in parts], pa.binary()).take(pa.array(part)),
            pa.array(offset[part] + starts - first[part]),
            pa.array(windows.astype(np.int32)),
            pa.array(gap.astype(np.int32)),
            pa.array(anchor.view(np.int64)),
            pa.array(content, pa.binary()),
        ]
        return pa.record_batch(columns, names=["doc_id", "text_key", "at", "windows", "gap", "anchor", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        parts, held = [], 0
        for batch in batches:
            id_type = batch.column(0).type
            for key, text_key, raw in zip(*(batch.column(i) for i in range(3))):
                raw = raw.as_py()
                for at in range(0, len(raw) - size + 1, CHUNK):
                    piece = raw[at : at + CHUNK + size - 1]
                    parts.append((key.as_py(), text_key.as_py(), at, piece))
                    held += len(piece)
                    if held >= CHUNK:
                        yield flush(parts)
                        parts, held = [], 0
        if parts:
            yield flush(parts)

    id_type = None
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole("text")
    rows = docs.select("doc_id", text_key(text), text.cast("binary").alias("raw"))
    schema = f"doc_id {kind}, text_key binary, at bigint, windows int, gap int, anchor bigint, content binary"
    return rows.filter(F.length("raw") >= size).mapInArrow(run, schema)


def two_stage(segments: list[bytes], windows: list[int], size: int) -> np.ndarray:
    """The starts of all windows in the order of the suffixes of the segments.

    ``windows[i]`` windows start at the head of segment i; suffixes end with their segment and are
    ordered by at least their first ``size`` bytes. Suffixes smaller than their successors (the one
    that starts a byte later) are sorted directly. The others are induced: scanning the buckets of
    first bytes in order, each suffix puts its predecessor, if that is larger, next into the bucket
    of its first byte. Suffixes that no window's order depends on are left out.
    """
    text = b"".join(segments)
    data = np.frombuffer(text, np.uint8)
    lengths = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lengths)
    heads = ends - lengths
    step = np.zeros(len(data), np.int16)
    step[:-1] = data[1:].astype(np.int16) - data[:-1]
    step[ends - 1] = -1  # the empty suffix is smaller than all
    decided = np.where(step != 0, np.arange(len(data)), len(data))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = step[decided] > 0
    # Orders follow from suffixes further right up to the next directly sorted one.
    sorted_at = np.flatnonzero(smaller)
    last_window = heads + np.array(windows, np.int64) - 1
    place = np.searchsorted(sorted_at, last_window)
    following = np.append(sorted_at, len(data))[place]
    stop = np.minimum(following, ends - 1)
    owner = np.repeat(np.arange(len(segments)), lengths)
    used = np.arange(len(data)) <= stop[owner]

    end_of = ends[owner]
    direct = np.flatnonzero(smaller & used).tolist()
    cut = np.minimum(np.array(direct, np.int64) + size, end_of[direct]).tolist() if direct else []
    keys = [text[a:b] for a, b in zip(direct, cut)]
    order = sorted(range(len(direct)), key=keys.__getitem__)
    direct = np.array(direct, np.int64)[order]
    firsts = data[direct]
    bounds = np.searchsorted(firsts, np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(at: np.ndarray) -> None:
        by_byte = np.argsort(data[at], kind="stable")
        at = at[by_byte]
        edges = np.flatnonzero(np.diff(data[at])) + 1
        for part in np.split(at, edges):
            if len(part):
                buckets[data[part[0]]].append(part)

    def larger_before(at: np.ndarray) -> np.ndarray:
        before = at[at > heads[owner[at]]] - 1
        return before[~smaller[before]]

    tails = ends - 1
    put(tails[used[tails]])
    found = []
    for byte in range(256):
        induced, buckets[byte] = buckets[byte], []
        current = np.concatenate(induced) if induced else np.empty(0, np.int64)
        while len(current):
            found.append(current)
            before = larger_before(current)
            again = data[before] == byte
            put(before[~again])
            current = before[again]
        own = direct[bounds[byte] : bounds[byte + 1]]
        if len(own):
            found.append(own)
            put(larger_before(own))
    everything = np.concatenate(found) if found else np.empty(0, np.int64)
    return everything[everything <= last_window[owner[everything]]]


def repeated(segments: list[bytes], windows: list[int], size: int) -> list[np.ndarray]:
    """Per segment, which of its windows equal another window of any segment: those whose common
    prefix with a neighbour in suffix order reaches ``size``."""
    order = two_stage(segments, windows, size)
    text = b"".join(segments)
    places = order.tolist()
    reach = np.array([text[a : a + size] == text[b : b + size] for a, b in zip(places, places[1:])], bool)
    twice = np.zeros(len(text), bool)
    twice[order[:-1][reach]] = True
    twice[order[1:][reach]] = True
    heads = np.cumsum([0, *map(len, segments)])
    return [twice[h : h + n] for h, n in zip(heads.tolist(), windows)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _sorted_shards(segments: DataFrame, size: int) -> DataFrame:
    """Runs of repeated windows of the segments (place, id, at, windows, n, raw), sorted shard by shard.

    A shard holds the segments of whole places, about ``SHARD`` bytes of them.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated([raw for *_, raw in rows], [n for _, _, _, n, _, _ in rows], size)
        keys, keys2, at, n = [], [], [], []
        for (doc, text_key, start, _, copies, _), flag in zip(rows, flags):
            if copies == 1:
                begin, length = runs(flag)
                keys += [doc] * len(begin)
                keys2 += [text_key] * len(begin)
                at += (begin + start).tolist()
                n += length.tolist()
        columns = [pa.array(keys, id_type), pa.array(keys2, pa.binary()), pa.array(at, pa.int64()), pa.array(n, pa.int32())]
        return pa.record_batch(columns, names=["doc_id", "text_key", "at", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        rows, held, last = [], 0, None
        for batch in batches:
            id_type = batch.column(1).type
            for values in zip(*(batch.column(i) for i in range(7))):
                place, *row = (v.as_py() for v in values)
                if held >= SHARD and place != last:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(tuple(row))
                held += len(row[-1])
                last = place
        if rows:
            yield flush(rows)

    id_type = None
    kind = segments.schema["doc_id"].dataType.simpleString()
    placed = segments.select("place", "doc_id", "text_key", "at", "windows", "n", "raw")
    placed = placed.repartition("place").sortWithinPartitions("place")
    return placed.mapInArrow(run, f"doc_id {kind}, text_key binary, at bigint, windows int")


def _split(segments: DataFrame, size: int, step: int) -> tuple[DataFrame, DataFrame]:
    """The segments cut into blocks of at most ``step`` windows, and the blocks that occur more than once.

    Windows are counted from the anchor in blocks. All windows of a block hold the same core of
    bytes, and equal windows lie as far from the anchor, so they meet in the place of their core.
    Identical blocks are folded into one, combined before the shuffle, so no passage is heavy, however common.
    """
    first = lambda k: F.greatest(F.lit(0), F.col("gap") - k * step - (step - 1))
    last = lambda k: F.least(F.col("windows") - 1, F.col("gap") - k * step)
    core = lambda k: F.substring(F.col("raw"), F.col("gap") - k * step + 1, F.lit(size - step + 1))
    piece = lambda k: F.substring(F.col("raw"), first(k) + 1, last(k) - first(k) + size)
    named = lambda k: F.concat("place", F.encode(F.concat(F.lit(":"), k.cast("string"), F.lit(":")), "utf-8"), core(k))
    numbers = F.sequence(F.floor((F.col("gap") - F.col("windows") + 1) / step).cast("int"), F.floor(F.col("gap") / step).cast("int"))
    each = F.transform(
        numbers,
        lambda k: F.struct(
            sql_digest(named(k)).alias("place"),
            (F.col("at") + first(k)).alias("at"),
            (last(k) - first(k) + 1).alias("windows"),
            (F.col("gap") - first(k)).alias("gap"),
            sql_digest(piece(k)).alias("content"),
            piece(k).alias("raw"),
        ),
    )
    blocks = materialize(segments.select("doc_id", "text_key", "n", F.inline(each)))
    kind = ["place", "windows", "gap", "content"]
    refs = [F.first(name).alias(name) for name in ("doc_id", "text_key", "at", "raw")]
    folded = materialize(blocks.groupBy(*kind).agg(F.sum("n").alias("n"), *refs))
    copied = blocks.filter("n = 1").join(folded.filter("n > 1").select(*kind), kind)
    return folded, copied.select("doc_id", "text_key", "at", "windows")


def _decided(segments: DataFrame, size: int, most: int) -> DataFrame:
    """Runs of repeated windows of the segments that occur once (``n`` = 1), by sorting.

    The segments of a place are sorted together if they have at most ``most`` bytes. Those of a larger
    place are split into blocks, whose places are the bytes that all windows of a block hold, and so on
    with smaller blocks. A block of one window shares its place with none but its copies,
    which are folded, so every place gets down to what one task can sort.
    """
    found = []
    for step in [*(s for s in STEPS if s <= size), None]:
        sizes = segments.groupBy("place").agg(
            F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum(F.octet_length("raw")).alias("bytes")
        )
        open_ = materialize(sizes.filter("kinds > 1 and least = 1"))
        small, large = (open_.filter(f"bytes {sign} {most}").select("place") for sign in ("<=", ">"))
        found.append(_sorted_shards(segments.join(small, "place"), size))
        if step is None or large.isEmpty():
            break
        segments, copied = _split(segments.join(large, "place"), size, step)
        found.append(copied)
    return reduce(DataFrame.unionByName, found)


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = SHARD) -> DataFrame:
    """Runs of windows (``doc_id``, ``text_key``, ``at``, ``windows``) that occur more than once."""
    every = materialize(all_units(docs, size, gram))
    counted = every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    shared = materialize(every.join(materialize(counted), "anchor"))
    place = [F.first(name).alias(name) for name in ("doc_id", "text_key", "at", "gap")]
    contents = materialize(shared.groupBy("anchor", "windows", "content").agg(F.count("*").alias("n"), *place))
    copied = contents.filter("n > 1").select("anchor", "windows", "content")
    whole_units = shared.join(copied, ["anchor", "windows", "content"]).select("doc_id", "text_key", "at", "windows")
    # Left to decide: units that occur once, where others have the same anchor.
    open_ = materialize(
        contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1")
    )
    wanted = contents.join(open_.select("anchor"), "anchor")
    listed = wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("anchor", "at", "windows", "gap", "n")).alias("units")
    )
    texts = docs.select("doc_id", text_key(whole("text")), whole("text").cast("binary").alias("raw"))
    # A repeated row holds the same segments; the first of them is enough.
    cut = let(
        F.col("raw"),
        lambda raw: F.transform(
            "units", lambda u: u.withField("raw", F.substring(raw, u["at"].cast("int") + 1, u["windows"] + size - 1))
        ),
    )
    met = join_same(texts, listed.hint("shuffle_hash"), ["doc_id", "text_key"], "inner")
    segments = met.select("doc_id", "text_key", F.inline(cut)).dropDuplicates(["doc_id", "text_key", "at"])
    placed = materialize(segments.withColumn("place", F.encode(F.col("anchor").cast("string"), "utf-8")).drop("anchor"))
    return whole_units.unionByName(_decided(placed, size, most))


def without_repeats(
    docs: DataFrame, size: int = SIZE, gram: int = GRAM, most: int = SHARD, sharing: DataFrame | None = None
) -> DataFrame:
    """Every row of ``docs`` without the bytes that a repeated string of ``size`` bytes covers.

    Returns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (removed runs), ``kept_sha256`` and ``kept``
    (what is left, binary: a run may begin or end inside a character). Texts are UTF-8 bytes, null
    is empty; strings are judged on the input and never cross documents. Repeated rows are
    documents of their own, so all their strings of that length go. With the rows (``doc_id``, ``text_key``)
    of ``passages.sharing``, ``shares_passage`` says whether a row is one of them.
    """
    found = repeats(docs, size, gram, most).withColumn("shares", F.lit(0))
    if sharing is not None:
        found = found.unionByName(sharing.withColumn("shares", F.lit(1)), allowMissingColumns=True)
    marks = found.groupBy("doc_id", "text_key").agg(
        F.collect_list("at").alias("starts"), F.collect_list("windows").alias("counts"), F.max("shares").alias("shares")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_key(whole("text")), whole("text").cast("binary").alias("raw"))
    joined = join_same(texts, marks.hint("shuffle_hash"), ["doc_id", "text_key"])
    joined = joined.select("doc_id", "raw", "starts", "counts", F.coalesce("shares", F.lit(0)).alias("shares"))
    last = [] if sharing is None else ["shares_passage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *last]
        for batch in batches:
            rows = []
            for raw, starts, counts in zip(*(batch.column(i) for i in (1, 2, 3))):
                raw = raw.as_py()
                kept, spans = (raw, 0) if not (starts.is_valid and len(starts.values)) else cut_out(
                    raw, starts.values.to_numpy(), counts.values.to_numpy(), size
                )
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), batch.column(4)]
            yield pa.record_batch(columns[: len(names)], names=names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(run, ", ".join([schema, *(f"{name} int" for name in last)]))


def cut_out(raw: bytes, starts: np.ndarray, counts: np.ndarray, size: int) -> tuple[bytes, int]:
    """What is left without the runs of windows, and how many runs of bytes were removed."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order].astype(np.int64), (starts + counts + size - 1)[order].astype(np.int64)
    end = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    first, last = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    pieces = zip([0, *last.tolist()], [*first.tolist(), len(raw)])
    return b"".join(raw[a:b] for a, b in pieces), len(first)
