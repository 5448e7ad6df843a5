"""SimHash near-duplicates by vantage-point trees over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.components import components
from varve.llm.tables import as_row, least_row, let, whole
from varve.shared import materialize

WORDS = 4
BITS = 4
LEAF = 256
SHARD = 32_768
# A shard is split around a vantage point if no side keeps more than this share of it.
WORTH = 0.75


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words of the text with A-Z in lower case."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1).tolist()
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], 42) for a, b in zip(starts, stops[words - 1 :])]
    return np.array(found, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` as ``doc_id``, ``text_key`` (a hash) and ``fingerprint``, a signed 64-bit number; 0 where
    there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            prints = np.fromiter((majority(shingle_hashes(t.as_py())) for t in texts), np.uint64, len(texts))
            columns = [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(whole("text")).alias("text_key"), whole("text").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_key bigint, fingerprint bigint")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Links:
    """Which of some numbered points are linked: trees of smaller and smaller numbers."""

    def __init__(self, size: int):
        self.above = np.arange(size)

    def root(self, point: int) -> int:
        above = self.above
        while above[point] != point:
            above[point] = above[above[point]]
            point = above[point]
        return point

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.above[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        above = self.above
        while not np.array_equal(above, above[above]):
            above = above[above]
        return above


def _near(prints: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, links: Links) -> None:
    """Link the points of ``a`` to those of ``b`` that are near, row block by row block."""
    if not len(a) or not len(b):
        return
    step = max(1, (1 << 20) // len(b))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        left, right = np.nonzero(distances(prints[rows][:, None], prints[b][None, :]) <= bits)
        left, right = rows[left], b[right]
        # Within a task only the connections matter, so points already connected need no new link.
        roots = links.roots()
        new = roots[left] != roots[right]
        pairs = np.unique(roots[left[new]] * len(prints) + roots[right[new]])
        links.add(pairs // len(prints), pairs % len(prints))


def _cross(prints, a, b, bits, links, depth=0) -> None:
    """Link points across two sets. A vantage point splits both; a branch is entered only where
    distances to the vantage point let a pair be near, by the triangle inequality."""
    if len(a) * len(b) <= LEAF * LEAF * 16 or depth > 24:
        return _near(prints, a, b, bits, links)
    vantage = prints[a[len(a) // 2]]
    da, db = distances(prints[a], vantage).astype(int), distances(prints[b], vantage).astype(int)
    cut = int(np.median(da))
    pairs = [(da <= cut, db <= cut + bits), (da > cut, db > cut - bits)]
    if sum(int(x.sum()) * int(y.sum()) for x, y in pairs) > 0.9 * len(a) * len(b):
        return _near(prints, a, b, bits, links)
    for x, y in pairs:
        _cross(prints, a[x], b[y], bits, links, depth + 1)


def _within(prints: np.ndarray, points: np.ndarray, bits: int, links: Links) -> None:
    """Link near points of one set through a vantage-point tree: a ball, its outside, and the shell of
    points so close to the boundary that a pair may lie across it."""
    while len(points) > LEAF:
        vantage = prints[points[0]]
        away = distances(prints[points], vantage).astype(int)
        close = away <= bits
        links.add(np.repeat(points[0], int(close.sum())), points[close])
        cut = int(np.median(away))
        inside, outside = points[away <= cut], points[away > cut]
        if 16 * len(outside) < len(points):
            break
        _cross(prints, points[(away <= cut) & (away > cut - bits)], points[(away > cut) & (away <= cut + bits)], bits, links)
        _within(prints, inside, bits, links)
        points = outside
    _near(prints, points, points, bits, links)


def near_in_shard(prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For distinct fingerprints, the smallest index that each is connected to."""
    links = Links(len(prints))
    if len(prints) > 1:
        _within(prints, np.arange(len(prints)), bits, links)
    return links.roots()


def _cells(fixed: Column, bits: int) -> Column:
    """``bits + 1`` masks that deal out the bits not in ``fixed``: two numbers that differ in at most
    ``bits`` places agree under one of them."""
    shift = lambda name, value, by: F.call_function(name, value, by)
    free = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: shift("shiftright", fixed, j).bitwiseAND(F.lit(1)) == 0)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def mask(free: Column, cell: Column) -> Column:
        own = F.filter(free, lambda j, place: place % (bits + 1) == cell)
        return F.aggregate(own, none, lambda total, j: total.bitwiseOR(shift("shiftleft", one, j)))

    return let(free, lambda free: F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda cell: mask(free, cell)))


def _by_cells(rows: DataFrame, *id_: str) -> DataFrame:
    """Each row once per mask of ``cells``, in a shard with those that agree with it under the mask."""
    dealt = rows.select(*id_, "fixed", "fingerprint", F.posexplode("cells").alias("cell", "mask"))
    key = F.xxhash64(*id_, "cell", F.col("fingerprint").bitwiseAND(F.col("mask")))
    return dealt.select(key.alias("shard"), F.col("fixed").bitwiseOR(F.col("mask")).alias("fixed"), "fingerprint")


def shards(distinct: DataFrame, bits: int = BITS, most: int = SHARD) -> DataFrame:
    """``shard`` and ``fingerprint``: fingerprints with at most ``bits`` differing bits share a shard.

    The bits are dealt into ``bits + 1`` cells, so two near fingerprints agree in a whole cell, and a
    fingerprint lies in one shard of each cell. A shard of more than ``most`` fingerprints is split
    around a vantage point, its least member, at the median distance; fingerprints within ``bits``
    of the boundary go to both sides. Where most lie that close to the boundary, as random ones do,
    the bits on which the shard does not agree yet are dealt into cells again. Each such step
    settles bits, and b open bits allow at most 2**b fingerprints, so every shard gets down to
    ``most`` (or to ``bits`` open bits, where all are near each other): no task gets an unbounded one.
    """
    start = distinct.select("fingerprint", F.lit(0).cast("bigint").alias("fixed"))
    rows = materialize(_by_cells(start.withColumn("cells", _cells(F.lit(0).cast("bigint"), bits))))
    done = []
    while True:
        sizes = rows.groupBy("shard").agg(
            F.count("*").alias("size"), F.min("fingerprint").alias("vantage"), F.min("fixed").alias("settled")
        )
        large = materialize(sizes.filter((F.col("size") > most) & (F.bit_count("settled") < 64 - bits)))
        if large.isEmpty():
            return _all([*done, rows]).select("shard", "fingerprint")
        done.append(rows.join(large, "shard", "left_anti"))
        away = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("vantage"))).alias("away")
        crowded = rows.join(large, "shard").select("*", away)
        # At most 65 distances a shard.
        counts = materialize(crowded.groupBy("shard", "away").agg(F.count("*").alias("n")))
        cuts = counts.groupBy("shard").agg(F.floor(F.percentile("away", 0.5, F.col("n"))).cast("int").alias("cut"))
        near_side, far_side = F.col("away") <= F.col("cut") + bits, F.col("away") > F.col("cut") - bits
        sides = counts.join(cuts, "shard").groupBy("shard", "cut").agg(
            *(F.sum(F.when(side, F.col("n")).otherwise(0)).alias(name) for name, side in (("inner", near_side), ("outer", far_side)))
        )
        halves = (F.greatest("inner", "outer") <= WORTH * F.col("size")).alias("halves")
        plan = materialize(large.join(sides, "shard").select("shard", "cut", halves, _cells(F.col("settled"), bits).alias("cells")))
        planned = crowded.drop("size", "settled", "vantage").join(plan, "shard")
        parts = F.array_compact(F.array(F.when(near_side, F.lit("inner")), F.when(far_side, F.lit("outer"))))
        split = planned.filter("halves").select("shard", "fixed", "fingerprint", F.explode(parts).alias("side"))
        split = split.select(F.xxhash64("shard", "side").alias("shard"), "fixed", "fingerprint")
        rows = materialize(split.unionByName(_by_cells(planned.filter("not halves"), "shard")))


def _all(parts: list[DataFrame]) -> DataFrame:
    whole_table = parts[0]
    for part in parts[1:]:
        whole_table = whole_table.unionByName(part)
    return whole_table


def near_links(distinct: DataFrame, bits: int = BITS, most: int = SHARD) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all that are near.

    Each shard is searched by a vantage-point tree and gives one link per connected fingerprint, not
    one per pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints in by_shard(batches):
            roots = near_in_shard(prints, bits)
            own = np.flatnonzero(roots != np.arange(len(roots)))
            if len(own):
                columns = [prints[own].view(np.int64), prints[roots[own]].view(np.int64)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["a", "b"])

    placed = shards(distinct, bits, most).repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(run, "a bigint, b bigint").distinct()


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The fingerprints of each shard, from batches in the order of the shards."""
    name, parts = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        prints = batch.column(1).to_numpy().view(np.uint64)
        edges = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for at, group in zip([0, *edges], np.split(prints, edges)):
            if not len(group):
                continue
            if shard[at] != name and parts:
                yield np.unique(np.concatenate(parts))
                parts = []
            name = shard[at]
            parts.append(group)
    if parts:
        yield np.unique(np.concatenate(parts))


def _grouped(docs: DataFrame, bits: int, most: int) -> DataFrame:
    """``doc_id``, ``text_key`` and ``fingerprint`` of every row, with the ``root`` fingerprint of its group
    and the ``component_id``. Equal fingerprints are searched once."""
    prints = materialize(fingerprints(docs))
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(first.select("fingerprint"), bits, most))
    joined = first.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = materialize(joined.withColumn("root", F.coalesce("root", "fingerprint")))
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    return prints.join(materialize(rooted.join(named, "root").drop("first")), "fingerprint")


def near_groups(docs: DataFrame, bits: int = BITS, most: int = SHARD) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints link at ``bits`` or fewer differing bits; the component is the smallest doc_id
    that links reach. A text without words has fingerprint zero and links like any other. A null
    id belongs to a group but never names it, unless all its ids are null. Repeated rows each
    get a row.
    """
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return _grouped(docs, bits, most).select("doc_id", digits, "component_id")


def drop_near(docs: DataFrame, bits: int = BITS, most: int = SHARD) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all its columns unchanged.

    The row with the smallest id stays; of rows with that id, the least by a hash of the text, then
    by its columns.
    """
    return keep_one(docs, _grouped(docs, bits, most))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of ``docs`` that stays of each ``root`` of ``groups``, which has a row for each of ``docs``."""
    eligible = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = eligible.groupBy("root").agg(F.min(F.struct("text_key", "doc_id")).alias("key")).select("key")
    rows = docs.select(F.struct(F.xxhash64(whole("text")).alias("text_key"), "doc_id").alias("key"), as_row(docs))
    kept = rows.join(stays, "key", "left_semi")
    return kept.groupBy("key").agg(least_row(docs)).select("row.*")
