"""Lloyd's clustering with the dimensions of the vectors spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.kdtree import scaled
from varve.shared import materialize

SCALE, DIMS, CLUSTERS, ROUNDS = 64, 64, 16, 3
# Dimensions in a column block, and vectors in a shard of it.
WIDTH, ROWS = 16, 4096
LABELS = "group bigint, cluster array<int>, distance array<bigint>"


def usable(table: DataFrame, dims: int = DIMS, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``x`` = floor(scale * component) and a number ``row`` of the rows whose vector has exactly
    ``dims`` components, none null or not finite. Repeated rows stay rows of their own."""
    kept = table.select("vec_id", scaled(vector, scale).alias("x")).filter(F.size("x") == dims)
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()))


def partial_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids over the dimensions of one block.

    In doubles where every term is a whole number that they hold, else in Python's whole numbers.
    """
    top = max(int(np.abs(a).max(initial=0)) for a in (x.astype(object), centroids.astype(object)))
    if 4 * top * top * max(1, x.shape[1]) < 2**53:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    steps = x.astype(object)[:, None, :] - centroids.astype(object)[None]
    return (steps * steps).sum(axis=2).astype(np.int64)


def shards(rows: DataFrame, dims: int, width: int, size: int, total: int) -> DataFrame:
    """One row per shard of a column block: ``group``, ``block``, its part ``x`` of the vectors (binary), and, with
    the first block, the ``ids``. Rows are dealt to groups by a hash of their number, so none is large."""
    groups, parts = -(-total // size), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    blocks = list(range(0, dims, width))

    def cut(table: pa.Table) -> pa.Table:
        vectors = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        ids = table["vec_id"].combine_chunks()
        own = pa.ListArray.from_arrays(pa.array([0, len(ids), *[len(ids)] * (len(blocks) - 1)], pa.int32()), ids)
        columns = [
            pa.array([table["group"][0].as_py()] * len(blocks), pa.int64()),
            pa.array(range(len(blocks)), pa.int32()),
            own,
            pa.array([np.ascontiguousarray(vectors[:, a : a + width]).tobytes() for a in blocks], pa.binary()),
        ]
        return pa.table(columns, names=["group", "block", "ids", "x"])

    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"), "vec_id", "x")
    packed = dealt.groupBy("group").applyInArrow(cut, f"group bigint, block int, ids array<{kind}>, x binary")
    return materialize(packed.repartition(min(parts, groups * len(blocks)), "block", "group"))


def _slices(centroids: DataFrame) -> DataFrame:
    """The centroids by block, each block's as one array; clusters times dimensions numbers in all."""
    own = F.sort_array(F.collect_list(F.struct("cluster", "i", "value")))
    return centroids.groupBy("block").agg(F.count_distinct("cluster").alias("k"), F.transform(own, lambda s: s["value"]).alias("c"))


def assigned(shards: DataFrame, centroids: DataFrame) -> DataFrame:
    """``LABELS``: per group the nearest centroid (ties: the smaller number) and the squared distance.

    Tasks over column blocks compute partial distances against their slice of the centroids; the
    blocks of a group are then added up and the least total taken.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for raw, k, c in zip(*(batch.column(i) for i in (1, 2, 3))):
                own = c.values.to_numpy().reshape(k.as_py(), -1)
                x = np.frombuffer(raw.as_py(), np.int64).reshape(-1, own.shape[1])
                found.append(partial_distances(x, own).tobytes())
            counts = batch.column(2)
            yield pa.record_batch([batch.column(0), counts, pa.array(found, pa.binary())], names=["group", "k", "distance"])

    def nearest(table: pa.Table) -> pa.Table:
        k, total = table["k"][0].as_py(), None
        for raw in table["distance"]:
            part = np.frombuffer(raw.as_py(), np.int64).reshape(-1, k)
            if total is not None and int(total.max()) + int(part.max()) >= 2**63:
                raise OverflowError("a squared distance does not fit a long")
            total = part if total is None else total + part
        cluster = total.argmin(axis=1)
        columns = [
            pa.array([table["group"][0].as_py()], pa.int64()),
            pa.array([cluster.astype(np.int32)], pa.list_(pa.int32())),
            pa.array([total[np.arange(len(total)), cluster]], pa.list_(pa.int64())),
        ]
        return pa.table(columns, names=["group", "cluster", "distance"])

    met = shards.select("group", "block", "x").join(F.broadcast(_slices(centroids)), "block")
    parts = met.select("group", "x", "k", "c").mapInArrow(partial, "group bigint, k bigint, distance binary")
    return parts.groupBy("group").applyInArrow(nearest, LABELS)


def moved(shards: DataFrame, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """``centroids`` (block, cluster, i, value) after one step: each shard of a block sums its own dimensions.

    A centroid becomes floor(sum / count) of its vectors, in whole numbers; an empty one stays.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, cluster in zip(*batch.columns):
                at = cluster.values.to_numpy()
                x = np.frombuffer(raw.as_py(), np.int64).reshape(len(at), -1)
                kinds, place, counts = np.unique(at, return_inverse=True, return_counts=True)
                total = np.zeros((len(kinds), x.shape[1]), np.int64)
                np.add.at(total, place, x)
                width = x.shape[1]
                columns = [
                    np.full(total.size, block.as_py(), np.int32),
                    np.repeat(kinds, width).astype(np.int32),
                    np.tile(np.arange(width, dtype=np.int32), len(kinds)),
                    np.repeat(counts, width),
                    total.ravel(),
                ]
                yield pa.record_batch([pa.array(c) for c in columns], names=["block", "cluster", "i", "n", "total"])

    met = shards.select("group", "block", "x").join(labels.select("group", "cluster"), "group")
    parts = met.select("block", "x", "cluster").mapInArrow(sums, "block int, cluster int, i int, n bigint, total bigint")
    place = ["block", "cluster", "i"]
    whole = parts.groupBy(*place).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    mean = F.expr("(total - pmod(total, n)) div n")
    return centroids.join(whole, place, "left").select(*place, F.coalesce(mean, "value").alias("value"))


def cluster(
    table: DataFrame,
    dims: int = DIMS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    vector: str = "embedding",
    scale: int = SCALE,
    width: int = WIDTH,
    size: int = ROWS,
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept row.

    Vectors of exactly ``dims`` components, none null or not finite, take part as whole numbers
    floor(scale * x); the first ``clusters`` of them by the sha256 of "1:" and the id (a null id as
    no digits; equal hashes by vector) are the first centroids, or all if there are fewer. Each of
    ``rounds`` rounds assigns every vector to the nearest centroid, the smaller number at a
    tie, and moves each centroid that has vectors to the floor of their mean. Repeated rows count and are
    returned each; a null id stays null; without kept rows the result is empty. Squared distances
    and their sums must fit a long, else the job fails. The centroids, ``clusters * dims`` numbers, are the
    only table that is broadcast.
    """
    spark = table.sparkSession
    rows = usable(table, dims, vector, scale)
    total = rows.count()
    if not total:
        kind = table.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    code = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(code.alias("code"), "x").orderBy("code", "x").limit(clusters).collect()
    listed = [(i // width, c, i % width, v) for c, row in enumerate(first) for i, v in enumerate(row["x"])]
    centroids = spark.createDataFrame(listed, "block int, cluster int, i int, value bigint")
    packed = shards(rows, dims, width, size, total)
    for _ in range(rounds):
        centroids = materialize(moved(packed, assigned(packed, centroids), centroids))
    labels = materialize(assigned(packed, centroids))
    ids = packed.filter("block = 0").select("group", "ids")
    each = labels.join(ids, "group").select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    sums = labels.select(F.inline(F.arrays_zip("cluster", "distance"))).groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("block", "i", "value"))), lambda s: s["value"].cast("string"))
    codes = centroids.groupBy("cluster").agg(F.sha2(F.array_join(own, ","), 256).alias("centroid_sha256"))
    known = materialize(sums.join(codes, "cluster"))
    everything = known.agg(F.sum("cluster_inertia")).scalar()
    return each.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", everything.alias("inertia"), "centroid_sha256"
    )
