"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from varve.shared import lookup_join, materialize

LEAF = 256
SHARD = 8192
BLOCK = 256
# Blocks of queries that meet a shard in one task.
GROUP = 64

TREE = "shard long, dim int, ids binary, vectors binary, nodes binary, low binary, high binary, least binary"
HITS = "dim int, block long, query_id long, vec_id long, score long"


def scaled(vector: str | Column, by: int = 256) -> Column:
    """Each component as floor(by * x), x as double; null unless all components are finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("long")))


def usable(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part: an id, and a vector without null or non-finite
    components. Repeated rows count once."""
    rows = table.select("vec_id", scaled(vector).alias("v"))
    return rows.filter("vec_id is not null and v is not null").distinct()


class Tree:
    """A KD-tree over the rows of a matrix: median splits of the widest side, boxes drawn tight."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, nodes, low, high, least = np.arange(len(ids)), [], [], [], []
        open_ = [(0, len(ids))]
        while open_:
            start, stop = open_.pop(0)
            rows = vectors[order[start:stop]]
            low.append(rows.min(axis=0, initial=np.iinfo(np.int64).max) if rows.shape[1] else rows[0])
            high.append(rows.max(axis=0, initial=np.iinfo(np.int64).min) if rows.shape[1] else rows[0])
            least.append(ids[order[start:stop]].min())
            children = -1
            if stop - start > leaf and rows.shape[1]:
                side = int(np.argmax(high[-1].astype(float) - low[-1].astype(float)))
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(rows[:, side], middle)]
                children = len(nodes) + len(open_) + 1
                open_ += [(start, start + middle), (start + middle, stop)]
            nodes.append((start, stop, children))
        self.ids, self.vectors = ids[order], vectors[order]
        self.nodes, self.low, self.high = np.array(nodes, np.int64), np.array(low), np.array(high)
        self.least = np.array(least, np.int64)

    def row(self, shard: int) -> dict:
        blobs = {n: getattr(self, n).astype(np.int64).tobytes() for n in ("ids", "vectors", "nodes", "low", "high", "least")}
        return {"shard": shard, "dim": self.vectors.shape[1], **blobs}

    @classmethod
    def of(cls, row: dict) -> Tree:
        tree = cls.__new__(cls)
        array = lambda name: np.frombuffer(row[name], np.int64)
        tree.ids, tree.least, tree.nodes = array("ids"), array("least"), array("nodes").reshape(-1, 3)
        for name, rows in (("vectors", len(tree.ids)), ("low", len(tree.nodes)), ("high", len(tree.nodes))):
            setattr(tree, name, array(name).reshape(rows, row["dim"]))
        return tree


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where every partial sum is a whole number that they hold."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**52:
        return a.astype(float) @ b.astype(float).T
    return a @ b.T


class Best:
    """The k best of one query: highest score, then smallest id. Holds (score, -id), worst first."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def admits(self, bound, least_id: int) -> bool:
        return len(self.heap) < self.k or (bound, -least_id) > self.heap[0]

    def offer(self, scores: np.ndarray, ids: np.ndarray, own: int) -> None:
        keep = ids != own
        if len(self.heap) >= self.k:
            keep &= scores >= self.heap[0][0]
        scores, ids = scores[keep], ids[keep]
        if len(self.heap) < self.k < len(scores):
            # The best come last: highest score, then smallest id. Repeated pairs count once before the cut.
            order = np.lexsort((~ids, scores))
            scores, ids = scores[order], ids[order]
            new = np.append(True, (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1]))
            scores, ids = scores[new][-self.k :], ids[new][-self.k :]
        for score, at in zip(scores.tolist(), ids.tolist()):
            if at == own or (score, -at) in self.heap:
                continue
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, (score, -at))
            elif (score, -at) > self.heap[0]:
                heapq.heapreplace(self.heap, (score, -at))


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, bests: list[Best]) -> None:
    """Best-first: nodes in the order of the highest score their box allows, until that is below the
    k-th score found so far, in this shard or in those searched before."""
    bounds = _products(np.maximum(queries, 0), tree.high) + _products(np.minimum(queries, 0), tree.low)
    wanted: dict[int, list[int]] = {}
    nodes, least = tree.nodes.tolist(), tree.least.tolist()
    for q, best in enumerate(bests):
        own, bound = int(query_ids[q]), bounds[q].tolist()
        heap = [(-bound[0], least[0], 0)]
        while heap and best.admits(-heap[0][0], heap[0][1]):
            _, _, node = heapq.heappop(heap)
            start, stop, children = nodes[node]
            if children >= 0:
                for child in (children, children + 1):
                    if best.admits(bound[child], least[child]):
                        heapq.heappush(heap, (-bound[child], least[child], child))
            else:
                best.offer(_products(queries[q : q + 1], tree.vectors[start:stop])[0], tree.ids[start:stop], own)


def trees(rows: DataFrame, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """One row per shard: its vectors in the order of the leaves, and the boxes of all nodes.

    Rows are dealt to shards by a hash of id and vector, so clustered vectors and those of one id spread
    over all of them. Shards hold vectors of one length; their number grows with the table.
    """
    placed = lookup_join(rows.withColumn("dim", F.size("v")), shard_counts(rows, shard), ["dim"])
    dealt = placed.select("dim", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).alias("shard"), "vec_id", "v")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        vectors = np.array(group["v"].tolist(), np.int64).reshape(len(group), dim)
        return pd.DataFrame([Tree(group["vec_id"].to_numpy(np.int64), vectors, leaf).row(int(group["shard"].iloc[0]))])

    return materialize(dealt.groupBy("dim", "shard").applyInPandas(build, TREE))


def shard_counts(rows: DataFrame, shard: int) -> DataFrame:
    """``dim`` and ``shards`` for each length of vector."""
    return materialize(rows.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard).alias("shards")))


def query_blocks(rows: DataFrame, is_query: Column, block: int = BLOCK) -> DataFrame:
    """Queries packed into blocks of about ``block``: ``dim``, ``block``, ``query_ids``, ``queries``."""
    wanted = rows.filter(is_query).withColumn("dim", F.size("v"))
    total = wanted.agg(F.ceil(F.greatest(F.count("*"), F.lit(1)) / block).alias("n"))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), total.scalar()))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        queries = np.array(group["v"].tolist(), np.int64).reshape(len(group), dim)
        ids = group["vec_id"].to_numpy(np.int64)
        return pd.DataFrame([{"dim": dim, "block": int(group["block"].iloc[0]), "query_ids": ids.tobytes(), "queries": queries.tobytes()}])

    return materialize(dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, query_ids binary, queries binary"))


def top_k(table: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", shard: int = SHARD, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """The ``k`` rows of ``table`` with the highest inner product, for each query row.

    Components are floor(256 * x). ``is_query`` selects queries by ``vec_id``; candidates are all rows
    of the same vector length but those with the query's id. Ties go to the smaller id. Returns
    ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``. Rows whose id or vector is null, or whose
    vector holds a null or non-finite component, take no part; fewer candidates give fewer
    rows. There may be any number of vector lengths, each searched apart. Scores must fit a long.

    Each block of queries first searches one shard. The best found there go along to all other
    shards, where the k-th score prunes from the start. Equal scores need the smallest ids, so a box is left out only if neither
    its bound nor, at an equal bound, its smallest id can still win.
    """
    rows = materialize(usable(table, vector))
    built, blocks = trees(rows, shard, leaf), query_blocks(rows, is_query, block)
    known = lookup_join(blocks, shard_counts(rows, shard), ["dim"]).withColumn("home", F.col("block") % F.col("shards"))
    nothing = F.array().cast("array<bigint>")
    at_home = known.withColumn("shard", F.col("home"))
    first = materialize(_searched(at_home.select("*", *(nothing.alias(n) for n in KNOWN)), built, k))
    hits = first.groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "vec_id", "score")).alias("hits"))
    others = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter("shard <> home")
    told = others.join(hits, ["dim", "block"], "left").select(
        "*", *(F.coalesce(F.col(f"hits.{n}"), nothing).alias(KNOWN[i]) for i, n in enumerate(("query_id", "vec_id", "score")))
    )
    found = _searched(told, built, k).unionByName(first).select("query_id", "vec_id", "score").distinct()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


KNOWN = ("known_query", "known_vec", "known_score")


def _searched(pairs: DataFrame, built: DataFrame, k: int) -> DataFrame:
    """New hits of each pair of a block and a shard. One task holds one tree and ``GROUP`` blocks."""

    def run(_: tuple, tree_rows: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        new = []
        if len(tree_rows):
            tree = Tree.of(tree_rows.iloc[0].to_dict())
            for row in block_rows.to_dict("records"):
                ids = np.frombuffer(row["query_ids"], np.int64)
                queries = np.frombuffer(row["queries"], np.int64).reshape(len(ids), row["dim"])
                bests = [Best(k) for _ in ids]
                place = {int(q): best for q, best in zip(ids, bests)}
                for query, vec, score in zip(*(row[name] for name in KNOWN)):
                    heapq.heappush(place[int(query)].heap, (int(score), -int(vec)))
                before = [set(best.heap) for best in bests]
                search(tree, ids, queries, bests)
                for query, best, old in zip(ids.tolist(), bests, before):
                    new += [(row["dim"], row["block"], query, -at, int(score)) for score, at in best.heap if (score, at) not in old]
        return pd.DataFrame(new, columns=["dim", "block", "query_id", "vec_id", "score"])

    groups = F.floor(F.col("block") / GROUP).alias("group")
    grouped = pairs.select("*", groups)
    wanted = grouped.select("dim", "shard", F.col("group").alias("part")).distinct()
    left = built.join(wanted, ["dim", "shard"]).groupBy("dim", "shard", "part")
    return left.cogroup(grouped.groupBy("dim", "shard", "group")).applyInPandas(run, HITS)
