"""Isolation forests, clusters and whitening against plain versions of them."""

import hashlib
import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.llm import isolation
from varve.llm.isolation import COUNTS, anomalies, failed, fit, isolate, repeated_words, statistics, thresholds
from varve.llm.lloyd import cluster
from varve.llm.tables import documents, labels
from varve.llm.whitening import components, polynomial, primes_for, restored, roots_above, whiten
from varve.shared import materialize

SF = "/root/testdata/sf0.01"


def embeddings(spark, folder=SF):
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def odd_vectors(spark):
    """Nulls, other lengths, ties, repeated rows and ids, extra columns of clashing names."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5, 0.25]), (1, [0.5, -0.5, 0.25]), (2, [0.5, -0.5, 0.25]), (1, [1.0, 2.0, -3.0]), (None, [0.1, 0.2, 0.3])]
    rows += [(3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (6, [None, 1.0, 2.0]), (7, [1.0, 2.0]), (8, []), (9, [0.0, -0.0, 0.0])]
    rows += [(10 + i, [math.sin(i), math.cos(3 * i), i / 7]) for i in range(20)]
    rows += [(50 + i, [i % 3 / 2.0, 1.0]) for i in range(4)]
    full = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, cluster string, n int").repartition(3)


def whole_vectors(table, scale):
    for row in table.collect():
        v = row["embedding"]
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            yield row["vec_id"], tuple(math.floor(scale * c) for c in v)


# clusters


def plain_clusters(table, dims, clusters=16, rounds=3):
    kept = [(i, x) for i, x in whole_vectors(table, 64) if len(x) == dims]
    if not kept:
        return []
    code = lambda row: (hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1])
    centers = [x for _, x in sorted(kept, key=code)[:clusters]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        own = [[] for _ in centers]
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        centers = [tuple(sum(c) // len(g) for c in zip(*g)) if g else old for g, old in zip(own, centers)]
    found = [(i, *nearest(x)) for i, x in kept]
    sums = Counter()
    for _, distance, k in found:
        sums[k] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, k, d, sums[k], sum(sums.values()), digest[k]) for i, d, k in found), key=repr)


@pytest.mark.parametrize("size", [64, 4096])
def test_clusters_equal_plain_ones(spark, size):
    assert rows_of(cluster(embeddings(spark), size=size)) == plain_clusters(embeddings(spark), 64)


@pytest.mark.parametrize("width", [1, 2, 5])
def test_clusters_of_odd_rows(odd_vectors, width):
    for dims in (3, 2, 7):
        assert rows_of(cluster(odd_vectors, dims=dims, width=width, size=4)) == plain_clusters(odd_vectors, dims)
    assert rows_of(cluster(odd_vectors, dims=3, clusters=2, rounds=1)) == plain_clusters(odd_vectors, 3, 2, 1)


def test_clusters_of_large_numbers_are_exact_or_fail(spark):
    table = spark.createDataFrame([(i, [2.0**20 * (i % 5) + i, -(2.0**21)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert rows_of(cluster(table, dims=2, width=1)) == plain_clusters(table, 2)
    huge = spark.createDataFrame([(i, [2.0**40 * i]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="Overflow|overflow"):
        cluster(huge, dims=1, clusters=1).collect()


# whitening


def test_polynomial_counts_roots_exactly():
    matrix = np.diag([0, 2, 2, 5, 9]).astype(object)
    poly = restored({p: polynomial((matrix % p).astype(np.int64), p) for p in primes_for(matrix)})
    want = [1]
    for root in (0, 2, 2, 5, 9):
        want = [a - root * b for a, b in zip([0, *want], [*want, 0])]
    assert poly == want
    assert [roots_above(poly, a) for a in (-1, 0, 1, 2, 4, 5, 8, 9)] == [5, 4, 4, 2, 2, 1, 1, 0]


def test_polynomial_of_a_full_matrix():
    random = np.random.default_rng(3)
    x = random.integers(-300, 300, (40, 9)).astype(object)
    matrix = x.T @ x
    poly = restored({p: polynomial((matrix % p).astype(np.int64), p) for p in primes_for(matrix)})
    # By the traces of powers (Newton's identities), in whole numbers.
    power, traces = np.eye(9, dtype=object), []
    for _ in range(9):
        power = power @ matrix
        traces.append(int(np.trace(power)))
    sums = [1]
    for k in range(1, 10):
        sums.append(sum((-1) ** (i - 1) * sums[k - i] * traces[i - 1] for i in range(1, k + 1)) // k)
    assert poly[::-1] == [(-1) ** k * e for k, e in enumerate(sums)]


def test_equal_and_close_eigenvalues():
    random = np.random.default_rng(4)
    q, _ = np.linalg.qr(random.normal(size=(6, 6)))
    whole = np.round(q * 1000).astype(int).astype(object)
    for base in (np.diag([7, 7, 7, 3, 1, 0]), np.diag([10**12, 10**12 - 1, 5, 5, 5, 5])):
        matrix = base.astype(object) if base[0, 0] > 10 else whole.T @ base.astype(object) @ whole
        poly = restored({p: polynomial((matrix % p).astype(np.int64), p) for p in primes_for(matrix)})
        found = components(matrix, 1, poly)
        vectors = np.array([v for *_, v in found])
        assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-14)
        for _, value, _, v in found:
            assert np.linalg.norm(matrix.astype(float) @ v - value * np.array(v)) <= 1e-13 * float(np.trace(matrix))


def check_whitened(table):
    """Against an eigenvector routine for each length."""
    rows = list(whole_vectors(table, 256))
    found = [r.asDict() for r in whiten(table).collect()]
    assert len({r["identity_error"] for r in found}) <= 1
    want = 0
    for dim in {len(x) for _, x in rows if x}:
        own = [(i, x) for i, x in rows if len(x) == dim]
        distinct = np.array(sorted({x for _, x in own}), dtype=np.int64).reshape(-1, dim)
        n, total = len(distinct), distinct.sum(axis=0)
        centred = distinct - total / n
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        used = [k for k in range(min(4, dim)) if values[-1 - k] > 1e-9]
        want += len(own) * len(used)
        for k in used:
            e, v = values[-1 - k], vectors[:, -1 - k]
            expected = sorted((repr(i), round(abs(float((np.array(x) - total / n) @ v / np.sqrt(e))), 7)) for i, x in own)
            deviations = sorted((repr(i), int(((n * np.array(x) - total) ** 2).sum())) for i, x in own)
            # Another length with the same n, component and share would be a chance of the data.
            mine = [r for r in found if (r["component"], r["n"]) == (k + 1, n) and math.isclose(r["explained"], e / values.sum(), rel_tol=1e-9)]
            assert sorted((repr(r["vec_id"]), r["deviation"]) for r in mine) == deviations
            got = sorted((repr(r["vec_id"]), round(abs(r["whitened"]), 7)) for r in mine)
            assert [i for i, _ in got] == [i for i, _ in expected]
            assert np.allclose([w for _, w in got], [w for _, w in expected], atol=1e-6)
    assert len(found) == want
    assert all(r["identity_error"] < 1e-9 for r in found)


def test_whitened_rows(spark, odd_vectors):
    check_whitened(embeddings(spark))
    check_whitened(odd_vectors)


def test_whitening_of_few_rows(odd_vectors):
    assert whiten(odd_vectors.limit(0)).collect() == []
    assert whiten(odd_vectors.filter("vec_id in (1, 2)").filter("embedding[0] = 0.5")).collect() == []


# isolation forests


def plain_counts(text):
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in "".join("\n" if c in blank else c for c in text).split("\n") if w]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if any(c not in blank for c in line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside), len(seen) + again


AWKWARD = ["", " ", "a b c d e", "a b c d e a b c d e", "a a a a a a a", "a b c d", "x\n\nx\n x\nx", "one|two <b>\r\none|two <b>\r\n", "ü " * 30]


def test_statistics_equal_plain_ones(given):
    texts = AWKWARD + [r["text"] or "" for r in given.select("text").collect()]
    assert [statistics(t) for t in texts] == [plain_counts(t) for t in texts]
    assert all(repeated_words(list(w)) == plain_counts(" ".join(w))[4] for w in product("ab", repeat=8))


def plain_path(forest, tree, row):
    node, depth = 0, 0
    while forest.child[tree, node]:
        node = forest.child[tree, node] + int(row[forest.column[tree, node]] > forest.bound[tree, node])
        depth += 1
    return forest.path[tree, node], depth


def test_rows_equal_the_forest_walked_tree_by_tree(spark):
    docs, marks = documents(spark, "/root/testdata/sf0.001"), labels(spark, SF)
    forests = fit(docs, marks)
    views = ((0,), (1,), (2, 3))
    found = {r["doc_id"]: r for r in isolate(docs, marks).collect()}
    for row in docs.collect():
        counts = plain_counts(row["text"] or "")
        n, chars, symbols, dup, repeated, lines = counts
        x = [chars / max(n, 1), symbols / max(n, 1), dup / max(lines, 1), repeated / max(n, 1)]
        scores = []
        for forest, view in zip(forests, views):
            own = [x[c] for c in view]
            paths = [plain_path(forest, t, own) for t in range(len(forest.path))]
            assert all(depth <= 8 for _, depth in paths)
            scores.append(2 ** -(sum(p for p, _ in paths) / len(paths) / forest.usual))
        base = n < 10 or 100 * repeated > 20 * n
        out = any(s >= f.threshold for s, f in zip(scores, forests))
        got = found[row["doc_id"]]
        assert tuple(got[c] for c in COUNTS[:-1]) == counts[:-1]
        assert got["base_failed"] == base and got["kept"] == (not base and not out)
        assert math.isclose(got["anomaly"], max(scores), rel_tol=1e-9)


def test_bad_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    found = isolate(documents(spark, folder), labels(spark, folder)).join(labels(spark, folder), "doc_id").filter("not base_failed")
    kept = {q: [r["kept"] for r in found.filter(f"quality = {q}").select("kept").collect()] for q in (0, 1)}
    assert np.mean(kept[1]) >= 0.999 and np.mean(kept[0]) <= 0.05


def test_thresholds_follow_the_labels():
    scores, good = [np.array([0.1, 0.2, 0.8, 0.9]), np.array([0.9, 0.1, 0.1, 0.5])], np.array([True, True, False, False])
    assert thresholds(scores, good) == [0.5, np.inf]
    assert thresholds(scores, ~good)[0] == np.inf
    assert thresholds(scores, np.ones(4, bool)) == [np.inf, np.inf]


def test_isolation_of_odd_rows(spark, hard, empty):
    marks = labels(spark, SF)
    found = isolate(hard, marks)
    counts = sorted(((r["doc_id"], *plain_counts(r["text"] or "")[:-1]) for r in hard.collect()), key=repr)
    assert rows_of(found.select("doc_id", *COUNTS[:-1])) == counts
    assert isolate(empty, marks).collect() == []
    alone = isolate(hard, marks.limit(0)).collect()
    assert all(r["anomaly"] is None and r["kept"] != r["base_failed"] for r in alone)
    again = marks.unionByName(marks).unionByName(marks.selectExpr("cast(null as long) doc_id", "quality", "toxic"))
    assert rows_of(isolate(hard, again)) == rows_of(found)


def test_thresholds_come_from_all_labelled_rows(spark, monkeypatch):
    """More than 8,000 rows of a label: the distributed cuts are those over all rows in memory, and every row is scored."""
    random = np.random.default_rng(4)
    for cut in (0.6, 0.9, 2.0):
        good = random.random(20_000) < 0.6
        scores = [np.round(random.random(20_000), 3) * np.where(good, 0.8, 1.0), np.round(random.random(20_000), 2) + (~good & (random.random(20_000) > cut))]
        df = spark.createDataFrame([(bool(g), [float(a), float(b)]) for g, a, b in zip(good, *scores)], "good boolean, scores array<double>")
        found, wanted = isolation.calibrated(materialize(df), 2), thresholds(scores, good)
        assert found == pytest.approx(wanted) and min(wanted) < np.inf
    text = F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * k % 1009 + 2000 * k).cast("string")) for k in range(1, 14)))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 20 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    seen = []
    monkeypatch.setattr(isolation, "calibrated", lambda scored, n: seen.append(scored.count()) or [np.inf] * n)
    forests = fit(docs, marks)
    assert seen == [20_000] and len(forests) == 3 and forests[0].usual == isolation.expected_path(256)


def test_trees_take_their_own_rows_of_all(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), *(F.col("id").alias(name) for name in COUNTS))
    samples = isolation.tree_samples(materialize(rows), 7, 50)
    taken = [tuple(sample[:, 0]) for sample in samples]
    assert len(set(taken)) == 7 and all(len(set(one)) == 50 for one in taken) and max(map(max, taken)) > 2000
    assert [len(one) for one in isolation.tree_samples(materialize(rows.limit(20)), 3, 50)] == [20] * 3
    assert isolation.tree_samples(materialize(rows.limit(0)), 3, 50) == []


def test_an_id_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "a" * n + " word" * 12) for n in range(1, 40)] + [(2, "b " * 15)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0)] * 20 + [(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    from varve.llm.tables import labelled_sample

    sample = labelled_sample(docs, marks, "quality", F.lit(True), {0: 5, 1: 5}).collect()
    assert sorted((r["doc_id"], r["label"]) for r in sample) == [(1, 0), (2, 1)]


def test_counts_fail_the_base_rules():
    counts = np.array([[9, 9, 0, 0, 0, 1], [10, 10, 0, 0, 2, 1], [10, 10, 0, 0, 3, 1]])
    assert failed(counts).tolist() == [True, False, True]
    assert anomalies([], counts)[1].tolist() == [False] * 3
