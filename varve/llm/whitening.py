"""Whitening of vectors by the exact characteristic polynomial of their scatter."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.kdtree import scaled
from varve.llm.tables import let
from varve.shared import lookup_join, materialize

SCALE, COMPONENTS = 256, 4
# Bits, relative to the trace, to which roots are found; roots closer than 2**CLOSE of the last ones
# count as one root of several components; further bits for rounding.
BITS, CLOSE, GUARD = 160, 20, 96
PASSES = 3
COMPONENT = "component int, e double, explained double, vector array<double>"


# whole-number sums over the fit list


def gram(x: np.ndarray) -> np.ndarray:
    """The exact sums of products of the columns of ``x`` with a column of ones before them, as Python's
    whole numbers. Rows are multiplied as doubles as far as every sum is a whole number that they hold."""
    ones = np.hstack([np.ones((len(x), 1), np.int64), x])
    top = max(1, int(np.abs(x.astype(float)).max(initial=0)) + 1)
    total = np.zeros((ones.shape[1],) * 2, object)
    step = 2**53 // (top * top)
    if not step:
        wide = ones.astype(object)
        return wide.T @ wide
    for at in range(0, len(ones), step):
        part = ones[at : at + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def sums(fit: DataFrame) -> DataFrame:
    """``dim`` and ``entries``, (i, j, value) for i <= j: sums of products of the components, 0 standing for ones.

    Each task adds up its own rows, so what is shuffled is one matrix per task. The length of the
    vectors, not their number, bounds a row of the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(0)
            lengths = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                own = vectors.take(pa.array(np.flatnonzero(lengths == dim))).flatten().to_numpy().reshape(-1, dim)
                totals[dim] = totals.get(dim, 0) + gram(own)
        for dim, total in totals.items():
            i, j = np.triu_indices(dim + 1)
            values = pa.array([Decimal(int(v)) for v in total[i, j]], pa.decimal128(38, 0))
            columns = [pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values]
            yield pa.record_batch(columns, names=["dim", "i", "j", "value"])

    parts = fit.select("x").mapInArrow(run, "dim int, i int, j int, value decimal(38,0)")
    added = parts.groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    entry = F.struct("i", "j", F.col("value").cast("string").alias("value"))
    return added.groupBy("dim").agg(F.collect_list(entry).alias("entries"))


def scatter(dim: int, entries: list[dict]) -> tuple[int, list[int], np.ndarray]:
    """The number n of vectors, their sums, and n * n times their covariance, all whole numbers.

    n * sum(x x') - S S' is the sum of (n x - S)(n x - S)' divided by n: centred, without a rounding.
    """
    total = np.zeros((dim + 1, dim + 1), object)
    for entry in entries:
        total[entry["i"], entry["j"]] = total[entry["j"], entry["i"]] = int(entry["value"])
    n, s = int(total[0, 0]), total[0, 1:]
    return n, [int(v) for v in s], n * total[1:, 1:] - np.outer(s, s)


# the characteristic polynomial, modulo primes


def is_prime(n: int) -> bool:
    """For odd n below 3,215,031,751, by strong tests to the bases 2, 3, 5 and 7."""
    odd, twos = n - 1, 0
    while not odd % 2:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        if n == base:
            return True
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(matrix: np.ndarray) -> list[int]:
    """Primes below 2**31, from the top, whose product exceeds twice any coefficient.

    The k-th coefficient is a sum of products of k roots, none negative: at most as if all were equal.
    """
    dim, trace = len(matrix), int(np.trace(matrix))
    most = 2 * max(comb(dim, k) * trace**k // dim**k + 1 for k in range(dim + 1))
    found, product, n = [], 1, 2**31 - 1
    while product <= most:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients modulo ``p``, constant first, of the characteristic polynomial of a matrix modulo ``p``.

    Similarity steps bring it to Hessenberg form, whose leading parts give the polynomial one after the other.
    """
    h, n = matrix.copy() % p, len(matrix)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        pivot = m + int(below[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    leading = np.zeros((n + 1, n + 1), np.int64)
    leading[0, 0] = 1
    for k in range(1, n + 1):
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        leading[k, 1:] = leading[k - 1, :-1]
        leading[k] = (leading[k] - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[n]


def restored(residues: dict[int, np.ndarray]) -> list[int]:
    """The whole numbers of least size with the given residues, by Chinese remaindering."""
    product = 1
    for p in residues:
        product *= p
    total = 0
    for p, residue in residues.items():
        rest = product // p
        total = total + residue.astype(object) * (rest * pow(rest, -1, p))
    return [int(v) - product if 2 * int(v) > product else int(v) for v in total % product]


# roots and null spaces


def roots_above(poly: list[int], a: int) -> int:
    """How many roots, counted as often as they occur, exceed ``a``: all are real, so the changes of
    sign in the coefficients about ``a`` count them exactly."""
    c, n = list(poly), len(poly) - 1
    for i in range(n):
        for j in range(n - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], trace: int, count: int) -> tuple[list[int], int]:
    """The ``count`` largest positive roots, times 2**bits and rounded down, falling, and these bits."""
    bits = max(0, BITS - trace.bit_length())
    n = len(poly) - 1
    scaled_up = [c << (bits * (n - k)) for k, c in enumerate(poly)]
    found, high = [], (trace + 1) << bits
    for rank in range(1, min(count, roots_above(scaled_up, 0)) + 1):
        low = 0
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if roots_above(scaled_up, middle) >= rank else (low, middle)
        found.append(low)
        high = low + 1
    return found, bits


def null_space(matrix: np.ndarray, root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthogonal unit vectors that the matrix takes to ``root`` / 2**bits times themselves.

    Inverse iteration in whole numbers: solving with the matrix less the root, almost singular, leaves what
    lies in its null space and shrinks all else by the distance of the roots.
    """
    n = len(matrix)
    near = matrix * (1 << (bits + 1 + GUARD)) - np.diag(np.full(n, (2 * root + 1) << GUARD, object))
    random = np.random.default_rng(42)
    vectors = random.integers(-(1 << 40), 1 << 40, (n, count)).astype(object)
    for _ in range(PASSES):
        vectors = _orthogonal(_solved(near, vectors))
    found = []
    for v in vectors.T:
        norm = isqrt(int((v * v).sum()))
        lead = max(range(n), key=lambda i: abs(v[i]))
        sign = 1 if v[lead] > 0 else -1
        found.append([sign * int(x) / norm for x in v])
    return found


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of ``matrix`` z = ``right``, both whole numbers, times a power of two."""
    u, n = matrix.copy(), len(matrix)
    size = max(1, max(abs(int(v)) for v in matrix.ravel())).bit_length()
    r = right * (1 << size)
    extra = size + GUARD
    for k in range(n):
        pivot = max(range(k, n), key=lambda i: abs(u[i, k]))
        if pivot != k:
            u[[k, pivot]], r[[k, pivot]] = u[[pivot, k]], r[[pivot, k]]
        if not u[k, k]:
            u[k, k] = 1
        for i in range(k + 1, n):
            if u[i, k]:
                factor = (u[i, k] << extra) // u[k, k]
                u[i, k:] -= (factor * u[k, k:]) >> extra
                r[i] -= (factor * r[k]) >> extra
    z = np.zeros_like(r)
    for k in range(n - 1, -1, -1):
        rest = r[k] * (1 << extra)
        if k < n - 1:
            rest = rest - (u[k, k + 1 :, None] * z[k + 1 :]).sum(axis=0)
        z[k] = rest // u[k, k]
    return z


def _orthogonal(vectors: np.ndarray) -> np.ndarray:
    """The columns brought to a like size and made orthogonal, one after the other, in whole numbers."""
    bits = BITS + GUARD
    done: list[np.ndarray] = []
    for v in vectors.T:
        for _ in range(2):
            shift = max(abs(int(x)) for x in v).bit_length() - bits
            v = v >> shift if shift >= 0 else v << -shift
            for other in done:
                v = v - other * ((int((v * other).sum()) << bits) // int((other * other).sum())) // (1 << bits)
        done.append(v)
    return np.stack(done, axis=1)


def components(matrix: np.ndarray, n: int, poly: list[int], count: int = COMPONENTS) -> list[tuple]:
    """(component, eigenvalue, share of the trace, unit vector) of the ``count`` largest eigenvalues of matrix / n**2."""
    trace = int(np.trace(matrix))
    roots, bits = largest_roots(poly, trace, count)
    found: list[tuple] = []
    while len(found) < len(roots):
        root = roots[len(found)]
        same = [r for r in roots[len(found) :] if root - r < 1 << CLOSE]
        for vector, own in zip(null_space(matrix, root, bits, len(same)), same):
            value = 2 * own + 1
            found.append((len(found) + 1, value / (n * n << (bits + 1)), value / (trace << (bits + 1)), vector))
    return found


# the operator


def model(fit: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """``dim``, ``n``, ``sums`` and ``components`` for each length of the distinct vectors ``fit``.

    One task per prime takes the polynomial modulo it; the remainders meet again per length.
    """
    known = materialize(sums(fit))
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, entries in zip(*(column.to_pylist() for column in batch.columns)):
                *_, matrix = scatter(dim, entries)
                for p in primes_for(matrix):
                    columns = [pa.array([dim], pa.int32()), pa.array([p], pa.int64()), pa.array([(matrix % p).astype(np.int64).tobytes()], pa.binary())]
                    yield pa.record_batch(columns, names=["dim", "p", "matrix"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                polynomial(np.frombuffer(raw, np.int64).reshape(dim, dim), p).tolist()
                for dim, p, raw in zip(*(column.to_pylist() for column in batch.columns))
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["dim", "p", "poly"])

    def finish(own: pa.Table, residues: pa.Table) -> pa.Table:
        dim, entries = own["dim"][0].as_py(), own["entries"][0].as_py()
        n, total, matrix = scatter(dim, entries)
        poly = restored({p: np.array(c, np.int64) for p, c in zip(residues["p"].to_pylist(), residues["poly"].to_pylist())})
        names = ("component", "e", "explained", "vector")
        listed = [dict(zip(names, one)) for one in components(matrix, n, poly, count)]
        kind = pa.list_(pa.struct([("component", pa.int32()), ("e", pa.float64()), ("explained", pa.float64()), ("vector", pa.list_(pa.float64()))]))
        columns = [pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64())), pa.array([listed], kind)]
        return pa.table(columns, names=["dim", "n", "sums", "components"])

    dealt = known.mapInArrow(deal, "dim int, p bigint, matrix binary").repartition(parts, "dim", "p")
    residues = dealt.mapInArrow(reduce, "dim int, p bigint, poly array<bigint>")
    met = known.groupBy("dim").cogroup(residues.groupBy("dim"))
    return materialize(met.applyInArrow(finish, f"dim int, n bigint, sums array<bigint>, components array<struct<{_typed(COMPONENT)}>>"))


def _typed(fields: str) -> str:
    return ", ".join(":".join(field.rsplit(" ", 1)) for field in fields.split(", "))


def _centred() -> Column:
    return F.zip_with("x", "sums", lambda x, s: F.col("n") * x - s)


def _whitened(y: Column, one: Column) -> Column:
    projected = F.aggregate(F.zip_with(y, one["vector"], lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)
    return projected / (F.col("n") * F.sqrt(one["e"]))


def whiten(table: DataFrame, count: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``, for every row
    whose vector is neither null nor holds a null or a non-finite component, and each of ``count`` components.

    Components are the eigenvectors of the covariance of the distinct vectors of whole numbers
    floor(scale * x), by falling eigenvalue; each points where its largest entry is positive.
    Vectors of each length are a space of their own; ``identity_error`` is the largest of all. A
    component without variance cannot be whitened and gives no row: none at all does for a single
    distinct vector, an empty vector or an empty table. Equal eigenvalues share a space, of which any orthogonal
    directions are taken. Repeated rows each get their rows, a null id too. ``deviation`` is null
    where it exceeds a long.
    """
    numbers = table.select("vec_id", scaled(vector, scale).alias("x")).filter(F.size("x") > 0)
    rows = materialize(numbers.select("vec_id", "x", F.size("x").alias("dim")))
    fit = materialize(rows.select("dim", "x").distinct())
    found = model(fit, count)
    placed = lookup_join(fit, found, ["dim"]).select(
        "dim", let(_centred(), lambda y: F.transform("components", lambda one: _whitened(y, one))).alias("w")
    )
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    entry = lambda a, b: F.abs(F.covar_pop(F.get("w", F.lit(a)), F.get("w", F.lit(b))) - float(a == b))
    largest = F.array_max(F.array(*(entry(a, b) for a, b in pairs)))
    error = materialize(placed.groupBy("dim").agg(largest.alias("error"))).agg(F.max("error")).scalar()
    wide = F.aggregate(
        F.transform(F.col("y"), lambda v: v.cast("decimal(19,0)") * v.cast("decimal(19,0)")),
        F.lit(0).cast("decimal(38,0)"),
        lambda total, v: (total + v).cast("decimal(38,0)"),
    )
    centred = lookup_join(rows, found, ["dim"]).withColumn("y", _centred())
    each = centred.select("vec_id", "n", "y", wide.try_cast("bigint").alias("deviation"), F.explode("components").alias("one"))
    return each.select(
        "vec_id",
        F.col("one.component").alias("component"),
        "n",
        "deviation",
        _whitened(F.col("y"), F.col("one")).alias("whitened"),
        F.col("one.explained").alias("explained"),
        error.alias("identity_error"),
    )
