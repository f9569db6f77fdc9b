"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

1. Tasks sum the outer products of the distinct vectors exactly (products of 20-bit limbs, which float64 holds without
   rounding); Spark adds the partial sums, so the driver sees d * d / 2 numbers, whatever the number of rows.
2. With n vectors, sums S and products G the matrix ``M = n * G - S S'`` is n * n times the covariance, in whole numbers. Its
   characteristic polynomial is found modulo many 31-bit primes, each by a reduction to Hessenberg form, the primes being
   dealt to tasks. The Chinese remainder theorem gives the whole coefficients; the number of primes follows from a bound on them.
3. All roots are real and none is negative, so Descartes' rule counts them exactly: the roots at or above ``a`` are the sign
   changes of the polynomial moved by ``a`` and its roots at 0. Bisection with that count isolates the largest ones, with multiplicity.
4. Inverse iteration with many decimal digits finds the null space of ``M - root``; a root of multiplicity m gets m vectors
   that are orthonormal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .vectors import by_length, complete, exact, largest, whole

COMPONENTS = 4
LIMB = 20
#: Rows whose products are summed in float64: 2^12 products of two limbs stay below 2^53.
ROWS = 1 << 12
PRIMES_A_TASK = 16
#: Roots are told apart down to 2^-BITS of the trace; closer ones count as one root of higher multiplicity.
BITS = 100
DIGITS = 60
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Float matrices l with x = sum of l[k] * 2^(LIMB * k); the last has a sign, all are below 2^LIMB."""
    out = []
    while largest(x) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray) -> np.ndarray:
    """x' x with a column of ones added to x: sums of products, sums, and the number of rows, as Python integers."""
    x = np.hstack([x, np.ones((len(x), 1), np.int64)])
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for start in range(0, len(x), ROWS):
        limbs = _limbs(x[start : start + ROWS])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return total


def _partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for length, _, x in by_length(batch.column(0)):
            totals[length] = totals.get(length, 0) + products(x)
    names = ["length", "i", "j", "a", "b", "c", "d"]
    for length, total in totals.items():
        i, j = np.triu_indices(length + 1)
        values, mask = total[i, j], (1 << 40) - 1
        parts = [values & mask, values >> 40 & mask, values >> 80 & mask, values >> 120]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(i), length, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
            *(pa.array(p.astype(np.int64)) for p in parts),
        ], names=names)


def scatter_sums(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector the exact matrix of ``products`` over all rows of the column ``x``."""
    parts = map_arrow(vectors.select("x"), _partial_products, "length int, i int, j int, a long, b long, c long, d long")
    sums = parts.groupBy("length", "i", "j").agg(*(F.sum(c).alias(c) for c in "abcd"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # (length + 1) * (length + 2) / 2 rows for each length
        m = out.setdefault(r.length, np.zeros((r.length + 1, r.length + 1), dtype=object))
        m[r.i, r.j] = m[r.j, r.i] = r.a + (r.b << 40) + (r.c << 80) + (r.d << 120)
    return out


def _is_prime(n: int) -> bool:
    """Miller's test; these bases decide every n below 3 * 10^9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_above(product: int) -> list[int]:
    """The largest primes below 2^31, as many as are needed for a product above the given number."""
    out, candidate, reached = [], (1 << 31) - 1, 1
    while reached <= product:
        if _is_prime(candidate):
            out.append(candidate)
            reached *= candidate
        candidate -= 2
    return out


def characteristic_residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo each prime; one row per prime."""
    d, k = len(matrix), len(primes)
    p = np.array(primes, dtype=np.int64)
    p2, p3 = p[:, None], p[:, None, None]
    h = np.stack([(matrix % q).astype(np.int64) for q in primes]) if d else np.zeros((k, 0, 0), np.int64)
    each = np.arange(k)
    for m in range(1, d - 1):
        below = h[:, m:, m - 1] != 0
        pivot = m + below.argmax(axis=1)
        h[each, m], h[each, pivot] = h[each, pivot], h[each, m].copy()
        h[each, :, m], h[each, :, pivot] = h[each, :, pivot], h[each, :, m].copy()
        inverse = np.array([pow(int(x), -1, q) if x else 0 for x, q in zip(h[:, m, m - 1], primes, strict=True)], dtype=np.int64)
        u = h[:, m + 1 :, m - 1] * inverse[:, None] % p2
        h[:, m + 1 :] = (h[:, m + 1 :] - u[:, :, None] * h[:, None, m] % p3) % p3
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * u[:, None, :] % p3).sum(axis=2)) % p2
    polys = np.zeros((k, d + 1, d + 1), dtype=np.int64)  # [prime, size of the leading block, coefficient]
    polys[:, 0, 0] = 1
    for m in range(d):
        chain = np.ones(k, dtype=np.int64)
        weights = np.zeros((k, m + 1), dtype=np.int64)
        for i in range(m, -1, -1):
            weights[:, i] = h[:, i, m] * chain % p
            if i:
                chain = chain * h[:, i, i - 1] % p
        moved = np.roll(polys[:, m], 1, axis=1)
        polys[:, m + 1] = (moved - (weights[:, :, None] * polys[:, : m + 1] % p3).sum(axis=1)) % p2
    return polys[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Whole coefficients (constant first) of det(x - matrix) for a positive semidefinite matrix of Python integers.

    The primes are dealt to tasks of ``PRIMES_A_TASK``. With trace T no coefficient exceeds (1 + T / d)^d.
    """
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    primes = primes_above(2 * (2 + trace // max(d, 1)) ** d)
    sent = spark.sparkContext.broadcast(matrix)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for start in range(0, len(mine), PRIMES_A_TASK):
                some = mine[start : start + PRIMES_A_TASK]
                rows = characteristic_residues(sent.value, some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["p", "c"])

    tasks = -(-len(primes) // PRIMES_A_TASK)
    dealt = spark.createDataFrame([(q,) for q in primes], "p long").repartition(tasks)
    found = map_arrow(dealt, images, "p long, c array<long>").collect()
    whole_product = math.prod(primes)
    out = [0] * (d + 1)
    for r in found:
        rest = whole_product // r.p
        rest *= pow(rest, -1, r.p)
        out = [a + c * rest for a, c in zip(out, r.c, strict=True)]
    out = [a % whole_product for a in out]
    return [a - whole_product if 2 * a > whole_product else a for a in out]


def roots_from(coefficients: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only are at or above the whole number ``a``, with multiplicity."""
    c = list(coefficients)
    for stop in range(len(c) - 1):
        for i in range(len(c) - 2, stop - 1, -1):
            c[i] += a * c[i + 1]
    signs = [x > 0 for x in c if x]
    at = next(i for i, x in enumerate(c) if x)
    return at + sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(coefficients: list[int], count: int) -> tuple[list[tuple[int, int]], int]:
    """``[(r, m), ...], s``: the largest roots lie in [r, r + 1) / 2^s, m of them each, until ``count`` are covered or roots end."""
    d, trace = len(coefficients) - 1, -coefficients[-2]
    s = max(64, BITS - trace.bit_length())
    scaled = [c << s * (d - i) for i, c in enumerate(coefficients)]
    positive = d - next(i for i, c in enumerate(coefficients) if c)
    out: list[tuple[int, int]] = []
    seen, high = 0, (trace << s) + 1
    while seen < min(count, positive):
        low, top = 0, high  # at least seen + 1 roots from low on, at most seen from top on
        while top - low > 1:
            middle = (low + top) // 2
            low, top = (middle, top) if roots_from(scaled, middle) > seen else (low, middle)
        now = min(roots_from(scaled, low), positive)
        out.append((low, now - seen))
        seen, high = now, low
    return out, s


def null_vectors(matrix: np.ndarray, root: int, s: int, many: int) -> np.ndarray:
    """``many`` orthonormal vectors (columns) of the null space of matrix - (root + 1/2) / 2^s, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = 2 * DIGITS + len(str(sum(matrix.diagonal())))
        a = np.array([[Decimal(int(x)) for x in row] for row in matrix], dtype=object)
        value = Decimal(2 * root + 1) / Decimal(2 ** (s + 1))
        for i in range(d):
            a[i, i] -= value
        tiny = Decimal(10) ** -DIGITS
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[k], order[best] = order[best], order[k]
            if not a[k, k]:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] /= a[k, k]
                a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :])

        def solve(b: list[Decimal]) -> list[Decimal]:
            y = np.array([b[i] for i in order], dtype=object)
            for k in range(d):
                y[k + 1 :] -= a[k + 1 :, k] * y[k]
            for k in range(d - 1, -1, -1):
                y[k] /= a[k, k]
                y[:k] -= a[:k, k] * y[k]
            return list(y)

        found: list[np.ndarray] = []
        for j in range(many):
            v = np.array([Decimal((i + 1) * (2 * j + 3) * 7919 % 1009 - 504) for i in range(d)], dtype=object)
            for _ in range(100):
                w = np.array(solve(list(v)), dtype=object)
                for u in found:
                    w = w - u * (w * u).sum()
                w = w / (w * w).sum().sqrt()
                w = w if w[np.argmax(abs(w))] > 0 else -w
                moved = max(abs(w - v))
                v = w
                if moved < Decimal(10) ** (-DIGITS // 2):
                    break
            found.append(v)
        return np.array([[float(x) for x in u] for u in found]).T


class Whitener(NamedTuple):
    """The fitted transform of vectors of one length; ``axes`` has a unit component per column."""

    n: int
    sums: list[int]
    axes: np.ndarray
    roots: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Deviation (None where it leaves the range of long) and whitened components of rows of whole numbers."""
        bound = self.n * largest(x) + max(map(abs, self.sums), default=0)
        y = exact(x, max(1, x.shape[1]) * bound * bound)
        y = y * self.n - np.array(self.sums, dtype=y.dtype)
        deviation = [v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))]
        y = y.astype(np.float64)
        # row by row sums, whose bits don't depend on the batch
        parts = [(y * self.axes[:, k]).sum(axis=1) / math.sqrt(r) if r else np.full(len(y), np.nan) for k, r in enumerate(self.roots)]
        return deviation, np.array(parts).reshape(len(parts), len(y))


def fit_whitener(spark: SparkSession, sums: np.ndarray, components: int = COMPONENTS) -> Whitener:
    """The transform from the exact ``products`` of the fit list."""
    d, n = len(sums) - 1, int(sums[-1, -1])
    s = [int(x) for x in sums[:d, d]]
    m = n * sums[:d, :d] - np.multiply.outer(np.array(s, dtype=object), np.array(s, dtype=object)) if d else np.zeros((0, 0), dtype=object)
    trace = int(sum(m.diagonal()))
    count = min(components, d)
    axes, roots = np.zeros((d, count)), np.zeros(count)
    if trace:
        intervals, scale = largest_roots(characteristic_polynomial(spark, m), count)
        at = 0
        for root, many in intervals:
            many = min(many, count - at)
            axes[:, at : at + many] = null_vectors(m, root, scale, many)
            roots[at : at + many] = float(Decimal(2 * root + 1) / Decimal(2 ** (scale + 1)))
            at += many
    live = roots > 0
    error = None
    if live.any():
        w = axes[:, live] / np.sqrt(roots[live])
        error = float(np.abs(w.T @ m.astype(np.float64) @ w - np.eye(w.shape[1])).max())
    return Whitener(n, s, axes, roots, roots / trace if trace else np.full(count, np.nan), error)


def _whitened(models: dict[int, Whitener]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for length, rows, x in by_length(batch.column(1)):
                model = models[length]
                many = len(model.roots)
                deviation, values = model.apply(x)
                again = np.repeat(np.arange(len(rows)), many)
                number = lambda v: pa.array(v, pa.float64(), from_pandas=True)  # noqa: E731  (nan becomes null)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(rows[again])), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(again), model.n, np.int64)), pa.array([deviation[i] for i in again], pa.int64()),
                    number(values.T.ravel()), number(np.tile(model.explained, len(rows))),
                    pa.array([model.identity_error] * len(again), pa.float64()),
                ], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per usable row and component.

    ``vectors`` has ``vec_id, embedding``; other columns are ignored. Components c become whole numbers floor(256 * c). The
    transform is fitted to the distinct vectors of whole numbers, each once, so copies carry no weight; every usable row is
    transformed, repeated rows and rows with a null id too. A vector that is null or has a null or non-finite component is left
    out. Vectors are fitted and transformed with those of their length; a length d below ``components`` gives d components, an
    empty vector none, an empty table no rows. A component without variance has ``whitened`` null and ``explained`` 0 (null where
    nothing varies); ``identity_error`` is taken over the other components. Equal eigenvalues share a space, of which any
    orthonormal basis may be returned. ``deviation`` is null where it exceeds the range of long. Runs the jobs of the fit: the
    driver receives sums of products and polynomial coefficients, which grow with the length of a vector alone.
    """
    spark = vectors.sparkSession
    rows = vectors.where(complete()).select(F.col("vec_id").cast("long").alias("vec_id"), whole().alias("x"))
    models = {length: fit_whitener(spark, sums, components) for length, sums in scatter_sums(rows.select("x").distinct()).items()}
    return map_arrow(rows, _whitened(models), SCHEMA)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
