"""Whitening of integer-scaled vectors by the exact characteristic polynomial of their scatter.

Vectors become integers, and their scatter n * sum(x x') - S S' is summed exactly by Spark. Its characteristic
polynomial is found modulo many primes by Hessenberg reduction, a Spark row for each prime, and put together by Chinese
remaindering. All its roots are real, so the sign changes of its shifted coefficients count the roots above any
number exactly, with multiplicity: bisection isolates the largest ones to any precision. Inverse iteration near a
root, in decimals of that precision, gives the null space and so the components.

Only what has the size of a vector or of the scatter (dimensions squared) reaches the driver, however many rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.storage import cut

#: Significant bits of a root at least, and digits of the inverse iteration.
ROOT_BITS = 200
DIGITS = 160
#: Decimal digits that sums of the scatter may have.
SUMS = "decimal(38,0)"
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list; eigenvalues and components of its covariance, largest first; its trace."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    trace: float


# ---------------------------------------------------------------- integers and their scatter


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x of the rows whose vector has finite entries only: floor(scale * entry) as long."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(usable).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _gram(x: np.ndarray) -> np.ndarray:
    """x'x, exactly: in 64 bits where no sum can leave them, else in Python's integers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < 1 << 53:  # such sums are exact in doubles too, which multiply faster
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    if most * most * len(x) < SAFE:
        return (x.T @ x).astype(object)
    y = x.astype(object)
    return y.T @ y


def _partial_scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: rows i, values = sums of x_i * x; and i = -1, values = (count, sums of x)."""
    gram, sums, n = None, None, 0
    for batch in batches:
        x = _matrix(batch.column("x"))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            own = _gram(part)
            gram = own if gram is None else gram + own
            total = part.astype(object).sum(axis=0) if int(np.abs(part).max(initial=0)) * len(part) >= SAFE else part.sum(axis=0).astype(object)
            sums = total if sums is None else sums + total
        n += len(x)
    if n:
        d = len(sums)
        rows = [[Decimal(n), *map(Decimal, sums)], *([Decimal(v) for v in gram[i]] for i in range(d))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array(rows, pa.list_(pa.decimal128(38, 0)))], ["i", "v"])


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n * sum(x x') - S S' of fit(x), all of them exact."""
    partial = fit.select("x").mapInArrow(_partial_scatter, f"i int, v array<{SUMS}>")
    summed = partial.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum(F.col("v")).cast(SUMS).alias("v")).collect()
    at = {(r["i"], r["j"]): int(r["v"]) for r in summed}
    if not at:
        return 0, [], []
    d = max(i for i, _ in at) + 1
    n, sums = at[-1, 0], [at[-1, 1 + j] for j in range(d)]
    return n, sums, [[n * at[i, j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


# ---------------------------------------------------------------- characteristic polynomial


def _is_prime(p: int) -> bool:
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(a, d, p)
        if x in (1, p - 1):
            continue
        for _ in range(s - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def primes_below(top: int, product: int) -> list[int]:
    """The largest odd primes below top whose product exceeds product."""
    out, p, held = [], top - 1 - top % 2, 1
    while held <= product:
        if _is_prime(p):
            out.append(p)
            held *= p
        p -= 2
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """det(t I - matrix) modulo p, lowest power first. matrix: residues below p < 2^31."""
    h = matrix.copy()
    d = len(h)
    for k in range(d - 2):  # similar matrices, until all below the first subdiagonal is zero
        nonzero = np.nonzero(h[k + 1 :, k])[0]
        if not len(nonzero):
            continue
        r = k + 1 + nonzero[0]
        if r != k + 1:
            h[[r, k + 1]] = h[[k + 1, r]]
            h[:, [r, k + 1]] = h[:, [k + 1, r]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        for i in np.nonzero(factor)[0]:  # a column at a time, as products of residues fill 62 bits
            h[:, k + 1] = (h[:, k + 1] + h[:, k + 2 + i] * factor[i] % p) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # polynomials of the leading submatrices
    leading[0, 0] = 1
    for k in range(d):
        row = np.zeros(d + 1, np.int64)
        row[1:] = leading[k, :-1]
        row = (row - h[k, k] * leading[k] % p) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            row = (row - int(h[i, k]) * product % p * leading[i] % p) % p
        leading[k + 1] = row
    return leading[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """det(t I - matrix), lowest power first, of a symmetric matrix without negative eigenvalues; a prime is a row.

    The k-th coefficient is a symmetric function of the eigenvalues, whose sum is the trace: it is at most
    C(d, k) * (trace / d)^k. Primes whose product is over twice the largest such bound determine all of them.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes = primes_below((1 << 31) - 1, 2 * bound)
    told = [[str(v) for v in row] for row in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in told], object)
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = polynomial_mod((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([found.tolist()], pa.list_(pa.int64()))], ["p", "c"])

    slices = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(slices).mapInArrow(run, "p long, c array<long>").collect()
    product, out = 1, [0] * (d + 1)
    for r in sorted(rows, key=lambda r: r["p"]):
        p = r["p"]
        inverse = pow(product, -1, p)
        out = [c + product * ((int(new) - c) * inverse % p) for c, new in zip(out, r["c"], strict=True)]
        product *= p
    return [c - product if 2 * c > product else c for c in out]


# ---------------------------------------------------------------- roots and components


def roots_above(polynomial: list[int], numerator: int, bits: int) -> int:
    """How many roots of a real-rooted polynomial exceed numerator / 2^bits, with multiplicity."""
    d = len(polynomial) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]  # roots times 2^bits
    for i in range(d):  # Taylor shift
        for k in range(d - 1, i - 1, -1):
            c[k] += numerator * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(polynomial: list[int], count: int) -> list[tuple[int, int]]:
    """(numerator, bits) of the count largest positive roots with multiplicity, falling; each is the root's floor at that scale.

    First every root is found to the integer, then to ROOT_BITS bits; roots that agree to the last bit are one.
    """
    count = min(count, roots_above(polynomial, 0, 0))
    top = -polynomial[-2]  # the sum of the roots
    found: list[tuple[int, int]] = []
    for k in range(1, count + 1):
        bits, low, high = 0, 0, top + 1  # more than k - 1 roots exceed low, fewer than k exceed high
        if found and roots_above(polynomial, *found[-1]) >= k:
            found.append(found[-1])
            continue
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if roots_above(polynomial, middle, bits) >= k else (low, middle)
        while low.bit_length() < ROOT_BITS:  # again if the root is far below one
            more = ROOT_BITS - low.bit_length()
            bits, low, high = bits + more, low << more, high << more
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if roots_above(polynomial, middle, bits) >= k else (low, middle)
        found.append((low, bits))
    return found


def _solver(matrix: np.ndarray):
    """Solves matrix * y = b in decimals by Gauss with pivots; a zero pivot becomes the least number that counts."""
    a = matrix.copy()
    d = len(a)
    steps = []
    least = max(abs(v) for v in a.ravel()) * Decimal(10) ** (-DIGITS) or Decimal(1)
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if r != k:
            a[[k, r]] = a[[r, k]]
        if abs(a[k, k]) < least:
            a[k, k] = least
        factor = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] = a[k + 1 :, k:] - np.outer(factor, a[k, k:])
        steps.append((r, factor))

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, (r, factor) in enumerate(steps):
            if r != k:
                y[[k, r]] = y[[r, k]]
            y[k + 1 :] = y[k + 1 :] - factor * y[k]
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] - (a[k, k + 1 :] * y[k + 1 :]).sum()) / a[k, k]
        return y

    return solve


def components_of(matrix: list[list[int]], roots: list[tuple[int, int]]) -> list[list[float]]:
    """Unit vectors of the null spaces of matrix - root, one for each root, orthonormal where a root repeats."""
    d = len(matrix)
    out: list[list[float]] = []
    with localcontext() as context:
        context.prec = DIGITS
        exact = np.array([[Decimal(v) for v in row] for row in matrix], object)
        done: list[tuple[tuple[int, int], np.ndarray]] = []
        solve, of = None, None
        for k, root in enumerate(roots):
            if root != of:
                shift = (Decimal(2 * root[0] + 1)) / (Decimal(2) ** (root[1] + 1))
                shifted = exact.copy()
                for i in range(d):
                    shifted[i, i] = shifted[i, i] - shift
                solve, of = _solver(shifted), root
            own = [v for r, v in done if r == root]
            y = np.array([Decimal((i + 1) * (2 * k + 3) % 101 + 1) for i in range(d)], object)
            for _ in range(4):
                for v in own:  # stay away from the directions that this root has already given
                    y = y - v * (v * y).sum()
                y = solve(y)
                y = y / (y * y).sum().sqrt()
            for v in own:
                y = y - v * (v * y).sum()
            y = y / (y * y).sum().sqrt()
            done.append((root, y))
            out.append([float(v) for v in y])
    return out


# ---------------------------------------------------------------- the operator


def learn(fit: DataFrame, components: int = 4) -> Whitening:
    """The whitening of fit(x), a row for each distinct vector. Directions without spread are no components."""
    n, sums, matrix = scatter(fit)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return Whitening(n, tuple(sums), (), (), 0.0)
    roots = largest_roots(characteristic_polynomial(fit.sparkSession, matrix), components)
    vectors = components_of(matrix, roots)
    values = [(2 * a + 1) / ((n * n) << (bits + 1)) for a, bits in roots]  # quotients of integers, rounded once
    return Whitening(n, tuple(sums), tuple(values), tuple(map(tuple, vectors)), trace / (n * n))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly."""
    sums = np.array(model.sums, object)
    if model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums)) < SAFE:
        return x * np.int64(model.n) - sums.astype(np.int64)
    return x.astype(object) * model.n - sums


def _whitened(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Rows of n * x - S on all components, over the square roots of their eigenvalues."""
    return (y.astype(np.float64) / model.n) @ np.array(model.components).T / np.sqrt(model.eigenvalues)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, measured over all of it."""
    k = len(model.components)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _whitened(_centred(_matrix(batch.column("x")), model), model)
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([[*sums, *products.ravel()]], pa.list_(pa.float64()))], ["v"])

    partial = fit.select("x").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("j", "v"))
    at = {r["j"]: r["v"] / model.n for r in partial.groupBy("j").agg(F.sum("v").alias("v")).collect()}
    means = [at[i] for i in range(k)]
    return max(abs(at[k + k * i + j] - means[i] * means[j] - (i == j)) for i in range(k) for j in range(k))


def apply(points: DataFrame, model: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of points(vec_id, x): a row for each component."""
    k = len(model.components)
    explained = [e / model.trace for e in model.eigenvalues]
    kind = points.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x) or not k:
                continue
            y = _centred(x, model)
            if y.dtype != object and int(np.abs(y).max()) ** 2 * y.shape[1] >= SAFE:
                far = y.astype(object)
            else:
                far = y
            deviation = pa.array([Decimal(v) for v in (far * far).sum(axis=1).tolist()], pa.decimal128(38, 0))
            row = np.repeat(np.arange(len(x)), k)
            each = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(row)), pa.array((each + 1).astype(np.int32)), pa.array(np.full(len(row), model.n)), deviation.take(pa.array(row)), pa.array(_whitened(y, model).ravel()), pa.array(np.array(explained)[each]), pa.array(np.full(len(row), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation {SUMS}, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries take no part; nor do those of another length
    than most have (of equally frequent lengths the longer). The fit list has every distinct integer vector once, so
    repeated rows and hot vectors neither weigh more nor meet in one task: equal vectors are merged before the
    shuffle. Null and repeated ids pass through; other columns are ignored. Components are those of positive
    eigenvalue: fewer than asked for if there are fewer, and none (so no rows) for an empty table or one where all
    vectors are equal. deviation is exact in up to 38 digits.
    """
    points = integers(vectors, scale, id_col, vector_col)
    sizes = points.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    points = points.where(F.size("x") == (sizes[0]["d"] if sizes else 0))
    fit = cut(points.select("x").distinct(), "whitening-fit")
    model = learn(fit, components)
    return apply(points, model, identity_error(fit, model))
