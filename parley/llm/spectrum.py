"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so the scatter ``n * sum(x x') - S S'`` is a matrix of whole numbers
without any rounding. Its characteristic polynomial is computed modulo many primes (reduction to
Hessenberg form, then the recurrence over leading blocks) and put together by the Chinese
remainder theorem. All its roots are real, so by Descartes' rule the number of roots above ``a`` is
the number of sign changes of the polynomial shifted by ``a``: whole-number shifts isolate each of
the largest roots, multiple ones included, to many more digits than a double holds. Components
are null-space vectors by inverse iteration at the isolated root in decimal arithmetic.

What leaves a task is bounded by the square of the dimension, not by rows. Primes, and the roots
and components, are dealt out over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.shared import settled

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Whole numbers are summed over tasks in digits of this many bits.
_LIMB = 30
#: A root is isolated to this many bits below the trace.
_BITS = 120
#: Primes just below 2^31: products of two residues fit into a signed 64-bit number.
_TOP = 1 << 31
_AT_ONCE = 16


# -- the integer scatter --------------------------------------------------------------------------


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * c), as long where it fits and as Python numbers beyond."""
    if not vectors.size or np.abs(vectors).max() < 2.0**62 / scale:
        return np.floor(vectors * float(scale)).astype(np.int64)
    exact = [[int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in row] for row in vectors]
    return np.array(exact, object).reshape(vectors.shape)


def product_sums(x: np.ndarray) -> np.ndarray:
    """x' x without rounding, as Python numbers."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    most = int(abs(x).max()) if x.size else 0
    if most >= 1 << 26:  # a product alone may leave the 53 bits of a double
        y = x.astype(object)
        return total + y.T @ y
    rows = max(1, (1 << 53) // max(1, most * most))
    for start in range(0, len(x), rows):
        part = x[start : start + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, at = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield at, sign * (value & ((1 << _LIMB) - 1))
        value >>= _LIMB
        at += 1


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))


def _sums(vectors: DataFrame, size: int, scale: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and sums of products of floor(scale * c), exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = whole(_matrix(batch.column(0)), scale) if batch.num_rows else np.zeros((0, size), np.int64)
            n += len(x)
            first = first + x.astype(object).sum(0) if len(x) else first
            second = second + product_sums(x)
        found = [(-1, -1, k, v) for k, v in _limbs(n)]
        found += [(-1, i, k, v) for i in range(size) for k, v in _limbs(int(first[i]))]
        found += [(i, j, k, v) for i in range(size) for j in range(i, size) for k, v in _limbs(int(second[i, j]))]
        columns = list(zip(*found)) or [()] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["i", "j", "limb", "value"])

    parts = vectors.mapInArrow(run, "i int, j int, limb int, value bigint")
    # one row per entry and limb, however many rows the table has
    table = parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect()
    n, first, second = 0, [0] * size, [[0] * size for _ in range(size)]
    for r in table:
        value = r["value"] << (_LIMB * r["limb"])
        if r["j"] < 0:
            n += value
        elif r["i"] < 0:
            first[r["j"]] += value
        else:
            second[r["i"]][r["j"]] += value
    for i in range(size):
        for j in range(i):
            second[i][j] = second[j][i]
    return n, first, second


# -- characteristic polynomial --------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact for n below 3,215,031,751."""
    if n % 2 == 0:
        return n == 2
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


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31 whose product is above twice the bound."""
    found, product, at = [], 1, _TOP - 1
    while product <= 2 * bound:
        if _is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def polynomials_modulo(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(x I - matrix), lowest first, modulo each prime."""
    p = np.array(primes, np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64)
    many, d = h.shape[0], h.shape[1]
    p3, every = p[:, None, None], np.arange(many)
    for k in range(1, d - 1):
        # a row with a residue other than 0 below the diagonal comes to place k, with its column
        pivot = k + (h[:, k:, k - 1] != 0).argmax(1)
        rows = h[every, pivot].copy()
        h[every, pivot], h[every, k] = h[every, k].copy(), rows
        columns = h[every, :, pivot].copy()
        h[every, :, pivot], h[every, :, k] = h[every, :, k].copy(), columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, k, k - 1], primes)], np.int64)
        times = h[:, k + 1 :, k - 1] * inverse[:, None] % p[:, None]
        h[:, k + 1 :] = (h[:, k + 1 :] - times[:, :, None] * h[:, k, None, :] % p3) % p3
        back = (h[:, :, k + 1 :] * times[:, None, :] % p3).sum(2)
        h[:, :, k] = (h[:, :, k] + back) % p[:, None]
    found = np.zeros((d + 1, many, d + 1), np.int64)
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        now = np.zeros((many, d + 1), np.int64)
        now[:, 1:] = found[k - 1][:, :-1]
        now = (now - h[:, k - 1, k - 1, None] * found[k - 1]) % p[:, None]
        along = np.ones(many, np.int64)
        for i in range(k - 1, 0, -1):
            along = along * h[:, i, i - 1] % p
            now = (now - (along * h[:, i - 1, k - 1] % p)[:, None] * found[i - 1]) % p[:, None]
        found[k] = now
    return found[d]


def remainder(residues: list[int], primes: list[int]) -> int:
    """The number of least size with these residues."""
    value, product = 0, 1
    for r, q in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, q) % q)
        product *= q
    return value - product if 2 * value > product else value


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x I - matrix), lowest first, for a positive semi-definite matrix."""
    # a coefficient is a sum of principal minors, none above the product of its diagonal
    primes = primes_for(math.prod(1 + matrix[i][i] for i in range(len(matrix))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _AT_ONCE):
                some = batch.column(0).to_pylist()[start : start + _AT_ONCE]
                found = polynomials_modulo(matrix, some).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found)], ["prime", "residues"])

    tasks = max(1, min(len(primes) // 8, 4 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame(pd.DataFrame({"prime": primes})).repartition(tasks)
    rows = dealt.mapInArrow(run, "prime bigint, residues array<bigint>").collect()
    order = [r["prime"] for r in rows]
    return [remainder([r["residues"][k] for r in rows], order) for k in range(len(matrix) + 1)]


# -- roots ----------------------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: int, bits: int) -> int:
    """How many roots, counted as often as they repeat, lie above at / 2^bits; all roots are real."""
    d = len(coefficients) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(coefficients)]  # roots times 2^bits
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(coefficients: list[int], rank: int, trace: int, bits: int = _BITS) -> tuple[int, int]:
    """(low, shift): the root of this rank from above lies in (low, low + 1] / 2^shift, or is no larger than 0.

    Equal roots get one interval.
    """
    shift = max(0, bits - trace.bit_length())
    low, high = 0, (trace + 1) << shift
    if roots_above(coefficients, 0, 0) < rank:
        return -1, shift
    while high - low > 1:
        middle = (low + high) // 2
        if roots_above(coefficients, middle, shift) >= rank:
            low = middle
        else:
            high = middle
    return low, shift


# -- components -----------------------------------------------------------------------------------


def _solved(rows: list[list[Decimal]], right: list[list[Decimal]]) -> list[list[Decimal]]:
    """Gaussian elimination with row pivots; a pivot of 0 becomes the smallest step away from it."""
    a, b, d = [r[:] for r in rows], [r[:] for r in right], len(rows)
    tiny = max(abs(v) for r in a for v in r).scaleb(-60) or Decimal(1)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best], b[k], b[best] = a[best], a[k], b[best], b[k]
        if not a[k][k]:
            a[k][k] = tiny
        for i in range(k + 1, d):
            if a[i][k]:
                f = a[i][k] / a[k][k]
                a[i][k + 1 :] = [x - f * y for x, y in zip(a[i][k + 1 :], a[k][k + 1 :])]
                b[i] = [x - f * y for x, y in zip(b[i], b[k])]
    for k in range(d - 1, -1, -1):
        for j in range(k + 1, d):
            b[k] = [x - a[k][j] * y for x, y in zip(b[k], b[j])]
        b[k] = [x / a[k][k] for x in b[k]]
    return b


def _dot(u: list[Decimal], v: list[Decimal]) -> Decimal:
    return sum((x * y for x, y in zip(u, v)), Decimal(0))


def null_space(matrix: list[list[int]], low: int, shift: int, many: int, digits: int = 80) -> list[list[float]]:
    """Unit vectors that span the eigenvectors of ``many`` roots in (low, low + 1] / 2^shift."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        root = Decimal(2 * low + 1) / Decimal(2) ** (shift + 1)
        away = [[Decimal(v) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
        draws = np.random.default_rng(d).integers(-1_000_000, 1_000_000, (many, d)).tolist()
        basis = [[Decimal(v) for v in row] for row in draws]
        for _ in range(3):
            columns = _solved(away, [list(row) for row in zip(*basis)])
            basis, found = [list(v) for v in zip(*columns)], []
            for v in basis:
                for _ in range(2):
                    for u in found:
                        along = _dot(u, v)
                        v = [x - along * y for x, y in zip(v, u)]
                    length = _dot(v, v).sqrt()
                    v = [x / length for x in v]
                found.append(v)
            basis = found
        return [[float(x) for x in v] for v in basis]


def components(
    spark: SparkSession, matrix: list[list[int]], many: int = COMPONENTS
) -> list[tuple[float, list[float]]]:
    """(eigenvalue as a share of the trace, unit eigenvector) by falling eigenvalue; roots of 0 give none."""
    trace, d = sum(matrix[i][i] for i in range(len(matrix))), len(matrix)
    if not trace:
        return []
    coefficients = characteristic(spark, matrix)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank in batch.column(0).to_pylist():
                low, shift = isolate(coefficients, rank, trace)
                columns = [pa.array([rank], pa.int64()), pa.array([str(low)]), pa.array([shift], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "low", "shift"])

    ranks = range(1, min(many, d) + 1)
    dealt = spark.range(1, len(ranks) + 1, 1, len(ranks))
    found = dealt.mapInArrow(locate, "id bigint, low string, shift int").collect()
    places = [(int(r["low"]), r["shift"]) for r in sorted(found, key=lambda r: r["id"]) if int(r["low"]) >= 0]
    # neighbouring intervals are one cluster: any basis of it serves to more digits than a double has
    clusters: list[tuple[int, int, int]] = []
    for low, shift in places:
        if clusters and clusters[-1][0] - low <= 1:
            clusters[-1] = (low, shift, clusters[-1][2] + 1)
        else:
            clusters.append((low, shift, 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                low, shift, size = clusters[at]
                span = null_space(matrix, low, shift, size)
                columns = [pa.array([at] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(span)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "place", "vector"])

    if not clusters:
        return []
    dealt = spark.range(0, len(clusters), 1, len(clusters))
    spans = dealt.mapInArrow(vectors, "id bigint, place int, vector array<double>").collect()
    values = [(2 * low + 1) / (trace << (shift + 1)) for low, shift, _ in clusters]
    return [(values[r["id"]], list(r["vector"])) for r in sorted(spans, key=lambda r: (r["id"], r["place"]))]


# -- operator -------------------------------------------------------------------------------------


def _sound(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whiten(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    many: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
) -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error.

    An entry ``c`` is ``x = floor(scale * c) + shift``. Components are unit eigenvectors of the
    covariance of all usable vectors, by falling eigenvalue ``e`` and numbered from 1; ``whitened``
    is the centred vector along one, over sqrt(e); ``explained`` is e over the trace. ``deviation``
    is the sum of (n * x - sum of x)^2 over the entries, exact; null where it leaves a long.

    A vector that is null, empty or holds a null or non-finite entry takes no part, nor does one of
    another length than that of the smallest id (of vectors without an id: the shortest length).
    Components without variance cannot be whitened and give no rows: equal vectors, one vector
    alone and an empty table have an empty result. Repeated rows and null ids are rows like others;
    other columns are not read.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    some = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    some = some.where(_sound(F.col("vector")))
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    sizes = some.agg(F.min_by(F.size("vector"), F.col("id")).alias("a"), F.min(F.size("vector")).alias("b")).first()
    size = sizes["a"] or sizes["b"] or 0
    some = some.where(F.size("vector") == size)
    n, sums, squares = _sums(some.select("vector"), size, scale) if size else (0, [], [])
    scatter = [[n * squares[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    found = components(spark, scatter, many)
    trace = sum(scatter[i][i] for i in range(size))
    ways = np.array([v for _, v in found]).reshape(len(found), size)
    # square roots of the eigenvalues of the scatter, n times those of the covariance; huge ones scaled down
    cut = max(0, trace.bit_length() - 900) // 2
    roots = np.array([math.sqrt(share) * math.sqrt(trace >> 2 * cut) for share, _ in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(_matrix(batch.column(1)), scale)
            most = int(abs(x).max()) * n + max(map(abs, sums))
            exact = x.astype(object) if most >= 1 << 62 else x
            apart = exact * n - np.array(sums, exact.dtype)
            if size * most * most >= 1 << 62:
                squared = [int(v) for v in (apart.astype(object) ** 2).sum(1)]
            else:
                squared = (apart**2).sum(1).tolist()
            places = (apart >> cut if cut else apart).astype(np.float64) @ ways.T / roots
            columns = [
                batch.column(0),
                pa.array([v if v < 1 << 63 else None for v in squared], pa.int64()),
                pa.array(list(places), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    if not found:
        empty = T.StructType(schema.fields[:2])
        table = spark.createDataFrame([], empty)
        return table.select(
            F.col("id").alias(id_col),
            F.lit(None).cast("int").alias("component"),
            F.lit(None).cast("bigint").alias("n"),
            "deviation",
            *[F.lit(None).cast("double").alias(c) for c in ("whitened", "explained", "identity_error")],
        )
    table = settled(some.mapInArrow(run, schema), "whitened")
    pairs = [(i, j) for i in range(len(found)) for j in range(i, len(found))]
    entry = lambda i: F.get("whitened", F.lit(i))
    errors = [F.abs(F.covar_pop(entry(i), entry(j)) - float(i == j)) for i, j in pairs]
    error = max(table.agg(*[e.alias(f"e{k}") for k, e in enumerate(errors)]).first())
    shares = F.array(*[F.lit(share) for share, _ in found])
    return table.select("id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
