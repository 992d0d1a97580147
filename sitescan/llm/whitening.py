"""Whitening of embeddings on their first principal components, from an exact scatter matrix of whole numbers.

Entries become whole numbers (floor(scale * entry)); each distinct vector counts once. With n vectors x, sums S and y = x less the rounded mean,
G = n * sum(y y') - sum(y) sum(y)' is n^2 times their covariance, without rounding. Its characteristic polynomial is found modulo many primes, one
Spark row a prime (reduction to Hessenberg form, then the recurrence of its leading minors), and put together by the Chinese
remainder theorem under a bound that holds for every positive semidefinite matrix. All its roots are real, so the variations in sign of the
polynomial moved to a point count the roots beyond that point, and bisection with whole numbers isolates the largest ones to 64 bits behind the point. Each
is the shift of an inverse iteration in long decimals, which gives a vector of the null space of G less the root.

Vectors are read, made distinct, summed and projected by Spark; the driver and each prime's task hold one dim x dim matrix of whole numbers (the size is
that of one vector squared, whatever the number of rows). Work on the matrix grows as the fourth power of the dimension.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches

#: Bits to which roots are isolated beyond the size of the matrix; digits of the decimals of the inverse iteration.
ROOT_BITS, DIGITS = 64, 60
LONG = 1 << 63


class Whitening(NamedTuple):
    """What `whitened` needs: rows of the fit list, sums, unit eigenvectors and eigenvalues of the covariance, its trace; and the largest absolute entry
    of the whitened fit list's covariance less the identity, measured on its rows."""

    n: int
    sums: list[int]
    components: list[list[float]]
    values: list[float]
    trace: float
    error: float = 0.0


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = 256, into: str = "x") -> DataFrame:
    """Rows of `df` whose vector has only finite entries, with `into`: array of floor(scale * entry). Entries beyond a long become its ends."""
    good = F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.filter(good).withColumn(into, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as whole numbers, filled up with zeros; Python's where long ones would not do."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out, ends = np.zeros((len(lengths), dim), np.int64), np.cumsum(lengths)
    for i, (stop, k) in enumerate(zip(ends, lengths, strict=True)):
        out[i, :k] = flat[stop - k : stop]
    return out


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers: by floating point where every sum stays below 2^53, else by Python's numbers."""
    if y.dtype != object:
        most = float(np.abs(y.astype(np.float64)).max(initial=0))
        if most * most * max(1, len(y)) < 2**52:
            f = y.astype(np.float64)
            return (f.T @ f).astype(np.int64)
    y = y.astype(object)
    return y.T @ y


def _sums(fit: DataFrame, dim: int, centre: list[int] | None) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums by dimension and, given a centre, the sums of products of what is left: whole numbers, added by Spark in two halves."""
    wide = centre is not None
    shift = np.array(centre or [0] * dim, dtype=object)
    small = all(abs(c) < 1 << 61 for c in shift)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in batches:
            x = _matrix(b.column(0), dim)
            if small and (not x.size or max(-int(x.min()), int(x.max())) < 1 << 61):
                y = x - shift.astype(np.int64)
            else:
                y = x.astype(object) - shift
            n += len(y)
            s = s + (y.sum(0) if y.dtype != object and np.abs(y).max(initial=0) < 1 << 40 else y.astype(object).sum(0)).astype(object)
            if wide:
                g = g + _exact_product(y).astype(object)
        cells = [(-1, -1, n), *((i, -1, int(v)) for i, v in enumerate(s)), *((i, j, int(g[i, j])) for i in range(dim) for j in range(i, dim) if wide)]
        i, j, v = zip(*cells, strict=True)
        halves = [divmod(c, 1 << 60) for c in v]
        number = pa.decimal128(38, 0)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([decimal.Decimal(h) for h, _ in halves], number), pa.array([decimal.Decimal(low) for _, low in halves], number)], ["i", "j", "high", "low"])

    got = fit.select("x").mapInArrow(partial, "i int, j int, high decimal(38,0), low decimal(38,0)").groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    n, s, g = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for r in got.collect():  # a row per cell of the matrix
        v = (int(r.high) << 60) + int(r.low)
        if r.i < 0:
            n = v
        elif r.j < 0:
            s[r.i] = v
        else:
            g[r.i][r.j] = g[r.j][r.i] = v
    return n, s, g


def _is_prime(n: int) -> bool:
    """For n below 2^32."""
    odd, k = n - 1, 0
    while odd % 2 == 0:
        odd, k = odd // 2, k + 1
    for a in (2, 3, 5, 7):
        x = pow(a, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(k - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than `bits` bits."""
    out, product, n = [], 1, 2**31 - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_modulo(g: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t - g) modulo p, the constant first: Hessenberg form by elimination with swaps, then its leading minors."""
    d = len(g)
    h = np.array([[c % p for c in row] for row in g], np.int64)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        swap = k + 1 + int(below[0])
        if swap != k + 1:
            h[[k + 1, swap]] = h[[swap, k + 1]]
            h[:, [k + 1, swap]] = h[:, [swap, k + 1]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1][None, :] % p) % p
        add = (h[:, k + 2 :] * f[None, :] % p).sum(1) % p
        h[:, k + 1] = (h[:, k + 1] + add) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = minors[m - 1, :-1]
        new = (new - int(h[m - 1, m - 1]) * minors[m - 1] % p) % p
        chain = 1
        for i in range(m - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            new = (new - chain * int(h[i - 1, m - 1]) % p * minors[i - 1] % p) % p
        minors[m] = new
    return minors[d].tolist()


def characteristic_polynomial(spark, g: list[list[int]]) -> list[int]:
    """Coefficients of det(t - g), the constant first, of a positive semidefinite matrix of whole numbers; a row and task per prime.

    Coefficients are elementary symmetric functions of eigenvalues that are not negative, so each is at most C(d, k) * (trace / d)^k."""
    d, total = len(g), sum(g[i][i] for i in range(len(g)))
    bits = max(math.comb(d, k).bit_length() + k * (max(1, -(-total // d)).bit_length()) for k in range(d + 1))
    primes = primes_beyond(bits)

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.record_batch([pa.array(ps, pa.int64()), pa.array([polynomial_modulo(g, p) for p in ps], pa.list_(pa.int64()))], ["p", "rest"])

    df = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    got = {r.p: r.rest for r in df.mapInArrow(rests, "p long, rest array<long>").collect()}
    value, modulus = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, got[p], strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def roots_beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only are greater than at / 2^bits, each as often as it comes."""
    d = len(poly) - 1
    c = [a << (bits * (d - k)) for k, a in enumerate(poly)]  # the polynomial whose roots are 2^bits as large
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], wanted: int, top: int, bits: int) -> list[tuple[int, int]]:
    """(root times 2^bits rounded down, how often) of the largest positive roots, falling, until `wanted` are had; `top` is beyond all.

    Roots that agree to all bits count as one that comes several times."""
    low_end = 0
    positive = roots_beyond(poly, 0, 0)
    out, had = [], 0
    while had < min(wanted, positive):
        # the smallest point beyond which at most `had` roots lie; first by whole bits, then by halving
        low, high, scale = low_end, top, 0
        while scale <= bits:
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if roots_beyond(poly, mid, scale) > had else (low, mid)
            if scale == bits:
                break
            step = min(32, bits - scale)
            low, high, scale = low << step, high << step, scale + step
        times = roots_beyond(poly, low, bits) - had
        out.append((low, times))
        had += times
    return out


def null_vectors(g: list[list[int]], root: decimal.Decimal, times: int) -> list[list[decimal.Decimal]]:
    """Orthonormal vectors that g - root takes to nearly nothing: inverse iteration on its triangular factors, in decimals."""
    d = len(g)
    a = [[decimal.Decimal(c) for c in row] for row in g]
    for i in range(d):
        a[i][i] -= root
    size = max(abs(c) for row in a for c in row) or decimal.Decimal(1)
    tiny = size * decimal.Decimal(10) ** (10 - DIGITS)
    order, factors = list(range(d)), []
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        for f in factors:
            f[k], f[best] = f[best], f[k]
        if abs(a[k][k]) < tiny:
            a[k][k] = tiny
        column = [decimal.Decimal(0)] * d
        head = a[k]
        for i in range(k + 1, d):
            if a[i][k]:
                f = column[i] = a[i][k] / head[k]
                row = a[i]
                for j in range(k + 1, d):
                    row[j] -= f * head[j]
        factors.append(column)

    def solved(v: list[decimal.Decimal]) -> list[decimal.Decimal]:
        b = [v[i] for i in order]
        for k, f in enumerate(factors):
            for i in range(k + 1, d):
                if f[i]:
                    b[i] -= f[i] * b[k]
        for k in range(d - 1, -1, -1):
            b[k] = (b[k] - sum((a[k][j] * b[j] for j in range(k + 1, d)), decimal.Decimal(0))) / a[k][k]
        return b

    found: list[list[decimal.Decimal]] = []
    for m in range(times):
        v = [decimal.Decimal((i + 1) * (2 * m + 1) * 7919 % 101 + 1) for i in range(d)]
        for _ in range(4):
            for _ in range(2):
                for u in found:
                    along = sum(x * y for x, y in zip(u, v, strict=True))
                    v = [y - along * x for x, y in zip(u, v, strict=True)]
                length = sum(x * x for x in v).sqrt()
                v = [x / length for x in v]
            v = solved(v)
        for _ in range(2):
            for u in found:
                along = sum(x * y for x, y in zip(u, v, strict=True))
                v = [y - along * x for x, y in zip(u, v, strict=True)]
            length = sum(x * x for x in v).sqrt()
            v = [x / length for x in v]
        found.append(v)
    return found


def fitted(rows: DataFrame, components: int = 4) -> Whitening:
    """The first components of `rows` (x: whole numbers), each distinct x once. Shorter vectors end in zeros. Components without variance are left
    out, so there may be fewer than asked for."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    small_batches(spark)
    fit = scratch.written(rows.select("x").distinct(), "whitening-fit")
    try:
        dim = fit.agg(F.max(F.size("x"))).first()[0] or 0
        if fit.filter(F.size("x") < dim).limit(1).count():  # equal only once filled up
            padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))).alias("x")
            fit = scratch.written(fit.select(padded).distinct(), "whitening-fit")
        model = _solved(fit, dim, components)
        return model._replace(error=_identity_error(fit, model))
    finally:
        scratch.drop_all_but()


def _solved(fit: DataFrame, dim: int, components: int) -> Whitening:
    if not dim:
        return Whitening(fit.count(), [], [], [], 0.0)
    n, s, _ = _sums(fit, dim, None)
    if not n:
        return Whitening(n, s, [], [], 0.0)
    centre = [(2 * c + n) // (2 * n) for c in s]
    _, rest, products = _sums(fit, dim, centre)
    g = [[n * products[i][j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    total = sum(g[i][i] for i in range(dim))
    if not total:
        return Whitening(n, s, [], [], 0.0)
    poly = characteristic_polynomial(fit.sparkSession, g)
    vectors, values = [], []
    with decimal.localcontext() as context:
        context.prec = DIGITS + total.bit_length() // 3
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        for low, times in largest_roots(poly, components, total + 1, ROOT_BITS):
            root = (decimal.Decimal(2 * low + 1) / 2) / decimal.Decimal(1 << ROOT_BITS)
            for v in null_vectors(g, root, times)[: components - len(values)]:
                vectors.append([float(c) for c in v])
                values.append(float(root / n / n))
        spread = float(decimal.Decimal(total) / n / n)
    return Whitening(n, s, vectors, values, spread)


def _projections(model: Whitening):
    """Of rows of whole numbers: coordinates on the components over the root of their variance, and the sum of (n x - S)^2."""
    dim = len(model.sums)
    mean = np.array([s / model.n for s in model.sums])
    whole = [s // model.n for s in model.sums]
    part = np.array([(s - w * model.n) / model.n for s, w in zip(model.sums, whole, strict=True)])
    small = all(abs(w) < 1 << 52 for w in whole)
    axes = np.array(model.components).reshape(-1, dim) / np.sqrt(np.array(model.values))[:, None]

    def of(column: pa.Array) -> tuple[np.ndarray, list[int | None]]:
        x = _matrix(column, dim)
        most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
        # the whole part of the mean is taken off without rounding
        centred = (x - np.array(whole, np.int64)).astype(np.float64) - part if small and most < 1 << 52 else x.astype(np.float64) - mean
        largest = model.n * most + max((abs(s) for s in model.sums), default=0)
        if largest**2 * dim < LONG:
            d = x * model.n - np.array(model.sums, np.int64)
            far = (d * d).sum(1).tolist()
        else:
            d = x.astype(object) * model.n - np.array(model.sums, dtype=object)
            far = [v if v < LONG else None for v in map(int, (d * d).sum(1))]
        return centred @ axes.T, far

    return of


def _mapped(model: Whitening, column: str) -> Column:
    kind = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    project = None

    def run(x: pa.Array) -> pa.Array:
        nonlocal project
        project = project or _projections(model)
        if not len(x):
            return pa.array([], kind)
        w, far = project(x)
        return pa.array([{"deviation": f, "whitened": v} for f, v in zip(far, w.tolist(), strict=True)], kind)

    return F.arrow_udf(run, "struct<deviation: long, whitened: array<double>>")(F.col(column))


def whitened(rows: DataFrame, model: Whitening, into: str = "whitening") -> DataFrame:
    """`rows` (x: whole numbers, ...) with `into`: deviation (null beyond a long) and the array of whitened coordinates."""
    small_batches(rows.sparkSession)
    return rows.withColumn(into, _mapped(model, "x"))


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    k = len(model.values)
    if not k:
        return 0.0
    w = whitened(fit, model, "w").select(*(F.col("w.whitened")[i].alias(f"w{i}") for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True))


def components_of(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = 4, scale: int = 256) -> DataFrame:
    """A row per remaining row and component: `ident`, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries go. Rows that repeat give rows each but count once in the fit; a null `ident` stays.
    Vectors shorter than the longest count as ending in zeros. Where fewer components than asked for have variance, only those are given: no rows for
    equal vectors, a single one, empty ones, or none. Equal eigenvalues share a space, of which some orthonormal vectors are taken.
    """
    rows = whole_numbers(df.select(F.col(ident).alias("ident"), F.col(vector).alias("vector")), "vector", scale).select("ident", "x")
    model = fitted(rows, components)
    k = len(model.values)
    w = whitened(rows if k else rows.filter(F.lit(False)), model, "w")
    explained = F.array(*(F.lit(v / model.trace) for v in model.values)).cast("array<double>")
    each = F.arrays_zip(F.col("w.whitened").alias("whitened"), explained.alias("explained"))
    out = w.select("ident", F.col("w.deviation").alias("deviation"), F.posexplode(each).alias("no", "c"))
    return out.select(
        F.col("ident").alias(ident), (F.col("no") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(model.error).alias("identity_error"),
    )
