"""Whitening of embeddings from the exact characteristic polynomial of their scatter.

Entries are made whole numbers (floor(scale * c)). Tasks add up whole products of
their rows; the sums over all rows give the scatter M = n * sum(x x') - S S', a
matrix of whole numbers as wide as a vector, that is n^2 times the covariance. A
constant added to all entries changes nothing in it.

M's characteristic polynomial is found modulo 31-bit primes: each is a row of a
Spark table, whose tasks bring M to Hessenberg form and expand its determinant;
Chinese remaindering joins the remainders (one prime more than the coefficients'
bound needs checks them). All roots are real, so the sign changes of the
polynomial moved to a place count the roots above it exactly; this isolates the
kth root, and signs at halved steps refine it to ``BITS`` bits. Inverse iteration
in ``DIGITS`` decimal digits on M - root then gives the null vector. Components
are found in tasks of their own, one row each.

Only M, the remainders and the components pass through the driver; their size
depends on the vectors' width alone.

Defined results: null vectors and those with null or non-finite entries take no
part and are not returned; null ids, repeated rows and repeated ids stay rows of
their own; vectors shorter than the longest are as if filled with 0; roots that
agree to ``BITS`` bits are one root with several components, an orthonormal basis
of which is chosen by fixed starts; a component's largest entry (the first of
equals) is positive; components without variance (a root of 0) cannot be whitened
and are not returned, so equal vectors, a single one or an empty table give no
rows; entries beyond 2^62 after scaling raise an error; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = 64
COMPONENTS = 32
#: Bits of a root, reckoned from the trace down.
BITS = 320
DIGITS = 110
#: Primes reduced together in a task.
PRIMES = 32
#: Rows worked on at a time.
ROWS = 4_096
LIMB = 20
PART = 40


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors without null and non-finite entries, as doubles."""
    v = F.transform(df[vec_col], lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(df[id_col].alias("id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)


def whole(col: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """Rows of floor(scale * c), filled up with 0 to the longest of them or ``width``."""
    size = np.diff(col.offsets.to_numpy())
    x = np.floor(col.flatten().to_numpy(zero_copy_only=False) * float(scale))
    if len(x) and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry has over 62 bits after scaling")
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x.astype(np.int64)
    return out


def products(y: np.ndarray) -> np.ndarray:
    """Exact y' y as Python integers: in doubles where no sum can pass 2^53, else by limbs of 20 bits."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    limbs, rest = [], y
    while len(limbs) < 3:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


@dataclass
class Scatter:
    n: int
    sums: list[int]
    m: list[list[int]]  # n * sum(x x') - S S'

    @property
    def trace(self) -> int:
        return sum(self.m[i][i] for i in range(len(self.m)))


def scatter(rows: DataFrame, scale: int) -> Scatter:
    """Whole sums over all rows (id, v): one number for each pair of dimensions comes to the driver."""
    names = ["i", "j", *[f"p{k}" for k in range(4)]]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = whole(batch.column(0).slice(at, ROWS), scale, len(s))
                old = len(s)
                if y.shape[1] > old:
                    s = np.append(s, np.zeros(y.shape[1] - old, object))
                    g, small = np.zeros((len(s), len(s)), object), g
                    g[:old, :old] = small
                n, g, s = n + len(y), g + products(y), s + y.astype(object).sum(0)
        i, j = np.triu_indices(len(s))
        values = [*g[i, j], *s, n]
        i, j = np.concatenate([i, np.arange(len(s)), [-1]]), np.concatenate([j, np.full(len(s), -1), [-1]])
        low = (1 << PART) - 1
        parts = [pa.array([int(v) >> PART * k & low if k < 3 else int(v) >> PART * 3 for v in values], pa.int64()) for k in range(4)]
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts], names=names)

    # parts of 40 bits leave room for the sums of millions of tasks
    kind = "i int, j int, " + ", ".join(f"p{k} long" for k in range(4))
    sums = rows.select("v").mapInArrow(partial, kind).groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in names[2:]]).collect()
    value = {(r["i"], r["j"]): sum(r[f"p{k}"] << PART * k for k in range(4)) for r in sums}
    n = value.get((-1, -1), 0)
    d = 1 + max((i for i, _ in value), default=-1)
    s = [value.get((i, -1), 0) for i in range(d)]
    return Scatter(n, s, [[n * value.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)])


def primes_below(top: int) -> Iterator[int]:
    """Primes under ``top`` (at most 2^31), falling."""
    small = [p for p in range(2, isqrt(1 << 31) + 1) if all(p % q for q in range(2, isqrt(p) + 1))]
    for x in range(top - 1, 1, -1):
        if all(x % p for p in small if p * p <= x):
            yield x


def power(a: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a ** e mod p, each under 2^31."""
    out = np.ones_like(a)
    while e.any():
        out = np.where(e & 1, out * a % p, out)
        a, e = a * a % p, e >> 1
    return out


def polynomials_mod(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (lowest first) of det(t I - m) mod p for a stack of matrices (primes x d x d)."""
    a, d, q = m.copy(), m.shape[1], p[:, None]
    each = np.arange(len(p))
    for k in range(d - 2):
        # the first row under the diagonal with an entry in column k moves up, with its column
        pivot = k + 1 + (a[:, k + 1 :, k] != 0).argmax(1)
        rows = a[each, pivot].copy()
        a[each, pivot], a[:, k + 1] = a[:, k + 1].copy(), rows
        cols = a[each, :, pivot].copy()
        a[each, :, pivot], a[:, :, k + 1] = a[:, :, k + 1].copy(), cols
        u = a[:, k + 2 :, k] * power(a[:, k + 1, k], p - 2, p)[:, None] % q
        a[:, k + 2 :] = (a[:, k + 2 :] - u[:, :, None] * a[:, k + 1, None] % q[:, None]) % q[:, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * u[:, None] % q[:, None]).sum(2)) % q
    # leading minors: the kth polynomial from those before it
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = poly[k - 1, :, :-1]
        down = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            new = (new - (a[:, i, k - 1] * down % p)[:, None] * poly[i] % q) % q
            if i:
                down = down * a[:, i, i - 1] % p
        poly[k] = new
    return poly[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Coefficients (lowest first) of det(t I - m), exact, for a matrix without negative roots."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    # the sum of all products of k roots is at most C(d, k) (trace / d)^k
    most = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes, size = [], 1
    source = primes_below(1 << 31)
    while size <= 2 * most:
        primes.append(next(source))
        size *= primes[-1]
    check = next(source)
    shared = spark.sparkContext.broadcast(m)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.array(shared.value, object)
        for batch in batches:
            for at in range(0, batch.num_rows, PRIMES):
                p = batch.column(0).slice(at, PRIMES).to_numpy()
                c = polynomials_mod((entries[None] % p.astype(object)[:, None, None]).astype(np.int64), p)
                yield pa.record_batch([pa.array(p), pa.array(c.tolist(), pa.list_(pa.int64()))], names=["p", "c"])

    table = spark.createDataFrame([(p,) for p in [*primes, check]], "p long")
    tasks = min(-(-len(primes) // PRIMES), max(2, spark.sparkContext.defaultParallelism))
    found = {r["p"]: r["c"] for r in table.repartition(tasks).mapInArrow(reduced, "p long, c array<long>").collect()}
    total = [0] * (d + 1)
    for p in primes:
        rest = size // p
        rest *= pow(rest, -1, p)
        for k, c in enumerate(found[p]):
            total[k] += c * rest
    out = [x % size for x in total]
    out = [x - size if 2 * x > size else x for x in out]
    if [x % check for x in out] != list(found[check]):
        raise ArithmeticError("the characteristic polynomial fails its check")
    return out


def roots_above(c: list[int], t: int) -> int:
    """How many roots of a polynomial with real roots only are over t: sign changes after a move by t."""
    c = list(c)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign_at(c: list[int], t: int) -> int:
    v = 0
    for x in reversed(c):
        v = v * t + x
    return (v > 0) - (v < 0)


def kth_root(c: list[int], k: int, top: int) -> tuple[int, int, int]:
    """(r, first, count): the kth greatest root is in (r - 1, r]; it is one of ``count`` roots there, of which the first is the ``first`` greatest.

    ``c`` has real roots over 0 and up to ``top`` only.
    """
    lo, hi, n_lo, n_hi = 0, top, len(c) - 1, 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if n_lo - n_hi == 1:
            # a single root: it lies where the sign changes
            at, end = sign_at(c, mid), sign_at(c, hi)
            if end == 0:
                lo = hi - 1
            elif at == 0:
                lo, hi = mid - 1, mid
            elif at == end:
                hi = mid
            else:
                lo = mid
            continue
        n = roots_above(c, mid)
        if n >= k:
            lo, n_lo = mid, n
        else:
            hi, n_hi = mid, n
    return hi, n_hi + 1, n_lo - n_hi


def null_vectors(m: list[list[int]], root: Decimal, unit: Decimal, count: int) -> list[list[float]]:
    """Orthonormal vectors of the ``count`` roots of m at ``root``: inverse iteration on (m - root) / unit."""
    d = len(m)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        a = np.array([[(Decimal(m[i][j]) - (root if i == j else 0)) / unit for j in range(d)] for i in range(d)], object)
        order, least = list(range(d)), Decimal(10) ** (10 - DIGITS)
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i, k]))
            if best != k:
                a[[k, best]] = a[[best, k]]
                order[k], order[best] = order[best], order[k]
            if abs(a[k, k]) < least:
                a[k, k] = least
            f = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k] = f
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - f[:, None] * a[k, k + 1 :][None]
        basis: list[np.ndarray] = []
        for nth in range(count):
            # fixed starts without a pattern
            x = np.array([Decimal((i + 1) * (7919 + 104729 * nth) * 2654435761 % 1000003 - 500001) for i in range(d)], object)
            for _ in range(3):
                x = x[order]
                for k in range(d):
                    x[k + 1 :] = x[k + 1 :] - a[k + 1 :, k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] = x[k] / a[k, k]
                    x[:k] = x[:k] - a[:k, k] * x[k]
                for _ in range(2):
                    for b in basis:
                        x = x - b * (b * x).sum()
                    x = x / max(abs(v) for v in x)
                    x = x / (x * x).sum().sqrt()
            basis.append(x)
        out = []
        for x in basis:
            big = max(range(d), key=lambda i: (abs(x[i]).quantize(Decimal(10) ** -12), -i))
            out.append([float(v if x[big] > 0 else -v) for v in x])
        return out


def components(spark: SparkSession, s: Scatter, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors as columns, roots of M, shares of the trace) of the greatest roots over 0."""
    c = characteristic_polynomial(spark, s.m)
    zero = next(k for k, x in enumerate(c) if x)
    c = c[zero:]
    d, trace = len(s.m), s.trace
    bits = max(0, BITS - trace.bit_length())
    # of 2^bits times the roots
    scaled = [x << bits * (len(c) - 1 - k) for k, x in enumerate(c)]
    shared = spark.sparkContext.broadcast((s.m, scaled, trace, bits))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, scaled, trace, bits = shared.value
            for k in batch.column(0).to_pylist():
                r, first, count = kth_root(scaled, k, trace << bits)
                with localcontext() as ctx:
                    ctx.prec = DIGITS
                    root = Decimal(r) / Decimal(1 << bits)
                    share = root / trace
                v = null_vectors(m, root, Decimal(trace), count)[k - first]
                yield pa.record_batch([pa.array([k]), pa.array([v], pa.list_(pa.float64())), pa.array([float(root)]), pa.array([float(share)])], names=["k", "v", "root", "share"])

    n = min(most, len(c) - 1)
    if not n:
        return np.zeros((d, 0)), np.zeros(0), np.zeros(0)
    found = sorted(spark.range(1, n + 1, 1, min(n, max(2, spark.sparkContext.defaultParallelism))).mapInArrow(one, "k long, v array<double>, root double, share double").collect())
    return np.array([r["v"] for r in found]).T, np.array([r["root"] for r in found]), np.array([r["share"] for r in found])


def centred(y: np.ndarray, s: Scatter) -> np.ndarray:
    """n * y - S, exact: as int64 where it and the sum of its squares fit, else as Python integers."""
    most = s.n * int(np.abs(y).max(initial=0)) + max((abs(x) for x in s.sums), default=0)
    kind = np.int64 if most * most * max(1, y.shape[1]) < 1 << 63 else object
    return y.astype(kind) * s.n - np.array(s.sums, kind)


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component; deviation is a decimal."""
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, id_col, vec_col)
    kind = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    s = scatter(rows, scale)
    if not s.trace:
        return spark.createDataFrame([], kind).withColumnRenamed("id", id_col)
    v, root, share = components(spark, s, most)
    k = len(root)
    # M is n^2 times the covariance, and centred rows are n times theirs
    shared = spark.sparkContext.broadcast((s, v / np.sqrt(root)))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, axes = shared.value
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = centred(whole(batch.column(0).slice(at, ROWS), scale, len(facts.sums)), facts).astype(np.float64) @ axes
                first, second = first + w.sum(0), second + w.T @ w
        i, j = np.triu_indices(k)
        i, j, x = np.append(i, np.arange(k)), np.append(j, np.full(k, -1)), np.append(second[i, j], first)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(x)], names=["i", "j", "x"])

    sums = {(r["i"], r["j"]): r["x"] / s.n for r in rows.select("v").mapInArrow(moments, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}
    error = max(abs(x - sums[i, -1] * sums[j, -1] - (i == j)) for (i, j), x in sums.items() if j >= 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, axes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = centred(whole(part.column(1), scale, len(facts.sums)), facts)
                w = z.astype(np.float64) @ axes
                far = (z * z).sum(1)
                far = pa.array(far).cast(pa.decimal128(38, 0)) if far.dtype == np.int64 else pa.array([Decimal(int(x)) for x in far], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(z)), k))
                total = len(z) * k
                out = [part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(z))), pa.array(np.full(total, facts.n, np.int64)), far.take(each), pa.array(w.ravel()), pa.array(np.tile(share, len(z))), pa.array(np.full(total, error))]
                yield pa.record_batch(out, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, kind).withColumnRenamed("id", id_col)
