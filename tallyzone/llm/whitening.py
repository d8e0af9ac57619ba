"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Entries are put on a grid, x = floor(64 c) + 1000000, and the fit list is
each distinct x vector once. With n of them and sums S, centred rows are
(n x - S) / n, the numerator exact.

1. The grid vectors are packed into the fewest bytes that hold them and made
   distinct by one shuffle, so a vector that a third of all rows share
   leaves a map task once. n and S are exact integer sums.
2. Blocks of centred rows are reduced to triangular factors R by QR, the
   factors of a partition to one, and the factors of ``FAN_IN`` partitions
   to one, until one d x d factor is left for the driver: V = R'R / n.
3. Householder reflections make R bidiagonal, R = P B Q'. The dqds
   transform, with shifts that never pass the least eigenvalue, gives the
   singular values of B to high relative accuracy.
4. Twisted factorisations of B'B - s**2 I give each right singular vector of
   B directly; near-equal values are made orthogonal in turn, from another
   twist or, if none will do, by inverse iteration. Q turns them back.
5. The covariance of the whitened fit list is summed in one more pass and
   compared with the identity.

The driver and the broadcast hold d x d numbers at any size.

Defined results: rows whose vector is null, holds a null or non-finite entry,
or has another length than the commonest (ties: the longer) are left out, as
are empty vectors and those with an entry of 2**46 or more in size, whose grid
point a double doesn't hold; components whose eigenvalue is zero to rounding
have no whitened value and are left out, so one distinct vector, or none, gives
no rows; repeated rows are each returned; a deviation that a long can't hold is
null; vectors of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, ship, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 46)
FAN_IN = 16
BLOCK_ROWS = 4096
EPS = float(np.finfo(float).eps)
#: Twists tried for a vector before inverse iteration.
TWISTS = 4


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # falling, as many as there are components
    directions: np.ndarray   # d x components, unit columns
    trace: float


# --- grid vectors ---------------------------------------------------------------

def grid(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and their floor(64 c) as integers."""
    lengths = np.array([-1 if v is None else v for v in vectors.value_lengths().to_pylist()], np.int64)
    fits = lengths == dim
    flat = vectors.filter(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    whole = (np.abs(flat) < LARGEST).all(axis=1)  # nulls have become NaN
    fits[np.flatnonzero(fits)[~whole]] = False
    return fits, np.floor(flat[whole] * SCALE).astype(np.int64)


def pack(rows: np.ndarray) -> list[bytes]:
    """Integer rows in the narrowest type each fits, so equal rows are equal bytes."""
    size = np.abs(rows).max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(rows)
    kind = np.select([size < 1 << 7, size < 1 << 15, size < 1 << 31], [1, 2, 4], 8)
    for width in (1, 2, 4, 8):
        at = np.flatnonzero(kind == width)
        if len(at):
            data = rows[at].astype(f"<i{width}").tobytes()
            step = width * rows.shape[1]
            for j, i in enumerate(at.tolist()):
                out[i] = data[j * step:(j + 1) * step]
    return out


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    """The rows of :func:`pack`."""
    out = np.empty((len(packed), dim), np.int64)
    widths = np.fromiter(map(len, packed), np.int64, len(packed)) // dim
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        out[at] = np.frombuffer(b"".join(packed[i] for i in at.tolist()), f"<i{width}").reshape(-1, dim)
    return out


def _packed_blocks(batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            yield unpack(batch.column("x").slice(a, BLOCK_ROWS).to_pylist(), dim)


def offsets(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S of integer rows, exact: in long where that holds it, else in Python's integers."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def deviations(rows: np.ndarray) -> list[int | None]:
    """Sums of squares of integer rows, exact; None beyond a long."""
    if rows.dtype != object and int(np.abs(rows).max(initial=0)) ** 2 * rows.shape[1] < 1 << 62:
        return (rows * rows).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) * int(v) for v in row) for row in rows)]


# --- the small solver -------------------------------------------------------------

def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor Q of r = P B Q' by Householder reflections."""
    a, m = r.copy(), r.shape[1]
    q = np.eye(m)

    def reflector(x):
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += math.copysign(norm, x[0])
        return v / np.linalg.norm(v)

    for k in range(m):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < m - 2 and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), q


def dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform of the squared bidiagonal (q, e) less ``shift``; also the inverse's trace. None below zero."""
    d, new_q, new_e, inverse = q[0] - shift, [], [], 0.0
    for i in range(len(e)):
        if d < 0:
            return None
        head = d + e[i]
        if head == 0:  # an exact zero stays and parts the matrix
            new_q.append(0.0)
            new_e.append(0.0)
            inverse = math.inf
            d = q[i + 1] - shift
            continue
        t = q[i + 1] / head
        inverse += 1 / d if d else math.inf
        new_q.append(head)
        new_e.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return None
    return [*new_q, d], new_e, inverse + (1 / d if d else math.inf)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Squares of the singular values of an unreduced bidiagonal, falling.

    The trace of the inverse bounds the least eigenvalue from below, so the
    shifts (Newton's, from below) never pass it and rounding can only ask
    for a smaller one.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, total = [], 0.0
    shift = 0.0
    while q:
        if len(q) == 1:
            found.append(q.pop() + total)
            break
        if e[-1] <= EPS * EPS * (total + q[-1]) / 4:
            found.append(q.pop() + total)
            e.pop()
            shift = 0.0
            continue
        step = dqds(q, e, shift)
        while step is None:
            shift = shift / 2 if shift > EPS * (total + q[-1]) else 0.0
            step = dqds(q, e, shift)
        q, e, inverse = step
        total += shift
        shift = (1 - 4 * EPS) / inverse if inverse and math.isfinite(inverse) else 0.0
        if total + shift == total:
            shift = 0.0
    return sorted(found, reverse=True)


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float, skip: list[int]) -> tuple[np.ndarray, int]:
    """An eigenvector of B'B for the eigenvalue ``square`` from the twist with the least pivot not in ``skip``."""
    m = len(diagonal)
    d = [float(x) ** 2 for x in diagonal]
    low = [float(b) / float(a) for a, b in zip(diagonal, above)]
    tiny = EPS * EPS * max(max(d), square, 1e-300)
    s, plus = [-square], []
    for i in range(m - 1):
        pivot = s[i] + d[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        plus.append(d[i] * low[i] / pivot)
        s.append(plus[i] * low[i] * s[i] - square)
    p, minus = [0.0] * m, [0.0] * (m - 1)
    p[-1] = d[-1] - square
    for i in range(m - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        t = d[i] / pivot
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - square
    at = min((i for i in range(m) if i not in skip), key=lambda i: abs(s[i] + p[i] + square))
    z = np.zeros(m)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(at, m - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z), at


def _apart(vector: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """A unit vector less its parts along ``others``, made a unit vector again, and how much was left."""
    for _ in range(2):
        for o in others:
            vector = vector - (o @ vector) * o
    norm = float(np.linalg.norm(vector))
    return vector / (norm or 1.0), norm


def _inverse_iteration(diagonal: np.ndarray, above: np.ndarray, square: float, at: int, size: int,
                       others: list[np.ndarray]) -> np.ndarray:
    """Where no twist tells equal values' vectors apart: inverse iteration beside the vectors found."""
    b = np.diag(diagonal) + np.diag(above, 1)
    shifted = b.T @ b - square * (1 + 4 * EPS) * np.eye(len(diagonal))
    full = np.zeros(size)
    full[at:at + len(diagonal)] = np.random.default_rng(len(others)).normal(size=len(diagonal))
    for _ in range(4):
        full, _ = _apart(full / np.linalg.norm(full), others)
        full[at:at + len(diagonal)] = np.linalg.lstsq(shifted, full[at:at + len(diagonal)], rcond=1e-300)[0]
    return _apart(full / np.linalg.norm(full), others)[0]


def right_vectors(diagonal: np.ndarray, above: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of a bidiagonal, and its right singular vectors as columns."""
    m = len(diagonal)
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((m, 0))
    # below rounding of B itself; keeps quotients finite where R is singular
    diagonal = np.where(np.abs(diagonal) < size * EPS * EPS, size * EPS * EPS, diagonal)
    cut = [0, *(np.flatnonzero(np.abs(above) <= EPS * EPS * size) + 1).tolist(), m]
    pairs = []
    for a, b in zip(cut, cut[1:]):
        for square in squared_singular_values(diagonal[a:b], above[a:b - 1]):
            pairs.append((square, a, b))
    pairs.sort(key=lambda p: (-p[0], p[1]))
    pairs = [p for p in pairs[:most] if p[0] > (m * EPS * size) ** 2]
    columns: list[np.ndarray] = []
    for j, (square, a, b) in enumerate(pairs):
        near = [i for i in range(j) if pairs[i][1] == a and pairs[i][0] - square < 1e-3 * pairs[i][0]]
        skip: list[int] = []
        norm = 0.0
        while norm < 0.1 and len(skip) < min(b - a, TWISTS):
            full = np.zeros(m)
            full[a:b], at = twisted(diagonal[a:b], above[a:b - 1], square, skip)
            full, norm = _apart(full, [columns[i] for i in near])
            skip.append(at)  # the same vector as another value's: try another twist
        if norm < 0.1:
            full = _inverse_iteration(diagonal[a:b], above[a:b - 1], square, a, m, [columns[i] for i in near])
        columns.append(full)
    return np.array([p[0] for p in pairs]), np.array(columns).T.reshape(m, len(pairs))


def solved(r: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
    """The whitening of a triangular factor of n centred rows."""
    diagonal, above, q = bidiagonalised(r)
    squares, z = right_vectors(diagonal, above, components)
    vectors = q @ z
    vectors /= np.linalg.norm(vectors, axis=0, keepdims=True) if vectors.size else 1.0
    return Whitening(n, sums, squares / n, vectors, float((r * r).sum()) / n)


# --- Spark ------------------------------------------------------------------------

def _vectors(table: DataFrame, vector: str) -> DataFrame:
    return table.select(F.col(vector).cast("array<double>").alias("v"))


def common_length(table: DataFrame, vector: str = "embedding") -> int:
    """The commonest length of a vector; 0 without any."""
    length = F.size(F.col(vector))
    top = (table.where(length > 0).groupBy(length.alias("d")).agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return top[0]["d"] if top else 0


def fit_list(table: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Each distinct grid vector once, packed: ``x``; stored."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                _, rows = grid(batch.column("v").slice(a, BLOCK_ROWS), dim)
                yield pa.record_batch({"x": pa.array(pack(rows), pa.binary())})

    return stored(mapped(_vectors(table, vector), run, "x binary").distinct(), "fit-list")


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of fit vectors and the exact sums of their entries, without the shift of the grid."""
    def run(batches):
        n, sums = 0, [0] * dim
        for rows in _packed_blocks(batches, dim):
            n += len(rows)
            exact = rows if int(np.abs(rows).max(initial=0)) < 1 << 50 else rows.astype(object)
            sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0))]
        yield pa.record_batch({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(s) for s in sums]])})

    parts = mapped(fit, run, "n long, sums array<string>")
    got = (parts.select("n", F.posexplode("sums").alias("d", "s")).groupBy("d")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    by_dim = {r["d"]: (r["n"], int(r["s"])) for r in got}
    return (by_dim[0][0] if by_dim else 0), [by_dim[d][1] if by_dim else 0 for d in range(dim)]


def _reduced(blocks: Iterable[np.ndarray], dim: int) -> np.ndarray:
    """The triangular factor of stacked blocks."""
    r = np.zeros((0, dim))
    for block in blocks:
        r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def triangular(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred fit list, dim x dim, combined ``FAN_IN`` factors at a time."""
    schema = "part int, r binary"

    def row(part, r):
        return pa.record_batch({"part": pa.array([part], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def run(batches):
        centred = (offsets(rows, n, sums).astype(float) / n for rows in _packed_blocks(batches, dim))
        r = _reduced(centred, dim)
        if len(r):
            yield row(TaskContext.get().partitionId(), r)

    def combine(table: pa.Table) -> pa.Table:
        blocks = sorted(table.column("r").to_pylist())
        r = _reduced((np.frombuffer(b).reshape(-1, dim) for b in blocks), dim)
        return pa.Table.from_batches([row(table.column("part")[0].as_py() // FAN_IN, r)])

    ship(fit.sparkSession)
    factors = stored(mapped(fit, run, schema), "factors")
    left = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while left > FAN_IN:
        factors = stored(factors.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(combine, schema), "factors")
        left = -(-left // FAN_IN)
    last = sorted(factors.collect())  # FAN_IN factors at most
    r = _reduced((np.frombuffer(f["r"]).reshape(-1, dim) for f in last), dim)
    return np.vstack([r, np.zeros((dim - len(r), dim))])


def fitted(fit: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None for an empty one."""
    n, sums = totals(fit, dim)
    return solved(triangular(fit, dim, n, sums), n, sums, components) if n else None


def whitened(rows: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, and the whitened values, of integer rows."""
    apart = offsets(rows, model.n, model.sums)
    return apart, (apart.astype(float) / model.n) @ (model.directions / np.sqrt(model.eigenvalues))


def identity_error(fit: DataFrame, dim: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over all its rows."""
    shared, m = fit.sparkSession.sparkContext.broadcast(model), len(model.eigenvalues)

    def run(batches):
        sums, products = np.zeros(m), np.zeros((m, m))
        for rows in _packed_blocks(batches, dim):
            w = whitened(rows, shared.value)[1]
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.record_batch({"values": pa.array([[*sums.tolist(), *products.ravel().tolist()]])})

    got = (mapped(fit, run, "values array<double>").select(F.posexplode("values").alias("i", "v"))
           .groupBy("i").agg(F.sum("v").alias("v")).collect())
    values = np.zeros(m + m * m)
    for r in got:
        values[r["i"]] = r["v"]
    mean = values[:m] / model.n
    cov = values[m:].reshape(m, m) / model.n - np.outer(mean, mean)  # of centred rows: the mean is rounding
    return float(np.abs(cov - np.eye(m)).max())


OUT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id`` and one row per component of every row that takes part (module docstring)."""
    kind = table.schema[id].dataType.simpleString()
    schema = f"id {kind}, {OUT}"
    dim = common_length(table, vector)
    fit = fit_list(table, dim, vector) if dim else None
    model = fitted(fit, dim, components) if dim else None
    if model is None or not len(model.eigenvalues):
        return table.sparkSession.createDataFrame([], schema)
    error, m = identity_error(fit, dim, model), len(model.eigenvalues)
    shared = table.sparkSession.sparkContext.broadcast((model, error))

    def run(batches):
        own, wrong = shared.value
        explained = own.eigenvalues / own.trace
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                fits, rows = grid(part.column("v"), dim)
                k = len(rows)
                if not k:
                    continue
                apart, w = whitened(rows, own)
                ids = part.column("id").filter(pa.array(fits))
                each = pa.array(np.repeat(np.arange(k), m))
                yield pa.record_batch({
                    "id": ids.take(each), "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    "n": pa.array(np.full(k * m, own.n, np.int64)),
                    "deviation": pa.array(deviations(apart), pa.int64()).take(each), "whitened": pa.array(w.ravel()),
                    "explained": pa.array(np.tile(explained, k)), "identity_error": pa.array(np.full(k * m, wrong))})

    return mapped(table.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")), run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened values of every embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
