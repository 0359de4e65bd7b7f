"""Whitening of embeddings by spectral divide-and-conquer on polar decompositions (QDWH).

Spark sums the moments of the distinct vectors, first n and the sums, then products of centred vectors. The
covariance, a square of the dimension, is split on the driver: the polar factor of the covariance less a shift has
eigenvalues 1 above the shift and -1 below, so half of it plus the identity projects on the upper invariant
subspace; its basis and the complement's give two smaller problems. Pieces of the highest eigenvalues are split on
until each is one component. A map of a few columns is then broadcast and applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsrisk.llm.common import kept, ship
from tsrisk.session import stage, unstage

SCALE = 256
#: Numbers that a step of a task holds at a time.
CELLS = 1 << 20

#: What a row of the result has beside the id.
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"

_EPS = np.finfo(float).eps
_I64 = np.iinfo(np.int64)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps in QR form."""
    m = len(a)
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.eye(m)
    x = a / scale
    try:  # a lower bound of the least singular value; it only steers the weights
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = _EPS
    low = min(max(low, _EPS / 8), 1.0)
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        alpha = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(m)]))
        following = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:m] @ q[m:].T)
        following = (following + following.T) / 2
        moved = np.linalg.norm(following - x)
        x, low = following, min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
        if moved < 1e-8 and 1 - low < 1e-8:  # steps converge with the third power
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if all eigenvalues are equal."""
    m = len(a)
    middle = np.trace(a) / m
    spread = np.linalg.norm(a - middle * np.eye(m))
    if spread <= 4 * m * _EPS * np.linalg.norm(a):
        return None
    start = np.random.default_rng(m).standard_normal((m, m))
    best = None
    # The mean always separates; the median halves the work, and the others step aside when a shift meets an eigenvalue.
    for shift in (np.median(np.diag(a)), middle, *(middle + spread / np.sqrt(m) * s for s in (0.03, -0.07, 0.13, -0.19))):
        projector = (polar(a - shift * np.eye(m)) + np.eye(m)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < m:
            continue
        basis = np.linalg.qr(projector @ start[:, :rank])[0]
        both = np.linalg.qr(projector @ basis, mode="complete")[0]
        upper, lower = both[:, :rank], both[:, rank:]
        off = np.linalg.norm(lower.T @ a @ upper)
        if best is None or off < best[0]:
            best = off, upper, lower
        if off <= 8 * m * _EPS * np.linalg.norm(a):
            break
    return best[1:] if best else None


def leading(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` highest eigenvalues, falling, and their unit eigenvectors as columns with a positive largest entry."""
    d = len(covariance)
    whole = (covariance + covariance.T) / 2
    waiting = [(whole, np.eye(d))] if d else []
    found: list[tuple[float, np.ndarray]] = []
    while waiting and len(found) < k:
        a, basis = waiting.pop()
        parts = split(a) if len(a) > 1 else None
        if parts is None:  # one component, or any basis of equal ones
            for column in basis.T:
                unit = column / np.linalg.norm(column)
                found.append((float(unit @ whole @ unit), unit))
            continue
        for own in reversed(parts):
            inner = own.T @ a @ own
            waiting.append(((inner + inner.T) / 2, basis @ own))
    found = sorted(found, key=lambda f: -f[0])[:k]
    values = np.array([e for e, _ in found])
    vectors = np.array([v * np.sign(v[np.argmax(np.abs(v))]) for _, v in found]).reshape(len(found), d).T
    return values, vectors


def _whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c * SCALE).cast("long"))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _by_length(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, row numbers and whole vectors in parts of bounded size."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    flat = batch.column(column).flatten().to_numpy()
    at = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, CELLS // size)
        for a in range(0, len(rows), step):
            own = rows[a : a + step]
            yield size, own, flat[at[own][:, None] + np.arange(size)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they suffice, else in Python's integers."""
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(deviations: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact, at most the largest 64-bit number."""
    if deviations.dtype != object and float(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1] < 2.0**62:
        return (deviations * deviations).sum(axis=1).tolist()
    return [min(sum(v * v for v in row), int(_I64.max)) for row in deviations.tolist()]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for size, _, x in _by_length(batch):
            n, sums = held.get(size, (0, np.zeros(size, dtype=object)))
            high, low = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            held[size] = n + len(x), sums + high * 2**32 + low
    rows = [(size, n, i, Decimal(int(s))) for size, (n, sums) in held.items() for i, s in enumerate(sums)]
    size, n, i, s = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(size, pa.int32()), pa.array(n, pa.int64()), pa.array(i, pa.int32()), pa.array(s, pa.decimal128(38, 0))],
        names=["size", "n", "i", "s"],
    )


def _fit_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums of each dimension, by length."""
    parts = fit.mapInArrow(_sums, "size int, n long, i int, s decimal(38,0)")
    rows = parts.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("size", "i").collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _products(fit: DataFrame, maps: dict) -> dict[int, np.ndarray]:
    """Sums of products of what `maps` makes of the vectors, by length: a square of the number of its columns."""
    shared = fit.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _by_length(batch):
                n, sums, columns = shared.value[size]
                z = _centred(x, n, sums)
                z = z if columns is None else np.column_stack([np.ones(len(z)), z @ columns])
                held[size] = held.get(size, 0) + z.T @ z
        for size, m in held.items():
            for i, row in enumerate(m):  # a batch a row, so that no array of the square is built twice
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([size] * len(row), pa.int32()), pa.array([i] * len(row), pa.int32()),
                        pa.array(range(len(row)), pa.int32()), pa.array(row, pa.float64()),
                    ],
                    names=["size", "i", "j", "v"],
                )

    parts = fit.mapInArrow(run, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.toLocalIterator():
        n, sums, columns = maps[r["size"]]
        width = len(sums) if columns is None else columns.shape[1] + 1
        out.setdefault(r["size"], np.zeros((width, width)))[r["i"], r["j"]] = r["v"]
    return out


def whiten(rows: DataFrame, components: int = 4, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error`, a row for each vector and component.

    Vectors that are null, empty, or hold null or non-finite entries take no part. Entries become x = floor(256 * entry);
    beyond 64 bits the nearest such number. The fit is over the distinct x vectors, those
    of each length for themselves; n is their number. `deviation` is the exact sum of (n * x - S)^2, at most
    the largest long. There are as many components as the vectors have entries, `components` at most. A component without
    variance, as all are if there is one distinct vector, has a null `whitened`, and null `explained` if there is no
    variance at all. Of equal eigenvalues any basis is taken, the same for all rows. Repeated rows and
    null ids give rows each, an empty table an empty result; other columns play no part. The driver holds one square of
    the dimension for each length, tasks get `components` columns of it.
    """
    ship(rows)
    spark = rows.sparkSession
    selected, names, fields, named = kept(rows, [key])
    used = rows.select(*selected, F.col(vector).cast("array<double>").alias("x")).filter(_usable(F.col("x")))
    whole = used.select(*names, _whole(F.col("x")).alias("x"))
    fit = stage(whole.select("x").distinct(), "wh-fit")
    moments = _fit_sums(fit)
    covariances = _products(fit, {size: (n, sums, None) for size, (n, sums) in moments.items()})
    maps, explained = {}, {}
    for size, (n, sums) in moments.items():
        values, vectors = leading(covariances[size] / n, components)
        total = float(np.trace(covariances[size] / n))
        some = values > 4 * size * _EPS * max(total, 0.0)
        maps[size] = n, sums, vectors[:, some] / np.sqrt(values[some])
        explained[size] = [float(e) / total if total > 0 else None for e in values]
    errors = {}
    for size, m in _products(fit, maps).items():
        n, mean = moments[size][0], m[0, 1:] / moments[size][0]
        off = m[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean))
        errors[size] = float(np.abs(off).max()) if len(mean) else None
    unstage(fit)
    out = T.StructType.fromDDL(OUT)
    columns_out = [*names, *out.names]
    shared = spark.sparkContext.broadcast((maps, explained, errors))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, explained, errors = shared.value
        for batch in batches:
            for size, at, x in _by_length(batch):
                n, sums, columns = maps[size]
                deviation = _squares(_deviations(x, n, sums))
                white = _centred(x, n, sums) @ columns
                own = batch.column(0).take(pa.array(at))
                for c, share in enumerate(explained[size]):
                    value = pa.array(white[:, c]) if c < columns.shape[1] else pa.nulls(len(at), pa.float64())
                    same = [pa.array([v] * len(at), t) for v, t in ((c + 1, pa.int32()), (n, pa.int64()))]
                    last = [pa.array([v] * len(at), pa.float64()) for v in (share, errors[size])]
                    yield pa.RecordBatch.from_arrays(
                        [own, *same, pa.array(deviation, pa.int64()), value, *last], names=columns_out
                    )

    return whole.mapInArrow(run, T.StructType([*fields, *out])).select(*named, *out.names)

