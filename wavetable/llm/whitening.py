"""Whitening of vectors by a QDWH spectral divide and conquer of their covariance.

Entries count as ``floor(scale * entry)``, so sums are exact. The statistics are those of the distinct vectors, each once, however
often a vector is repeated; distinct vectors and sums combine map-side, and the covariance (vectors centred before they are
multiplied) is summed entry by entry in Spark. Only sums and covariance, of the size of one vector and of its square, reach
the driver.

There the covariance is split: the polar factor of the covariance less a shift, by QR-based dynamically weighted Halley steps, is
its matrix sign, from which the projector onto the eigenvectors above the shift follows; orthonormal bases of its range and
kernel turn the matrix into two smaller ones, which are split alike until single components are left. The components, width
times their number, are broadcast, and every vector is projected in the task that holds it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored
from .negatives import whole_numbers

EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, its matrix sign where no eigenvalue is zero."""
    n = len(a)
    norm = np.linalg.norm(a)
    x, low, eye = a / norm, 1e-17, np.eye(n)          # ``low`` bounds the singular values of x from below
    for _ in range(12):
        l2 = low * low
        g = (4 * (1 - l2) / (l2 * l2)) ** (1 / 3)
        root = np.sqrt(1 + g)
        wa = root + np.sqrt(max(8 - 4 * g + 8 * (2 - l2) / (l2 * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.concatenate([np.sqrt(wc) * x, eye]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * l2) / (1 + wc * l2), 1.0)
        done = low > 1 - 1e-15 and np.linalg.norm(new - x) <= 4 * EPS ** (1 / 3) * np.sqrt(n)
        x = new
        if done:
            break
    return x


def _bases(projector: np.ndarray, rank: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range and the kernel of a projector of that rank, by two steps of subspace iteration."""
    q = np.linalg.qr(projector @ rng.normal(size=(len(projector), rank)), mode="complete")[0]
    q = np.linalg.qr(projector @ q[:, :rank], mode="complete")[0]
    return q[:, :rank], q[:, rank:]


def _split(a: np.ndarray, norm: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces; None where all eigenvalues are equal to rounding.

    The shift is the median of the diagonal or, should that lie at an end of the spectrum or upon an eigenvalue, the mean of the
    eigenvalues, then points between the mean and the ends of the diagonal.
    """
    n = len(a)
    diagonal = np.diag(a)
    mean = float(np.trace(a)) / n
    if np.linalg.norm(a - mean * np.eye(n)) <= EPS * norm:
        return None
    best, least = None, np.inf
    ends = (float(diagonal.min()), float(diagonal.max()))
    for shift in (float(np.median(diagonal)), mean, *[mean + (e - mean) * f for f in (.25, .0625, .5) for e in ends]):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < n:
            continue
        one, two = _bases(projector, rank, rng)
        left = np.linalg.norm(two.T @ a @ one)
        if left < least:
            best, least = (one, two), left
        if left <= 8 * EPS * norm * np.sqrt(n):
            break
    return best


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    norm, rng = float(np.linalg.norm(a)), np.random.default_rng(1)
    found, todo = [], [(a, np.eye(len(a)))]
    while todo:
        part, basis = todo.pop()
        pair = _split(part, norm, rng) if len(part) > 1 and norm else None
        if pair is None:
            found += [basis[:, i] for i in range(basis.shape[1])]
            continue
        for v in pair:
            small = v.T @ part @ v
            todo.append(((small + small.T) / 2, basis @ v))
    v = np.array(found).T.reshape(len(a), len(a))
    v = _polish(a, _polish(a, v))
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _polish(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One step of iterative refinement of eigenvectors that are right to about half of the digits or more."""
    s, r = v.T @ a @ v, np.eye(len(a)) - v.T @ v
    e = np.diag(s) / (1 - np.diag(r))
    tied = 2 * (np.linalg.norm(s - np.diag(e)) + np.linalg.norm(a) * np.linalg.norm(r)) + EPS * np.linalg.norm(a)
    gap = e[None, :] - e[:, None]
    apart = np.abs(gap) > tied
    step = np.where(apart, (s + r * e[None, :]) / np.where(apart, gap, 1), r / 2)
    v = v + v @ step
    return v / np.linalg.norm(v, axis=0)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dims)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (…, x) of one length of vectors each; empty vectors are left out."""
    for batch in batches:
        size = pc.binary_length(batch.column("x")).to_numpy(zero_copy_only=False) // 8
        for dims in np.unique(size[size > 0]).tolist():
            yield dims, batch.take(pa.array(np.flatnonzero(size == dims)))


def sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of vectors their number and their exact sums; one row of the width of a vector for each length is collected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = {}, defaultdict(int)
        for dims, batch in _by_length(batches):
            x = _matrix(batch.column("x"), dims)
            bound = float(np.abs(x).max()) * len(x) + float(np.abs(total.get(dims, np.zeros(1))).max())
            if bound >= 2.0 ** 62:
                raise OverflowError("sums need more than 62 bits")
            total[dims] = total.get(dims, 0) + x.sum(0)
            count[dims] += len(x)
        for dims, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dims, dims), pa.int32()), pa.array(np.arange(dims), pa.int32()),
                                              pa.array(np.full(dims, count[dims]), pa.int64()), pa.array(s)], names=["dims", "i", "n", "s"])

    parts = fit.select("x").mapInArrow(work, "dims int, i int, n long, s long")
    rows = parts.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict = {}
    for r in rows:
        n, s = out.setdefault(r["dims"], (r["n"], np.zeros(r["dims"], np.int64)))
        s[r["i"]] = r["s"]
    return out


def _scatter(fit: DataFrame, width: dict[int, int], centred) -> dict[int, np.ndarray]:
    """For each length of vectors the sum of y y' over ``y = centred(dims, x)`` rows; the square of the width is collected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for dims, batch in _by_length(batches):
            if width[dims]:
                y = centred(dims, _matrix(batch.column("x"), dims))
                total[dims] = total.get(dims, 0) + y.T @ y
        for dims, s in total.items():
            k = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, dims), pa.int32()), pa.array(np.arange(k), pa.int32()),
                                              pa.array(list(s), pa.list_(pa.float64()))], names=["dims", "i", "row"])

    parts = fit.select("x").mapInArrow(work, "dims int, i int, row array<double>").select("dims", "i", F.posexplode("row").alias("j", "v"))
    out = {dims: np.zeros((k, k)) for dims, k in width.items()}
    for r in parts.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["dims"]][r["i"], r["j"]] = r["v"]
    return out


def whiten(vectors: DataFrame, count: int | None = None, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays, component by component), identity_error; one row per usable row.

    ``count`` is the largest number of components, all if None. Components whose eigenvalue is zero to rounding are left out, so the
    arrays may be shorter, and empty where all vectors are equal. Rows whose vector is null, or holds a null or a component that is
    not finite, are dropped. Vectors of different lengths are fitted apart; empty ones have n, a deviation of 0 and empty arrays.
    Equal eigenvalues have any basis of their space. Ids are only carried: nulls and repeats are rows of their own. An empty table
    gives no rows. Other columns are ignored. Whole numbers beyond 62 bits raise an error.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = vectors.where(F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    kind = source.schema["vec_id"].dataType.simpleString()

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False))).tolist()
            x = whole_numbers(batch.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                                             names=["vec_id", "x"])

    rows = stored(source.mapInArrow(scaled, f"vec_id {kind}, x binary"), "whitening-rows")
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    total = sums(fit)
    width = {dims: dims for dims in total}
    means = {dims: s / n for dims, (n, s) in total.items()}
    scatter = _scatter(fit, width, lambda dims, x: x - means[dims])
    model = {}
    for dims, (n, s) in total.items():
        v = scatter[dims] / n
        e, u = components(v)
        top = max(float(e[0]), 0.0) if dims else 0.0
        keep = np.flatnonzero(e > 8 * dims * EPS * top)[:count]
        model[dims] = (n, s, u[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(v) if len(keep) else e[keep])
    number = {dims: m[2].shape[1] for dims, m in model.items()}
    white = lambda dims, x: (x - means[dims]) @ model[dims][2]
    errors = _identity_errors(fit, {d: m[0] for d, m in model.items()}, number, white)
    empty = rows.where(F.length("x") == 0).limit(1).count()         # all empty vectors are one distinct vector
    out_type = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids, n, deviation, y, explained, error):
            k = y.shape[1]
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(a).ravel()))
            return pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(y), n), pa.int64()), pa.array(deviation), lists(y),
                                               lists(np.tile(explained, (len(y), 1))), pa.array(np.full(len(y), error))],
                                              names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])
        for batch in batches:
            void = batch.filter(pc.equal(pc.binary_length(batch.column("x")), 0))
            if void.num_rows:
                yield made(void.column("vec_id"), empty, np.zeros(void.num_rows, np.int64), np.zeros((void.num_rows, 0)), np.zeros(0), 0.0)
            for dims, part in _by_length([batch]):
                n, s, _, explained = model[dims]
                x = _matrix(part.column("x"), dims)
                yield made(part.column("vec_id"), n, _deviation(x, n, s), white(dims, x), explained, errors[dims])

    return rows.mapInArrow(project, out_type)


def _deviation(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Exact sums of (n x - s) squared."""
    far = float(np.abs(x).max()) * n + float(np.abs(s).max())
    if far >= 2.0 ** 62 or far * far * x.shape[1] >= 2.0 ** 63:
        exact = ((x.astype(object) * n - s.astype(object)) ** 2).sum(1)
        if max(exact) >= 1 << 63:
            raise OverflowError("deviations need more than 63 bits")
        return exact.astype(np.int64)
    return ((x * n - s) ** 2).sum(1)


def _identity_errors(fit: DataFrame, n: dict[int, int], width: dict[int, int], white) -> dict[int, float]:
    """For each length the largest absolute entry of the covariance of the whitened vectors less the identity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for dims, batch in _by_length(batches):
            total[dims] = total.get(dims, 0) + white(dims, _matrix(batch.column("x"), dims)).sum(0)
        for dims, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), dims), pa.int32()), pa.array(np.arange(len(s)), pa.int32()), pa.array(s)],
                                             names=["dims", "i", "s"])

    centre = {dims: np.zeros(k) for dims, k in width.items()}
    for r in fit.select("x").mapInArrow(work, "dims int, i int, s double").groupBy("dims", "i").agg(F.sum("s").alias("s")).collect():
        centre[r["dims"]][r["i"]] = r["s"] / n[r["dims"]]
    scatter = _scatter(fit, width, lambda dims, x: white(dims, x) - centre[dims])
    return {dims: float(np.abs(s / n[dims] - np.eye(len(s))).max()) if len(s) else 0.0 for dims, s in scatter.items()}
