"""Near-duplicate vectors by hashing to E8 lattice cells.

Each table projects unit vectors to two orthonormal random blocks of eight dimensions, scales and shifts them, and decodes each
block to the nearest point of the E8 lattice; the two points are the cell. A vector is filed in its own cell of every
table and looks into it and into the ``probes`` neighbouring cells (one step to a nearest lattice neighbour in either block)
that lie closest. Pairs found are verified by the cosine in double precision. Equal vectors of a label are one node, so a
very common vector is filed once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ready, stored

BLOCKS = 2
#: Length of a projected unit vector, in units in which lattice points lie sqrt(2) apart: at a cosine of 0.98 vectors are 0.6 apart.
RADIUS = 3.0


def scale_of(dims: int) -> float:
    """Scale at which the projection of a random unit vector of ``dims`` entries is ``RADIUS`` long, whatever their number."""
    return RADIUS * (max(dims, 8 * BLOCKS) / (8 * BLOCKS)) ** 0.5


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    half = [np.array(v) for v in itertools.product((0.5, -0.5), repeat=8) if np.prod(v) > 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    rows = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(1)
    near[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the better of an even integer point and one shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def cells(unit: np.ndarray, table: int, probes: int, scale: float | None, seed: int) -> np.ndarray:
    """(rows, 1 + probes) keys: the own cell first, then the closest neighbouring ones. Without a ``scale`` it follows the dimension."""
    scale = scale_of(unit.shape[1]) if scale is None else scale
    rng = np.random.default_rng([seed, table, unit.shape[1]])
    width = 8 * BLOCKS
    wide = max(unit.shape[1], width)
    basis = np.linalg.qr(rng.normal(size=(wide, width)))[0][:unit.shape[1]]
    shift = rng.uniform(0, 1, width)
    odd = rng.integers(1, 1 << 62, width) * 2 + 1
    step = neighbours()
    x = unit @ basis * scale + shift
    home = np.concatenate([decode(x[:, 8 * k:8 * k + 8]) for k in range(BLOCKS)], 1)
    gain = np.concatenate([(x - home)[:, 8 * k:8 * k + 8] @ step.T for k in range(BLOCKS)], 1)
    best = np.argsort(-gain, 1, kind="stable")[:, :probes]
    with np.errstate(over="ignore"):
        own = ((2 * home).astype(np.int64) * odd).sum(1)
        moves = np.concatenate([((2 * step).astype(np.int64) * odd[8 * k:8 * k + 8]).sum(1) for k in range(BLOCKS)])
        return np.concatenate([own[:, None], own[:, None] + moves[best]], 1)


def link(vectors: DataFrame, threshold: float = 0.98, tables: int = 8, probes: int = 8, scale: float | None = None, seed: int = 3,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept; one row per row.

    Compared within a label and a length of vectors. Vectors or labels that are null, vectors that are zero, empty or
    hold null or non-finite values link with nothing. Rows with a null id have a null component and are kept. Repeated
    ids are rows of their own. Other columns are ignored.
    """
    ready(vectors.sparkSession, 2000)
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"),
                            F.col(embedding).cast("array<double>").alias("v"))
    kind = source.schema["vec_id"].dataType.simpleString()
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull() \
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = source.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # -0.0 equals 0.0, so it is hashed as such
    digest = F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))).cast("binary"))
    rows = stored(rows.withColumn("same", F.when(F.col("ok"), digest)), "lattice-rows")
    good = rows.where("ok").groupBy("label", "same").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v"))
    good = stored(good, "lattice-nodes")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            for n in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == n)))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                unit = x / np.abs(x).max(1, keepdims=True)          # no overflow in the norm
                unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
                for t in range(tables):
                    keys = cells(unit, t, probes, scale, seed)
                    rows_, width = keys.shape
                    at = pa.array(np.repeat(np.arange(rows_), width))
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(at), part.column(1).take(at), pa.array(np.full(len(at), t), pa.int32()),
                        pa.array(np.full(len(at), n), pa.int32()), pa.array(keys.ravel(), pa.int64()),
                        pa.array(np.tile(np.arange(width) == 0, rows_))], names=["node", "label", "t", "dims", "cell", "home"])

    filed = good.select("node", "label", "v").mapInArrow(
        file, f"node {kind}, label string, t int, dims int, cell long, home boolean")
    filed = stored(filed, "lattice-cells")
    key = ["label", "t", "dims", "cell"]
    own = filed.where("home").select(*key, F.col("node").alias("a"))
    look = filed.select(*key, F.col("node").alias("b"))
    pairs = own.join(look, key).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sized = good.select("node", "v", "copies")
    both = pairs.join(sized.toDF("a", "x", "na"), "a").join(sized.toDF("b", "y", "nb"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = int(np.diff(batch.column(2).offsets.to_numpy())[0])
            same = np.all(np.diff(batch.column(2).offsets.to_numpy()) == n) and np.all(np.diff(batch.column(3).offsets.to_numpy()) == n)
            if same:
                x = batch.column(2).flatten().to_numpy().reshape(-1, n)
                y = batch.column(3).flatten().to_numpy().reshape(-1, n)
                cosine = _cosine(x, y)
            else:
                cosine = np.array([_cosine(np.array([x.as_py()]), np.array([y.as_py()]))[0] for x, y in
                                   zip(batch.column(2), batch.column(3))])
            good_ = pa.array(np.flatnonzero(cosine >= threshold))
            yield batch.select(["a", "b", "na", "nb"]).take(good_)

    links = stored(both.select("a", "b", "x", "y", "na", "nb").mapInArrow(verify, f"a {kind}, b {kind}, na long, nb long")
                   .select("a", "b", "na", "nb"), "lattice-links")
    joined = components(links, name="lattice-graph")
    degree = links.select(F.col("a").alias("node"), F.col("nb").alias("n")).unionByName(
        links.select(F.col("b").alias("node"), F.col("na").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    classes = good.select("label", "same", "node", "copies").join(degree, "node", "left").join(joined, "node", "left").select(
        "label", "same", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "label", "same").join(classes, ["label", "same"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape != y.shape:
        return np.full(len(x), -1.0)
    x = x / np.abs(x).max(1, keepdims=True)
    y = y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
