"""Hard negatives by slot-decomposed selection.

Scores are inner products of whole numbers, exact at every size. Anchors are held against all rows in a grid of packed blocks: a
cell is one block of anchors and one of rows, so a task holds two blocks and one tile of scores, and every block is copied
once per block of the other side.

1. Cells look at rows of the anchor's own label only and keep its first ``positives`` rows; a window keeps the first of all cells.
2. A positive of score p admits negatives from ``lower * p / 100`` to ``upper * p / 100``. The upper limits of an anchor cut the scores
   into disjoint slots. Cells look at rows of other labels and keep the first ``negatives`` rows of each slot, a window (cut
   short before its shuffle) keeps the first of all cells.
3. The slots of an anchor in falling order, at most ``positives * negatives`` rows, answer all of its overlapping windows: a
   window begins at the slot of its own upper limit and takes the first ``negatives`` rows of the suffix that reach its lower limit.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import stored

ROW_BYTES, ANCHOR_BYTES = 32 << 20, 8 << 20      # packed bytes of a block
TILE = 1 << 21                                    # scores held at once
CELLS = 20_000                                    # tasks at most; cells beyond that share tasks


def usable(embedding: str, label: str) -> Column:
    """True where the label and all components are there and finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(embedding).isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_numbers(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * component) as 64-bit integers."""
    x = np.floor(flat.astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= 2.0 ** 62:
        raise OverflowError("a scaled component needs more than 62 bits")
    return x.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integer type that holds them."""
    peak = int(np.abs(x).max()) if x.size else 0
    return x.astype(next(t for t, top in ((np.int8, 127), (np.int16, 32767), (np.int32, 2 ** 31 - 1), (np.int64, 2 ** 63 - 1)) if peak <= top))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of ``a`` with rows of ``b``, in the cheapest type that is exact."""
    bound = a.shape[1] * (int(np.abs(a.astype(np.int64)).max()) if a.size else 0) * (int(np.abs(b.astype(np.int64)).max()) if b.size else 0)
    if bound >= 1 << 63:
        raise OverflowError("inner products need more than 63 bits")
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return a.astype(kind) @ b.astype(kind).T


def first(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of every group by falling score, then rising place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    begin = np.ones(len(g), bool)
    begin[1:] = g[1:] != g[:-1]
    start = np.flatnonzero(begin)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def _blocks(rows: DataFrame, limit: int, scale: float, id_type: str) -> DataFrame:
    """Blocks of a partition of (uid, id, label, v, ups): rows sorted by label, one length of vectors each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        held, size = defaultdict(list), defaultdict(int)

        def flush(dims: int) -> pa.RecordBatch:
            t = pa.concat_tables(held.pop(dims)).combine_chunks()
            size.pop(dims)
            rank = np.empty(len(t), np.int32)
            rank[pc.sort_indices(t, [("id", "ascending"), ("uid", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(t))
            t = t.append_column("rank", pa.array(rank)).sort_by([("label", "ascending"), ("rank", "ascending")]).combine_chunks()
            runs = t.column("label").combine_chunks().dictionary_encode()
            codes = runs.indices.to_numpy()
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            x = narrow(np.frombuffer(b"".join(t.column("x").to_pylist()), np.int64).reshape(len(t), dims))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            whole = lambda c: one(t.column(c).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([dims], pa.int32()), pa.array([str(x.dtype)]), pa.array([x.tobytes()], pa.binary()),
                 whole("uid"), whole("id"), whole("rank"), one(t.column("label").combine_chunks().take(pa.array(starts))),
                 one(pa.array(np.append(starts, len(t)), pa.int32())), whole("ups")],
                names=["part", "dims", "dtype", "x", "uids", "ids", "ranks", "labels", "starts", "ups"])

        for batch in batches:
            lens = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for dims in np.unique(lens).tolist():
                b = batch.take(pa.array(np.flatnonzero(lens == dims)))
                x = whole_numbers(b.column("v").flatten().to_numpy(zero_copy_only=False), scale).reshape(b.num_rows, dims)
                packed = pa.array([r.tobytes() for r in x], pa.binary())
                held[dims].append(pa.table({**{c: b.column(c) for c in ("uid", "id", "label", "ups")}, "x": packed}))
                size[dims] += b.num_rows * max(dims, 1) * narrow(x).itemsize
                if size[dims] >= limit:
                    yield flush(dims)
        for dims in list(held):
            yield flush(dims)

    return rows.select("uid", "id", "label", "v", "ups").mapInArrow(
        pack, f"part int, dims int, dtype string, x binary, uids array<long>, ids array<{id_type}>, ranks array<int>, "
              "labels array<string>, starts array<int>, ups array<array<long>>")


class _Block:
    """One side of a cell, unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str):
        get = lambda c: batch.column(batch.schema.get_field_index(f"{side}_{c}"))[i]
        self.dims = batch.column(batch.schema.get_field_index("dims"))[i].as_py()
        self.uids, self.ids, self.ranks = get("uids").values.to_numpy(), get("ids").values, get("ranks").values.to_numpy()
        self.x = np.frombuffer(get("x").as_py(), get("dtype").as_py()).reshape(len(self.uids), self.dims)
        self.labels, starts = get("labels").as_py(), get("starts").as_py()
        self.spans = {name: (a, b) for name, a, b in zip(self.labels, starts, starts[1:])}
        self.ups = get("ups").values


def _cells(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows of the same length of vectors."""
    n_a, n_r = (int(df.agg(F.coalesce(F.max("part"), F.lit(-1)) + 1).first()[0]) for df in (anchors, rows))
    named = lambda df, side: df.select("dims", "part", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("dims", "part")])
    left = named(anchors, "a").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(max(n_r - 1, 0))))).withColumnRenamed("part", "a")
    right = named(rows, "r").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(max(n_a - 1, 0))))).withColumnRenamed("part", "r")
    tasks = min(max(n_a * n_r, 1), CELLS)         # given, so that cells of few bytes and much work are not put together
    return left.repartition(tasks, "a", "r", "dims").join(right.repartition(tasks, "a", "r", "dims"), ["a", "r", "dims"])


def _tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    wide = min(len(b), 8192) or 1
    high = max(TILE // wide, 1)
    for i in range(0, len(a), high):
        for j in range(0, len(b), wide):
            yield slice(i, min(i + high, len(a))), slice(j, min(j + wide, len(b))), products(a[i:i + high], b[j:j + wide])


def _positives(cells: DataFrame, k: int, id_type: str) -> DataFrame:
    """(anchor, id, score): the first ``k`` other rows of the anchor's label in every cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, r = _Block(batch, i, "a"), _Block(batch, i, "r")
                own = dict(zip(r.uids.tolist(), range(len(r.uids))))
                for name, (a0, a1) in a.spans.items():
                    if name not in r.spans:
                        continue
                    r0, r1 = r.spans[name]
                    at, row, score = (np.zeros(0, np.int64) for _ in range(3))
                    for si, sj, s in _tiles(a.x[a0:a1], r.x[r0:r1]):
                        for m in range(s.shape[0]):                          # the anchor itself is no positive
                            j = own.get(int(a.uids[a0 + si.start + m]), -1) - r0 - sj.start
                            if 0 <= j < s.shape[1]:
                                s[m, j] = np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf
                        if s.shape[1] > k:
                            keep = s >= np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k:s.shape[1] - k + 1]
                        else:
                            keep = np.ones(s.shape, bool)
                        keep &= s > (np.iinfo(np.int64).min if s.dtype == np.int64 else -np.inf)
                        m, j = np.nonzero(keep)
                        at = np.concatenate([at, m + si.start + a0])
                        row = np.concatenate([row, j + sj.start + r0])
                        score = np.concatenate([score, s[m, j].astype(np.int64)])
                        best = first(at, score, r.ranks[row], k)
                        at, row, score = at[best], row[best], score[best]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(a.uids[at]), r.ids.take(pa.array(row)), pa.array(score)], names=["anchor", "id", "score"])

    return cells.mapInArrow(work, f"anchor long, id {id_type}, score long")


def _negatives(cells: DataFrame, k: int, low: int, high: int, id_type: str) -> DataFrame:
    """(anchor, slot, id, score): the first ``k`` rows of other labels in every slot of an anchor, cell by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, r = _Block(batch, i, "a"), _Block(batch, i, "r")
                limits, floors = _slots(a.ups.to_pylist(), low, high)
                code = {name: c for c, name in enumerate({*a.labels, *r.labels})}
                spread = lambda b: np.repeat([code[x] for x in b.labels], [e - s for s, e in b.spans.values()]).astype(np.int64)
                la, lr = spread(a), spread(r)
                at, slot, row, score = (np.zeros(0, np.int64) for _ in range(4))
                for si, sj, s in _tiles(a.x, r.x):
                    if len(a.labels) == 1 and a.labels == r.labels:
                        continue
                    m, j = np.nonzero((s >= floors[si, None]) & (s <= limits[si, :1]) & (la[si, None] != lr[None, sj]))
                    if not len(m):
                        continue
                    new = s[m, j].astype(np.int64)
                    m, j = m + si.start, j + sj.start
                    at, row, score = np.concatenate([at, m]), np.concatenate([row, j]), np.concatenate([score, new])
                    slot = np.concatenate([slot, (limits[m] >= new[:, None]).sum(1) - 1])
                    best = first(at * limits.shape[1] + slot, score, r.ranks[row], k)
                    at, slot, row, score = at[best], slot[best], row[best], score[best]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(a.uids[at]), pa.array(slot, pa.int32()), r.ids.take(pa.array(row)), pa.array(score)],
                                                     names=["anchor", "slot", "id", "score"])

    return cells.mapInArrow(work, f"anchor long, slot int, id {id_type}, score long")


def _slots(scores: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor the distinct upper limits in falling order (filled up below any score) and the least lower limit."""
    tops = [sorted({high * p // 100 for p in row}, reverse=True) for row in scores]
    width = max((len(t) for t in tops), default=1) or 1
    limits = np.full((len(tops), width), np.iinfo(np.int64).min, np.int64)
    for i, t in enumerate(tops):
        limits[i, :len(t)] = t
    return limits, np.array([min(-(-low * p // 100) for p in row) for row in scores], np.int64)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: float = 256.0,
         row_bytes: int = ROW_BYTES, anchor_bytes: int = ANCHOR_BYTES,
         vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; ``anchor`` says which rows are anchors.

    Components count as ``floor(scale * component)``. Rows whose label, vector or any component is null, or that hold a component that
    is not finite, take no part. Vectors are compared within one length; empty ones have a score of 0. Ties go to the smaller id, null
    ids last. Repeated ids are rows of their own, and an anchor is its row: another row with its id may be its positive. A row whose
    ``anchor`` is null is none. Limits of a negative positive score allow nothing. An anchor without positives or a window
    without negatives gives no rows; so does an empty table. Other columns are ignored. Products beyond 63 bits raise an error.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    number = vectors.schema[embedding].dataType.elementType.simpleString()
    rows = vectors.where(usable(embedding, label)).select(
        F.monotonically_increasing_id().alias("uid"), F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<float>" if number == "float" else "array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.array().cast("array<long>").alias("ups"))
    id_type = rows.schema["id"].dataType.simpleString()
    rows = stored(rows, "negatives-rows")
    wide = F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1)).cast("long")), F.lit(0))
    (size,), (size_a,) = rows.agg(wide).first(), rows.where("anchor").agg(wide).first()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(2 * size / row_bytes))      # about two bytes a component
    parts_a = max(1, math.ceil(2 * size_a / anchor_bytes))
    blocks = stored(_blocks(rows.repartition(parts), row_bytes, scale, id_type), "negatives-blocks")
    asked = stored(_blocks(rows.where("anchor").repartition(parts_a), anchor_bytes, scale, id_type), "negatives-anchors")
    falling = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    near = _positives(_cells(asked, blocks), positives, id_type)
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy(*falling))).where(F.col("k") <= positives)
    near = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("found"))      # ``positives`` at most
    near = stored(near, "negatives-positives")
    near = near.withColumnRenamed("anchor", "uid")
    scored = near.select("uid", F.transform("found", lambda p: p["score"]).alias("ups"))
    limited = stored(_blocks(rows.where("anchor").drop("ups").join(scored, "uid").repartition(parts_a), anchor_bytes, scale, id_type), "negatives-limits")
    far = _negatives(_cells(limited, blocks), negatives, lower, upper, id_type)
    far = far.withColumn("k", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*falling))).where(F.col("k") <= negatives)
    far = far.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "k", "id", "score"))).alias("falling"))  # positives * negatives
    names = rows.where("anchor").select("uid", F.col("id").alias("anchor_id"))
    both = names.join(near, "uid").join(far.withColumnRenamed("anchor", "uid"), "uid")
    both = both.withColumn("tops", F.array_distinct(F.transform("found", lambda p: _floor_percent(p["score"], upper))))
    each = both.select("anchor_id", "falling", "tops", F.explode("found").alias("p"))
    slot = F.array_position("tops", _floor_percent(F.col("p.score"), upper)) - 1
    suffix = F.slice(F.filter("falling", lambda x: x["slot"] >= slot), 1, negatives)
    kept = F.filter(suffix, lambda x: x["score"] >= -_floor_percent(F.col("p.score"), -lower))
    return each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(kept).alias("i", "x")).select(
        "anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score",
        F.col("x.score").alias("negative_score"))


def _floor_percent(score: Column, percent: int) -> Column:
    """floor(percent * score / 100) in whole numbers; no product is larger than the larger of score and result."""
    hundred = F.lit(100).cast("long")
    rest = F.pmod(score, hundred)
    whole = lambda x: F.call_function("div", x - F.pmod(x, hundred), hundred)
    return whole(score) * F.lit(percent).cast("long") + whole(rest * F.lit(percent).cast("long"))
