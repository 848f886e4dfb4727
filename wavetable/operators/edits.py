"""Hand edits of labels: a smooth curve through edited points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import kernels
from .blocks import BLK, BLOCK_FRAMES, OWN, Carry, Key, Running, each_group, explode_range, keys, scan, with_halo
from .resample import clip01

BLOCK_KNOTS = 512
HALO_KNOTS = 64


def edit_curves(points: DataFrame, *, series: Key = "series_id", block: int = BLOCK_FRAMES,
                block_knots: int = BLOCK_KNOTS) -> DataFrame:
    """Polynomial pieces of the not-a-knot spline through the edited points of each series.

    The system of a spline couples neighbours only, with rows dominated at least two to one by the
    diagonal, so the influence of a knot halves with every knot between. Blocks of knots with a halo
    of 64 on each side therefore give the spline of the whole series to the last bit of a double.
    """
    by = keys(series)
    p = points.groupBy(*by, "frame_idx").agg(clip01(F.max("value")).alias("value"))
    p = scan(p, [Running("_k", F.lit(1)), Carry("_next", F.col("frame_idx"), ahead=True, inclusive=False)],
             series=series, block=block)
    p = p.withColumn("_k", F.col("_k") - 1).withColumn("_end", F.col("_next").isNull()).drop("_next")
    p = with_halo(p, HALO_KNOTS, HALO_KNOTS + 1, order="_k", block=block_knots)
    schema = T.StructType([p.schema[c] for c in by])
    for name in ("i0", "i1"):
        schema = schema.add(name, T.LongType())
    for name in ("c0", "c1", "c2", "c3"):
        schema = schema.add(name, T.DoubleType())

    def fit(t):
        import numpy as np
        import pyarrow as pa
        x, y = t["frame_idx"].to_numpy().astype(float), t["value"].to_numpy()
        pieces = kernels.edit_pieces(x, y, t["_k"][0].as_py() == 0, t["_end"][t.num_rows - 1].as_py())
        own = np.flatnonzero((t[OWN].to_numpy() == t[BLK].to_numpy())[:len(pieces)])
        made = list(zip(*[pieces[k] for k in own])) or [[]] * 6
        columns = [t[c].take(pa.array(np.zeros(len(own), np.int64))).combine_chunks() for c in by]
        kinds = [pa.int64()] * 2 + [pa.float64()] * 4
        return pa.Table.from_arrays([*columns, *[pa.array(v, k) for v, k in zip(made, kinds)]], names=schema.fieldNames())

    return each_group(p, [*by, BLK], fit, schema, order="_k")


def edit_labels(lengths: DataFrame, points: DataFrame, base: DataFrame | None = None, *, series: Key = "series_id",
                block: int = BLOCK_FRAMES, block_knots: int = BLOCK_KNOTS) -> DataFrame:
    """Labels of ``n`` frames per series after edits (frame_idx, value).

    Without base labels one point gives a constant and more give the curve, extrapolated. With base
    labels, padded with their last value, the curve replaces only the frames between the first and
    last edit. Two or three points give a line or parabola.
    """
    by = keys(series)
    grid = explode_range(lengths.select(*by, "n").where(F.col("n") > 0), F.lit(0), F.col("n") - 1, "frame_idx",
                         rebalance=True)
    grid = grid.withColumn("frame_idx", F.col("frame_idx").cast("int")).drop("n")
    if base is None:
        out = grid.withColumn("pos", F.lit(0.0))
    else:
        known = grid.join(base.select(*by, "frame_idx", F.col("pos").cast("double").alias("_b")), [*by, "frame_idx"], "left")
        out = scan(known, [Carry("pos", F.col("_b"), F.col("_b").isNotNull())], series=series, block=block)
        out = out.withColumn("pos", F.coalesce("pos", F.lit(0.0))).select(*by, "frame_idx", "pos")
    pieces = edit_curves(points, series=series, block=block, block_knots=block_knots)
    ends = points.groupBy(*by).agg(F.min("frame_idx").alias("_a"), F.max("frame_idx").alias("_z"))
    pieces = pieces.join(ends, by).join(lengths.select(*by, "n"), by)
    whole = F.lit(base is None)
    end = F.col("i1") == F.col("_z")
    lo = F.when((F.col("i0") == F.col("_a")) & whole, F.lit(0)).otherwise(F.col("i0"))
    hi = F.when(end & whole, F.col("n") - 1).when(end, F.col("i1")).otherwise(F.col("i1") - 1)
    curve = explode_range(pieces, lo, F.least(hi, F.col("n") - 1), "frame_idx")
    t = F.col("frame_idx") - F.col("i0")
    value = F.col("c0") + t * (F.col("c1") + t * (F.col("c2") + t * F.col("c3")))
    curve = curve.select(*by, F.col("frame_idx").cast("int").alias("frame_idx"), value.alias("_v"))
    out = out.join(curve, [*by, "frame_idx"], "left")
    return out.select(*by, "frame_idx", clip01(F.coalesce("_v", "pos")).alias("pos"))
