"""Irregular control points to regular frames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels
from ..session import stored
from .blocks import (BLK, BLOCK_FRAMES, BLOCK_MS, OWN, Carry, Key, block_window, dense_index, explode_range,
                     halo_columns, keys, range_join, scan, with_halo)

MONOTONE = ("pchip", "cubic", "monotone", "monotonic")
KINDS = (*MONOTONE, "linear", "nearest")


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# ---------------------------------------------------------------- control points


def trim_edges(actions: DataFrame, ratio: float = 0.0, *, series: Key = "series_id",
               block_ms: float = BLOCK_MS) -> DataFrame:
    """Drop ``int(n * ratio)`` control points at each end, if that leaves any."""
    if ratio <= 0.0:
        return actions
    cols = actions.columns
    out = dense_index(actions, "_i", series=series, order="at_ms", ties=["ord"], block=block_ms)
    n = actions.groupBy(*keys(series)).agg(F.count("*").alias("_n"))
    out = out.join(n, keys(series))
    edge = F.floor(F.col("_n") * F.lit(ratio))
    keep = (F.col("_n") <= 2) | (edge * 2 >= F.col("_n")) | (
        (F.col("_i") >= edge) & (F.col("_i") < F.col("_n") - edge))
    return out.where(keep).select(*cols)


def dedup_last(actions: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Positions scaled to [0, 1]; of equal timestamps the last in file order stays."""
    by = keys(series)
    return (actions.groupBy(*by, "at_ms").agg(F.max_by("pos", "ord").alias("pos"))
                   .withColumn("pos", F.col("pos") / F.lit(100.0)))


def estimate_fps(actions: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Mean sampling rate of a script; null below two points."""
    n, first, last = F.count("*"), F.min("at_ms"), F.max("at_ms")
    return actions.groupBy(*keys(series)).agg(
        n.alias("num_actions"),
        F.when((n >= 2) & (last > first), F.lit(1000.0) * (n - 1) / (last - first)).alias("fps"))


def script_fps(metadata: Column, estimated: Column) -> Column:
    """First usable rate in the script metadata, else the estimate."""
    options = [metadata[key].try_cast("double") for key in ("postprocess_fps", "output_fps", "fps")]
    return F.coalesce(*[F.when(o > 0, o) for o in options], estimated)


# ---------------------------------------------------------------- grids and sampling plans


def frame_grid(segments: DataFrame, *, frames: str = "total_frames", fps: str = "fps",
               start_sec: str | None = None) -> DataFrame:
    """One row per frame: index and time in milliseconds. Without a valid rate every frame has time 0; a segment without
    frames has no rows. ``invalid_segments`` names both."""
    out = explode_range(segments.where(F.col(frames) > 0), F.lit(0), F.col(frames) - 1, "frame_idx", rebalance=True)
    out = out.withColumn("frame_idx", F.col("frame_idx").cast("int"))
    time = grid_time(F.col("frame_idx"), F.col(fps), F.col(start_sec) if start_sec else None)
    return out.withColumn("t_ms", F.when(F.col(fps) > 0, time).otherwise(0.0))


def invalid_segments(segments: DataFrame, *, frames: str = "total_frames", fps: str = "fps") -> DataFrame:
    """Segments that cannot be sampled, with the ``reason``; fail on these where a segment must not be empty."""
    reason = (F.when(F.col(frames).isNull() | (F.col(frames) <= 0), "no frames")
               .when(F.col(fps).isNull() | F.isnan(F.col(fps).cast("double")) | (F.col(fps) <= 0), "no frame rate"))
    return segments.withColumn("reason", reason).where(F.col("reason").isNotNull())


def grid_time(i: Column, fps: Column, start_sec: Column | None = None) -> Column:
    if start_sec is None:
        return i * (F.lit(1000.0) / fps)
    return (start_sec + i / fps) * F.lit(1000.0)


def effective_fps(fps: Column, half: Column) -> Column:
    return F.when((fps > 0) & half, fps / F.lit(2.0)).otherwise(fps)


def sampling_plan(fps: Column, n: Column, start_time: Column, duration: Column, half: Column) -> dict[str, Column]:
    """First frame, end frame, step and number of frames a clip request reads."""
    start = F.when(start_time > 0, F.greatest(F.lit(0), F.floor(start_time * fps))).otherwise(F.lit(0))
    # the end is cut down to a whole frame; durations are not negative, so floor does that
    end = F.when(duration.isNull(), n).otherwise(start + F.floor(duration * fps))
    end = F.when(n.isNotNull(), F.least(end, n)).otherwise(end)
    first = F.when(n.isNotNull(), F.least(start, n)).otherwise(start)
    step = F.when(half, F.lit(2)).otherwise(F.lit(1))
    count = F.when(end.isNull(), F.lit(None).cast("bigint")).when(end <= first, F.lit(0)).otherwise(
        F.ceil((end - first) / step))
    return {"start_frame": first.cast("bigint"), "end_frame": end.cast("bigint"),
            "frame_step": step.cast("int"), "num_frames": count.cast("bigint")}


def slice_frames(frames: DataFrame, plan: DataFrame, *, series: Key = "series_id",
                 block: int = BLOCK_FRAMES) -> DataFrame:
    """Frames of every clip request in ``plan`` (start_frame, end_frame, frame_step)."""
    hit = range_join(frames, plan.where(F.col("end_frame") > F.col("start_frame")), at="frame_idx",
                     lo="start_frame", hi="end_frame", series=series, block=block)
    return hit.where((F.col("frame_idx") - F.col("start_frame")) % F.col("frame_step") == 0)


def half_rate(frames: DataFrame) -> DataFrame:
    """Every second frame, renumbered."""
    return (frames.where(F.col("frame_idx") % 2 == 0)
                  .withColumn("frame_idx", (F.col("frame_idx") / 2).cast("int")))


# ---------------------------------------------------------------- interpolation


def knot_intervals(knots: DataFrame, kind: str = "pchip", *, series: Key = "series_id",
                   block_ms: float = BLOCK_MS, block: int = BLOCK_FRAMES) -> DataFrame:
    """Neighbouring knots as half-open intervals ``[t0, t1)`` with end values and, for monotone
    interpolation, end slopes. Knots are numbered first, so that the two neighbours on each side
    come from a bounded halo.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown interpolation {kind!r}")
    by = keys(series)
    t = F.col("at_ms").cast("double")
    if kind not in MONOTONE:
        nxt = Carry("_next", F.struct(t.alias("t"), F.col("pos").alias("p")), ahead=True, inclusive=False)
        out = scan(knots, [nxt], series=series, order="at_ms", block=block_ms)
        return out.where(F.col("_next").isNotNull()).select(
            *by, t.alias("t0"), F.col("pos").alias("p0"),
            F.col("_next.t").alias("t1"), F.col("_next.p").alias("p1"))

    numbered = dense_index(knots.select(*by, "at_ms", t.alias("t"), F.col("pos").alias("p")), "_k",
                           series=series, order="at_ms", block=block_ms)
    w = block_window(series, "_k")
    lag = lambda c, n: F.lag(c, n).over(w)
    lead = lambda c, n: F.lead(c, n).over(w)
    h0, h1 = F.col("_h0"), F.col("_h1")
    d0, d1 = F.col("_d0"), F.col("_d1")

    def weighted(ha, hb, da, db):
        wa, wb = F.lit(2.0) * hb + ha, hb + F.lit(2.0) * ha
        return F.when(da * db <= 0, F.lit(0.0)).otherwise((wa + wb) / (wa / da + wb / db))

    def one_sided(ha, hb, da, db):
        m = ((F.lit(2.0) * ha + hb) * da - ha * db) / (ha + hb)
        return (F.when(F.signum(m) != F.signum(da), F.lit(0.0))
                 .when((F.signum(da) != F.signum(db)) & (F.abs(m) > 3.0 * F.abs(da)), 3.0 * da)
                 .otherwise(m))

    # _h0/_d0 step in from the left, _h1/_d1 out to the right, _h2/_d2 and _hm/_dm one further
    columns = [
        ("_h0", F.col("t") - lag("t", 1)), ("_d0", (F.col("p") - lag("p", 1)) / (F.col("t") - lag("t", 1))),
        ("_h1", lead("t", 1) - F.col("t")), ("_d1", (lead("p", 1) - F.col("p")) / (lead("t", 1) - F.col("t"))),
        ("_hm", lag("t", 1) - lag("t", 2)), ("_dm", (lag("p", 1) - lag("p", 2)) / (lag("t", 1) - lag("t", 2))),
        ("_h2", lead("t", 2) - lead("t", 1)), ("_d2", (lead("p", 2) - lead("p", 1)) / (lead("t", 2) - lead("t", 1))),
        ("_m", F.when(d0.isNotNull() & d1.isNotNull(), weighted(h0, h1, d0, d1))
                .when(d0.isNull() & F.col("_d2").isNotNull(), one_sided(h1, F.col("_h2"), d1, F.col("_d2")))
                .when(d1.isNull() & F.col("_dm").isNotNull(), one_sided(h0, F.col("_hm"), d0, F.col("_dm")))
                .otherwise(F.coalesce(d0, d1))),
        ("_t1", lead("t", 1)), ("_p1", lead("p", 1)), ("_m1", lead("_m", 1)),
    ]
    out = halo_columns(numbered, columns, 2, 3, series=series, order="_k", block=block)
    return out.where(F.col("_t1").isNotNull()).select(
        *by, F.col("t").alias("t0"), F.col("p").alias("p0"), F.col("_m").alias("m0"),
        F.col("_t1").alias("t1"), F.col("_p1").alias("p1"), F.col("_m1").alias("m1"))


def interpolate(kind: str, t: Column) -> Column:
    """Value at ``t`` in an interval row of ``knot_intervals``."""
    t0, t1, p0, p1 = (F.col(c) for c in ("t0", "t1", "p0", "p1"))
    if kind == "nearest":
        return F.when(t - t0 <= t1 - t, p0).otherwise(p1)
    if kind == "linear":
        return p0 + (p1 - p0) * ((t - t0) / (t1 - t0))
    h = t1 - t0
    s = (t - t0) / h
    one = F.lit(1.0)
    return ((one + 2.0 * s) * (one - s) * (one - s) * p0 + s * (one - s) * (one - s) * h * F.col("m0")
            + s * s * (3.0 - 2.0 * s) * p1 + s * s * (s - one) * h * F.col("m1"))


def resample(actions: DataFrame, segments: DataFrame, kind: str = "pchip", *, series: Key = "series_id",
             segment: str | None = None, start_sec: str | None = None, fps: str = "fps",
             frames: str = "total_frames", block_ms: float = BLOCK_MS) -> DataFrame:
    """Sample control points on the frame grid of every segment.

    Each interval between two knots emits the frames it covers, so nothing is looked up per
    frame. Outside the knots the end values hold; a series without knots gives 0, and so does a segment whose
    rate is not valid (see ``invalid_segments``).
    """
    kind = kind.lower()
    if kind not in KINDS:
        raise ValueError(f"unknown interpolation {kind!r}")
    by = keys(series)
    spec = segments.where((F.col(fps) > 0) & (F.col(frames) > 0)).select(
        *by, *([segment] if segment else []), F.col(fps).cast("double").alias("_fps"),
        F.col(frames).cast("bigint").alias("_n"),
        (F.col(start_sec).cast("double") if start_sec else F.lit(0.0)).alias("_start"))
    start = F.col("_start") if start_sec else None
    t_of = lambda i: grid_time(i, F.col("_fps"), start)
    spec = (spec.withColumn("_t_first", t_of(F.lit(0))).withColumn("_t_last", t_of(F.col("_n") - 1)))
    knots = dedup_last(actions, series=series)
    ends = knots.groupBy(*by).agg(
        F.min("at_ms").cast("double").alias("_ka"), F.min_by("pos", "at_ms").alias("_pa"),
        F.max("at_ms").cast("double").alias("_kb"), F.max_by("pos", "at_ms").alias("_pb"))
    out_cols = [*by, *([segment] if segment else []), "frame_idx", "t_ms", "pos"]

    held = spec.join(ends, by, "left")
    index_at = lambda t: (t / F.lit(1000.0) - F.col("_start")) * F.col("_fps")
    last_i = F.col("_n") - 1
    before = explode_range(
        held, F.lit(0), F.when(F.col("_ka").isNull(), last_i)
                         .otherwise(F.least(last_i, F.ceil(index_at(F.col("_ka"))) + 1)), "frame_idx", rebalance=True)
    before = (before.withColumn("t_ms", t_of(F.col("frame_idx")))
                    .where(F.col("_ka").isNull() | (F.col("t_ms") < F.col("_ka")))
                    .withColumn("pos", F.coalesce("_pa", F.lit(0.0))))
    after = explode_range(held.where(F.col("_kb").isNotNull()),
                          F.greatest(F.lit(0), F.floor(index_at(F.col("_kb"))) - 1), last_i, "frame_idx", rebalance=True)
    after = (after.withColumn("t_ms", t_of(F.col("frame_idx")))
                  .where(F.col("t_ms") >= F.col("_kb")).withColumn("pos", F.col("_pb")))

    pieces = knot_intervals(knots, kind, series=series, block_ms=block_ms)
    touch = _overlaps(pieces, spec, by, block_ms)
    lo = F.greatest(F.lit(0), F.floor(index_at(F.col("t0"))) - 1)
    hi = F.least(last_i, F.ceil(index_at(F.col("t1"))) + 1)
    inner = (explode_range(touch, lo, hi, "frame_idx")
             .withColumn("t_ms", t_of(F.col("frame_idx")))
             .where((F.col("t_ms") >= F.col("t0")) & (F.col("t_ms") < F.col("t1")))
             .withColumn("pos", interpolate(kind, F.col("t_ms"))))
    unrated = segments.where((F.col(frames) > 0) & ~F.coalesce(F.col(fps) > 0, F.lit(False)))
    flat = explode_range(unrated, F.lit(0), F.col(frames) - 1, "frame_idx", rebalance=True).withColumns(
        {"t_ms": F.lit(0.0), "pos": F.lit(0.0)})
    out = before.select(out_cols).unionByName(inner.select(out_cols)).unionByName(after.select(out_cols)).unionByName(
        flat.select(out_cols))
    return out.withColumn("frame_idx", F.col("frame_idx").cast("int")).withColumn("pos", clip01(F.col("pos")))


def _overlaps(pieces: DataFrame, spec: DataFrame, by: list[str], block_ms: float) -> DataFrame:
    """Interval x segment pairs that share time. Both sides are copied to the time blocks they
    touch; the pair is kept in the first block they share."""
    def spread(df, lo, hi, extra):
        a, b = F.floor(F.col(lo) / block_ms), F.floor(F.col(hi) / block_ms)
        return (df.withColumn(extra, a.cast("bigint"))
                  .withColumn("_tb", F.explode(F.sequence(a.cast("bigint"), b.cast("bigint")))))
    left = spread(pieces, "t0", "t1", "_b0")
    right = spread(spec, "_t_first", "_t_last", "_b1")
    pairs = left.join(right, [*by, "_tb"])
    first = F.greatest("_b0", "_b1")
    return (pairs.where((F.col("_tb") == first) & (F.col("t0") <= F.col("_t_last"))
                        & (F.col("t1") > F.col("_t_first")))
                 .drop("_tb", "_b0", "_b1"))


def extract_labels(segments: DataFrame, actions: DataFrame, kind: str = "pchip", *, scene: Key = "scene_id",
                   segment: str = "series_id", block_ms: float = BLOCK_MS) -> DataFrame:
    """Frame labels of every segment from the control points of its scene."""
    return resample(actions, segments, kind, series=scene, segment=segment,
                    start_sec="segment_start_sec", block_ms=block_ms)


def sample_at(knots: DataFrame, queries: DataFrame, *, series: Key = "series_id", at: str = "t_ms",
              block_ms: float = BLOCK_MS) -> DataFrame:
    """Linear value of a series at arbitrary times, ends held. ``knots`` has at_ms and pos.

    Both tables are laid in one time order and the nearest knots are carried to the queries."""
    by = keys(series)
    extra = [c for c in queries.columns if c not in {*by, at}]
    point = F.struct(F.col("at_ms").cast("double").alias("t"), F.col("pos").cast("double").alias("p"))
    a = knots.select(*by, F.col("at_ms").cast("double").alias("_t"), F.lit(0).alias("_q"), point.alias("_k"),
                     *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in extra])
    b = queries.select(*by, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_q"),
                       F.lit(None).cast(a.schema["_k"].dataType).alias("_k"), *extra)
    known = F.col("_k").isNotNull()
    out = scan(a.unionByName(b), [Carry("_p", F.col("_k"), known), Carry("_n", F.col("_k"), known, ahead=True)],
               series=series, order="_t", ties=["_q"], block=block_ms)
    p, n, t = F.col("_p"), F.col("_n"), F.col("_t")
    value = (F.when(p.isNull(), n["p"]).when(n.isNull(), p["p"]).when(p["t"] == t, p["p"])
              .otherwise(p["p"] + (n["p"] - p["p"]) * ((t - p["t"]) / (n["t"] - p["t"]))))
    return out.where(F.col("_q") == 1).select(*by, t.alias(at), *extra, F.coalesce(value, F.lit(0.0)).alias("pos"))


# ---------------------------------------------------------------- frames to control points


def frames_to_actions(frames: DataFrame, fps: Column, start_time: Column | None = None, *,
                      series: Key = "series_id") -> DataFrame:
    """Milliseconds and 0-100 positions, both rounded half to even."""
    start = start_time if start_time is not None else F.lit(0.0)
    at = F.rint((F.col("frame_idx") / fps + start) * F.lit(1000.0)).cast("bigint")
    pos = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.col("pos") * F.lit(100.0)).cast("int")))
    return frames.select(*keys(series), F.col("frame_idx").alias("ord"), at.alias("at_ms"), pos.alias("pos"))


def simplify(frames: DataFrame, fps: Column, tolerance: float = 2.0, *, series: Key = "series_id",
             block: int = BLOCK_FRAMES) -> DataFrame:
    """Keep ends, extrema and points that leave the chord by more than ``tolerance``.

    Whether a point stays depends on the last kept one. A point that is an extremum among its
    direct neighbours always stays, though: had the point before it been dropped, that one would
    lie strictly between the last kept value and this one. So a block with an extremum hands a value to the next that does not
    depend on what comes before. Only blocks inside one long monotone stretch do: for these a summary tells which last kept
    values change nothing, and those that do change are asked for in rounds. Each such block keeps a point, and the values of a monotone
    stretch move by more than the tolerance for every point kept, so rounds are bounded by the range of the values over the tolerance.
    A task holds one block, or one small row per block of a series.
    """
    by = keys(series)
    base = frames.select(*by, "frame_idx", (F.col("pos").cast("double") * F.lit(100.0)).alias("_x"))
    packs = stored(_monotone_packs(with_halo(base, 1, 1, block=block), by, tolerance), "simplify")
    summary = packs.select(*by, BLK, "_turn", "_out", "_below", "_above")
    known = None
    while True:
        entering = stored(_entering(summary, known, by), "simplify")
        asked = entering.where("_ask")
        if asked.isEmpty():
            break
        solved = stored(_left_behind(packs.where("not _turn").join(asked.select(*by, BLK, "_in"), [*by, BLK]), by, tolerance), "simplify")
        known = solved if known is None else known.unionByName(solved)
    out = _kept_points(packs.join(entering.select(*by, BLK, "_in"), [*by, BLK]), by, frames.schema["frame_idx"].dataType, tolerance)
    at = F.rint(F.col("frame_idx") * F.lit(1000.0) / fps).cast("bigint")
    pos = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_x")))).cast("int")
    return out.select(*by, "frame_idx", at.alias("at_ms"), pos.alias("pos"))


def _schema(df: DataFrame, names: list[str], **more: str) -> T.StructType:
    out = T.StructType([df.schema[c] for c in names])
    for name, kind in more.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def _monotone_packs(near: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """One row per block: its samples, the values before and behind it, whether it has an extremum, the last value kept in it if so, and
    else the bounds of the last kept values (``_below`` up to ``_above``) that surely keep nothing in it."""
    schema = _schema(near, [*by, BLK], _i="array<bigint>", _x="array<double>", _before="double", _after="double", _turn="boolean",
                     _out="double", _below="double", _above="double")
    arrow = to_arrow_schema(schema)

    def pack(t):
        import numpy as np
        import pyarrow as pa
        t = t.take(pa.array(np.argsort(t["frame_idx"].to_numpy(), kind="stable")))
        own = np.flatnonzero(t[OWN].to_numpy() == t[BLK].to_numpy())
        if not len(own):
            return pa.Table.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        x = t["_x"].to_numpy(zero_copy_only=False).astype(float)
        first, last = own[0], own[-1] + 1
        before = float(x[first - 1]) if first else None
        after = float(x[last]) if last < len(x) else None
        turns, _, out = kernels.chord_points(x[first:last], before, after, None, tolerance)
        below, above = kernels.chord_bounds(x[first:last], after, tolerance)
        made = [t["frame_idx"].to_numpy()[first:last].tolist(), x[first:last].tolist(), before, after, bool(turns.any()), out if turns.any() else None,
                below, above]
        return pa.Table.from_arrays([*[t[c].slice(0, 1).combine_chunks() for c in (*by, BLK)],
                                     *[pa.array([m], f.type) for m, f in zip(made, list(arrow)[len(by) + 1:])]], schema=arrow)

    return near.select(*by, BLK, OWN, "frame_idx", "_x").groupBy(*by, BLK).applyInArrow(pack, schema)


def _entering(summary: DataFrame, known: DataFrame | None, by: list[str]) -> DataFrame:
    """The last kept value before every block (null if it hangs on an answer), and whether the block must be asked what it makes of it."""
    if known is None:
        rows = summary.withColumns({"_was": F.lit(None).cast("double"), "_res": F.lit(None).cast("double")})
    else:
        rows = summary.join(known.withColumnRenamed("_in", "_was"), [*by, BLK], "left")
    schema = _schema(rows, [*by, BLK], _in="double", _ask="boolean")
    arrow = to_arrow_schema(schema)

    def walk(t):
        import numpy as np
        import pyarrow as pa
        t = t.take(pa.array(np.argsort(t[BLK].to_numpy())))
        columns = [t[c].to_pylist() for c in ("_turn", "_out", "_below", "_above", "_was", "_res")]
        last, entering, ask = None, [], []
        for turn, out, below, above, was, res in zip(*columns):
            entering.append(last)
            ask.append(False)
            if turn:
                last = out
            elif last is not None and not below <= last <= above:
                ask[-1] = was is None
                last = res
        return pa.Table.from_arrays([*[t[c].combine_chunks() for c in (*by, BLK)], pa.array(entering, pa.float64()), pa.array(ask, pa.bool_())], schema=arrow)

    return rows.groupBy(*by).applyInArrow(walk, schema)


def _rows_of(batch) -> list[dict]:
    """Scalars and arrays of a batch, one packed row at a time."""
    import numpy as np
    for k in range(batch.num_rows):
        yield {f.name: (np.asarray(c[k].values) if c.type.num_fields else c[k].as_py()) for f, c in zip(batch.schema, batch.columns)}


def _left_behind(packs: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    schema = _schema(packs, [*by, BLK], _in="double", _res="double")
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = [kernels.chord_points(r["_x"], r["_before"], r["_after"], r["_in"], tolerance)[2] for r in _rows_of(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in (*by, BLK, "_in")],
                                              pa.array(found, pa.float64())], schema=arrow)

    return packs.mapInArrow(run, schema)


def _kept_points(packs: DataFrame, by: list[str], index: T.DataType, tolerance: float) -> DataFrame:
    schema = _schema(packs, by).add("frame_idx", index).add("_x", T.DoubleType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for k, r in enumerate(_rows_of(batch)):
                turns, far, _ = kernels.chord_points(r["_x"], r["_before"], r["_after"], r["_in"], tolerance)
                keep = np.flatnonzero(turns | far)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)).take(pa.array(np.full(len(keep), k))) for c in by],
                                                  pa.array(r["_i"][keep]).cast(arrow.field("frame_idx").type), pa.array(r["_x"][keep])], schema=arrow)

    return packs.mapInArrow(run, schema)


# ---------------------------------------------------------------- overrides on frames


def asof_step(frames: DataFrame, overrides: DataFrame, value: str, *, series: Key = "series_id",
              block: int = BLOCK_FRAMES) -> DataFrame:
    """``value`` of the last override at or before a frame; before the first, the frame's own."""
    return _with_marks(frames, overrides, [value], series, block,
                       lambda p, n, i: {value: F.coalesce(p[value], F.col(value))}, ahead=False)


def interval_lerp(frames: DataFrame, keyframes: DataFrame, values: list[str], *, series: Key = "series_id",
                  block: int = BLOCK_FRAMES) -> DataFrame:
    """Linear between two keyframes, the keyframe's value on it, and the frame's own outside."""
    def formula(p, n, i):
        share = (i - p["frame_idx"]) / (n["frame_idx"] - p["frame_idx"])
        return {v: F.when(p["frame_idx"] == i, p[v])
                    .when(p.isNotNull() & n.isNotNull(), p[v] + share * (n[v] - p[v]))
                    .otherwise(F.col(v)) for v in values}
    return _with_marks(frames, keyframes, values, series, block, formula, ahead=True)


def _with_marks(frames, marks, values, series, block, formula, ahead):
    by = keys(series)
    mark = marks.select(*by, "frame_idx", F.struct("frame_idx", *values).alias("_mark"))
    rest = [c for c in frames.columns if c not in {*by, "frame_idx"}]
    joined = frames.join(mark, [*by, "frame_idx"], "left")
    known = F.col("_mark").isNotNull()
    specs = [Carry("_p", F.col("_mark"), known)] + ([Carry("_n", F.col("_mark"), known, ahead=True)] if ahead else [])
    out = scan(joined, specs, series=series, block=block)
    new = formula(F.col("_p"), F.col("_n") if ahead else None, F.col("frame_idx"))
    return out.select(*by, "frame_idx", *[(new[c].alias(c) if c in new else F.col(c)) for c in rest])


def visibility(conf: Column, threshold: float = 0.25) -> Column:
    """0 hidden, 1 visible, 2 occluded (stored as 3.0, in old data as about 0.5)."""
    return (F.when((conf >= 2.0) | conf.between(0.45, 0.55), 2)
             .when(conf >= threshold, 1).otherwise(0))


def visibility_conf(vis: Column) -> Column:
    return F.when(vis == 0, 0.0).when(vis == 1, 0.9).when(vis == 2, 3.0)
