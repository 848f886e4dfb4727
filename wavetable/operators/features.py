"""Per-frame array features: channels, detections, vector fields and keypoints.

Work inside a frame is expressions over arrays in the row; only what compares frames or folds a
series shuffles.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocks import BLOCK_FRAMES, Key, attach, block_window, halo_columns, keys


def _sum(a: Column | str, of=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + of(x))


def _mean(a: Column, of=lambda x: x) -> Column:
    return _sum(a, of) / F.size(a)


def _std(a: Column) -> Column:
    """Population deviation, two passes over the array."""
    return F.sqrt(F.transform(F.array(_mean(a)), lambda m: _mean(a, lambda x: (x - m) * (x - m)))[0])


# ---------------------------------------------------------------- channels


def channel_scale(grids: DataFrame, v: str = "v", *, compat: bool = False, series: Key = "series_id") -> DataFrame:
    """Scale per series and channel from the largest magnitude.

    The documented mapping spreads it over [-127, 127]; ``compat`` divides by the magnitude itself,
    as earlier stored data did.
    """
    top = F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))
    scale = F.greatest(top if compat else top / F.lit(127.0), F.lit(1e-8))
    return grids.groupBy(*keys(series), "channel").agg(scale.alias("scale"), (F.max("frame_idx") + 1).alias("_len"))


def quantize_channels(grids: DataFrame, v: str = "v", *, compat: bool = False, series: Key = "series_id",
                      block: int = BLOCK_FRAMES) -> DataFrame:
    scale = channel_scale(grids, v, compat=compat, series=series)
    out = attach(grids, scale, length="_len", series=[*keys(series), "channel"], block=block).drop("_len")
    q = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(
        x.cast("double") / F.col("scale")).cast("int"))).cast("tinyint"))
    return out.withColumn("q", q).drop(v)


def dequantize_channels(quantized: DataFrame) -> DataFrame:
    """Values from codes and scale; a row without a scale is an error."""
    scale = F.coalesce(F.col("scale"), F.raise_error(F.lit("missing channel scale")).cast("double"))
    return quantized.withColumn("v", F.transform("q", lambda q: q * scale)).drop("q")


def channel_slices(specs: DataFrame, *, model: Key = "model") -> DataFrame:
    """Offsets ``[start, end)`` of concatenated parts, in their order. A model has few parts."""
    run = F.sum("channels").over(W.partitionBy(*keys(model)).orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return specs.withColumn("end", run).withColumn("start", F.col("end") - F.col("channels"))


def slice_errors(slices: DataFrame, *, model: Key = "model") -> DataFrame:
    """What is wrong with given slices: bad bounds or overlap with the one before; null if nothing."""
    prev = F.lag("end").over(W.partitionBy(*keys(model)).orderBy("ord"))
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start"))
    return slices.withColumn("_prev", prev).withColumn(
        "error", F.when(bad, "invalid slice").when(F.col("start") < F.col("_prev"), "overlapping slices")).drop("_prev")


# ---------------------------------------------------------------- detections


def slot_detections(detections: DataFrame, slots: int, *, ties: Sequence[str] = ("det",),
                    series: Key = "series_id") -> DataFrame:
    """The ``slots`` most confident detections of each frame. The rank limit is applied before the
    shuffle as well, so a crowded frame sends at most ``slots`` rows per task."""
    w = W.partitionBy(*keys(series), "frame_idx").orderBy(F.desc("conf"), *ties)
    out = detections.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= slots)
    return out.withColumn("slot", (F.col("_rn") - 1).cast("int")).drop("_rn")


def slot_detections_by_class(detections: DataFrame, partners: int, beholders: int, *, kp: str | None = None,
                             kept_points: int = 7, ties: Sequence[str] = ("det",),
                             series: Key = "series_id") -> DataFrame:
    """Class 0 fills the first slots, class 1 the ones after, cut to its first points."""
    a = slot_detections(detections.where(F.col("cls") == 0), partners, ties=ties, series=series)
    b = slot_detections(detections.where(F.col("cls") == 1), beholders, ties=ties, series=series)
    b = b.withColumn("slot", F.col("slot") + partners)
    if kp:
        b = b.withColumn(kp, F.slice(kp, 1, kept_points))
    return a.unionByName(b)


def fill_slots(slotted: DataFrame, frames: DataFrame, slots: int, defaults: dict[str, Column], *,
               series: Key = "series_id") -> DataFrame:
    """A row for every slot of every frame; empty ones take the defaults."""
    every = frames.select(*keys(series), "frame_idx", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    out = every.join(slotted.select(*keys(series), "frame_idx", "slot", *defaults), [*keys(series), "frame_idx", "slot"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def primary_box(frames: DataFrame, detections: DataFrame, width: float, height: float, *, fixed: bool = False,
                ties: Sequence[str] = ("det",), series: Key = "series_id") -> DataFrame:
    """Best class-0 box with its bottom at the frame edge, else a box at the centre bottom; clamped.

    ``fixed`` always takes the latter, as batch extraction does.
    """
    by = [*keys(series), "frame_idx"]
    order = F.struct(-F.col("conf"), *ties)
    best = detections.where((F.col("cls") == 0) & F.lit(not fixed)).groupBy(*by).agg(
        F.min_by(F.struct("x1", "y1", "x2", "conf"), order).alias("_b"))
    out = frames.select(*by).join(best, by, "left")
    clamp = lambda c, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), c))
    b = F.col("_b")
    return out.select(*by, clamp(F.coalesce(b["x1"], F.lit(0.25 * width)), width).alias("x1"),
                      clamp(F.coalesce(b["y1"], F.lit(0.5 * height)), height).alias("y1"),
                      clamp(F.coalesce(b["x2"], F.lit(0.75 * width)), width).alias("x2"),
                      F.lit(float(height)).alias("y2"), F.coalesce(b["conf"], F.lit(0.0)).alias("conf"))


# ---------------------------------------------------------------- vector fields (arrays row by row, h x w)


def field_normalize(fields: DataFrame) -> DataFrame:
    return (fields.withColumn("fx", F.transform("fx", lambda x: x / F.col("w")))
                  .withColumn("fy", F.transform("fy", lambda y: y / F.col("h"))))


def field_downsample(fields: DataFrame, size: int) -> DataFrame:
    """Area average to ``size x size``; magnitudes stay, an equal size passes through."""
    def axis(cell, n):
        lo, hi = cell * n / F.lit(float(size)), (cell + 1) * n / F.lit(float(size))
        first, last = F.floor(lo).cast("int"), (F.ceil(hi) - 1).cast("int")
        return F.sequence(first, last), lambda i: F.least(i + 1.0, hi) - F.greatest(i.cast("double"), lo)

    def resized(name):
        def cell(k):
            rows, wr = axis(F.floor(k / F.lit(size)), F.col("h"))
            cols, wc = axis(k % size, F.col("w"))
            total = F.aggregate(rows, F.lit(0.0), lambda a, i: a + wr(i) * F.aggregate(
                cols, F.lit(0.0), lambda b, j: b + wc(j) * F.element_at(name, i * F.col("w") + j + 1)))
            return total * F.lit(float(size * size)) / (F.col("h") * F.col("w"))
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), cell)

    same = (F.col("h") == size) & (F.col("w") == size)
    plain = lambda c: F.transform(c, lambda x: x.cast("double"))
    return (fields.withColumn("_fx", F.when(same, plain("fx")).otherwise(resized("fx")))
                  .withColumn("_fy", F.when(same, plain("fy")).otherwise(resized("fy")))
                  .drop("fx", "fy").withColumnsRenamed({"_fx": "fx", "_fy": "fy"})
                  .withColumn("h", F.lit(size)).withColumn("w", F.lit(size)))


def field_summary(fields: DataFrame, n: int = 64, layout: str = "full") -> DataFrame:
    """Grid-cell and whole-field statistics as a vector ``f``.

    Per cell: mean and deviation of the magnitude, mean x, mean y; then six of the whole field. ``full`` holds all
    of them, four numbers for each of the ``n / 4`` cells and the six behind. ``compat`` has ``n`` numbers and fills only
    a quarter of the cells, in row order, which stored data relies on.
    """
    if layout not in ("compat", "full"):
        raise ValueError(f"unknown layout {layout!r}")
    cells = max(n // 4, 4)
    side = int(-(-(cells ** 0.5) // 1))
    used = min(-(-cells // 4) if layout == "compat" else side * side, side * side)
    mag = F.zip_with("fx", "fy", lambda x, y: F.sqrt(x.cast("double") * x + y.cast("double") * y))
    df = fields.withColumn("_m", mag).withColumn("_x", F.transform("fx", lambda x: x.cast("double")))
    df = df.withColumn("_y", F.transform("fy", lambda y: y.cast("double")))
    ch, cw = F.floor(F.col("h") / F.lit(side)).cast("int"), F.floor(F.col("w") / F.lit(side)).cast("int")

    def part(name, k):
        r, c = F.floor(k / F.lit(side)).cast("int"), k % side
        return F.flatten(F.transform(F.sequence(r * ch, (r + 1) * ch - 1),
                                     lambda i: F.slice(name, i * F.col("w") + c * cw + 1, cw)))

    # cells are cut out once, then summarised
    df = df.withColumn("_cells", F.transform(F.sequence(F.lit(0), F.lit(used - 1)), lambda k: F.struct(
        part("_m", k).alias("m"), part("_x", k).alias("x"), part("_y", k).alias("y"))))
    grid = F.flatten(F.transform("_cells", lambda c: F.array(_mean(c["m"]), _std(c["m"]), _mean(c["x"]), _mean(c["y"]))))
    m, s = F.col("_m"), F.array_sort("_m")
    rank = F.lit(0.9) * (F.size(m) - 1)
    lo, hi = F.element_at(s, F.floor(rank).cast("int") + 1), F.element_at(s, F.ceil(rank).cast("int") + 1)
    angle = F.zip_with("_y", "_x", lambda y, x: F.atan2(y, x))
    whole = F.array(_mean(m), _std(m), _mean(F.col("_x")), _mean(F.col("_y")), lo + (hi - lo) * (rank - F.floor(rank)),
                    _mean(angle))
    padded = F.concat(grid, whole, F.array_repeat(F.lit(0.0), max(0, n - used * 4 - 6)))
    return df.withColumn("f", F.slice(padded, 1, n) if layout == "compat" else padded).drop("_m", "_x", "_y", "_cells")

def field_flip(fields: DataFrame, mode: str = "hflip") -> DataFrame:
    """Mirror a field left-right (negates x), top-bottom (negates y) or both."""
    if mode not in ("none", "hflip", "vflip", "hvflip"):
        raise ValueError(f"unknown flip {mode!r}")
    rows = lambda c: F.transform(F.sequence(F.lit(0), F.col("h") - 1),
                                 lambda r: F.slice(c, r * F.col("w") + 1, F.col("w")))

    def flipped(c, sign_h, sign_v):
        out, sign = rows(c), 1.0
        if mode in ("hflip", "hvflip"):
            out, sign = F.transform(out, lambda r: F.reverse(r)), sign * sign_h
        if mode in ("vflip", "hvflip"):
            out, sign = F.reverse(out), sign * sign_v
        return F.transform(F.flatten(out), lambda x: x.cast("double") * F.lit(sign))

    return fields.withColumn("fx", flipped("fx", -1.0, 1.0)).withColumn("fy", flipped("fy", 1.0, -1.0))


def field_sample(x: Column, y: Column, fy: Column | str = "fy", h: Column | str = "h", w: Column | str = "w") -> Column:
    """Bilinear value of the vertical component at a normalised point, corners aligned."""
    fy, h, w = (F.col(c) if isinstance(c, str) else c for c in (fy, h, w))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    px, py = unit(x) * (w - 1), unit(y) * (h - 1)
    x0, y0 = F.floor(px).cast("int"), F.floor(py).cast("int")
    x1, y1 = F.least(x0 + 1, w - 1), F.least(y0 + 1, h - 1)
    at = lambda r, c: F.element_at(fy, r * w + c + 1).cast("double")
    ax, ay = px - x0, py - y0
    top = at(y0, x0) * (1.0 - ax) + at(y0, x1) * ax
    return top * (1.0 - ay) + (at(y1, x0) * (1.0 - ax) + at(y1, x1) * ax) * ay


# ---------------------------------------------------------------- keypoints (array of x, y, conf)

# Bones as pairs of point numbers.
BONES_17 = ((0, 1), (0, 2), (1, 3), (2, 4), (0, 5), (0, 6), (5, 7), (6, 8), (7, 9), (8, 10), (5, 11), (6, 12), (11, 13),
            (12, 14), (13, 15), (14, 16))
BONES_21 = ((0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13),
            (13, 15), (12, 14), (14, 16), (11, 17), (12, 17), (17, 18), (5, 19), (6, 20), (19, 20), (18, 19), (18, 20))
BONES_7 = ((0, 1), (0, 2), (1, 3), (0, 4), (1, 4), (4, 5))
# Heights sampled along the vertical strip, and the pelvis of the short topology.
STRIP_Y = (0.17, 0.25, 0.33, 0.42, 0.50, 0.58, 0.67, 0.75, 0.83, 0.92)
STRIP_PELVIS = 4


#: Least number of points, bones, root point and root pair of each role, largest first.
TOPOLOGIES = {
    "performer": ((21, BONES_21, 17, (11, 12)), (17, BONES_17, None, (11, 12))),
    "beholder": ((7, BONES_7, 4, (0, 1)), (2, (), None, (0, 1))),
}


def topology(points: int, role: str = "performer") -> tuple[tuple, int | None, tuple[int, int] | None]:
    """Bones, root point and root pair of the largest known layout that the points fill."""
    fitting = [row[1:] for row in TOPOLOGIES.get(role, TOPOLOGIES["performer"]) if row[0] <= points]
    return fitting[0] if fitting else ((), None, None)


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def weighted_root(kp: Column, floor: float = 0.0) -> Column:
    """Mean point weighted with confidence; ``floor`` is the least weight of a point."""
    weight = lambda p: F.greatest(p["conf"].cast("double"), F.lit(floor))
    total = F.greatest(_sum(kp, weight), F.lit(1e-6))
    return _xy(_sum(kp, lambda p: p["x"] * weight(p)) / total, _sum(kp, lambda p: p["y"] * weight(p)) / total)


def pose_root(kp: Column, points: int, role: str = "performer") -> Column:
    """Root point, else the middle of the root pair, else the weighted mean; each only if seen."""
    _, root, pair = topology(points, role)
    mean = weighted_root(kp, 1e-6)
    seen = lambda p: p["conf"] > 1e-6
    out = mean
    if pair is not None and max(pair) < points:
        a, b = kp[pair[0]], kp[pair[1]]
        mid = _xy((a["x"] + b["x"]).cast("double") * 0.5, (a["y"] + b["y"]).cast("double") * 0.5)
        out = F.when((a["conf"] + b["conf"]) * 0.5 > 1e-6, mid).otherwise(mean)
    if root is not None and root < points:
        p = kp[root]
        out = F.when(seen(p), _xy(p["x"].cast("double"), p["y"].cast("double"))).otherwise(out)
    return out


def pose_relative(kp: Column, root: Column) -> Column:
    """Points relative to the root, scaled by confidence."""
    return F.transform(kp, lambda p: _xy((p["x"] - root["x"]) * p["conf"], (p["y"] - root["y"]) * p["conf"]))


def pose_bones(relative: Column, bones: Sequence[tuple[int, int]]) -> Column:
    return F.array(*[_xy(relative[b]["x"] - relative[a]["x"], relative[b]["y"] - relative[a]["y"]) for a, b in bones])


def pose_velocity(poses: DataFrame, kp: str = "kp", *, series: Key = ("series_id", "slot"),
                  block: int = BLOCK_FRAMES) -> DataFrame:
    """Velocity and acceleration of every point; zero where the past is missing."""
    w = block_window(series)
    flat = _xy(F.lit(0.0), F.lit(0.0))
    sub = lambda a, b: F.zip_with(a, b, lambda p, q: _xy((p["x"] - q["x"]).cast("double"), (p["y"] - q["y"]).cast("double")))
    still = F.transform(kp, lambda p: flat)
    columns = [("velocity", F.when(F.lag(kp).over(w).isNull(), still).otherwise(sub(F.col(kp), F.lag(kp).over(w)))),
               ("acceleration", F.when(F.lag(kp, 2).over(w).isNull(), still)
                .otherwise(sub(F.col("velocity"), F.lag("velocity").over(w))))]
    return halo_columns(poses, columns, 2, 0, series=series, block=block)


def mean_visible_conf(kp: Column) -> Column:
    return _sum(kp, lambda p: p["conf"]) / F.greatest(F.size(F.filter(kp, lambda p: p["conf"] > 0)), F.lit(1))


def visible_ratio(kp: Column) -> Column:
    return F.size(F.filter(kp, lambda p: p["conf"] > 0)) / F.size(kp)


def mean_conf(kp: Column) -> Column:
    return _mean(kp, lambda p: p["conf"])


def primary_slot(poses: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Slot with the most visible points; then centre nearest the middle, then the lowest slot."""
    c = weighted_root(F.col("kp"))
    dist = F.sqrt((c["x"] - 0.5) * (c["x"] - 0.5) + (c["y"] - 0.5) * (c["y"] - 0.5))
    seen = F.size(F.filter("kp", lambda p: p["conf"] > 0))
    return poses.groupBy(*keys(series), "frame_idx").agg(
        F.min_by("slot", F.struct((-seen).alias("seen"), dist.alias("dist"), "slot")).alias("slot"))


def collapse_slots(poses: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """One pose per frame: confidence-weighted points and their largest confidence. A frame with one
    slot passes through."""
    by = [*keys(series), "frame_idx"]
    rows = poses.select(*by, F.posexplode("kp").alias("k", "p"))
    w = F.greatest(F.col("p.conf").cast("double"), F.lit(0.0))
    total = F.greatest(F.sum(w), F.lit(1e-6))
    one = F.count("*") == 1
    pts = rows.groupBy(*by, "k").agg(
        F.when(one, F.max("p.x").cast("double")).otherwise(F.sum(F.col("p.x") * w) / total).alias("x"),
        F.when(one, F.max("p.y").cast("double")).otherwise(F.sum(F.col("p.y") * w) / total).alias("y"),
        F.when(one, F.max("p.conf").cast("double")).otherwise(F.max(w)).alias("conf"))
    return pts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "conf"))).alias("_l")).select(
        *by, F.transform("_l", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["conf"].alias("conf"))).alias("kp"))


def pair_distances(beholder: DataFrame, partner: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Distance between every point of one pose and every point of each slot, and the product of
    confidences; zero distance where that is zero. The points of a pose are a fixed few."""
    by = [*keys(series), "frame_idx"]
    a = beholder.select(*by, F.posexplode("kp").alias("kb", "_a"))
    j = a.join(partner.select(*by, "slot", F.col("kp").alias("_k")), by)
    j = j.select(*by, "kb", "_a", "slot", F.posexplode("_k").alias("kp", "_b"))
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    conf = F.col("_a.conf").cast("double") * F.col("_b.conf")
    return j.select(*by, "kb", "slot", "kp", F.when(conf > 0, F.sqrt((dx * dx + dy * dy).cast("double"))).otherwise(0.0)
                    .alias("distance"), conf.alias("conf"))


def pair_features(df: DataFrame, a: str = "kp_a", b: str = "kp_b") -> DataFrame:
    """Seven numbers for two poses and the field of a frame."""
    ka, kb = F.col(a), F.col(b)
    df = df.withColumn("_ra", weighted_root(ka)).withColumn("_rb", weighted_root(kb))
    sample = lambda r: field_sample(F.col(r)["x"], F.col(r)["y"])
    return df.select("*", F.struct(
        (F.col("_ra.x") - F.col("_rb.x")).alias("dx"), (F.col("_ra.y") - F.col("_rb.y")).alias("dy"),
        (sample("_ra") - sample("_rb")).alias("dflow"), mean_conf(ka).alias("conf_a"), mean_conf(kb).alias("conf_b"),
        visible_ratio(ka).alias("visible_a"), visible_ratio(kb).alias("visible_b")).alias("pair")).drop("_ra", "_rb")


def strip_points(kp: Column) -> Column:
    """Ten points on a vertical line through the pelvis, else the root, else the middle."""
    root, pelvis = weighted_root(kp), F.get(kp, F.lit(STRIP_PELVIS))
    fallback = F.when(mean_conf(kp) > 1e-6, root["x"]).otherwise(0.5)
    seen = pelvis.isNotNull() & (pelvis["conf"] > 1e-6)
    x = F.when(seen, pelvis["x"].cast("double")).otherwise(fallback)
    conf = F.when(seen, pelvis["conf"].cast("double")).otherwise(F.array_max(F.transform(kp, lambda p: p["conf"].cast("double"))))
    return F.array(*[F.struct(x.alias("x"), F.lit(y).alias("y"), conf.alias("conf")) for y in STRIP_Y])


def point_features(kp: Column) -> Column:
    """Per point: position, position relative to the root, confidence, sampled flow."""
    root = weighted_root(kp)
    return F.transform(kp, lambda p: F.struct(
        p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"),
        (p["x"] - root["x"]).alias("rx"), (p["y"] - root["y"]).alias("ry"), p["conf"].cast("double").alias("conf"),
        field_sample(p["x"], p["y"]).alias("flow")))


def temporal_delta(vectors: DataFrame, v: str = "v", *, series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """The vector followed by its change since the frame before (zero for the first)."""
    w = block_window(series)
    x = F.transform(v, lambda a: a.cast("double"))
    delta = F.when(F.lag(v).over(w).isNull(), F.transform(v, lambda a: F.lit(0.0))).otherwise(
        F.zip_with(v, F.lag(v).over(w), lambda a, b: a.cast("double") - b))
    return halo_columns(vectors, [("delta", F.concat(x, delta))], 1, 0, series=series, block=block)


def softmax_pool(slots: DataFrame, v: str = "v", *, series: Key = "series_id") -> DataFrame:
    """Softmax-weighted sum over the slots of a frame; the log of the confidence adds to the score."""
    by = [*keys(series), "frame_idx"]
    s = F.col("score") + F.log(F.greatest(F.col("conf"), F.lit(1e-6)))
    frame = W.partitionBy(*by)                       # a frame has a fixed few slots
    df = slots.withColumn("_s", s).withColumn("_e", F.exp(F.col("_s") - F.max("_s").over(frame)))
    df = df.select(*by, "_e", F.posexplode(v).alias("dim", "_x"))
    return df.groupBy(*by, "dim").agg((F.sum(F.col("_x") * F.col("_e")) / F.sum("_e")).alias("value"))
