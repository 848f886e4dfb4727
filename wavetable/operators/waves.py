"""Wave clean-up: fill, smooth, find runs, stretch, and the chunked pipeline over long series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels
from ..session import stored
from .blocks import (BLK, BLOCK_FRAMES, Carry, Key, attach, block_window, each_group, explode_range, halo_columns, keys, own_rows,
                     range_join, scan, with_block, with_halo)
from .resample import clip01


@dataclass(frozen=True)
class WaveConfig:
    """Knobs of the clean-up."""
    # Names and defaults under which stored results were made.
    lowpass_cutoff_hz: float = 8.0
    lowpass_order: int = 2
    trough_prominence: float = 0.035
    trough_distance_seconds: float = 0.15
    min_cycle_amplitude: float = 0.3
    min_cycle_frequency_hz: float = 0.5
    gradient_smoothing: str = "savgol"
    gradient_window_seconds: float = 0.45
    gradient_polyorder: int = 2
    gradient_sigma_seconds: float = 0.12
    gradient_floor: float = 0.00075
    gradient_low_quantile: float = 0.25
    gradient_high_quantile: float = 0.9
    min_gradient_length_seconds: float = 0.6
    min_gradient_range: float = 0.08
    min_gradient_sign_balance: float = 0.65
    merge_gap_seconds: float = 0.15
    stretch_mode: str = "tanh"
    stretch_gain: float = 4.0
    chunk_seconds: float = 300.0
    chunk_overlap_seconds: float = 2.0

    def __post_init__(self):
        if self.gradient_smoothing not in ("none", "gaussian", "savgol"):
            raise ValueError(f"unknown smoothing {self.gradient_smoothing!r}")
        if self.stretch_mode not in ("linear", "tanh"):
            raise ValueError(f"unknown stretch mode {self.stretch_mode!r}")
        if not 0.0 <= self.gradient_low_quantile <= self.gradient_high_quantile <= 1.0:
            raise ValueError("quantiles must lie in [0, 1] in ascending order")
        if not 0.0 <= self.min_gradient_sign_balance <= 1.0 or not 0.0 <= self.min_cycle_amplitude <= 1.0:
            raise ValueError("amplitude and sign balance must lie in [0, 1]")
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (int, float)) and value < 0:
                raise ValueError(f"{f.name} must not be negative")

    def chunking(self, fps: float) -> tuple[int, int]:
        """Frames per chunk and overlap. A chunk is what one task holds, so it must be finite."""
        size = kernels.half_even(self.chunk_seconds * fps)
        overlap = kernels.half_even(self.chunk_overlap_seconds * fps)
        if size <= overlap + 2:
            raise ValueError("chunk_seconds must exceed the overlap by more than two frames")
        return size, overlap

    def as_map(self) -> dict[str, str]:
        return {k: str(v) for k, v in asdict(self).items()}


# ---------------------------------------------------------------- values


def fill_nonfinite(frames: DataFrame, x: str = "pos", *, series: Key = "series_id",
                   block: int = BLOCK_FRAMES) -> DataFrame:
    """Linear over the index between finite values, ends held, 0 if nothing is finite."""
    v = F.col(x)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    point = F.struct(F.col("frame_idx").alias("i"), v.cast("double").alias("v"))
    cols = frames.columns
    out = scan(frames, [Carry("_p", point, ok), Carry("_n", point, ok, ahead=True)], series=series, block=block)
    p, n, i = F.col("_p"), F.col("_n"), F.col("frame_idx")
    filled = (F.when(p.isNull() & n.isNull(), F.lit(0.0)).when(p.isNull(), n["v"]).when(n.isNull(), p["v"])
               .when(p["i"] == i, p["v"])
               .otherwise(p["v"] + (n["v"] - p["v"]) * ((i - p["i"]) / (n["i"] - p["i"]))))
    return out.withColumn(x, filled).select(cols)


def smooth_fir(frames: DataFrame, weights: list[float], x: str = "pos", *, out: str = "smooth",
               series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Dot product with a centred kernel; the end values repeat beyond the ends."""
    r = len(weights) // 2
    w = block_window(series)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = with_halo(frames, r, r, block=block)
    df = df.withColumn("_first", F.first(x).over(whole)).withColumn("_last", F.last(x).over(whole))
    total = None
    for k, weight in enumerate(weights):
        shift = k - r
        value = (F.col(x) if shift == 0 else F.coalesce(
            (F.lead(x, shift) if shift > 0 else F.lag(x, -shift)).over(w), F.col("_last" if shift > 0 else "_first")))
        term = F.lit(float(weight)) * value
        total = term if total is None else total + term
    return own_rows(df.withColumn(out, total).drop("_first", "_last"))


def smooth_gaussian(frames: DataFrame, fps: float, sigma_seconds: float = 0.12, x: str = "pos", **kw) -> DataFrame:
    return smooth_fir(frames, kernels.gaussian_weights(max(0.5, sigma_seconds * fps)), x, **kw)


def gradient(frames: DataFrame, x: str = "pos", *, out: str = "gradient", series: Key = "series_id",
             block: int = BLOCK_FRAMES) -> DataFrame:
    """Central difference, one-sided at the ends; 0 for a single frame."""
    w = block_window(series)
    a, b, c = F.lag(x).over(w), F.col(x), F.lead(x).over(w)
    return halo_columns(frames, [(out, F.coalesce((c - a) / F.lit(2.0), c - b, b - a, F.lit(0.0)))], 1, 1,
                        series=series, block=block)


def gradient_thresholds(frames: DataFrame, floor: float = 0.00075, lo: float = 0.25, hi: float = 0.9, *,
                        eligible: Column | None = None, g: str = "gradient", chunk: Key) -> DataFrame:
    """Band of slow gradients per chunk: quantiles of the positive absolute gradient.

    A chunk has a bounded number of frames, so the exact percentile buffer is bounded as well.
    """
    a = F.abs(F.col(g))
    take = F.when((a > 0) & (F.lit(True) if eligible is None else eligible), a)
    q = frames.groupBy(*keys(chunk)).agg(F.percentile(take, F.lit(lo)).alias("_l"),
                                         F.percentile(take, F.lit(hi)).alias("_h"))
    low = F.greatest(F.lit(float(floor)), F.col("_l"))
    return q.select(*keys(chunk), F.when(F.col("_l").isNull(), 0.0).otherwise(low).alias("low"),
                    F.when(F.col("_l").isNull(), 0.0).otherwise(F.greatest(F.col("_h"), low)).alias("high"))


# ---------------------------------------------------------------- runs


def runs(frames: DataFrame, mask: Column, *, series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Maximal stretches of consecutive true frames as ``[start, end)``."""
    return merge_runs(_block_runs(frames, mask, series, block), 0, series=series, block=block)


def _block_runs(frames, mask, series, block):
    """Runs cut at block borders; ``merge_runs`` with gap 0 joins the pieces again."""
    by = keys(series)
    on = frames.where(mask).select(*by, "frame_idx", F.floor(F.col("frame_idx") / F.lit(block)).alias("_blk"))
    island = F.col("frame_idx") - F.row_number().over(block_window(series))
    return (on.withColumn("_g", island).groupBy(*by, "_blk", "_g")
              .agg(F.min("frame_idx").alias("start"), (F.max("frame_idx") + 1).alias("end")).drop("_blk", "_g"))


def merge_runs(segments: DataFrame, gap: int = 0, *, series: Key = "series_id",
               block: int = BLOCK_FRAMES) -> DataFrame:
    """Join runs whose distance is at most ``gap`` frames. Input runs must not overlap."""
    by = keys(series)
    rows = with_block(segments.select(*by, "start", "end"), "start", block)
    inside = W.partitionBy(*by, BLK).orderBy("start")
    rows = rows.withColumn("_prev", F.lag("end").over(inside))
    opens = F.col("start") - F.col("_prev") > gap                     # null for the first run of a block
    # only the first run of a block depends on other blocks: whether it opens a group, and which group is open before it
    edge = rows.groupBy(*by, BLK).agg(F.min("start").alias("_first"), F.max("end").alias("_last"),
                                      F.max(F.when(opens, F.col("start"))).alias("_opened"))
    before = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("_before", F.last("_last").over(before))
    fresh = F.col("_before").isNull() | (F.col("_first") - F.col("_before") > gap)
    edge = edge.withColumn("_fresh", fresh).withColumn(
        "_open", F.last(F.coalesce("_opened", F.when(F.col("_fresh"), F.col("_first"))), True).over(before))
    joined = rows.join(edge.select(*by, BLK, "_fresh", "_open"), [*by, BLK])
    own = F.max(F.when(F.coalesce(opens, F.col("_fresh")), F.col("start"))).over(inside.rowsBetween(W.unboundedPreceding, 0))
    grouped = joined.withColumn("_group", F.coalesce(own, F.col("_open")))
    return grouped.groupBy(*by, "_group").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end")).drop("_group")


def gradient_segments(frames: DataFrame, fps: float, config: WaveConfig = WaveConfig(), *,
                      eligible: Column | None = None, reference: str = "pos", low: str = "low",
                      high: str = "high", series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Sustained slow gradients. ``frames`` carries gradient, reference and the band columns."""
    by = keys(series)
    a = F.abs(F.col("gradient"))
    ok = F.lit(True) if eligible is None else eligible
    band = ok & (a >= F.col(low)) & (a <= F.col(high)) & (F.col(high) > 0)
    gap = kernels.half_even(config.merge_gap_seconds * fps)
    least = max(2, kernels.half_even(config.min_gradient_length_seconds * fps))
    merged = merge_runs(_block_runs(frames, band, series, block), gap, series=series, block=block)
    merged = merged.where(F.col("end") - F.col("start") >= least)
    inside = range_join(frames, merged, at="frame_idx", lo="start", hi="end", series=series, block=block)
    sign = F.when(F.abs(F.col("gradient")) >= F.col(low), F.signum("gradient"))
    stats = inside.groupBy(*by, "start", "end").agg(
        F.abs(F.avg(sign)).alias("balance"), (F.max(reference) - F.min(reference)).alias("range"))
    return stats.where((F.col("balance") >= config.min_gradient_sign_balance)
                       & (F.col("range") >= config.min_gradient_range))


def stretch(frames: DataFrame, segments: DataFrame, mode: str = "tanh", gain: float = 4.0,
            min_range: float = 0.08, x: str = "pos", *, series: Key = "series_id",
            block: int = BLOCK_FRAMES) -> DataFrame:
    """Push every segment towards the extremes; frames outside keep their value."""
    by = keys(series)
    if mode not in ("linear", "tanh"):
        raise ValueError(f"unknown stretch mode {mode!r}")
    seg = segments.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = range_join(frames.select(*by, "frame_idx", x), seg, at="frame_idx", lo="_s", hi="_e",
                     series=series, block=block)
    stats = hit.groupBy(*by, "_s", "_e").agg(F.min(x).alias("_min"), F.max(x).alias("_max"),
                                             F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_std"))
    span = F.col("_max") - F.col("_min")
    stats = stats.where((F.col("_e") - F.col("_s") >= 2) & (span >= min_range))
    joined = range_join(frames, stats, at="frame_idx", lo="_s", hi="_e", series=series, block=block, how="left")
    spread = F.when(F.col("_std") <= 1e-6, F.greatest(span / 6.0, F.lit(1e-6))).otherwise(F.col("_std"))
    if mode == "linear":
        value = (F.col(x) - F.col("_min")) / F.greatest(span, F.lit(1e-6))
    else:
        value = 0.5 * (F.tanh(F.lit(float(gain)) * (F.col(x) - F.col("_mean")) / spread) + 1.0)
    return (joined.withColumn("stretched", F.col("_s").isNotNull())
                  .withColumn(x, F.when(F.col("_s").isNull(), F.col(x)).otherwise(value))
                  .drop("_s", "_e", "_min", "_max", "_mean", "_std"))


# ---------------------------------------------------------------- single steps of the clean-up on chunks


def _on_chunks(frames: DataFrame, chunk: Key, added: list[tuple[str, T.DataType]], work: Callable) -> DataFrame:
    """Columns that a kernel adds to the frames of each chunk, in frame order. A chunk has a bounded number of frames."""
    by = keys(chunk)
    schema = T.StructType([f for f in frames.schema.fields if f.name not in {n for n, _ in added}])
    names = schema.fieldNames()
    for name, kind in added:
        schema = schema.add(name, kind)
    out_schema = to_arrow_schema(schema)

    def run(rows):
        import pyarrow as pa
        new = [pa.array(v, out_schema.field(n).type) for v, (n, _) in zip(work(rows), added)]
        return pa.Table.from_arrays([*[rows[n].combine_chunks() for n in names], *new], schema=out_schema)

    return each_group(frames, by, run, schema)


def lowpass(frames: DataFrame, fps: float, cutoff: float = 8.0, order: int = 2, x: str = "pos", *, out: str = "low",
            chunk: Key = ("series_id", "chunk")) -> DataFrame:
    """Zero-phase Butterworth low-pass of every chunk; passed through where the filter is not defined."""
    return _on_chunks(frames, chunk, [(out, T.DoubleType())],
                      lambda r: [kernels.lowpass(r[x].to_numpy(), fps, cutoff, order).astype("float64")])


def troughs(frames: DataFrame, fps: float, prominence: float = 0.035, min_distance: float = 0.15, x: str = "pos", *,
            out: str = "trough", chunk: Key = ("series_id", "chunk")) -> DataFrame:
    """Whether a frame is a trough of its chunk: local minimum, spaced, and deep enough."""
    def mark(r):
        import numpy as np
        flag = np.zeros(r.num_rows, bool)
        flag[kernels.troughs(r[x].to_numpy(), fps, prominence, min_distance)] = True
        return [flag]
    return _on_chunks(frames, chunk, [(out, T.BooleanType())], mark)


def normalize_cycles(frames: DataFrame, fps: float, min_amplitude: float = 0.3, min_hz: float = 0.5, x: str = "pos", *,
                     reference: str | None = None, trough: str = "trough", out: str = "in_cycle",
                     chunk: Key = ("series_id", "chunk")) -> DataFrame:
    """Cycles between marked troughs spread over [0, 1], and which frames lie in one. ``reference`` decides which cycles are
    high enough (default: the values themselves)."""
    def spread_out(r):
        import numpy as np
        at = np.flatnonzero(r[trough].to_numpy(zero_copy_only=False))
        y, mask, _ = kernels.stretch_cycles(r[x].to_numpy(), r[reference or x].to_numpy(), at, fps, min_amplitude, min_hz)
        return [y.astype("float64"), mask]
    return _on_chunks(frames, chunk, [(x, T.DoubleType()), (out, T.BooleanType())], spread_out)


def smooth(frames: DataFrame, fps: float, mode: str = "savgol", window_seconds: float = 0.5, poly: int = 2,
           sigma_seconds: float = 0.12, x: str = "pos", *, out: str = "smooth", chunk: Key = ("series_id", "chunk")) -> DataFrame:
    """``none``, ``gaussian`` or ``savgol`` smoothing of every chunk."""
    if mode not in ("none", "gaussian", "savgol"):
        raise ValueError(f"unknown smoothing {mode!r}")
    return _on_chunks(frames, chunk, [(out, T.DoubleType())], lambda r: [kernels.smooth(
        r[x].to_numpy(), fps, mode, window_seconds, poly, sigma_seconds).astype("float64")])


# ---------------------------------------------------------------- chunks


def chunk_table(lengths: DataFrame, size: int, overlap: int, *, n: str = "n") -> DataFrame:
    """Overlapping chunks of every series: number, ``[start, end)`` and whether each end fades."""
    if size <= overlap + 2:
        raise ValueError("a chunk must be longer than the overlap plus two frames")
    step = max(1, size - overlap)
    last = F.greatest(F.ceil((F.col(n) - size) / F.lit(step)), F.lit(0)).cast("bigint")
    out = explode_range(lengths.where(F.col(n) > 0), F.lit(0), last, "chunk", rebalance=True)
    start = F.col("chunk") * step
    end = F.least(F.col(n).cast("bigint"), start + size)
    return (out.withColumn("start", start).withColumn("end", end)
               .withColumn("fade_in", F.col("start") > 0).withColumn("fade_out", F.col("end") < F.col(n)))


def chunk_frames(frames: DataFrame, chunks: DataFrame, *, series: Key = "series_id",
                 block: int = BLOCK_FRAMES) -> DataFrame:
    """Every frame once per chunk that holds it."""
    return range_join(frames, chunks, at="frame_idx", lo="start", hi="end", series=series, block=block)


def taper_weight(overlap: int) -> Column:
    """Weight of a frame in its chunk: a ramp over the overlap at every end that fades."""
    i, length = F.col("frame_idx") - F.col("start"), F.col("end") - F.col("start")
    if overlap <= 0:
        return F.lit(1.0)
    ramp_len = F.least(F.lit(overlap), length)
    up = (i + 1) / (ramp_len + 1)
    down = (length - i) / (ramp_len + 1)
    w = (F.when(F.col("fade_in") & (i < ramp_len), up).otherwise(1.0)
         * F.when(F.col("fade_out") & (length - i <= ramp_len), down).otherwise(1.0))
    return F.when(length <= 1, 1.0).otherwise(w)


def taper_blend(chunked: DataFrame, overlap: int, x: str = "pos", *, series: Key = "series_id") -> DataFrame:
    """Overlapping chunk values to one value per frame."""
    w = taper_weight(overlap)
    return (chunked.withColumn("_w", w).groupBy(*keys(series), "frame_idx")
                   .agg((F.sum(F.col(x) * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-6))).alias(x))
                   .withColumn(x, clip01(F.col(x))))


def lengths_of(frames: DataFrame, *, series: Key = "series_id") -> DataFrame:
    return frames.groupBy(*keys(series)).agg((F.max("frame_idx") + 1).alias("n"))


# ---------------------------------------------------------------- the whole clean-up


def _config_fields() -> str:
    types = {"str": "string", "int": "int", "float": "double"}
    return ", ".join(f"{f.name}: {types[f.type]}" for f in fields(WaveConfig))


def _cut(frames: DataFrame, size: int, overlap: int, series: Key, x: str) -> DataFrame:
    """Every frame in the chunks it may belong to, from its index alone.

    A chunk also gets the frame after its end, which tells that the series goes on; a chunk that
    would hold nothing beyond the overlap of the one before does not exist and is dropped later.
    """
    step = max(1, size - overlap)
    i = F.col("frame_idx")
    first = F.greatest(F.ceil((i - size) / F.lit(step)), F.lit(0)).cast("bigint")
    last = F.floor(i / F.lit(step)).cast("bigint")
    return frames.select(*keys(series), "frame_idx", F.col(x).cast("float").alias("pos"),
                         F.explode(F.sequence(first, last)).alias("chunk"))


def _chunk_rows(rows, size: int, overlap: int):
    """The samples of one chunk in order, its number and whether the series goes on; None if the chunk does not exist."""
    chunk, n = rows["chunk"][0].as_py(), min(rows.num_rows, size)
    if chunk > 0 and n <= overlap:
        return None
    return rows.slice(0, n), chunk, rows.num_rows > size


def _process_chunks(frames: DataFrame, configs: list[WaveConfig], fps: float, series: Key,
                    x: str) -> tuple[DataFrame, int]:
    """Cut, and clean each chunk under every configuration: one shuffle before the kernel.

    A chunk has a fixed number of frames, so a task holds a fixed amount whatever the series.
    """
    (size, overlap), by = configs[0].chunking(fps), keys(series)
    step = max(1, size - overlap)
    cut = _cut(frames, size, overlap, series, x)
    schema = T.StructType([cut.schema[c] for c in (*by, "frame_idx", "pos", "chunk")])
    for name, kind in (("start", T.LongType()), ("end", T.LongType()), ("fade_in", T.BooleanType()),
                       ("fade_out", T.BooleanType()), ("config_id", T.IntegerType())):
        schema = schema.add(name, kind)
    out_schema = to_arrow_schema(schema)

    def clean(rows):
        import numpy as np
        import pyarrow as pa
        found = _chunk_rows(rows, size, overlap)
        if found is None:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema})
        rows, chunk, more = found
        n, start, raw, parts, stages = rows.num_rows, chunk * step, rows["pos"].to_numpy(), [], kernels.Stages()
        same = lambda v, kind: pa.array(np.full(n, v), kind)
        for c, config in enumerate(configs):
            values, _ = kernels.clean_wave(raw, fps, config, stages)
            columns = [rows[name].combine_chunks() if name != "pos" else pa.array(values, pa.float32())
                       for name in (*by, "frame_idx", "pos", "chunk")]
            parts.append(pa.Table.from_arrays([
                *columns, same(start, pa.int64()), same(start + n, pa.int64()), same(chunk > 0, pa.bool_()),
                same(more, pa.bool_()), same(c, pa.int32())], schema=out_schema))
        return pa.concat_tables(parts)

    return each_group(cut, [*by, "chunk"], clean, schema), overlap


def _chunk_stats(frames: DataFrame, config: WaveConfig, fps: float, series: Key, x: str) -> DataFrame:
    """One row per chunk: its end and what the clean-up did there. No frame leaves the kernel."""
    (size, overlap), by = config.chunking(fps), keys(series)
    step = max(1, size - overlap)
    cut = _cut(frames, size, overlap, series, x)
    schema = T.StructType([cut.schema[c] for c in (*by, "chunk")]).add("end", T.LongType()).add("_stats", T.StringType())
    out_schema = to_arrow_schema(schema)

    def tell(rows):
        import pyarrow as pa
        found = _chunk_rows(rows, size, overlap)
        if found is None:
            return pa.table({f.name: pa.array([], f.type) for f in out_schema})
        rows, chunk, _ = found
        _, stats = kernels.clean_wave(rows["pos"].to_numpy(), fps, config)
        first = rows.slice(0, 1)
        return pa.Table.from_arrays([*[first[c].combine_chunks() for c in (*by, "chunk")],
                                     pa.array([chunk * step + rows.num_rows], pa.int64()),
                                     pa.array([kernels.stats_json(stats, chunk * step)])], schema=out_schema)

    return each_group(cut, [*by, "chunk"], tell, schema)


def _blend_overlaps(out: DataFrame, size: int, overlap: int, series: Key) -> DataFrame:
    """One value per frame. A frame that only one chunk holds is final; only overlaps are shuffled and blended."""
    step = max(1, size - overlap)
    out = stored(out, "cleaned")                          # read twice below; a chunk is cleaned once
    i = F.col("frame_idx")
    shared = ((i - F.col("start") < overlap) & F.col("fade_in")) | ((F.col("frame_idx") >= F.col("start") + step) & F.col("fade_out"))
    alone = out.where(~shared).select(*keys(series), "frame_idx", clip01(F.col("pos").cast("double")).alias("pos"))
    return alone.unionByName(taper_blend(out.where(shared), overlap, series=series).select(*alone.columns))


# names of the statistics: fixed values
STATS_SCHEMA = ("num_samples bigint, num_troughs bigint, num_normalized_cycles bigint, "
                "num_gradient_segments bigint, num_cycle_samples bigint, num_gradient_samples bigint, "
                "num_clipped_samples bigint, gradient_low_threshold double, gradient_high_threshold double, "
                "cycle_segments array<array<bigint>>, gradient_segments array<array<bigint>>")
COUNTS = ("num_troughs", "num_normalized_cycles", "num_gradient_segments", "num_cycle_samples",
          "num_gradient_samples", "num_clipped_samples")


def postprocess(frames: DataFrame, fps: float, config: WaveConfig = WaveConfig(), x: str = "pos", *,
                series: Key = "series_id") -> DataFrame:
    """Clean every series. The unit of work is one chunk, whatever the length of the series."""
    out, overlap = _process_chunks(frames, [config], fps, series, x)
    return _blend_overlaps(out, config.chunking(fps)[0], overlap, series)


def postprocess_stats(frames: DataFrame, fps: float, config: WaveConfig = WaveConfig(), x: str = "pos", *,
                      series: Key = "series_id") -> DataFrame:
    """What the clean-up did per series. Counts sum over chunks (overlaps count twice), the
    thresholds are the largest of any chunk."""
    rows = _chunk_stats(frames, config, fps, series, x).select(
        *keys(series), "chunk", "end", F.from_json("_stats", STATS_SCHEMA).alias("s"))
    return rows.groupBy(*keys(series)).agg(
        F.max("end").cast("bigint").alias("num_samples"), F.count("*").alias("num_chunks"),
        *[F.sum(f"s.{c}").alias(c) for c in COUNTS],
        F.max("s.gradient_low_threshold").alias("gradient_low_threshold"),
        F.max("s.gradient_high_threshold").alias("gradient_high_threshold"))


def postprocess_segments(frames: DataFrame, fps: float, config: WaveConfig = WaveConfig(), x: str = "pos", *,
                         series: Key = "series_id") -> DataFrame:
    """The segments the clean-up changed, one row each: kind, chunk and ``[start, end)``."""
    rows = _chunk_stats(frames, config, fps, series, x).select(
        *keys(series), "chunk", F.from_json("_stats", STATS_SCHEMA).alias("s"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s.{k}_segments").alias("list"))
                      for k in ("cycle", "gradient")])
    rows = rows.select(*keys(series), "chunk", F.explode(kinds).alias("k"))
    rows = rows.select(*keys(series), "chunk", F.col("k.kind").alias("kind"), F.explode("k.list").alias("seg"))
    return rows.select(*keys(series), "chunk", "kind", F.col("seg")[0].alias("start"), F.col("seg")[1].alias("end"))


def postprocess_sweep(frames: DataFrame, fps: float, configs: list[WaveConfig], x: str = "pos", *,
                      series: Key = "series_id") -> DataFrame:
    """Many configurations over the same series in one job, keyed by ``config_id``.

    They share the chunk layout, so the frames are read, cut and shuffled once, and within a chunk every stage (low-pass, troughs,
    cycles, smoothing, slopes, stretching) runs once for all configurations that agree on the settings that lead to it.
    """
    if len({c.chunking(fps) for c in configs}) != 1:
        raise ValueError("all configurations of a sweep must share chunk length and overlap")
    out, overlap = _process_chunks(frames, configs, fps, series, x)
    return _blend_overlaps(out, configs[0].chunking(fps)[0], overlap, ["config_id", *keys(series)])
