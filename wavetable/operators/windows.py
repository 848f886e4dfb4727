"""Fixed-length windows over series: index, cut, score with a user model, blend back."""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import BLK, OWN, Key, explode_range, keys, range_join, spread, with_halo
from ..session import cut_lineage
from .order_stats import seeded_hash, smallest_by


BLOCK_PREDICT = 8192


def window_index(lengths: DataFrame, seq: int = 120, stride: int = 60, *, n: str = "n") -> DataFrame:
    """Starts 0, stride, ... of the windows that fit; no tail."""
    out = explode_range(lengths.where(F.col(n) >= seq), F.lit(0), F.floor((F.col(n) - seq) / F.lit(stride)), "_k",
                        rebalance=True)
    return out.withColumn("start", (F.col("_k") * stride).cast("int")).drop("_k")


def window_index_full(lengths: DataFrame, seq: int = 120, stride: int = 60, *, n: str = "n") -> DataFrame:
    """As ``window_index`` plus a last window at ``n - seq`` when the end is missed. A series shorter
    than a window gets one; ``length`` tells how many of its frames are real."""
    fits = window_index(lengths, seq, stride, n=n)
    left = (F.col(n) - seq) % stride
    tail = lengths.where((F.col(n) > seq) & (left != 0)).withColumn("start", (F.col(n) - seq).cast("int"))
    short = lengths.where((F.col(n) > 0) & (F.col(n) < seq)).withColumn("start", F.lit(0))
    out = fits.unionByName(tail).unionByName(short)
    return out.withColumn("length", F.least(F.col(n), F.lit(seq)).cast("int"))


def assemble_features(labels: DataFrame, required: Sequence[DataFrame] = (),
                      optional: dict[str, tuple[DataFrame, Column]] | None = None, *,
                      series: Key = "series_id") -> DataFrame:
    """Labels with the feature columns of other frame tables. Frames without a required feature
    drop out, an absent optional one takes its default."""
    by = [*keys(series), "frame_idx"]
    out = labels
    for table in required:
        out = out.join(table, by)
    for name, (table, default) in (optional or {}).items():
        out = out.join(table, by, "left").withColumn(name, F.coalesce(F.col(name), default))
    return out


def materialize_windows(frames: DataFrame, index: DataFrame, columns: Sequence[str] = ("pos",), seq: int = 120, *,
                        pad: dict[str, Column] | None = None, series: Key = "series_id",
                        block: int | None = None) -> DataFrame:
    """One row per window with an array per column, in frame order.

    Windows meet frames through the blocks they touch; all windows of a block are held against all its frames, so a block
    is four windows long unless said, and the work grows with the frames. Windows are spread over all shuffle partitions, as
    what is done with them is heavy per byte. Only complete windows are returned, unless ``pad`` gives the value to fill
    short ones with.
    """
    block = block or 4 * seq
    by = keys(series)
    ranges = index.select(*by, "start", (F.col("start") + seq).alias("_end"))
    hit = range_join(frames.select(*by, "frame_idx", *columns), ranges, at="frame_idx", lo="start", hi="_end",
                     series=series, block=block)
    item = F.struct((F.col("frame_idx") - F.col("start")).alias("i"), *columns)
    out = spread(hit, *by, "start").groupBy(*by, "start").agg(F.sort_array(F.collect_list(item)).alias("_w"))
    if pad is None:
        out = out.where(F.size("_w") == seq)
    arrays = []
    for c in columns:
        values = F.col(f"_w.{c}")
        if pad is not None:
            values = F.concat(values, F.array_repeat(pad[c], F.lit(seq) - F.size("_w")))
        arrays.append(values.alias(c))
    return out.select(*by, "start", F.size("_w").alias("length"), *arrays)


# ---------------------------------------------------------------- scoring


class LinearScorer:
    """Default model: weighted sum of the features of a frame. Also the contract of a scorer:
    a function from ``[batch, time(, features)]`` to ``[batch, time]`` or ``[batch, channel, time]``."""

    def __init__(self, weights: Sequence[float] = (1.0,), bias: float = 0.0):
        self.weights, self.bias = tuple(weights), bias

    def __call__(self, x):
        import numpy as np
        return (x * self.weights[0] if x.ndim == 2 else x @ np.asarray(self.weights)) + self.bias


def score_windows(windows: DataFrame, scorer: Callable, column: str = "pos", *,
                  series: Key = "series_id") -> DataFrame:
    """Apply a batch model to every window in Arrow batches; ``pred`` is an array per channel."""
    kept = [*keys(series), "start", "length"]
    schema = T.StructType([*windows.select(*kept).schema.fields,
                           T.StructField("pred", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        import numpy as np
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([np.stack(v) if isinstance(v[0], np.ndarray) else np.asarray(v) for v in pdf[column]],
                         dtype=np.float64)
            y = np.asarray(scorer(x), dtype=np.float64)
            if y.ndim == 2:
                y = y[:, None, :]
            if y.ndim != 3:
                raise ValueError(f"unsupported prediction shape {y.shape}")
            yield pdf[kept].assign(pred=[[c.tolist() for c in w] for w in y])

    return windows.select(*kept, column).mapInPandas(run, schema)


def blend_weight(i: Column, seq: int) -> Column:
    """Triangular weight of position ``i`` in a window, never zero."""
    if seq == 1:
        return F.lit(1.01)
    return F.lit(1.0) - F.abs(F.lit(2.0) * i / F.lit(float(seq - 1)) - F.lit(1.0)) + F.lit(0.01)


def blend_windows(scored: DataFrame, seq: int, *, series: Key = "series_id") -> DataFrame:
    """Overlapping window predictions to one value per frame and channel."""
    by = keys(series)
    rows = scored.select(*by, "start", "length", F.posexplode("pred").alias("channel", "_p"))
    rows = rows.select(*by, "start", "length", "channel", F.posexplode("_p").alias("_i", "_v"))
    rows = rows.where(F.col("_i") < F.col("length"))
    w = blend_weight(F.col("_i"), seq)
    return (rows.groupBy(*by, (F.col("start") + F.col("_i")).alias("frame_idx"), "channel")
                .agg((F.sum(F.col("_v") * w) / F.sum(w)).alias("pos")))


def sliding_predict(frames: DataFrame, scorer: Callable, column: str = "pos", seq: int = 120, stride: int = 60, *,
                    series: Key = "series_id", block: int = BLOCK_PREDICT) -> DataFrame:
    """Index, cut, score and blend; every frame of every series gets a prediction per channel.

    Same result as the single steps, in one shuffle: a stretch of ``block`` frames with a window
    length on each side sees every window that touches its own frames, so windows are neither
    shuffled nor stored and blending stays inside the task. A series ends where the halo does.
    """
    by = keys(series)
    data = with_halo(frames.select(*by, "frame_idx", F.col(column).alias("_x")), seq, seq, block=block).drop(OWN)
    kinds = frames.select(*by).schema
    schema = T.StructType([*kinds.fields, T.StructField("frame_idx", T.IntegerType()),
                           T.StructField("channel", T.IntegerType()), T.StructField("pos", T.DoubleType())])

    def predict(rows):
        import numpy as np
        import pyarrow as pa
        idx = rows["frame_idx"].to_numpy()
        order = np.argsort(idx, kind="stable")
        idx = idx[order]
        if len(idx) > 1 and (np.diff(idx) != 1).any():
            raise ValueError("frame indices must be dense")
        raw = rows["_x"].combine_chunks()
        x = raw.flatten().to_numpy(zero_copy_only=False).reshape(len(idx), -1) if pa.types.is_list(raw.type) \
            else raw.to_numpy(zero_copy_only=False)
        x = np.asarray(x, dtype=np.float64)[order]
        base, top = int(idx[0]), int(idx[-1]) + 1
        lo = rows[BLK][0].as_py() * block
        hi = min(lo + block, top)
        first = max(0, -(-(lo - seq + 1) // stride) * stride)
        starts = [s for s in range(first, hi, stride) if s + seq <= top]
        if top < lo + block + seq and top > lo:          # the series ends here
            if top < seq:
                starts, x = [0], np.concatenate([x, np.zeros((seq - top, *x.shape[1:]))])
            elif (top - seq) % stride:
                starts.append(top - seq)
        empty = pa.table({f.name: pa.array([], f.type) for f in out_schema})
        if hi <= lo or not starts:
            return empty
        weight = 1.0 - np.abs(2.0 * np.arange(seq) / max(seq - 1, 1) - 1.0) + 0.01 if seq > 1 else np.array([1.01])
        total, norm = None, np.zeros(top - base + seq)
        for b in range(0, len(starts), 256):
            part = starts[b:b + 256]
            y = np.asarray(scorer(np.stack([x[s - base:s - base + seq] for s in part])), dtype=np.float64)
            y = y[:, None, :] if y.ndim == 2 else y
            if y.ndim != 3:
                raise ValueError(f"unsupported prediction shape {y.shape}")
            total = np.zeros((y.shape[1], len(norm))) if total is None else total
            for s, p in zip(part, y):
                total[:, s - base:s - base + seq] += p * weight
                norm[s - base:s - base + seq] += weight
        own = np.arange(lo, hi)
        hit = own[norm[own - base] > 0]
        channels = total.shape[0]
        values = total[:, hit - base] / norm[hit - base]
        n = len(hit) * channels
        fixed = [pa.array([rows[c][0].as_py()] * n, out_schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*fixed, pa.array(np.tile(hit, channels).astype(np.int32)),
                                     pa.array(np.repeat(np.arange(channels), len(hit)).astype(np.int32)),
                                     pa.array(values.reshape(-1))], schema=out_schema)

    out_schema = to_arrow_schema(schema)
    return spread(data, *by, BLK).groupBy(*by, BLK).applyInArrow(predict, schema)


# ---------------------------------------------------------------- subsets


def epoch_subset(index: DataFrame, maximum: int, seed: int = 42, epoch: int = 0, *, shuffle: bool = True,
                 series: Key = "series_id", hash_column: str | None = None) -> DataFrame:
    """``maximum`` windows of an epoch: a seeded draw that changes with the epoch, or the first ones."""
    ids = [*keys(series), "start"]
    if not shuffle:
        from .catalog import numbered
        return numbered(index, ids, "_k").where(F.col("_k") <= maximum).drop("_k")
    if hash_column is None:
        index = index.withColumn("_h", seeded_hash(seed + epoch, *ids))
    out = smallest_by(index, hash_column or "_h", F.lit(maximum), ties=ids)
    return out if hash_column else out.drop("_h")


def sample_windows(index: DataFrame, count: int = 10, seed: int = 42, explicit: DataFrame | None = None, *,
                   series: Key = "series_id") -> DataFrame:
    """The same seeded sample for every model, or the windows named in ``explicit``."""
    ids = [*keys(series), "start"]
    if explicit is not None:
        return index.join(explicit.select(*ids), ids, "left_semi")
    drawn = smallest_by(index.withColumn("_h", seeded_hash(seed, *ids)), "_h",
                        F.least(F.col("_total"), F.lit(max(1, count))), ties=ids)
    return drawn.drop("_h")


def unknown_windows(index: DataFrame, explicit: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Explicitly named windows that do not exist."""
    return explicit.join(index, [*keys(series), "start"], "left_anti")


# ---------------------------------------------------------------- features of vectors


def normalize_features(vectors: DataFrame, stats: DataFrame, vector: str = "v") -> DataFrame:
    """``(x - mean) / (std + 1e-8)`` where the width agrees with the statistics.

    The statistics fold into one row, as long as a vector is wide, which joins on that width.
    """
    folded = stats.groupBy().agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "std"))).alias("_s"))
    folded = folded.withColumn("_width", F.size("_s"))
    out = vectors.withColumn("_width", F.size(vector)).join(F.broadcast(folded), "_width", "left")
    scaled = F.zip_with(vector, "_s", lambda x, s: (x - s["mean"]) / (s["std"] + F.lit(1e-8)))
    plain = F.transform(vector, lambda x: x.cast("double"))
    return out.withColumn(vector, F.when(F.col("_s").isNull(), plain).otherwise(scaled)).drop("_s", "_width")


def flatten_slots(slots: Column, max_persons: int) -> Column:
    """First slots of a frame as one vector."""
    return F.flatten(F.slice(slots, 1, max_persons))


# ---------------------------------------------------------------- choosing segments


def choose_segments(videos: DataFrame, segment_sec: float, count: int, seed: int = 42, *,
                    scene: str = "scene_id", duration: str = "duration") -> DataFrame:
    """``count`` seeded starts per video, pairwise at least a segment apart, or as many as the video has room for.

    The time that the segments leave over is cut at sorted random points, and the cuts become the gaps: no draw is
    rejected, so a video with room always gives all its starts. Short videos give one start at 0 if they hold half a segment.
    """
    from .order_stats import unit_hash
    room = F.col(duration) - F.lit(float(segment_sec))

    fits = F.least(F.lit(count), F.floor(F.col(duration) / F.lit(float(segment_sec)))).cast("int")
    spare = F.col(duration) - fits * F.lit(float(segment_sec))
    none = F.array().cast("array<double>")
    cuts = F.array_sort(F.transform(F.sequence(F.lit(1), fits), lambda k: unit_hash(seed, F.col(scene), k) * spare))
    drawn = F.transform(cuts, lambda t, i: t + i * F.lit(float(segment_sec)))
    short = F.when(F.col(duration) >= segment_sec * 0.5, F.array(F.lit(0.0))).otherwise(none)
    starts = F.when(room <= 0, short).otherwise(drawn)
    return videos.select(scene, duration, F.explode(starts).alias("segment_start_sec"))


def choose_segments_by_bin(videos: DataFrame, analysis: DataFrame, bins: DataFrame, segment_sec: float, count: int,
                           blacklist: Sequence[int] = (), seed: int = 42, *, scene: str = "scene_id",
                           duration: str = "duration", target_bins: int = 3) -> DataFrame:
    """Starts from the ``target_bins`` least filled bins, in seeded order without overlap; videos without such
    candidates draw freely.

    ``count`` rounds each take the first remaining candidate of every video by a map-side minimum
    and drop what overlaps it, so no task gathers the candidates of a video. All videos of a batch
    see one snapshot of the bin counts. The candidates and each pick are checkpointed, so the rounds
    do not repeat one another.
    """
    open_bins = bins.where(~F.col("bin_id").isin(*blacklist)) if blacklist else bins
    target = open_bins.orderBy("count", "bin_id").limit(target_bins)
    cand = analysis.join(F.broadcast(target.select("bin_id")), "bin_id", "left_semi")
    cand = cand.groupBy(scene, "start_time_sec").agg(F.min("bin_id").alias("bin_id"))
    with_any = cand.select(scene).distinct()
    free = choose_segments(videos.join(with_any, scene, "left_anti"), segment_sec, count, seed, scene=scene,
                           duration=duration)
    cand = cand.join(videos.select(scene, duration), scene).where(
        F.col("start_time_sec") + F.lit(float(segment_sec)) <= F.col(duration))
    cand = cand.withColumn("_h", seeded_hash(seed, scene, "start_time_sec"))
    cand, picks = cut_lineage(cand), []
    for _ in range(count):
        best = cut_lineage(cand.groupBy(scene).agg(F.min_by(F.struct(duration, "start_time_sec"), F.struct("_h", "start_time_sec")).alias("_b")))
        picks.append(best.select(scene, f"_b.{duration}", F.col("_b.start_time_sec").alias("segment_start_sec")))
        cand = cand.join(best.select(scene, F.col("_b.start_time_sec").alias("_t")), scene)
        cand = cand.where(F.abs(F.col("start_time_sec") - F.col("_t")) >= F.lit(float(segment_sec))).drop("_t")
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out.unionByName(free)


def update_bins(bins: DataFrame, imported: DataFrame) -> DataFrame:
    """Bin counts after a batch of imported segments (column ``bin_id``)."""
    new = imported.where(F.col("bin_id").isNotNull()).groupBy("bin_id").agg(F.count("*").alias("_n"))
    return bins.join(new, "bin_id", "left").select(
        "bin_id", (F.col("count") + F.coalesce("_n", F.lit(0))).alias("count"))
