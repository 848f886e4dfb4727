"""Differences, error metrics, label audits and feature statistics."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .blocks import BLOCK_FRAMES, Key, attach, block_window, halo_columns, keys, own_rows, with_halo
from .order_stats import exact_quantile

REGRESSION_METRICS = ("pos_mse", "pos_mae", "event_mse", "active_mse", "active_mae", "vel_mse", "vel_mae",
                      "acc_mse", "acc_mae", "spec_mse", "activity_mean")
BENCHMARK_METRICS = ("pos_mse", "event_mse", "active_mse", "vel_mse", "vel_mae", "acc_mae", "spec_mse",
                     "pred_mean", "pred_std")


# ---------------------------------------------------------------- column formulas over a block window


def _lag(x: str, n: int, w: W) -> Column:
    return F.lag(x, n).over(w)


def diff1(x: str, w: W) -> Column:
    return F.coalesce(F.col(x) - _lag(x, 1, w), F.lit(0.0))


def diff2(x: str, w: W) -> Column:
    return F.coalesce(F.col(x) - F.lit(2.0) * _lag(x, 1, w) + _lag(x, 2, w), F.lit(0.0))


def activity(d1: Column, d2: Column, gain: float = 1.0, power: float = 1.0) -> Column:
    a = F.abs(d1) + F.lit(0.5) * F.abs(d2)
    if power != 1.0:
        a = F.pow(a, F.lit(power))
    return F.lit(float(gain)) * a if gain != 1.0 else a


def moving_average(x: str, k: int, w: W, order: str = "frame_idx") -> Column:
    """Centred mean of ``k`` values; beyond the ends of the series the end value repeats.

    Valid for own rows of a halo of ``k // 2`` over a dense index: the rows that are missing then lie
    before index 0 or after the last one in reach.
    """
    if k % 2 == 0:
        raise ValueError("the window must be odd")
    r = k // 2
    near = F.sum(x).over(w.rowsBetween(-r, r))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    missing_before = F.greatest(F.lit(0), F.lit(r) - F.col(order))
    missing_after = F.greatest(F.lit(0), F.lit(r) + F.col(order) - F.last(order).over(whole))
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    return (near + missing_before * first + missing_after * last) / F.lit(float(k))


def with_differences(frames: DataFrame, x: str = "pos", *, gain: float = 1.0, power: float = 1.0,
                     series: Key = "series_id", block: int = BLOCK_FRAMES, keep_block: bool = False) -> DataFrame:
    """First and second difference and activity of every frame."""
    w = block_window(series)
    return halo_columns(frames, [("diff1", diff1(x, w)), ("diff2", diff2(x, w)),
                                 ("activity", activity(F.col("diff1"), F.col("diff2"), gain, power))],
                        2, 0, series=series, block=block, keep_block=keep_block)


def event_weights(frames: DataFrame, x: str = "pos", *, gain: float = 3.0, power: float = 1.0,
                  series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Weights ``1 + activity`` scaled to mean one in each series."""
    d = with_differences(frames, x, gain=gain, power=power, series=series, block=block, keep_block=True)
    means = d.groupBy(*keys(series)).agg((F.max("frame_idx") + 1).alias("_n"), F.avg(1.0 + F.col("activity")).alias("_m"))
    out = attach(d, means, length="_n", series=series, block=block, blocked=True)
    return (out.withColumn("weight", (1.0 + F.col("activity")) / F.greatest(F.col("_m"), F.lit(1e-6)))
               .drop("_n", "_m"))


def smoothed(frames: DataFrame, k: int, x: str = "pos", *, out: str = "smooth", series: Key = "series_id",
             block: int = BLOCK_FRAMES) -> DataFrame:
    w = block_window(series)
    return halo_columns(frames, [(out, moving_average(x, k, w))], k // 2, k // 2, series=series, block=block)


def align_series(a: DataFrame, b: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Frames present on both sides; for dense indices that truncates to the shorter series."""
    return a.join(b, [*keys(series), "frame_idx"])


# ---------------------------------------------------------------- regression metrics


def _frame_errors(pairs: DataFrame, k: int, gain: float, power: float, series: Key, block: int) -> DataFrame:
    w = block_window(series)
    r = k // 2
    base = pairs.select(*keys(series), "frame_idx", F.col("pred").cast("double").alias("pred"),
                        F.col("target").cast("double").alias("target"))
    cols = with_halo(base, max(r, 2), r, block=block)
    for name, column in [
        ("_v", diff1("pred", w) - diff1("target", w)),
        ("_a", diff2("pred", w) - diff2("target", w)),
        ("_act", activity(diff1("target", w), diff2("target", w), gain, power)),
        ("_h", (F.col("pred") - moving_average("pred", k, w)) - (F.col("target") - moving_average("target", k, w))),
    ]:
        cols = cols.withColumn(name, column)
    return own_rows(cols.withColumn("_e", F.col("pred") - F.col("target")), keep_block=True)


def regression_metrics(pairs: DataFrame, *, kernel: int = 15, gain: float = 3.0, power: float = 1.0,
                       active_quantile: float = 0.8, series: Key = "series_id",
                       block: int = BLOCK_FRAMES) -> DataFrame:
    """The eleven error metrics of ``pred`` against ``target``, one row per series.

    One halo shuffle gives all per-frame errors, one hash aggregation folds them. The activity
    threshold is an exact quantile that never gathers a series (see ``exact_quantile``).
    """
    by = keys(series)
    errors = _frame_errors(pairs, kernel, gain, power, series, block)
    w = block_window(series)
    act = halo_columns(pairs.select(*by, "frame_idx", F.col("target").cast("double").alias("target")),
                       [("_act", activity(diff1("target", w), diff2("target", w), gain, power))], 2, 0,
                       series=series, block=block)
    cut = exact_quantile(act, F.col("_act"), active_quantile, series=series, out="_cut", length="_len", weighted=True)
    errors = attach(errors, cut, length="_len", series=series, block=block, blocked=True)

    e, act_, sq = F.col("_e"), F.col("_act"), F.col("_e") * F.col("_e")
    weight = 1.0 + act_
    active = act_ >= F.col("_cut")
    n_active = F.greatest(F.sum(active.cast("int")), F.lit(1))
    return errors.groupBy(*by).agg(
        F.avg(sq).alias("pos_mse"), F.avg(F.abs(e)).alias("pos_mae"),
        (F.avg(sq * weight) / F.greatest(F.avg(weight), F.lit(1e-6))).alias("event_mse"),
        (F.sum(F.when(active, sq).otherwise(0.0)) / n_active).alias("active_mse"),
        (F.sum(F.when(active, F.abs(e)).otherwise(0.0)) / n_active).alias("active_mae"),
        F.avg(F.col("_v") * F.col("_v")).alias("vel_mse"), F.avg(F.abs("_v")).alias("vel_mae"),
        F.avg(F.col("_a") * F.col("_a")).alias("acc_mse"), F.avg(F.abs("_a")).alias("acc_mae"),
        F.avg(F.col("_h") * F.col("_h")).alias("spec_mse"), F.avg(act_).alias("activity_mean"))


def highfreq_mse(pairs: DataFrame, kernel: int = 15, *, series: Key = "series_id",
                 block: int = BLOCK_FRAMES) -> DataFrame:
    errors = _frame_errors(pairs, kernel, 1.0, 1.0, series, block)
    return errors.groupBy(*keys(series)).agg(F.avg(F.col("_h") * F.col("_h")).alias("spec_mse"))


def active_frames(frames: DataFrame, x: str = "pos", *, q: float = 0.8, gain: float = 3.0,
                  series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Frames with the flag ``active``: activity at or above the series' own quantile."""
    d = with_differences(frames, x, gain=gain, series=series, block=block, keep_block=True)
    cut = exact_quantile(d, F.col("activity"), q, series=series, out="threshold", length="_len", weighted=True)
    out = attach(d, cut, length="_len", series=series, block=block, blocked=True)
    return out.withColumn("active", F.col("activity") >= F.col("threshold")).drop("_len")


def masked_mean(value: Column, mask: Column) -> Column:
    return (F.sum(F.when(mask, value).otherwise(0.0))
            / F.greatest(F.sum(mask.cast("int")), F.lit(1)))


def composite_error(metrics: DataFrame, velocity: float, acceleration: float) -> DataFrame:
    """Weighted sum of position, velocity and acceleration error (the latter two times 60)."""
    position = max(0.0, 1.0 - velocity - acceleration)
    if velocity + acceleration > 1.0:
        total = velocity + acceleration
        velocity, acceleration = velocity / total, acceleration / total
    return metrics.withColumn("composite", F.col("pos_mse") * F.lit(position)
                              + F.lit(velocity) * F.col("vel_mse") * F.lit(60.0)
                              + F.lit(acceleration) * F.col("acc_mse") * F.lit(60.0))


SCENE_METRICS = {"mse": "pos_mse", "event_mse": "event_mse", "active_mse": "active_mse",
                 "vel_mae": "vel_mae", "acc_mae": "acc_mae", "spec_mse": "spec_mse"}


def scene_evaluation(labels: DataFrame, predictions: DataFrame, *, series: Key = "series_id",
                     kernel: int = 15) -> DataFrame:
    """The six metrics kept per scene; scenes missing on either side drop out of the join."""
    pairs = align_series(labels.withColumnRenamed("pos", "target"),
                         predictions.withColumnRenamed("pos", "pred"), series=series)
    m = regression_metrics(pairs, kernel=kernel, series=series)
    return m.select(*keys(series), *[F.col(src).alias(name) for name, src in SCENE_METRICS.items()])


def upsert_metrics(stored: DataFrame, fresh: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Fresh rows replace stored ones of the same series."""
    return stored.join(fresh, keys(series), "left_anti").unionByName(fresh)


# ---------------------------------------------------------------- series statistics and audits


def label_stats(frames: DataFrame, x: str = "pos", *, series: Key = "series_id") -> DataFrame:
    return frames.groupBy(*keys(series)).agg(
        F.count("*").alias("frames"), F.stddev_pop(x).alias("label_std"),
        (F.max(x) - F.min(x)).alias("label_range"), F.avg(x).alias("label_mean"),
        F.min(x).alias("label_min"), F.max(x).alias("label_max"))


def label_mismatch(stored: DataFrame, regenerated: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Stored labels against labels made again from their source, over the common frames."""
    pair = align_series(stored.select(*keys(series), "frame_idx", F.col("pos").alias("_s")),
                        regenerated.select(*keys(series), "frame_idx", F.col("pos").alias("_r")), series=series)
    d = F.col("_s") - F.col("_r")
    flat = (F.col("_s") <= 1e-4) | (F.col("_s") >= 1.0 - 1e-4)
    stats = pair.groupBy(*keys(series)).agg(
        F.stddev_pop("_s").alias("stored_std"), F.avg(flat.cast("double")).alias("flat_frac"),
        F.sqrt(F.avg(d * d)).alias("rmse"), F.max(F.abs(d)).alias("max_abs"))
    every = stored.select(*keys(series)).union(regenerated.select(*keys(series))).distinct()
    # a series without common frames counts as flat and as agreeing
    return every.join(stats, keys(series), "left").na.fill(
        {"stored_std": 0.0, "flat_frac": 1.0, "rmse": 0.0, "max_abs": 0.0})


def rank_mismatches(findings: DataFrame, top: int | None = 25, *, similarity: str = "similarity",
                    offset: str | None = None, series: Key = "series_id") -> DataFrame:
    """The ``top`` worst findings (all for ``None``): offset, then error, then poor name match, then flatness."""
    by_offset = F.coalesce(F.abs(F.col(offset)), F.lit(0.0)) if offset else F.lit(0.0)
    out = findings.orderBy(by_offset.desc(), F.desc("rmse"), (1.0 - F.col(similarity)).desc(),
                            F.desc("flat_frac"), *[F.asc(c) for c in keys(series)])
    return out if top is None else out.limit(top)


def label_audit(segments: DataFrame, actions: DataFrame, stored: DataFrame, regenerated: DataFrame, reviews: DataFrame | None = None, *,
                offsets: DataFrame | None = None, status: str | None = None, ratio: bool = False, scene: Key = "scene_id",
                series: Key = "series_id") -> DataFrame:
    """Stored labels of every segment held against their script: one finding per segment.

    ``segments`` has video_path and script_path, ``actions`` the control points by scene, ``regenerated`` the labels made again
    (``resample.extract_labels``), ``reviews`` the status (``pending`` where there is none), ``offsets`` the offset_sec and
    score of ``best_offset``. ``status`` keeps one status only. Adds to ``label_mismatch``: status, action_count,
    similarity of the two names, offset_sec and score (null without ``offsets``). Rank with ``rank_mismatches``.
    """
    from ..functions import strings as S
    by = keys(series)
    seg = segments.select(*by, *keys(scene), "video_path", "script_path")
    if reviews is not None:
        seg = seg.join(reviews.select(*by, "status"), by, "left")
    seg = seg.withColumn("status", F.coalesce("status", F.lit("pending")) if reviews is not None else F.lit("pending"))
    seg = seg if status is None else seg.where(F.col("status") == status)
    counts = actions.groupBy(*keys(scene)).agg(F.count("*").alias("action_count"))
    tokens = [S.name_tokens(F.col(c)) for c in ("video_path", "script_path")]
    named = F.when(F.col("video_path").isNull(), 0.0).otherwise(
        S.name_similarity(F.col("video_path"), F.col("script_path"), *tokens, ratio=ratio))
    out = seg.join(counts, keys(scene), "left").withColumn("action_count", F.coalesce("action_count", F.lit(0)))
    out = out.join(label_mismatch(stored, regenerated, series=series), by).withColumn("similarity", named)
    if offsets is None:
        return out.withColumns({"offset_sec": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
    return out.join(offsets.select(*by, "offset_sec", "score"), by, "left")


def best_offset(pairs: DataFrame, max_lag: int, fps: float = 1.0, *, a: str = "a", b: str = "b",
                series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """Lag of ``b`` against ``a`` with the least mean absolute difference; ties to the smallest lag.

    All lags come from one halo shuffle: every lag is one aggregate over a window offset, so
    rows are not multiplied by the number of lags.
    """
    w = block_window(series)
    lags = list(range(-max_lag, max_lag + 1))
    shifted = halo_columns(pairs.select(*keys(series), "frame_idx", a, b),
                           [(f"_d{n}", F.abs(F.col(a) - F.lead(b, lag).over(w))) for n, lag in enumerate(lags)],
                           max_lag, max_lag, series=series, block=block)
    means = shifted.groupBy(*keys(series)).agg(*[F.avg(f"_d{n}").alias(f"_d{n}") for n in range(len(lags))])
    options = F.array_compact(F.array(*[
        F.when(F.col(f"_d{n}").isNotNull(), F.struct(F.col(f"_d{n}").alias("score"), F.lit(lag).alias("lag")))
        for n, lag in enumerate(lags)]))
    best = F.array_min(options)
    return means.select(*keys(series), best["lag"].alias("lag"),
                        (best["lag"] / F.lit(float(fps))).alias("offset_sec"), best["score"].alias("score"))


def pred_vs_baseline(pairs: DataFrame, *, series: Key = "series_id") -> DataFrame:
    d = F.col("pred") - F.col("target")
    return pairs.groupBy(*keys(series)).agg(
        F.count("*").alias("frames"), F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs"),
        (F.avg(d * d) < 1e-6).alias("identical"))


def values_close(a: DataFrame, b: DataFrame, atol: float = 1e-6, *, series: Key = "series_id") -> DataFrame:
    """Same frames on both sides and every difference within ``atol``."""
    by = [*keys(series), "frame_idx"]
    full = a.select(*by, F.col("pos").alias("_a")).join(b.select(*by, F.col("pos").alias("_b")), by, "full")
    near = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= F.lit(atol), F.lit(False))
    return full.groupBy(*keys(series)).agg(F.bool_and(near).alias("close"))


def detection_rate(keypoints: DataFrame, threshold: float = 0.25, *, series: Key = "series_id") -> DataFrame:
    """Share of frames whose first slot has a point above the threshold."""
    seen = F.exists("kp", lambda p: p["conf"] > threshold)
    return keypoints.where(F.col("slot") == 0).groupBy(*keys(series)).agg(
        F.avg(seen.cast("double")).alias("detection_rate"))


# ---------------------------------------------------------------- summaries over tables


def feature_stats(vectors: DataFrame, vector: str = "v", *, width: int | Column | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Mean and floored standard deviation per dimension; vectors of another width are left out.

    One pass with map-side aggregation: what is shuffled is one row per dimension and task.
    """
    if width is not None:
        vectors = vectors.where(F.size(vector) == width)
    dims = vectors.select(*by, F.posexplode(vector).alias("dim", "_x"))
    dims = dims.withColumn("_x", F.col("_x").cast("double"))
    var = F.pow(F.stddev_pop("_x"), F.lit(2.0))
    return dims.groupBy(*by, "dim").agg(
        F.avg("_x").alias("mean"),
        F.greatest(F.sqrt(F.greatest(var, F.lit(1e-12))), F.lit(1e-6)).alias("std"), F.count("*").alias("n"))


def benchmark_summary(metrics: DataFrame, names: Sequence[str] = BENCHMARK_METRICS, *,
                      label: Key = "label") -> DataFrame:
    """Count, mean and population deviation of every metric per label, as a long table."""
    long = metrics.unpivot(keys(label), [c for c in names if c in metrics.columns], "metric", "value")
    return long.groupBy(*keys(label), "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def augmentation_rates(windows: DataFrame, names: Sequence[str]) -> DataFrame:
    long = windows.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [], list(names), "augmentation", "hit")
    return long.groupBy("augmentation").agg(F.avg("hit").alias("rate"), F.count("*").alias("windows"))


def split_totals(splits: DataFrame, stats: DataFrame, *, series: Key = "series_id") -> DataFrame:
    return splits.join(stats, keys(series)).groupBy("split").agg(
        F.count("*").alias("scenes"), F.sum("frames").alias("frames"))
