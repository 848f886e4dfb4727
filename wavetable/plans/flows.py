"""The three flows of the library as one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import catalog as C, curation as U, metrics as M, resample as R, waves as V, windows as G


def import_segments(scenes: DataFrame, files: DataFrame, actions: DataFrame, imported: DataFrame, *,
                    segment_sec: float, count: int, fps: float, min_actions: int = 3, seed: int = 42,
                    kind: str = "pchip", ratio: bool = False, block_ms: float = 86_400_000) -> tuple[DataFrame, DataFrame]:
    """Catalogue to labels: best pair, seeded segments with enough control points, not imported yet.

    ``actions`` is keyed by scene_id. Returns the segments and their frame labels.
    """
    from ..functions.strings import segment_id
    pairs = C.best_pair(scenes, files, ratio=ratio)
    seg = G.choose_segments(pairs, segment_sec, count, seed)
    seg = seg.withColumn("segment_duration_sec", F.lit(float(segment_sec))).withColumn("fps", F.lit(float(fps)))
    seg = seg.withColumn("total_frames", F.lit(int(segment_sec * fps)))
    seg = seg.withColumn("series_id", segment_id(F.col("scene_id"), F.col("segment_start_sec"), F.lit(segment_sec)))
    seg = seg.dropDuplicates(["series_id"]).join(imported.select("series_id"), "series_id", "left_anti")
    enough = C.count_actions(seg, actions, min_actions, block_ms=block_ms).where("enough").select("series_id")
    seg = seg.join(enough, "series_id", "left_semi")
    return seg, R.extract_labels(seg, actions, kind, block_ms=block_ms)


def predict_and_clean(features: DataFrame, scorer: Callable, fps: float, *, column: str = "pos", seq: int = 120,
                      stride: int = 60, config: V.WaveConfig = V.WaveConfig()) -> DataFrame:
    """Window, score, blend, clean up, and give control points."""
    p = G.sliding_predict(features, scorer, column, seq, stride).where(F.col("channel") == 0).drop("channel")
    clean = V.postprocess(p, fps, config)
    return R.frames_to_actions(clean, F.lit(float(fps)))


def evaluate_and_split(labels: DataFrame, predictions: DataFrame, reviews: DataFrame, requested: DataFrame, *,
                       min_std: float = 0.02, min_frames: int = 200, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Metrics, review state and label statistics per series, quality filters, and the split.

    Series that are left out carry the reason and no split.
    """
    stats = M.label_stats(labels)
    scenes = stats.join(reviews.select("series_id", "status", "stage2_status"), "series_id", "left")
    scenes = scenes.na.fill({"status": "pending", "stage2_status": "pending"}).withColumn("has_labels", F.lit(True))
    tagged = U.quality_reasons(U.candidate_reasons(scenes).withColumnRenamed("reason", "_r"), min_std, min_frames)
    tagged = tagged.withColumn("reason", F.coalesce("_r", "reason")).drop("_r")
    kept = tagged.where(F.col("reason").isNull()).select("series_id")
    split = U.train_val_split(kept, requested, ratio, seed)
    metrics = M.scene_evaluation(labels, predictions)
    return (tagged.select("series_id", "frames", "label_std", "status", "reason")
            .join(split, "series_id", "left").join(metrics, "series_id", "left"))


def benchmark_suite(frames: DataFrame, models: dict[str, Callable], *, seq: int = 120, stride: int = 60, count: int = 40,
                    seed: int = 42, explicit: DataFrame | None = None, x: str = "pos", series: str = "series_id") -> DataFrame:
    """Several models on the same windows, drawn by seed or named: score, metrics per window, summary per model."""
    index = G.sample_windows(G.window_index(V.lengths_of(frames), seq, stride), count, seed, explicit)
    cut = G.materialize_windows(frames, index, [x], seq)
    scored = [G.score_windows(cut, model).select(series, "start", F.lit(label).alias("label"), F.element_at("pred", 1).alias("pred"))
              for label, model in models.items()]
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.unionByName(more)
    by = ["label", series, "start"]
    both = rows.join(cut.select(series, "start", F.col(x).alias("target")), [series, "start"])
    both = both.select(*by, F.posexplode(F.arrays_zip("pred", "target")).alias("frame_idx", "z")).select(*by, "frame_idx", "z.pred", "z.target")
    spread = both.groupBy(*by).agg(F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"))
    return M.benchmark_summary(M.regression_metrics(both, series=by).join(spread, by))
