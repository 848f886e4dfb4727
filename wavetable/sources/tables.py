"""Other sources and sinks: catalogue database, listings, frames, splits, reviews, reports, pose lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.curation import review_with_defaults
from .scripts import unescape


def read_catalog(spark: SparkSession, url: str, *, properties: dict[str, str] | None = None,
                 scene_range: tuple[int, int] | None = None, partitions: int = 16) -> tuple[DataFrame, DataFrame]:
    """``scenes`` and ``files`` over JDBC. Filters of ``catalog_pairs`` are pushed to the database;
    with ``scene_range`` the files are read by ``partitions`` connections at once."""
    def table(name, column):
        r = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for k, v in (properties or {}).items():
            r = r.option(k, v)
        if scene_range:
            r = (r.option("partitionColumn", column).option("lowerBound", scene_range[0])
                  .option("upperBound", scene_range[1]).option("numPartitions", partitions))
        return r.load()
    return table("scenes", "id"), table("files", "scene_id")


def list_files(spark: SparkSession, path: str, pattern: str = "*", *, recursive: bool = False) -> DataFrame:
    """Paths below a folder. The content column is not selected, so no file is opened."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return r.load(path).select(F.regexp_replace("path", "^file:", "").alias("path"), "length", "modificationTime")


def write_frames(frames: DataFrame, path: str, *, series: str = "series_id", partitions: int | None = None) -> None:
    """Frames in ``(series, frame)`` order, cut by range: a long series spans files, and row-group
    statistics let a reader skip to a series or a stretch of it."""
    by = [series, "frame_idx"]
    spread = frames.repartitionByRange(partitions, *by) if partitions else frames.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def write_splits(splits: DataFrame, path: str, *, series: str = "series_id") -> None:
    splits.select("split", series).write.partitionBy("split").mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str, *, series: str = "series_id", dtype: str = "string") -> DataFrame:
    return spark.read.schema(f"`{series}` {dtype}, split string").json(path)


def read_split_list(spark: SparkSession, path: str, split: str, *, series: str = "series_id") -> DataFrame:
    """A file that holds one JSON list of ids."""
    text = spark.read.text(path, wholetext=True)
    ids = F.explode(F.from_json("value", "array<string>"))
    return text.select(F.lit(split).alias("split"), ids.alias(series))


def split_or_all(scenes: DataFrame, splits: DataFrame | None, split: str, *, series: str = "series_id") -> DataFrame:
    """Scenes of a split; without a list, every scene."""
    if splits is None:
        return scenes
    return scenes.join(splits.where(F.col("split") == split), series, "left_semi")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Review documents below ``<series>/review.json``; unreadable ones read as defaults."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "review.json").text(path, wholetext=True)
    series = unescape(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    return review_with_defaults(raw.select(series.alias("series_id"), F.col("value").alias("json")))


def write_report_csv(df: DataFrame, path: str, *, first: tuple[str, ...] = ()) -> None:
    """CSV with a header; after the ``first`` columns the rest in name order."""
    rest = sorted(c for c in df.columns if c not in first)
    df.select(*first, *rest).write.option("header", True).mode("overwrite").csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pose_lines(keypoints: DataFrame, threshold: float = 0.25, pad: float = 0.03) -> DataFrame:
    """Text line of slot 0 per frame: box around the visible points, then every point. Frames
    without a visible point are left out."""
    from ..operators.resample import visibility
    seen = F.transform("kp", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"),
                                                visibility(p["conf"], threshold).alias("v")))
    df = keypoints.where(F.col("slot") == 0).withColumn("_k", seen)
    vis = F.filter("_k", lambda p: p["v"] > 0)
    df = df.withColumn("_v", vis).where(F.size("_v") > 0)
    xs, ys = F.transform("_v", lambda p: p["x"]), F.transform("_v", lambda p: p["y"])
    x1, y1 = F.greatest(F.lit(0.0), F.array_min(xs) - pad), F.greatest(F.lit(0.0), F.array_min(ys) - pad)
    x2, y2 = F.least(F.lit(1.0), F.array_max(xs) + pad), F.least(F.lit(1.0), F.array_max(ys) + pad)
    points = F.array_join(F.transform("_k", lambda p: F.format_string("%.6f %.6f %d", p["x"], p["y"], p["v"])), " ")
    box = F.format_string("0 %.6f %.6f %.6f %.6f", (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)
    return df.select("series_id", "frame_idx", F.concat_ws(" ", box, points).alias("line"))


def export_pose_lines(keypoints: DataFrame, path: str, threshold: float = 0.25) -> None:
    lines = pose_lines(keypoints, threshold)
    lines.select("series_id", F.format_string("%s_%05d\t%s", F.col("series_id").cast("string"), "frame_idx", "line").alias("value")
                 ).write.partitionBy("series_id").mode("overwrite").text(path)
