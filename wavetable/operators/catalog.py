"""Media catalogue: pairing, availability, segment sources and artefacts."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import strings as S
from ..session import cut_lineage
from .blocks import BLOCK_MS, Key, keys, range_join, spread, scan, Carry

# Stereo layout of each known projection name.
STEREO_LAYOUTS = {"180_sbs": "sbs", "fisheye190": "sbs", "mkx200": "sbs", "": "sbs", "360_tb": "tb", "180_mono": "mono"}


# ---------------------------------------------------------------- pairing


def catalog_pairs(scenes: DataFrame, files: DataFrame, projections: Sequence[str] | None = None,
                  min_duration: float = 60.0) -> DataFrame:
    """Every usable (video, script) pair of a scripted scene, as the catalogue lists it.

    The filters are plain comparisons on the base columns, so they reach the source, Parquet or JDBC.
    """
    full = F.concat_ws("/", "path", "filename")
    video = files.where((F.col("type") == "video") & (F.col("video_width") > 0)
                        & (F.col("video_duration") >= min_duration))
    if projections:
        video = video.where(F.col("video_projection").isin(*projections))
    video = video.select("scene_id", full.alias("video_path"), "video_width", "video_height",
                         F.coalesce("video_projection", F.lit("")).alias("projection"),
                         F.col("video_duration").alias("duration"))
    script = files.where(F.col("type") == "script").select("scene_id", full.alias("script_path"))
    named = scenes.where(F.col("is_scripted") == 1).select(F.col("id").alias("scene_id"), "title")
    return named.join(video, "scene_id").join(script, "scene_id")


def best_pair(scenes: DataFrame, files: DataFrame, projections: Sequence[str] | None = None,
              min_duration: float = 60.0, ratio: bool = False, limit: int | None = None) -> DataFrame:
    """The most plausible pair of every scene: name similarity, then pixels, then duration, then paths.

    Files of equal name score alike, so copies collapse map-side to the best of them before anything
    is paired: what is scored is distinct names against distinct names, and the maximum is folded
    map-side again. Names are only taken apart for scenes that have both kinds of file.
    """
    px = F.coalesce(F.col("video_width"), F.lit(0)).cast("bigint") * F.coalesce(F.col("video_height"), F.lit(0))
    full = F.concat_ws("/", "path", "filename")
    video = files.where((F.col("type") == "video") & (F.col("video_width") > 0)
                        & (F.col("video_duration") >= min_duration))
    if projections:
        video = video.where(F.col("video_projection").isin(*projections))
    script = files.where(F.col("type") == "script").groupBy("scene_id", "filename").agg(F.min(full).alias("script_path"))
    script = script.drop("filename")
    rank = F.struct((-px).alias("px"), (-F.coalesce("video_duration", F.lit(0.0))).alias("dur"), full.alias("path"))
    video = video.join(script.select("scene_id"), "scene_id", "left_semi")
    video = video.groupBy("scene_id", "filename").agg(
        F.min_by(F.struct(full.alias("video_path"), "video_width", "video_height",
                          F.coalesce("video_projection", F.lit("")).alias("projection"),
                          F.coalesce("video_duration", F.lit(0.0)).alias("duration")), rank).alias("_v"),
        F.min(rank).alias("_rank")).drop("filename")
    video = video.withColumn("_ta", S.name_tokens(F.col("_v.video_path")))
    script = script.withColumn("_tb", S.name_tokens(F.col("script_path")))
    named = scenes.where(F.col("is_scripted") == 1).select(F.col("id").alias("scene_id"), "title")
    pair = named.join(video, "scene_id").join(script, "scene_id")
    pair = pair.withColumn("similarity", S.name_similarity(F.col("_v.video_path"), F.col("script_path"),
                                                           F.col("_ta"), F.col("_tb"), ratio))
    order = F.struct((-F.col("similarity")).alias("s"), F.col("_rank.px"), F.col("_rank.dur"),
                     F.col("_rank.path"), "script_path")
    best = pair.groupBy("scene_id").agg(F.min_by(F.struct("title", "_v", "script_path", "similarity"), order).alias("b"))
    out = best.select("scene_id", "b.title", "b._v.*", "b.script_path", "b.similarity")
    return out.orderBy("scene_id").limit(limit) if limit else out


def numbered(df: DataFrame, order: Sequence, name: str) -> DataFrame:
    """Consecutive numbers from 1 in a total order over the whole table.

    A distributed sort numbers rows inside each range partition; the sizes of the partitions, one
    row each, give the offsets. The sorted rows are checkpointed, so both uses see the same ranges.
    """
    ranked = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    ranked = ranked.withColumn("_part", F.shiftright("_m", 33))
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))      # one row per range partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = ranked.join(F.broadcast(offsets), "_part")
    within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, within + F.col("_off") + 1).drop("_m", "_part", "_off")


def pairs_from_listing(media: DataFrame, scripts: DataFrame, extensions: Sequence[str] = S.VIDEO_EXTENSIONS,
                       script_extension: str = ".funscript") -> DataFrame:
    """Media and scripts of equal stem, numbered by extension priority and then name."""
    priority = F.array_position(F.array(*[F.lit(e) for e in extensions]), S.suffix(F.col("path")))
    m = media.select(F.col("path").alias("video_path"), S.stem(F.col("path")).alias("title"), priority.alias("_prio"))
    s = scripts.where(F.endswith("path", F.lit(script_extension))).select(
        F.col("path").alias("script_path"), S.stem(F.col("path")).alias("title"))
    found = m.where(F.col("_prio") > 0).join(s, "title")
    out = numbered(found, ["_prio", "video_path", "script_path"], "scene_id")
    return out.select("scene_id", "title", "video_path", "script_path", F.lit(0).alias("video_width"),
                      F.lit(0).alias("video_height"), F.lit("").alias("projection"), F.lit(0.0).alias("duration"))


def _existence(pairs: DataFrame, media: DataFrame, scripts: DataFrame) -> DataFrame:
    v = media.select(F.col("path").alias("video_path")).distinct().withColumn("_video", F.lit(True))
    s = scripts.select(F.col("path").alias("script_path")).distinct().withColumn("_script", F.lit(True))
    return pairs.join(v, "video_path", "left").join(s, "script_path", "left")


def available_pairs(pairs: DataFrame, media: DataFrame, scripts: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs whose two files exist; the limit counts available pairs."""
    out = (pairs.join(media.select(F.col("path").alias("video_path")), "video_path", "left_semi")
                .join(scripts.select(F.col("path").alias("script_path")), "script_path", "left_semi"))
    return out.orderBy("scene_id", "video_path", "script_path").limit(limit) if limit else out


def availability(pairs: DataFrame, media: DataFrame, scripts: DataFrame) -> DataFrame:
    """Counts: all, available, video missing, script missing (only if the video is there)."""
    e = _existence(pairs, media, scripts)
    v, s = F.col("_video").isNotNull(), F.col("_script").isNotNull()
    return e.agg(F.count("*").alias("total"), F.count_if(v & s).alias("available"),
                 F.count_if(~v).alias("missing_video"), F.count_if(v & ~s).alias("missing_script"))


def stereo_layout(projection: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STEREO_LAYOUTS.items() for x in kv])
    return F.coalesce(known[F.coalesce(projection, F.lit(""))], F.lit("sbs"))


def is_wide(width: Column, height: Column) -> Column:
    return width > 1.8 * height


# ---------------------------------------------------------------- segments


def nearest_segment(segments: DataFrame, analysis: DataFrame, *, scene: str = "scene_id",
                    block_sec: float = 86_400.0) -> DataFrame:
    """Bin of the nearest analysed start, if nearer than the segment is long; the earlier start wins a tie.

    Only the nearest start on each side can win, so both tables are laid in one time order and
    the neighbours are carried over; no segment is compared with all starts of its scene.
    """
    point = F.struct(F.col("start_time_sec").alias("t"), F.col("bin_id").alias("bin"))
    a = analysis.groupBy(scene, "start_time_sec").agg(F.min_by("bin_id", "ord").alias("bin_id"))
    a = a.select(scene, F.col("start_time_sec").alias("_t"), F.lit(0).alias("_q"), point.alias("_a"),
                 F.lit(None).cast("string").alias("series_id"), F.lit(None).cast("double").alias("_dur"))
    s = segments.select(scene, F.col("segment_start_sec").cast("double").alias("_t"), F.lit(1).alias("_q"),
                        F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), "series_id",
                        F.col("segment_duration_sec").alias("_dur"))
    known = F.col("_a").isNotNull()
    both = scan(a.unionByName(s), [Carry("_p", F.col("_a"), known), Carry("_n", F.col("_a"), known, ahead=True)],
                series=scene, order="_t", ties=["_q", "series_id"], block=block_sec)
    dp, dn = F.col("_t") - F.col("_p.t"), F.col("_n.t") - F.col("_t")
    left = F.col("_n").isNull() | (F.col("_p").isNotNull() & (dp <= dn))
    dist, bin_ = F.when(left, dp).otherwise(dn), F.when(left, F.col("_p.bin")).otherwise(F.col("_n.bin"))
    return both.where(F.col("_q") == 1).select(
        scene, "series_id", F.when(dist < F.col("_dur"), bin_).alias("bin_id"))


def count_actions(segments: DataFrame, actions: DataFrame, minimum: int = 3, *, scene: str = "scene_id",
                  block_ms: float = BLOCK_MS) -> DataFrame:
    """Control points inside each segment, both ends included, and whether there are enough."""
    start = F.col("segment_start_sec") * 1000.0
    seg = segments.select(scene, "series_id", start.alias("_lo"),
                          (start + F.col("segment_duration_sec") * 1000.0).alias("_hi"))
    hits = range_join(actions.select(scene, "at_ms"), seg, at="at_ms", lo="_lo", hi="_hi", series=scene,
                      block=block_ms, closed=True)
    n = hits.groupBy("series_id").agg(F.count("*").alias("actions"))
    out = segments.select(scene, "series_id").join(n, "series_id", "left").na.fill({"actions": 0})
    return out.withColumn("enough", F.col("actions") >= minimum)


def exclude_done(segments: DataFrame, labels: DataFrame, reviews: DataFrame, *, series: Key = "series_id") -> DataFrame:
    """Segments not yet imported; imported means labels and a review exist."""
    by = keys(series)
    done = labels.select(*by).join(reviews.select(*by), by, "left_semi")
    return segments.join(done, by, "left_anti")


def lookup_fallback(df: DataFrame, lookup: DataFrame, *, scene: str = "scene_id") -> DataFrame:
    """Fill missing paths from the catalogue by scene."""
    l = lookup.select(scene, F.col("video_path").alias("_v"), F.col("script_path").alias("_s"))
    return (df.join(l, scene, "left").withColumn("video_path", F.coalesce("video_path", "_v"))
              .withColumn("script_path", F.coalesce("script_path", "_s")).drop("_v", "_s"))


def resolve_segment_sources(segments: DataFrame, lookup: DataFrame, *, listing: DataFrame | None = None,
                            scene: str | None = None) -> DataFrame:
    """Timing and source paths of stored segments, or the first reason to skip one.

    With ``listing`` (the audit) paths that do not exist count as missing before the lookup. ``scene`` names a column with the scene
    of a segment, for names that do not hold all of it; else the name tells.
    """
    name = F.col("series_id")
    parsed = S.parse_segment_id(name)
    timed = F.col("segment_start_sec").isNotNull() & F.col("segment_duration_sec").isNotNull()
    trusted = (F.col("video_path") != "") & ~F.contains(F.regexp_replace("video_path", r"\\", "/"), F.lit("preprocessed"))
    if listing is None:
        video = F.when(trusted, F.col("video_path"))
        named = parsed["scene_id"]
    else:
        video = F.when(F.col("video_path") != "", F.col("video_path"))
        named = S.audit_scene_id(name).cast("bigint")
    df = segments.withColumn("_scene", F.col(scene) if scene else named).withColumn("video_path", video)
    df = df.withColumn("script_path", F.when(F.col("script_path") != "", F.col("script_path")))
    if listing is not None:
        there = listing.select("path").distinct()
        for c in ("video_path", "script_path"):
            known = there.select(F.col("path").alias(c), F.lit(True).alias("_ok"))
            df = df.join(known, c, "left").withColumn(c, F.when(F.col("_ok"), F.col(c))).drop("_ok")
    df = lookup_fallback(df, lookup.withColumnRenamed("scene_id", "_scene"), scene="_scene")
    start = F.when(timed, F.col("segment_start_sec")).otherwise(parsed["start_sec"])
    duration = F.when(timed, F.col("segment_duration_sec")).otherwise(parsed["duration_sec"])
    reason = (F.when(start.isNull(), "no parseable timing")
               .when(F.col("video_path").isNull(), "cannot determine video path")
               .when(F.col("script_path").isNull(), "cannot determine script path"))
    return df.select("series_id", start.alias("start_sec"), duration.alias("duration_sec"), "video_path",
                     "script_path", reason.alias("skip_reason"))


# ---------------------------------------------------------------- artefacts

# The embedding layout this library accepts.
EMBEDDING_VERSION, EMBEDDING_METHOD = 4, "single_pass_hook_roi_align"


def artifact_candidates(kind: str, name: Column) -> list[Column]:
    """Relative paths to try, new layout first. ``name`` is a model file name or a flow stem."""
    legacy = {"keypoints": "pose_keypoints.npy", "embeddings": "embeddings.npy", "flow": "optical_flow.npy"}
    base = name if kind == "flow" else S.stem(name)
    return [F.concat(F.lit(f"{kind}/"), base, F.lit(".npy")), F.lit(legacy[kind])]


def resolve_artifact(scenes: DataFrame, listing: DataFrame, candidates: Sequence[Column], *,
                     series: Key = "series_id") -> DataFrame:
    """First existing candidate of every scene, null if none."""
    by = keys(series)
    options = F.posexplode(F.array(*candidates)).alias("_prio", "path")
    tried = scenes.select(*by, options)
    found = tried.join(listing, [*by, "path"], "left_semi").groupBy(*by).agg(F.min_by("path", "_prio").alias("path"))
    return scenes.select(*by).join(found, by, "left")


def artifact_reason(max_persons: int | None = None, embed_dim: int | None = None) -> Column:
    """First failed check of an embedding artefact row, or ``ok``."""
    text = lambda label, c: F.concat(F.lit(label + "="), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    bad = F.when(~F.col("file_exists"), "missing embeddings file").when(~F.col("has_metadata"), "missing embeddings metadata")
    bad = bad.when(~F.col("format_version").eqNullSafe(EMBEDDING_VERSION), text("format_version", "format_version"))
    bad = bad.when(~F.col("method").eqNullSafe(EMBEDDING_METHOD), text("method", "method"))
    if embed_dim is not None:
        bad = bad.when(~F.col("embed_dim").eqNullSafe(embed_dim), text("embed_dim", "embed_dim"))
    if max_persons is not None:
        bad = bad.when(F.coalesce("max_persons", F.lit(0)) < max_persons, text("max_persons", "max_persons"))
    bad = bad.when(F.col("shape").isNull(), "cannot load embeddings array")
    bad = bad.when(F.size("shape") != 3, F.concat(F.lit("expected 3 dims, got "), F.size("shape").cast("string")))
    width, slots = F.get("shape", F.lit(2)), F.get("shape", F.lit(1))
    if embed_dim is not None:
        bad = bad.when(width != embed_dim, F.concat(F.lit(f"expected embed_dim {embed_dim}, got "), width.cast("string")))
    if max_persons is not None:
        bad = bad.when(slots < max_persons, F.concat(F.lit(f"expected at least {max_persons} persons, got "),
                                                     slots.cast("string")))
    return bad.otherwise("ok")


def validate_artifacts(artifacts: DataFrame, max_persons: int | None = None, embed_dim: int | None = None) -> DataFrame:
    return artifacts.withColumn("reason", artifact_reason(max_persons, embed_dim)).withColumn(
        "valid", F.col("reason") == "ok")


def inspect_embeddings(artifacts: DataFrame, max_persons: int | None = None, *, strict: bool = False,
                       series: Key = "series_id") -> DataFrame:
    """Usable embedding path of every scene, and why not.

    ``artifacts`` has one row per candidate with ``priority`` (0 is the model's own path) and
    ``path``. The loose form takes the first valid of both and reports all reasons, the strict
    form looks at the model's own path only.
    """
    by = keys(series)
    v = validate_artifacts(artifacts, max_persons)
    base = S.file_name(F.col("path"))
    if strict:
        own = v.where(F.col("priority") == 0)
        reason = (F.when(~F.col("file_exists"), F.concat(F.lit("missing model-specific embeddings at "), base))
                   .when(F.col("valid"), "ok").otherwise(F.concat_ws(": ", base, "reason")))
        return own.select(*by, F.when(F.col("valid"), F.col("path")).alias("path"), reason.alias("reason"))
    there = F.col("file_exists")
    ok = there & F.col("valid")
    why = F.when(there & ~F.col("valid"), F.struct("priority", F.concat_ws(": ", base, "reason").alias("r")))
    g = v.groupBy(*by).agg(F.min_by(F.when(ok, F.col("path")), F.when(ok, F.col("priority"))).alias("path"),
                           F.sort_array(F.collect_list(why)).alias("_w"))
    reasons = F.array_join(F.transform("_w", lambda w: w["r"]), "; ")
    return g.select(*by, "path", F.when(F.col("path").isNotNull(), "ok").when(F.size("_w") > 0, reasons)
                    .otherwise("missing").alias("reason"))


def discover_video(scripts: DataFrame, listing: DataFrame, *, extensions: Sequence[str] = S.VIDEO_EXTENSIONS,
                   library: str | None = None) -> DataFrame:
    """Video of a script: named in its metadata, beside it, or in the library; first existing wins.

    ``scripts`` has script_path and metadata (map). The candidate list is short and fixed. Scripts are spread before it is laid out: a
    table of one small file would give all candidates to one task.
    """
    scripts = spread(scripts, "script_path")
    folder = F.regexp_replace("script_path", r"[^/]*$", "")
    stems = S.candidate_stems(S.stem(F.col("script_path")))
    names = F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit(e)) for e in extensions])))
    named = F.array_compact(F.array(*[F.when(F.col("metadata")[k] != "", F.col("metadata")[k])
                                      for k in ("source_video", "video_path")]))
    options = F.concat(named, F.transform(names, lambda n: F.concat(folder, n)))
    if library is not None:
        options = F.concat(options, F.transform(names, lambda n: F.concat(F.lit(f"{library}/preprocessed/"), n)))
    tried = scripts.select("script_path", F.posexplode(F.array_distinct(options)).alias("_prio", "path"))
    found = tried.join(listing, "path", "left_semi").groupBy("script_path").agg(F.min_by("path", "_prio").alias("video_path"))
    return scripts.select("script_path").join(found, "script_path", "left")
