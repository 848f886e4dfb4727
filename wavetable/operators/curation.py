"""Review state, stages, quality filters and the split."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import Key, keys
from .order_stats import seeded_hash, smallest_by

# Rank of each stage in the stage order.
STAGE_RANK = {"rejected": 0, "pending": 1, "legacy": 2, "approved": 3, "keypoints": 4, "stage2_ok": 5, "flow": 6}
REVIEW_DEFAULTS = {"status": "pending", "stage2_status": "pending", "force_val": False, "notes": ""}
REVIEW_SCHEMA = ("status string, stage2_status string, force_val boolean, imported_at string, reviewed_at string, "
                 "stage2_reviewed_at string, notes string, _bad string")


# ---------------------------------------------------------------- review documents and events


def review_with_defaults(raw: DataFrame, column: str = "json") -> DataFrame:
    """Parsed review documents; missing fields and corrupt documents get the defaults."""
    parsed = F.from_json(column, REVIEW_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = raw.withColumn("_r", parsed)
    good = F.col("_r._bad").isNull()
    out = []
    for name in ("status", "stage2_status", "force_val", "imported_at", "reviewed_at", "stage2_reviewed_at", "notes"):
        value = F.when(good, F.col(f"_r.{name}"))
        out.append((F.coalesce(value, F.lit(REVIEW_DEFAULTS[name])) if name in REVIEW_DEFAULTS else value).alias(name))
    return df.select(*[c for c in raw.columns if c != column], *out)


ACTIONS = {"approve": ("status", "approved"), "reject": ("status", "rejected"),
           "approve2": ("stage2_status", "approved"), "reject2": ("stage2_status", "rejected")}


def apply_decisions(events: DataFrame, *, series: Key = "series_id", ts: str = "ts", ties: Sequence[str] = (),
                    streaming: bool = False) -> DataFrame:
    """Current state from the append-only decisions: per field the latest event, folded map-side.

    ``events`` has ``action`` (approve, reject, approve2, reject2, force_val, toggle) and ``value``
    for force_val. Toggles flip the last set value as often as they follow it.
    """
    order = F.struct(ts, *ties)
    a = F.col("action")

    def latest(names, value):
        return F.max_by(value, F.when(a.isin(*names), order))

    status = F.when(a == "approve", "approved").otherwise("rejected")
    status2 = F.when(a == "approve2", "approved").otherwise("rejected")
    state = events.groupBy(*keys(series)).agg(
        F.coalesce(latest(["approve", "reject"], status), F.lit("pending")).alias("status"),
        F.coalesce(latest(["approve2", "reject2"], status2), F.lit("pending")).alias("stage2_status"),
        F.max(F.when(a.isin("approve", "reject"), F.col(ts))).alias("reviewed_at"),
        F.max(F.when(a.isin("approve2", "reject2"), F.col(ts))).alias("stage2_reviewed_at"), *([_flag(a, order)] if streaming else []))
    return state if streaming else state.join(toggle_force_val(events, series=series, ts=ts, ties=ties), keys(series))


def _flag(action: Column, order: Column) -> Column:
    """The flag as one aggregate, for streams: set and toggle events of a series in order, folded. The state keeps these
    events of a series, which people make one by one; in batch the toggles are counted without gathering them."""
    seen = F.array_sort(F.collect_list(F.when(action.isin("force_val", "toggle"), F.struct(
        order.alias("at"), (action == "toggle").alias("flip"), F.coalesce("value", F.lit(False)).alias("value")))))
    return F.aggregate(seen, F.lit(False), lambda v, e: F.when(e["flip"], ~v).otherwise(e["value"])).alias("force_val")


def toggle_force_val(events: DataFrame, *, series: Key = "series_id", ts: str = "ts", ties: Sequence[str] = ()) -> DataFrame:
    """The flag after all set and toggle events: last set value, flipped once per later toggle.

    Toggles after the last set are counted by joining that one row per series back to the toggles.
    """
    by = keys(series)
    order = F.struct(ts, *ties)
    sets = events.where(F.col("action") == "force_val").groupBy(*by).agg(
        F.max(order).alias("_at"), F.max_by("value", order).alias("_value"))
    flips = events.where(F.col("action") == "toggle").join(sets.select(*by, "_at"), by, "left")
    flips = flips.where(F.col("_at").isNull() | (order > F.col("_at"))).groupBy(*by).agg(F.count("*").alias("_n"))
    base = events.select(*by).distinct().join(sets.drop("_at"), by, "left").join(flips, by, "left")
    odd = F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1
    return base.select(*by, (F.coalesce("_value", F.lit(False)) != odd).alias("force_val"))


def init_reviews(segments: DataFrame, reviews: DataFrame, imported_at: Column, *, overwrite: bool = False,
                 series: Key = "series_id") -> DataFrame:
    """Default rows for segments without a review (for all of them when overwriting)."""
    by = keys(series)
    fresh = segments.select(*by).distinct()
    if not overwrite:
        fresh = fresh.join(reviews, by, "left_anti")
    none = F.lit(None).cast("timestamp")
    return fresh.select(*by, F.lit("pending").alias("status"), F.lit("pending").alias("stage2_status"),
                        F.lit(False).alias("force_val"), imported_at.alias("imported_at"), none.alias("reviewed_at"),
                        none.alias("stage2_reviewed_at"), F.lit("").alias("notes"))


# ---------------------------------------------------------------- stages and listings


def stage(has_review: Column, status: Column, stage2: Column, has_keypoints: Column, has_flow: Column) -> Column:
    """Highest processing stage reached."""
    return (F.when(~has_review, "legacy").when((status == "rejected") | (stage2 == "rejected"), "rejected")
             .when(status == "pending", "pending").when((stage2 == "approved") & has_flow, "flow")
             .when(stage2 == "approved", "stage2_ok").when(has_keypoints, "keypoints")
             .when(status == "approved", "approved").otherwise("pending"))


def scene_stages(scenes: DataFrame, reviews: DataFrame, keypoints: DataFrame, flow: DataFrame, *,
                 series: Key = "series_id") -> DataFrame:
    by = keys(series)
    flag = lambda df, name: df.select(*by).distinct().withColumn(name, F.lit(True))
    df = (scenes.join(reviews.select(*by, "status", "stage2_status").withColumn("_r", F.lit(True)), by, "left")
                .join(flag(keypoints, "_k"), by, "left").join(flag(flow, "_f"), by, "left"))
    return df.withColumn("stage", stage(F.col("_r").isNotNull(), F.col("status"), F.col("stage2_status"),
                                        F.col("_k").isNotNull(), F.col("_f").isNotNull())).drop("_r", "_k", "_f")


def list_scenes(state: DataFrame, stages: Sequence[str], sort: str = "name", *, series: str = "series_id") -> DataFrame:
    """Scenes of the given stages, sorted by name, by stage, or by error with missing ones last."""
    out = state.where(F.col("stage").isin(*stages))
    if sort == "stage":
        rank = F.create_map(*[F.lit(x) for kv in STAGE_RANK.items() for x in kv])
        return out.orderBy(F.coalesce(rank[F.col("stage")], F.lit(99)), series)
    if sort == "mse":
        return out.orderBy(F.col("mse").try_cast("double").asc_nulls_last(), series)
    return out.orderBy(series)


def discover(scenes: DataFrame, labels: DataFrame, reviews: DataFrame, *, include_rejected: bool = False,
             require_labels: bool = True, series: Key = "series_id") -> DataFrame:
    """Scenes with their review, sorted; only the first-stage status rejects here."""
    by = keys(series)
    df = scenes.join(labels.select(*by), by, "left_semi") if require_labels else scenes
    df = df.join(reviews, by, "left").na.fill({"status": "pending", "stage2_status": "pending"})
    if not include_rejected:
        df = df.where(F.col("status") != "rejected")
    return df.orderBy(*by)


def needs_work(scenes: DataFrame, inputs: DataFrame, done: DataFrame, subset: DataFrame | None = None, *,
               overwrite: bool = False, series: Key = "series_id") -> DataFrame:
    """Scenes whose inputs exist and whose output does not; ``done`` with an ``mse`` column counts
    only where that is filled."""
    by = keys(series)
    df = scenes.join(inputs.select(*by), by, "left_semi")
    if subset is not None:
        df = df.join(subset.select(*by), by, "left_semi")
    if not overwrite:
        if "mse" in done.columns:
            done = done.where(F.col("mse").isNotNull() & (F.col("mse").cast("string") != ""))
        df = df.join(done.select(*by), by, "left_anti")
    return df


# ---------------------------------------------------------------- candidates and splits


def candidate_reasons(scenes: DataFrame, *, require_embeddings: bool = False) -> DataFrame:
    """First reason to leave a scene out, null for candidates.

    ``scenes`` has has_labels, status, stage2_status and, if required, embedding_reason.
    """
    reason = (F.when(~F.col("has_labels"), "missing labels")
               .when((F.col("status") == "rejected") | (F.col("stage2_status") == "rejected"), "scene is rejected")
               .when(~F.col("status").eqNullSafe("approved"), "scene is not approved"))
    if require_embeddings:
        reason = reason.when(F.col("embedding_reason") != "ok", F.col("embedding_reason"))
    return scenes.withColumn("reason", reason)


def filter_candidates(scenes: DataFrame, *, require_embeddings: bool = False) -> tuple[DataFrame, DataFrame]:
    tagged = candidate_reasons(scenes, require_embeddings=require_embeddings)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def quality_reasons(stats: DataFrame, min_std: float = 0.02, min_frames: int = 200) -> DataFrame:
    """Why a series is too flat or too short, null if it is neither."""
    reason = (F.when(F.col("label_std") < min_std,
                     F.concat(F.lit("label_std="), F.format_string("%.4f", "label_std"), F.lit(f" < {min_std}")))
               .when(F.col("frames") < min_frames,
                     F.concat(F.lit("frames="), F.col("frames").cast("string"), F.lit(f" < {min_frames}"))))
    return stats.withColumn("reason", reason)


def filter_quality(stats: DataFrame, min_std: float = 0.02, min_frames: int = 200) -> tuple[DataFrame, DataFrame]:
    tagged = quality_reasons(stats, min_std, min_frames)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def flag_low_quality(stats: DataFrame, min_std: float = 0.02) -> DataFrame:
    return stats.withColumn("low_quality", F.col("label_std") < min_std)


def train_val_split(ids: DataFrame, requested: DataFrame, ratio: float = 0.1, seed: int = 42, *,
                    force_val: Column | None = None, group: str | None = None,
                    series: str = "series_id") -> DataFrame:
    """``split`` per series. Requested ids go to validation, which is topped up to
    ``max(1, ceil(n * ratio))`` by a seeded order.

    ``force_val`` adds flagged series; ``group`` keeps all series of a source on one side, the quota
    then counts sources. The top-up is exact without sorting the ids (see ``smallest_by``).
    """
    unit = group or series
    wanted = requested.select(F.col(series).alias("_want")).distinct()
    tagged = ids.join(wanted, F.col(series) == F.col("_want"), "left")
    flag = F.col("_want").isNotNull()
    if force_val is not None:
        flag = flag | F.coalesce(force_val, F.lit(False))
    units = tagged.groupBy(F.col(unit).alias("_unit")).agg(F.max(flag).alias("_req"))
    # requested units come below all others, so they are drawn first
    drawn = seeded_hash(seed, "_unit")
    units = units.withColumn("_h", F.when(F.col("_req"), drawn - F.lit(1 << 60)).otherwise(drawn))
    total = F.ceil(F.col("_total") * F.lit(ratio))
    quota = F.greatest(total, F.lit(1), F.col("_requested"))
    val = smallest_by(units, "_h", quota, ties=["_unit"], sums={"_requested": F.col("_req").cast("bigint")})
    val = val.select("_unit", F.lit("val").alias("split"))
    out = ids.withColumn("_unit", F.col(unit)).join(val, "_unit", "left").drop("_unit")
    return out.withColumn("split", F.coalesce("split", F.lit("train")))


def missing_requested(ids: DataFrame, requested: DataFrame, *, series: str = "series_id") -> DataFrame:
    return requested.join(ids, series, "left_anti")
