"""Queries for sources and sinks, streams and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import blocks as B, edits as E, metrics as M, resample as R, waves as V, windows as G
from ..session import shared_folder
from ..sources import scripts as SC, tables as T
from ..streaming import live as L
from . import flows as P
from .catalog_queries import decisions, files, review_state, scenes
from .feature_queries import BLENDED, poses, two_channels, window_model
from .roles import actions, cte, drawn, frames, pairs, query, r6, rounded, table
from .series_queries import DAY, WAVE, clean

# ---------------------------------------------------------------- sources and sinks


def some_actions(spark, sf):
    """Scripts with integer positions, as files hold them."""
    return actions(spark, sf).withColumn("pos", F.rint("pos")).withColumn("series_id", F.col("series_id").cast("string"))


@query("scripts_round_trip", "actions", """SELECT CAST(series_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY series_id ORDER BY at_ms, ord) - 1 AS ord, at_ms, round_even(pos, 0) AS pos FROM actions""")
def _(spark, sf):
    """Write scripts of at most 50 points per document and read them back."""
    path = shared_folder(spark, "scripts")
    SC.write_scripts(some_actions(spark, sf), path, per_document=50, block_ms=DAY, bundled=True)
    return SC.read_actions(spark, path, bundled=True)


@query("script_documents", "actions", """SELECT CAST(series_id AS VARCHAR) AS series_id, '1.0' AS version, false AS inverted, 100 AS range, CASE WHEN series_id % 2 = 0 THEN 'yes' END AS even FROM actions GROUP BY series_id""")
def _(spark, sf):
    a = some_actions(spark, sf)
    m = a.select("series_id").distinct().where(F.col("series_id").cast("int") % 2 == 0).withColumn("metadata", F.create_map(F.lit("even"), F.lit("yes")))
    path = shared_folder(spark, "scripts")
    SC.write_scripts(a, path, m, block_ms=DAY, bundled=True)
    return SC.read_scripts(spark, path, bundled=True).select("series_id", "version", "inverted", "range", F.col("metadata")["even"].alias("even"))


@query("rewrite_positions", "actions", """SELECT series_id, ord, at_ms, greatest(0, least(100, CAST(round_even((pos/100.0::DOUBLE*1.2::DOUBLE)*100.0::DOUBLE, 0) AS INTEGER))) AS pos FROM actions WHERE ord % 4 <> 0""")
def _(spark, sf):
    a = actions(spark, sf)
    p = a.where(F.col("ord") % 4 != 0).select("series_id", "ord", (F.col("pos") / F.lit(100.0) * F.lit(1.2)).alias("pos"))
    return SC.rewrite_positions(a, p)


@query("postprocess_metadata", "actions", """SELECT series_id, 'a' AS title, 'true' AS postprocessed, 'wave' AS method, '8.0' AS cutoff FROM actions GROUP BY series_id""")
def _(spark, sf):
    a = R.estimate_fps(actions(spark, sf))
    m = SC.postprocess_metadata(F.create_map(F.lit("title"), F.lit("a"), F.lit("postprocessed"), F.lit("false")), V.WaveConfig(),
                                F.col("fps"), F.col("series_id").cast("string"))
    m = a.select("series_id", m.alias("m"))
    return m.select("series_id", F.col("m.title").alias("title"), F.col("m.postprocessed").alias("postprocessed"), F.col("m.postprocess_method").alias("method"),
                    F.get_json_object("m.postprocess_config", "$.lowpass_cutoff_hz").alias("cutoff"))


@query("script_fps", "actions", """SELECT series_id, CASE series_id % 4 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE ELSE 1000.0::DOUBLE*(count(*)-1)/(max(at_ms)-min(at_ms)) END AS fps FROM actions GROUP BY series_id""")
def _(spark, sf):
    e = R.estimate_fps(actions(spark, sf))
    k = F.col("series_id") % 4
    meta = F.create_map(F.lit("postprocess_fps"), F.when(k == 0, "30").when(k == 1, "-5").otherwise("x"), F.lit("fps"), F.when(k == 1, "25.0").otherwise("0"))
    return e.select("series_id", R.script_fps(meta, F.col("fps")).alias("fps"))


@query("splits_round_trip", "", "SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'val' END AS split FROM labels")
def _(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    path = shared_folder(spark, "splits")
    T.write_splits(l, path, series="doc_id")
    return T.read_splits(spark, path, series="doc_id", dtype="bigint")


@query("split_or_all", "", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    return T.split_or_all(table(spark, sf, "documents").select("doc_id"), l, "train", series="doc_id")


@query("write_frames", "frames", "SELECT series_id, frame_idx, pos FROM frames")
def _(spark, sf):
    path = shared_folder(spark, "frames")
    T.write_frames(frames(spark, sf), path)
    return spark.read.parquet(path)


@query("report_csv", "frames", "SELECT series_id, round(avg(pos), 10) AS mean, count(*) AS frames FROM frames GROUP BY series_id")
def _(spark, sf):
    path = shared_folder(spark, "report")
    s = frames(spark, sf).groupBy("series_id").agg(r6(F.avg("pos"), 10).alias("mean"), F.count("*").alias("frames"))
    T.write_report_csv(s, path, first=("series_id",))
    return spark.read.schema("series_id bigint, frames bigint, mean double").option("header", True).csv(path)


@query("report_json", "frames", "SELECT series_id, count(*) AS frames FROM frames GROUP BY series_id")
def _(spark, sf):
    path = shared_folder(spark, "report")
    T.write_report_json(frames(spark, sf).groupBy("series_id").agg(F.count("*").alias("frames")), path)
    return spark.read.schema("series_id bigint, frames bigint").json(path)


@query("pose_lines", "pose_points", """WITH p AS (SELECT *, CASE WHEN conf >= 2 OR conf BETWEEN 0.45 AND 0.55 THEN 2 WHEN conf >= 0.1 THEN 1 ELSE 0 END AS v FROM pose_points WHERE slot = 0),
b AS (SELECT series_id, frame_idx, greatest(0, min(x)-0.03::DOUBLE) AS x1, greatest(0, min(y)-0.03::DOUBLE) AS y1, least(1, max(x)+0.03::DOUBLE) AS x2, least(1, max(y)+0.03::DOUBLE) AS y2 FROM p WHERE v > 0 GROUP BY ALL),
l AS (SELECT series_id, frame_idx, string_agg(printf('%.6f %.6f %d', x, y, v), ' ' ORDER BY k) AS pts FROM p GROUP BY ALL)
SELECT series_id, frame_idx, printf('0 %.6f %.6f %.6f %.6f', (x1+x2)/2, (y1+y2)/2, x2-x1, y2-y1) || ' ' || pts AS line FROM b JOIN l USING (series_id, frame_idx)""")
def _(spark, sf):
    return T.pose_lines(poses(spark, sf), 0.1)


CUBIC = "0.1::DOUBLE + u*(0.5::DOUBLE + u*(-0.2::DOUBLE + u*0.3::DOUBLE))"


@query("edit_labels", "frames", f"""WITH e AS (SELECT series_id, min(frame_idx) AS a, max(frame_idx) AS z FROM frames WHERE (series_id + frame_idx) % 9 = 4 GROUP BY series_id)
SELECT series_id, frame_idx, round(CASE WHEN frame_idx BETWEEN a AND z THEN {CUBIC} ELSE pos END, 9) AS pos FROM (SELECT *, frame_idx/100.0::DOUBLE AS u FROM frames) LEFT JOIN e USING (series_id)""")
def _(spark, sf):
    """The edits lie on a cubic, which the spline must reproduce between the first and the last."""
    f = frames(spark, sf)
    u = F.col("frame_idx") / F.lit(100.0)
    pts = f.where((F.col("series_id") + F.col("frame_idx")) % 9 == 4).select(
        "series_id", "frame_idx", (F.lit(0.1) + u * (F.lit(0.5) + u * (F.lit(-0.2) + u * F.lit(0.3)))).alias("value"))
    return rounded(E.edit_labels(V.lengths_of(f), pts, f), "pos", digits=9)


# ---------------------------------------------------------------- streams


@query("review_stream", "review_state", "SELECT series_id, status, stage2_status, force_val, reviewed_at, stage2_reviewed_at FROM review_state")
def _(spark, sf):
    """Decisions in arrival batches through a streaming aggregation; the last state per series."""
    src, log, chk = (shared_folder(spark, n) for n in ("decisions", "reviewlog", "reviewchk"))
    decisions(spark, sf).repartitionByRange(4, "event_id").write.mode("overwrite").parquet(src)
    s = L.stream_table(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    L.update_log(L.review_stream(s, ties=("event_id",)), log, chk).awaitTermination()
    return L.latest(spark.read.parquet(log))


@query("stream_windows", "frames", BLENDED.format(seq=12, stride=5, kind="BIGINT"))
def _(spark, sf):
    """Frames in time order through stateful windows; equal to scoring each series as a whole."""
    src, out, chk = (shared_folder(spark, n) for n in ("frames", "predictions", "windowchk"))
    f = frames(spark, sf).withColumn("is_end", F.lit(False))
    ends = V.lengths_of(f).select("series_id", F.col("n").alias("frame_idx"), F.lit(0.0).alias("pos"), F.lit(True).alias("is_end"))
    f.unionByName(ends).repartitionByRange(4, "frame_idx").write.mode("overwrite").parquet(src)
    s = L.stream_table(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = L.stream_windows(s, window_model, 12, 5, block=40)
    (q.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True)
      .start().awaitTermination())
    return rounded(spark.read.parquet(out), "pos")


@query("watch", "pairs", """SELECT series_id, count(*) AS frames, round(avg((pred-target)*(pred-target)), 10) AS mse FROM pairs WHERE series_id % 10 <> 3 GROUP BY series_id""")
def _(spark, sf):
    """New series are scored as they arrive; those without a target fail into their own table."""
    src, done, failed, chk = (shared_folder(spark, n) for n in ("items", "done", "failed", "watchchk"))
    p = pairs(spark, sf)
    p.select("series_id").distinct().repartitionByRange(3, "series_id").write.mode("overwrite").parquet(src)

    def work(batch):
        mine = p.where(F.col("series_id") % 10 != 3).join(batch.select("series_id"), "series_id", "left_semi")
        m = M.pred_vs_baseline(mine).select("series_id", "frames", "mse")
        j = batch.join(m, "series_id", "left")
        return j.withColumn("error", F.when(F.col("mse").isNull(), "missing target"))

    items = L.stream_table(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    L.watch(items, work, done=done, failed=failed, checkpoint=chk).awaitTermination()
    return rounded(spark.read.parquet(done).drop("batch"), "mse", digits=10)


# ---------------------------------------------------------------- flows


@query("import_segments")
def _(spark, sf):
    a = actions(spark, sf).withColumn("scene_id", F.col("series_id")).drop("series_id")
    a = a.withColumn("at_ms", ((F.col("at_ms") - 1704067200000) / F.lit(86_400.0)).cast("bigint"))
    none = a.where("false").select(F.lit("").alias("series_id"))
    seg, labels = P.import_segments(scenes(spark, sf), files(spark, sf), a, none, segment_sec=10.0, count=2, fps=5.0,
                                    min_actions=1, ratio=False)
    return labels.join(seg.select("series_id", "segment_start_sec"), "series_id").groupBy("series_id").agg(
        F.count("*").alias("frames"), r6(F.avg("pos")).alias("mean"))


@query("predict_and_clean", "frames", f"""WITH RECURSIVE predicted AS (SELECT series_id, frame_idx, 2.0::DOUBLE * pos AS pos FROM frames), {clean('predicted')}
    SELECT series_id, CAST(frame_idx AS INTEGER) AS ord, CAST(round_even((frame_idx / 15.0::DOUBLE) * 1000.0::DOUBLE, 0) AS BIGINT) AS at_ms,
        CAST(greatest(0, least(100, round_even(pos * 100.0::DOUBLE, 0))) AS INTEGER) AS pos FROM blended""")
def _(spark, sf):
    return P.predict_and_clean(frames(spark, sf), two_channels, 15.0, seq=30, stride=15, config=WAVE)


SPLIT = f"""WITH s AS (SELECT series_id, count(*) AS frames, stddev_pop(target) AS label_std FROM pairs GROUP BY series_id),
    t AS (SELECT s.*, CASE WHEN r.series_id IS NULL THEN 'pending' WHEN s.series_id % 3 = 0 THEN 'approved' ELSE coalesce(r.status, 'pending') END AS status
        FROM s LEFT JOIN review_state r USING (series_id)),
    q AS (SELECT *, CASE WHEN status = 'rejected' THEN 'scene is rejected' WHEN status <> 'approved' THEN 'scene is not approved'
        WHEN label_std < 0.02 THEN 'label_std=' || printf('%.4f', label_std) || ' < 0.02' WHEN frames < 55 THEN 'frames=' || frames || ' < 55' END AS reason FROM t),
    k AS (SELECT series_id, series_id IN (SELECT item_id FROM benchmark) AS wanted FROM q WHERE reason IS NULL),
    d AS (SELECT series_id, CASE WHEN row_number() OVER (ORDER BY NOT wanted, {drawn(42, 'series_id')}, series_id)
        <= greatest(1, ceil(count(*) OVER () * 0.1::DOUBLE), count(*) FILTER (WHERE wanted) OVER ()) THEN 'val' ELSE 'train' END AS split FROM k)
    SELECT series_id, frames, round(label_std, 6) AS label_std, status, reason, split, round(pos_mse, 10) AS mse, round(event_mse, 10) AS event_mse,
        round(active_mse, 10) AS active_mse, round(vel_mae, 10) AS vel_mae, round(acc_mae, 10) AS acc_mae, round(spec_mse, 10) AS spec_mse
    FROM q LEFT JOIN d USING (series_id) LEFT JOIN metrics USING (series_id)"""


@query("evaluate_and_split", "review_state metrics", SPLIT)
def _(spark, sf):
    p = pairs(spark, sf)
    side = lambda c: p.select("series_id", "frame_idx", F.col(c).alias("pos"))
    r = review_state(spark, sf).withColumn("status", F.when(F.col("series_id") % 3 == 0, "approved").otherwise(F.col("status")))
    want = table(spark, sf, "benchmark").select(F.col("item_id").alias("series_id"))
    out = P.evaluate_and_split(side("target"), side("pred"), r.withColumn("stage2_status", F.lit("approved")), want, min_frames=55)
    return rounded(rounded(out, "label_std"), *M.SCENE_METRICS, digits=10)
