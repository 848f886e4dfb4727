"""Sources, sinks, streams and curation steps on small made-up inputs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from wavetable.functions import strings as S
from wavetable.operators import catalog as C, curation as U, features as H, windows as G, metrics as M, waves as V
from wavetable.sources import scripts as SC, tables as T
from wavetable.streaming import live as L


def test_read_plain_script_files(spark, tmp_path):
    doc = {"version": "1.0", "inverted": False, "range": 100, "metadata": {"creator": "x", "fps": 30},
           "actions": [{"at": 200, "pos": 10}, {"at": 100, "pos": 5}, {"at": 200, "pos": 90}]}
    (tmp_path / "my clip.funscript").write_text(json.dumps(doc, indent=2))
    a = SC.read_actions(spark, str(tmp_path)).orderBy("at_ms", "ord").collect()
    assert [(r["series_id"], r["at_ms"], r["pos"]) for r in a] == [("my clip", 100, 5.0), ("my clip", 200, 10.0), ("my clip", 200, 90.0)]
    s = SC.read_scripts(spark, str(tmp_path)).first()
    assert s["metadata"]["creator"] == "x" and s["metadata"]["fps"] == "30"


def test_written_script_is_one_json_document(spark, tmp_path):
    a = spark.createDataFrame([("s/1", i, i * 40, float(i % 101)) for i in range(250)], "series_id string, ord int, at_ms bigint, pos double")
    SC.write_scripts(a, str(tmp_path / "out"), per_document=100)
    docs = [json.loads(p.read_text()) for p in sorted((tmp_path / "out").rglob("*.txt"))]
    assert len(docs) == 3 and sum(len(d["actions"]) for d in docs) == 250
    assert all(d["actions"] == sorted(d["actions"], key=lambda x: x["at"]) for d in docs)
    back = SC.read_actions(spark, str(tmp_path / "out"))
    assert back.select("series_id").distinct().first()[0] == "s/1"
    assert sorted((r["at_ms"], r["pos"]) for r in back.collect()) == [(i * 40, float(i % 101)) for i in range(250)]


def test_split_list_file(spark, tmp_path):
    (tmp_path / "val.json").write_text('["a", "b"]')
    got = T.read_split_list(spark, str(tmp_path / "val.json"), "val").collect()
    assert sorted(tuple(r) for r in got) == [("val", "a"), ("val", "b")]
    every = spark.createDataFrame([("a",), ("c",)], "series_id string")
    assert T.split_or_all(every, None, "val").count() == 2
    assert T.split_or_all(every, T.read_split_list(spark, str(tmp_path / "val.json"), "val"), "val").count() == 1


def test_read_reviews(spark, tmp_path):
    for name, text in (("s1", '{"status": "approved"}'), ("s2", '{"status": "appro'), ("s3", "{}")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "review.json").write_text(text)
    got = {r["series_id"]: (r["status"], r["force_val"]) for r in T.read_reviews(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("approved", False), "s2": ("pending", False), "s3": ("pending", False)}


def test_listing_feeds_pairing(spark, tmp_path):
    for n in ("a.mkv", "b.mp4", "c.txt", "a.funscript", "c.funscript", "b.funscript"):
        (tmp_path / n).write_text("x")
    m = T.list_files(spark, str(tmp_path))
    got = C.pairs_from_listing(m, m).orderBy("scene_id").collect()
    assert [(r["scene_id"], r["title"]) for r in got] == [(1, "b"), (2, "a")]


def test_report_columns_are_sorted(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, z double, a double").coalesce(1)
    T.write_report_csv(df, str(tmp_path / "r"), first=("id",))
    text = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert text == ["id,a,z", "1,3.0,2.0"]


def test_name_similarity_with_ratio(spark):
    df = spark.createDataFrame([("/v/Big_Red-Fox_180_sbs.mp4", "/s/big red fox.funscript"), ("/v/a.mp4", "/s/vr_script.funscript"),
                                ("/v/same.mp4", "/x/SAME.funscript")], "a string, b string")
    s = S.name_similarity(F.col("a"), F.col("b"), S.name_tokens(F.col("a")), S.name_tokens(F.col("b")), ratio=True)
    got = [r["s"] for r in df.select(s.alias("s")).collect()]
    assert got == [5.0 + 6.0 + 1.0 + 1.0, 0.0, 10.0 + 5.0 + 2.0 + 1.0 + 1.0]


def test_best_pair_takes_copies_and_ties(spark):
    scenes = spark.createDataFrame([(1, "t", 1), (2, "u", 0)], "id bigint, title string, is_scripted int")
    files = spark.createDataFrame(
        [(1, "video", "/a", "fox.mp4", 100, 100, None, 90.0), (1, "video", "/b", "fox.mp4", 200, 100, "mkx200", 90.0),
         (1, "video", "/c", "other.mp4", 900, 900, None, 90.0), (1, "video", "/d", "fox.mkv", 300, 300, None, 10.0),
         (1, "script", "/s", "fox.funscript", None, None, None, None), (2, "video", "/a", "x.mp4", 9, 9, None, 99.0),
         (2, "script", "/a", "x.funscript", None, None, None, None)],
        "scene_id bigint, type string, path string, filename string, video_width int, video_height int, video_projection string, video_duration double")
    got = C.best_pair(scenes, files).collect()
    assert [(r["scene_id"], r["video_path"], r["projection"]) for r in got] == [(1, "/b/fox.mp4", "mkx200")]
    assert C.catalog_pairs(scenes, files).count() == 3


def test_review_events_fold(spark):
    rows = [("s", 1, "approve", None), ("s", 2, "reject2", None), ("s", 3, "force_val", True), ("s", 4, "toggle", None),
            ("s", 5, "approve2", None), ("t", 1, "toggle", None), ("t", 2, "toggle", None), ("t", 3, "toggle", None)]
    e = spark.createDataFrame(rows, "series_id string, ts int, action string, value boolean")
    e = e.withColumn("ts", F.timestamp_seconds("ts"))
    s = {r["series_id"]: r for r in U.apply_decisions(e).collect()}
    assert (s["s"]["status"], s["s"]["stage2_status"], s["s"]["force_val"]) == ("approved", "approved", False)
    assert s["t"]["status"] == "pending" and s["t"]["force_val"]
    one = {r["series_id"]: r["force_val"] for r in U.apply_decisions(e, streaming=True).collect()}
    assert one == {"s": False, "t": True}
    f = {r["series_id"]: r["force_val"] for r in U.toggle_force_val(e).collect()}
    assert f == {"s": False, "t": True}


def pose(spark):
    kp = [(0.1 * k, 0.05 * k, 0.0 if k in (4, 17) else 0.5) for k in range(21)]
    return spark.createDataFrame([("s", 0, 0, kp)], "series_id string, frame_idx int, slot int, kp array<struct<x:double,y:double,conf:double>>")


def test_pose_root_falls_through(spark):
    r = pose(spark).select(H.pose_root(F.col("kp"), 21).alias("r")).first()["r"]
    assert (r["x"], r["y"]) == (pytest.approx(1.15), pytest.approx(0.575))       # middle of points 11 and 12
    gone = pose(spark).withColumn("kp", F.transform("kp", lambda p, k: F.when(k > 10, p.withField("conf", F.lit(0.0))).otherwise(p)))
    r = gone.select(H.pose_root(F.col("kp"), 21).alias("r")).first()["r"]
    assert r["x"] == pytest.approx(sum(0.1 * k for k in range(11) if k != 4) / 10, abs=1e-4)


def test_strip_and_pair_features(spark):
    p = pose(spark).select("series_id", "frame_idx", F.col("kp").alias("kp_a"), F.slice("kp", 1, 7).alias("kp_b"),
                           F.lit(2).alias("h"), F.lit(2).alias("w"), F.array([F.lit(0.0)] * 4).alias("fx"),
                           F.array(*[F.lit(v) for v in (0.0, 1.0, 2.0, 3.0)]).alias("fy"))
    strip = p.select(H.strip_points(F.col("kp_b")).alias("s")).first()["s"]
    assert len(strip) == 10 and strip[0]["y"] == 0.17 and strip[0]["conf"] == 0.5
    assert strip[0]["x"] == pytest.approx(sum(0.1 * k for k in range(7) if k != 4) / 6)
    f = H.pair_features(p).first()["pair"]
    assert f["visible_a"] == pytest.approx(19 / 21) and f["visible_b"] == pytest.approx(6 / 7)
    assert f["dflow"] == pytest.approx(min(1.0, f["dx"] + strip[0]["x"]) + 2 * (f["dy"] + strip[0]["x"] / 2) - strip[0]["x"] - strip[0]["x"])


def test_isolated_failures_become_rows(spark):
    def half(pdf):
        if pdf["x"].iloc[0] < 0:
            raise ValueError("negative")
        return pdf.assign(x=pdf["x"] / 2)
    fn, schema = L.isolated(half, ["k"], "k int, x double")
    df = spark.createDataFrame([(1, 4.0), (2, -1.0)], "k int, x double").groupBy("k").applyInPandas(fn, schema)
    got = {r["k"]: (r["x"], r["error"]) for r in df.collect()}
    assert got[1] == (2.0, None) and got[2][1] == "ValueError: negative"


def test_watch_skips_finished_items(spark, tmp_path):
    src, done, failed, chk = (str(tmp_path / n) for n in ("in", "done", "failed", "chk"))
    work = lambda b: b.withColumn("error", F.when(F.col("series_id") == "bad", "broken"))
    read = lambda: L.stream_table(spark, src, "series_id string, v int")
    for batch in ([("a", 1), ("bad", 1)], [("a", 2), ("b", 2)]):
        spark.createDataFrame(batch, "series_id string, v int").coalesce(1).write.mode("append").parquet(src)
        L.watch(read(), work, done=done, failed=failed, checkpoint=chk).awaitTermination()
    assert sorted((r["series_id"], r["v"]) for r in spark.read.parquet(done).collect()) == [("a", 1), ("b", 2)]
    counts = {r["batch"]: (r["ok"], r["failed"]) for r in L.watch_counts(spark, done, failed).collect()}
    assert counts == {0: (1, 1), 1: (1, 1)}                             # the failed item was tried again


def test_watch_retries_and_survives_exceptions(spark, tmp_path):
    src, done, failed, chk = (str(tmp_path / n) for n in ("in", "done", "failed", "chk"))
    calls = []

    def work(b):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("no connection")
        return b.withColumn("error", F.when((F.col("series_id") == "slow") & F.lit(len(calls) == 2), "not yet"))

    for batch in ([("a", 1), ("slow", 1)], [("b", 2)], [("c", 3)]):
        spark.createDataFrame(batch, "series_id string, v int").coalesce(1).write.mode("append").parquet(src)
        L.watch(L.stream_table(spark, src, "series_id string, v int"), work, done=done, failed=failed, checkpoint=chk).awaitTermination()
    assert sorted((r["series_id"], r["v"], r["batch"]) for r in spark.read.parquet(done).collect()) == [
        ("a", 1, 1), ("b", 2, 1), ("c", 3, 2), ("slow", 1, 2)]
    assert "no connection" in spark.read.parquet(failed).where("batch = 0").first()["error"]


def test_folders_are_released(spark):
    from wavetable import session
    held, session._folders[:] = list(session._folders), []
    try:
        folder = session.shared_folder(spark, "gone")
        spark.range(3).write.parquet(f"{folder}/rows")
        assert os.path.isdir(f"{folder}/rows")
        session.release_folders()
        assert not os.path.exists(folder) and session._folders == []
    finally:
        session._folders[:] = held


def test_watch_isolates_an_item_that_always_raises(spark, tmp_path):
    src, done, failed, chk = (str(tmp_path / n) for n in ("in", "done", "failed", "chk"))

    def work(b):
        checked = F.udf(lambda k: 1 // 0 if k.startswith("bomb") else None, "string")
        return b.withColumn("error", checked("series_id"))

    for n in range(10):
        rows = [(f"{c}{n}", n) for c in "abc"] + ([("bomb", n)] if n == 2 else [])
        spark.createDataFrame(rows, "series_id string, v int").coalesce(1).write.mode("append").parquet(src)
        L.watch(L.stream_table(spark, src, "series_id string, v int"), work, done=done, failed=failed, checkpoint=chk, attempts=4).awaitTermination()
    got = {r["series_id"]: r["batch"] for r in spark.read.parquet(done).collect()}
    assert got == {f"{c}{n}": 3 if n == 2 else n for c in "abc" for n in range(10)}
    (gone,) = spark.read.parquet(f"{failed}-given-up").collect()
    assert (gone["series_id"], gone["v"], gone["attempts"], gone["batch"]) == ("bomb", 2, 4, 6) and "ZeroDivisionError" in gone["error"]
    assert spark.read.parquet(f"{failed}-items/batch=9").count() == 0


def test_watch_waits_until_an_item_is_due(spark, tmp_path):
    src, done, failed, chk = (str(tmp_path / n) for n in ("in", "done", "failed", "chk"))
    calls = []

    def work(b):
        calls.append(sorted(r["series_id"] for r in b.select("series_id").collect()))
        return b.withColumn("error", F.when(F.col("series_id") == "bad", "broken"))

    for n in range(3):
        spark.createDataFrame([(f"a{n}", n)] + ([("bad", 0)] if n == 0 else []), "series_id string, v int").coalesce(1).write.mode("append").parquet(src)
        L.watch(L.stream_table(spark, src, "series_id string, v int"), work, done=done, failed=failed, checkpoint=chk, wait_seconds=3600.0).awaitTermination()
    assert calls == [["a0", "bad"], ["a1"], ["a2"]]
    (left,) = spark.read.parquet(f"{failed}-items/batch=2").collect()
    assert left["series_id"] == "bad" and left["_tries"] == 1


def test_live_windows_over_vectors_equal_batch(spark, tmp_path):
    import numpy as np
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    schema = "series_id string, frame_idx int, v array<float>, is_end boolean"
    rng = np.random.default_rng(3)
    data = {k: rng.random((n, 5)).astype(np.float32) for k, n in (("a", 130), ("b", 13), ("c", 40))}

    def model(x):
        import numpy as np
        return np.stack([x[:, :, 0], x.sum(2) - x[:, :1, 1], x[:, :, 4] * x[:, :, 2]], 1)

    rows = [(k, i, [float(c) for c in v[i]], False) for k, v in data.items() for i in range(len(v))]
    rng.shuffle(rows)
    for part in (rows[:90], rows[90:], [(k, len(v), None, True) for k, v in data.items()]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        s = L.stream_windows(L.stream_table(spark, src, schema), model, 20, 8, block=40, column="v")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    got = {(r["series_id"], r["frame_idx"], r["channel"]): r["pos"] for r in spark.read.parquet(out).collect()}
    frames = spark.createDataFrame([r[:3] for r in rows], "series_id string, frame_idx int, v array<float>")
    want = {(r["series_id"], r["frame_idx"], r["channel"]): r["pos"] for r in G.sliding_predict(frames, model, "v", seq=20, stride=8, block=30).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 183
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_live_series_without_end_marker_ends_by_timer(spark, tmp_path):
    import time
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    schema = "series_id string, frame_idx int, pos double, is_end boolean"
    wave = lambda x: __import__("numpy").stack([x + x[:, :1], 1 - x], 1)
    spark.createDataFrame([("s", i, i / 100.0, False) for i in range(47)], schema).coalesce(1).write.parquet(src)
    s = L.stream_windows(L.stream_table(spark, src, schema), wave, 20, 5, block=40, idle_seconds=0.5)
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(processingTime="1 second").start()
    found = "series_id string, frame_idx bigint, channel int, pos double"
    for _ in range(60):
        time.sleep(0.5)
        if os.path.isdir(out + "/_spark_metadata") and spark.read.schema(found).parquet(out).count() >= 94:
            break
    q.stop()
    got = {(r["frame_idx"], r["channel"]): r["pos"] for r in spark.read.schema(found).parquet(out).collect()}
    data = spark.createDataFrame([("s", i, i / 100.0) for i in range(47)], "series_id string, frame_idx int, pos double")
    want = {(r["frame_idx"], r["channel"]): r["pos"] for r in G.sliding_predict(data, wave, seq=20, stride=5, block=25).collect()}
    assert len(want) == 94 and got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("lengths,block", [((130, 64, 40, 41, 5), 40), ((97,), 20)])
def test_live_windows_equal_batch(spark, tmp_path, lengths, block):
    rows = [(f"s{j}", i, ((i * 37 + j) % 101) / 100.0, False) for j, n in enumerate(lengths) for i in range(n)]
    data = spark.createDataFrame(rows, "series_id string, frame_idx int, pos double, is_end boolean")
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    ends = spark.createDataFrame([(f"s{j}", n, 0.0, True) for j, n in enumerate(lengths)], data.schema)
    for lo in range(0, max(lengths) + 30, 30):                       # arrive in pieces of 30 frames
        part = data.unionByName(ends).where((F.col("frame_idx") >= lo) & (F.col("frame_idx") < lo + 30))
        part.coalesce(1).write.mode("append").parquet(src)
    scorer = G.LinearScorer((1.5,), 0.1)
    wave = lambda x: scorer(x) + x[:, :1]                            # depends on the window a frame is in
    s = L.stream_windows(L.stream_table(spark, src, data.schema, files_per_trigger=1), wave, 20, 5, block=block)
    (s.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True)
      .start().awaitTermination())
    got = {(r["series_id"], r["frame_idx"]): r["pos"] for r in spark.read.parquet(out).collect()}
    batch = G.sliding_predict(data.drop("is_end"), wave, seq=20, stride=5, block=25).collect()
    assert len(batch) == sum(lengths) == len(got)
    for r in batch:
        assert got[(r["series_id"], r["frame_idx"])] == pytest.approx(r["pos"], abs=1e-9)


def test_no_key_loses_its_share(spark):
    """More keys than a 32nd of the maximum: the quota falls, every key keeps values, the total is the maximum."""
    from wavetable.operators import keyed as K
    v = spark.range(300).select(F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).alias("key"), F.floor(F.col("id") / 100).alias("pos"),
                                F.col("id").cast("double").alias("value"))
    got = K.systematic_sample(v, 250).groupBy("key").count().collect()
    assert len(got) == 100 and {r["count"] for r in got} == {2, 3} and sum(r["count"] for r in got) == 250


def test_long_digit_runs_compare_as_numbers(spark):
    from wavetable.functions import strings as S
    names = ["a" + "1" * 20 + "9", "a" + "1" * 20 + "5", "a2", "a10", "a" + "9" * 40, "a" + "1" + "0" * 40]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in got] == sorted(names, key=lambda n: int(n[1:]))


def test_script_order_continues_over_documents(spark, tmp_path):
    from wavetable.sources import scripts as SC
    a = spark.range(25).select(F.lit("s").alias("series_id"), F.col("id").alias("ord"), (F.col("id") * 7).alias("at_ms"), (F.col("id") % 5).cast("double").alias("pos"))
    for name, per in (("one", None), ("many", 4)):
        SC.write_scripts(a, str(tmp_path / name), per_document=per)
        assert [r["ord"] for r in SC.read_actions(spark, str(tmp_path / name)).orderBy("at_ms").collect()] == list(range(25))


def test_videos_with_room_get_all_their_segments(spark):
    v = spark.createDataFrame([(i, d) for i, d in enumerate([100.0, 100.5, 64.0, 25.0, 7.0, 3.0])], "scene_id bigint, duration double")
    got = {}
    for r in G.choose_segments(v, 10.0, 10).collect():
        got.setdefault(r["scene_id"], []).append(r["segment_start_sec"])
    assert {k: len(x) for k, x in got.items()} == {0: 10, 1: 10, 2: 6, 3: 2, 4: 1}
    for k, x in got.items():
        x.sort()
        assert all(b - a >= 10 - 1e-9 for a, b in zip(x, x[1:])) and (x[-1] + 10 <= v.collect()[k]["duration"] + 1e-9 or k == 4)


def test_field_summary_holds_the_whole_field(spark):
    f = spark.createDataFrame([([1.0] * 64, [0.0] * 64)], "fx array<double>, fy array<double>").withColumns({"h": F.lit(8), "w": F.lit(8)})
    full, compat = H.field_summary(f).first()["f"], H.field_summary(f, layout="compat").first()["f"]
    assert len(full) == 70 and full[-6:] == [1.0, 0.0, 1.0, 0.0, 1.0, 0.0] and len(compat) == 64


def test_epoch_subset_without_shuffle(spark):
    index = spark.range(50).select((F.col("id") % 5).alias("series_id"), F.col("id").alias("start"))
    got = [tuple(r) for r in G.epoch_subset(index, 12, shuffle=False).orderBy("series_id", "start").collect()]
    assert got == sorted((i % 5, i) for i in range(50))[:12]


def test_segments_without_a_rate_give_zeros(spark):
    from wavetable.operators import resample as R
    seg = spark.createDataFrame([("a", 10.0, 3), ("a", 0.0, 2), ("a", None, 1), ("a", 10.0, 0)], "series_id string, fps double, total_frames int")
    seg = seg.withColumn("id", F.monotonically_increasing_id())
    knots = spark.createDataFrame([("a", 0, 0, 50.0), ("a", 1, 1000, 50.0)], "series_id string, ord int, at_ms bigint, pos double")
    assert sorted(r["reason"] for r in R.invalid_segments(seg).collect()) == ["no frame rate", "no frame rate", "no frames"]
    assert [(r["frame_idx"], r["t_ms"]) for r in R.frame_grid(seg.where("fps = 0")).orderBy("frame_idx").collect()] == [(0, 0.0), (1, 0.0)]
    got = R.resample(knots, seg, "linear", segment="id").groupBy("id").agg(F.count("*").alias("n"), F.max("pos").alias("top")).collect()
    assert sorted((r["n"], r["top"]) for r in got) == [(1, 0.0), (2, 0.0), (3, 0.5)]


def plain_filter(x, fps=15.0, cutoff=4.0):
    """Second-order Butterworth low-pass, sample by sample, forwards and backwards over an odd extension of nine samples."""
    import math
    c = math.tan(math.pi * cutoff / fps)
    d = 1 + math.sqrt(2) * c + c * c
    b, a = (c * c / d, 2 * c * c / d, c * c / d), (1.0, 2 * (c * c - 1) / d, (1 - math.sqrt(2) * c + c * c) / d)
    pad = 9

    def once(v):
        z2 = (b[2] - a[2]) * v[0]                       # state in which a constant input stays as it is
        z1 = (b[1] - a[1]) * v[0] + z2
        out = []
        for s in v:
            y = b[0] * s + z1
            z1, z2 = b[1] * s - a[1] * y + z2, b[2] * s - a[2] * y
            out.append(y)
        return out
    ext = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2:-pad - 2:-1]]
    return once(once(ext)[::-1])[::-1][pad:-pad]


def plain_troughs(x, depth=0.035, distance=4):
    runs, i = [], 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < len(x) - 1 and x[i - 1] > x[i] < x[j + 1]:
            runs.append((i + j) // 2)
        i = j + 1
    kept = []
    for p in sorted(runs, key=lambda p: (x[p], -p)):    # the deepest first, of equal ones the later
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)

    def wall(p, step):
        most, q = x[p], p
        while 0 <= q < len(x) and x[q] >= x[p]:
            most, q = max(most, x[q]), q + step
        return most
    return sorted(p for p in kept if min(wall(p, -1), wall(p, 1)) - x[p] >= depth)


def test_filter_and_trough_queries_do_work(spark):
    """Registered with parameters under which both operators act, over all rows."""
    import __spark_entry__ as entry
    from collections import defaultdict
    from wavetable.plans import series_queries as Q
    sf, chunks = "/root/testdata/sf0.001", defaultdict(list)
    for r in Q.chunked(spark, sf).orderBy("frame_idx").collect():
        chunks[r["series_id"], r["chunk"]].append((r["frame_idx"], r["pos"]))
    low = {(r["series_id"], r["frame_idx"]): r["low"] for r in entry.queries()["lowpass_4hz"](spark, sf).collect()}
    found = {(r["series_id"], r["frame_idx"]) for r in entry.queries()["troughs_spaced"](spark, sf).collect()}
    exact = {(r["series_id"], r["frame_idx"]): r["low"] for r in V.lowpass(Q.chunked(spark, sf), 15.0, 4.0).collect()}
    far, deep = set(), set()                            # minima by spacing alone and by depth alone
    want_low, want = {}, set()
    for (series, _), rows in chunks.items():
        at, x = [i for i, _ in rows], [v for _, v in rows]
        want_low |= {(series, i): v for i, v in zip(at, plain_filter(x) if len(x) > 9 else x)}
        quiet = [exact[series, i] for i in at]
        for to, depth, distance in ((want, 0.035, 4), (far, 0.0, 4), (deep, 0.035, 1)):
            to |= {(series, at[p]) for p in plain_troughs(quiet, depth, distance)}
    assert low.keys() == want_low.keys() and max(abs(low[k] - want_low[k]) for k in low) < 2e-6
    assert found == want and want < far and want < deep                                # either rule drops some
    raw = {(s, i): v for (s, _), rows in chunks.items() for i, v in rows}
    assert sum(abs(low[k] - raw[k]) > 1e-3 for k in low) > len(low) / 10
