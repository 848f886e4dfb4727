"""Hand-computed results (FIXTURES.md, section 3) and small worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from wavetable.functions import strings as S
from wavetable.operators import (blocks as B, curation as U, features as H, keyed as K, metrics as M, resample as R,
                                 waves as V, windows as G)

ACTIONS = [("s", i, at, float(p)) for i, (at, p) in enumerate([(0, 0), (100, 100), (100, 50), (200, 100)])]


def actions(spark, rows=ACTIONS):
    return spark.createDataFrame(rows, "series_id string, ord int, at_ms bigint, pos double")


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "series_id string, frame_idx int, pos double")


def ordered(df, column, by="frame_idx"):
    return [r[column] for r in df.orderBy(by).collect()]


def near(a, b, tol=1e-6):
    assert len(a) == len(b)
    assert all(abs(x - y) <= tol for x, y in zip(a, b)), (a, b)


def at_times(spark, times, kind, rows=ACTIONS):
    """Values at single times, each through a one-frame segment."""
    seg = spark.createDataFrame([("s", str(i), t / 1000.0, 1.0, 1) for i, t in enumerate(times)],
                                "series_id string, seg string, start double, fps double, total_frames int")
    out = R.resample(actions(spark, rows), seg, kind, segment="seg", start_sec="start", block_ms=50)
    return [r["pos"] for r in out.orderBy(F.col("seg").cast("int")).collect()]


def test_f1_dedup(spark):
    got = R.dedup_last(actions(spark)).orderBy("at_ms").collect()
    assert [(r["at_ms"], r["pos"]) for r in got] == [(0, 0.0), (100, 0.5), (200, 1.0)]


def test_f2_linear(spark):
    near(at_times(spark, [50, 150, -10, 999], "linear"), [0.25, 0.75, 0.0, 1.0])


def test_f3_nearest(spark):
    assert at_times(spark, [50, 51], "nearest") == [0.0, 0.5]


def test_f4_pchip(spark):
    rows = [("s", i, at, p) for i, (at, p) in enumerate([(0, 0.0), (1000, 100.0), (2000, 0.0)])]
    got = at_times(spark, list(range(0, 2001, 100)), "pchip", rows)
    assert got[10] == pytest.approx(1.0) and max(got) <= 1.0
    assert got[:11] == sorted(got[:11]) and got[10:] == sorted(got[10:], reverse=True)
    near(got, got[::-1])


def test_resample_edge_cases(spark):
    grid = spark.createDataFrame([("s", 2.0, 4), ("none", 2.0, 3), ("bad", 0.0, 3)], "series_id string, fps double, total_frames int")
    one = actions(spark, [("s", 0, 700, 40.0)])
    got = R.resample(one, grid, "pchip").orderBy("series_id", "frame_idx").collect()
    # a segment without a valid rate is not lost: it gives zeros
    assert [(r["series_id"], r["pos"]) for r in got] == [("bad", 0.0)] * 3 + [("none", 0.0)] * 3 + [("s", 0.4)] * 4
    with pytest.raises(ValueError):
        R.resample(one, grid, "spline")


def test_pchip_between_two_knots_is_linear(spark):
    rows = [("s", 0, 0, 0.0), ("s", 1, 100, 80.0)]
    near(at_times(spark, [25, 50, 75], "pchip", rows), [0.2, 0.4, 0.6])


def test_f5_differences(spark):
    d = M.with_differences(series(spark, [0.0, 1.0, 0.0]))
    assert ordered(d, "diff1") == [0.0, 1.0, -1.0]
    assert ordered(d, "diff2") == [0.0, 0.0, -2.0]
    assert ordered(d, "activity") == [0.0, 1.0, 2.0]


def test_f6_runs(spark):
    f = series(spark, [0.0, 1.0, 1.0, 0.0, 1.0])
    for block in (2, 3, 100):
        r = V.runs(f, F.col("pos") > 0, block=block)
        assert sorted((x["start"], x["end"]) for x in r.collect()) == [(1, 3), (4, 5)]
        assert [(x["start"], x["end"]) for x in V.merge_runs(r, 1, block=block).collect()] == [(1, 5)]


def test_f7_windows(spark):
    n = spark.createDataFrame([("s", 250), ("t", 100), ("u", 120)], "series_id string, n int")
    plain = G.window_index(n, 120, 60)
    assert sorted(tuple(r) for r in plain.select("series_id", "start").collect()) == [("s", 0), ("s", 60), ("s", 120), ("u", 0)]
    full = G.window_index_full(n, 120, 60).select("series_id", "start", "length")
    assert sorted(tuple(r) for r in full.collect()) == [
        ("s", 0, 120), ("s", 60, 120), ("s", 120, 120), ("s", 130, 120), ("t", 0, 100), ("u", 0, 120)]


def test_f8_blend_weight(spark):
    got = spark.range(5).select(G.blend_weight(F.col("id"), 5).alias("w")).collect()
    near([r["w"] for r in got], [0.01, 0.51, 1.01, 0.51, 0.01])


def test_f9_fill(spark):
    nan, inf = float("nan"), float("inf")
    for block in (2, 100):
        assert ordered(V.fill_nonfinite(series(spark, [nan, 1.0, nan, 3.0, inf]), block=block), "pos") == [1, 1, 2, 3, 3]
        assert ordered(V.fill_nonfinite(series(spark, [nan, inf]), block=block), "pos") == [0, 0]


def test_f10_simplify_constant(spark):
    assert R.simplify(series(spark, [0.5] * 5), F.lit(10.0)).count() == 5


def test_simplify_drops_straight_line(spark):
    got = R.simplify(series(spark, [0.0, 0.01, 0.02, 0.03, 0.04]), F.lit(10.0)).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["at_ms"], r["pos"]) for r in got] == [(0, 0, 0), (4, 400, 4)]


def test_f11_chunks(spark):
    n = spark.createDataFrame([("s", 20), ("t", 10), ("u", 11)], "series_id string, n int")
    c = V.chunk_table(n, 10, 2).orderBy("series_id", "start").collect()
    assert [(r["series_id"], r["start"], r["end"]) for r in c] == [
        ("s", 0, 10), ("s", 8, 18), ("s", 16, 20), ("t", 0, 10), ("u", 0, 10), ("u", 8, 11)]


def test_f12_stretch(spark):
    seg = spark.createDataFrame([("s", 1, 4)], "series_id string, start int, end int")
    f = series(spark, [0.9, 0.2, 0.4, 0.6, 0.1])
    near(ordered(V.stretch(f, seg, "linear"), "pos"), [0.9, 0.0, 0.5, 1.0, 0.1])
    tanh = ordered(V.stretch(f, seg, "tanh"), "pos")
    sd = math.sqrt(0.08 / 3)
    near(tanh[1:4], [0.5 * (math.tanh(4 * d / sd) + 1) for d in (-0.2, 0.0, 0.2)])


def test_f13_segment_names(spark):
    row = spark.range(1).select(S.segment_id(F.lit(18), F.lit(926.4), F.lit(40.0)).alias("n"))
    assert row.first()["n"] == "scene_00018_t00926_40s"
    p = S.parse_segment_id(F.col("n"))
    r = row.union(spark.createDataFrame([("scene_00018",)], "n string")).select(*[c.alias(k) for k, c in p.items()]).collect()
    assert tuple(r[0]) == (18, 926.0, 40.0) and tuple(r[1]) == (None, None, None)


def test_f14_split(spark):
    ids = spark.createDataFrame([(f"id{i}",) for i in range(10)], "series_id string")
    want = spark.createDataFrame([("id7",), ("gone",)], "series_id string")
    got = {r["series_id"]: r["split"] for r in U.train_val_split(ids, want, 0.1).collect()}
    assert [k for k, v in got.items() if v == "val"] == ["id7"] and len(got) == 10
    assert [r[0] for r in U.missing_requested(ids, want).collect()] == ["gone"]
    more = U.train_val_split(ids, want, 0.35).where("split = 'val'")
    assert more.count() == 4 and more.where("series_id = 'id7'").count() == 1


def test_split_by_group_and_flag(spark):
    ids = spark.createDataFrame([(i, i // 5, i == 3) for i in range(50)], "series_id int, scene_id int, force_val boolean")
    none = ids.select("series_id").where("false")
    got = U.train_val_split(ids, none, 0.2, group="scene_id", force_val=F.col("force_val"))
    sides = got.groupBy("scene_id").agg(F.countDistinct("split").alias("n"), F.max("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in sides) and sum(r["s"] == "val" for r in sides) == 2
    assert {r["s"] for r in sides if r["scene_id"] == 0} == {"val"}


def test_f15_quantise(spark):
    g = spark.createDataFrame([("s", 0, 0, [-2.0, 0.5, 2.0])], "series_id string, frame_idx int, channel int, v array<double>")
    r = H.quantize_channels(g).first()
    assert r["q"] == [-127, 32, 127] and r["scale"] == pytest.approx(2 / 127)
    r = H.quantize_channels(g, compat=True).first()
    assert r["q"] == [-1, 0, 1] and r["scale"] == 2.0


def test_f16_slice(spark):
    f = series(spark, [0.0] * 10)
    plan = R.sampling_plan(F.lit(2.0), F.lit(10), F.lit(1.0), F.lit(3.0), F.lit(True))
    p = spark.createDataFrame([("s",)], "series_id string").select("series_id", *[c.alias(k) for k, c in plan.items()])
    assert [r["frame_idx"] for r in R.slice_frames(f, p, block=3).orderBy("frame_idx").collect()] == [2, 4, 6]
    assert p.first()["num_frames"] == 3


def test_f17_identity_blend(spark):
    values = [((i * 37) % 101) / 100.0 for i in range(53)]
    for n in (53, 12, 7):
        out = G.sliding_predict(series(spark, values[:n]), G.LinearScorer(), seq=12, stride=5, block=9)
        near(ordered(out, "pos"), values[:n])


def test_f18_rollup(spark):
    rows = [("a.x", "compatible", 2, 2.0), ("a.y", "compatible", 6, 18.0), ("b", "missing_in_a", 0, None)]
    diff = spark.createDataFrame(rows, "key string, status string, n bigint, abs_diff double")
    for c in (*K.SUMS, "max_abs_diff"):
        if c != "abs_diff":
            diff = diff.withColumn(c, F.when(F.col("n") > 0, 0.0))
    got = {r["path"]: r for r in K.rollup_prefixes(diff).collect()}
    assert (got["a"]["n"], got["a"]["mean_abs_diff"], got["a"]["status"]) == (8, 2.5, "compatible")
    assert got[""]["status"] == "partial" and got["b"]["status"] == "incompatible"


def test_merge_identity(spark):
    t = spark.createDataFrame([("k", 0, [2], "float32", [1.0, 2.0]), ("j", 0, [1], "int64", [3.0])],
                              "key string, tile int, shape array<int>, dtype string, v array<double>")
    got = {r["key"]: r["v"] for r in K.merge_weighted(t, t, 1.0, 3.0).collect()}
    assert got == {"k": [1.0, 2.0], "j": [3.0]}
    with pytest.raises(ValueError):
        K.merge_weighted(t, t, 0.0, 0.0)


def test_composite_weights(spark):
    m = spark.createDataFrame([(1.0, 0.1, 0.01)], "pos_mse double, vel_mse double, acc_mse double")
    assert M.composite_error(m, 0.5, 0.9).first()["composite"] == pytest.approx(0.5 / 1.4 * 6 + 0.9 / 1.4 * 0.6)
    assert M.composite_error(m, 0.2, 0.1).first()["composite"] == pytest.approx(0.7 + 0.2 * 6 + 0.1 * 0.6)


def test_rounding_is_half_even(spark):
    f = series(spark, [0.005, 0.015, 0.025, -1.0, 2.0])
    got = R.frames_to_actions(f, F.lit(1000.0 / 2.5)).orderBy("ord").collect()
    assert [r["at_ms"] for r in got] == [0, 2, 5, 8, 10]
    assert [r["pos"] for r in got] == [0, 2, 2, 0, 100]


def test_visibility(spark):
    got = spark.createDataFrame([(3.0,), (0.5,), (0.3,), (0.1,)], "c double").select(R.visibility(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in got] == [2, 2, 1, 0]


def test_quantisation_error_is_half_a_step(spark):
    rows = [("s", i, c, [math.sin(i + c + k) * (c + 1) for k in range(5)]) for i in range(20) for c in range(3)]
    g = spark.createDataFrame(rows, "series_id string, frame_idx int, channel int, v array<double>")
    back = H.dequantize_channels(H.quantize_channels(g, block=4)).withColumnRenamed("v", "w")
    worst = g.join(back, ["series_id", "frame_idx", "channel"]).select(
        F.array_max(F.zip_with("v", "w", lambda a, b: F.abs(a - b))).alias("e"), "scale")
    assert worst.where(F.col("e") > F.col("scale") / 2 + 1e-12).count() == 0
    assert worst.count() == 60
