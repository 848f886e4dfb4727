"""Queries over series: resampling, wave clean-up and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import blocks as B, metrics as M, passes as P, resample as R, waves as V
from ..operators.order_stats import exact_quantile
from .roles import (actions, cte, frames, grids, long_frames, oracle, pairs, query, r6, rounded, segments, table)

DAY = 86_400_000 * 30

# ---------------------------------------------------------------- resampling


@query("dedup_last", "actions_daily",
       "SELECT series_id, at_ms, arg_max(pos, ord)/100.0::DOUBLE AS pos FROM actions_daily GROUP BY series_id, at_ms")
def _(spark, sf):
    return R.dedup_last(actions(spark, sf, daily=True))


@query("trim_edges", "actions", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY at_ms, ord) - 1 AS i,
    count(*) OVER (PARTITION BY series_id) AS n FROM actions)
SELECT series_id, ord, at_ms, pos FROM n
WHERE n <= 2 OR 2*CAST(floor(n*0.1::DOUBLE) AS BIGINT) >= n
   OR (i >= floor(n*0.1::DOUBLE) AND i < n - floor(n*0.1::DOUBLE))""")
def _(spark, sf):
    return R.trim_edges(actions(spark, sf), 0.1, block_ms=DAY).select("series_id", "ord", "at_ms", "pos")


@query("estimate_fps", "actions", """
SELECT series_id, count(*) AS num_actions, CASE WHEN count(*) >= 2 AND max(at_ms) > min(at_ms) THEN
    1000.0::DOUBLE*(count(*)-1)/(max(at_ms)-min(at_ms)) END AS fps FROM actions GROUP BY series_id""")
def _(spark, sf):
    return R.estimate_fps(actions(spark, sf))


@query("frame_grid", "grid_times", "SELECT series_id, frame_idx, t_ms FROM grid_times")
def _(spark, sf):
    return R.frame_grid(grids(spark, sf), start_sec="start_sec").select("series_id", "frame_idx", "t_ms")


KNOTS = """knots AS (SELECT series_id, at_ms::DOUBLE AS t, arg_max(pos, ord)/100.0::DOUBLE AS p FROM actions
    GROUP BY series_id, at_ms)"""
BRACKET = f"""{KNOTS},
nx AS (SELECT *, lead(t) OVER w AS t1, lead(p) OVER w AS p1, first_value(t) OVER w AS ta, first_value(p) OVER w AS pa
    FROM knots WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ends AS (SELECT series_id, min(t) AS ta, arg_min(p, t) AS pa FROM knots GROUP BY series_id),
j AS (SELECT g.series_id, g.frame_idx, g.t_ms, n.t AS t0, n.p AS p0, n.t1, n.p1, e.pa
    FROM grid_times g ASOF LEFT JOIN nx n ON g.series_id = n.series_id AND g.t_ms >= n.t
    LEFT JOIN ends e ON g.series_id = e.series_id)"""


@query("resample_linear", "grid_times actions", f"""WITH {BRACKET}
SELECT series_id, frame_idx, t_ms, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t0 IS NULL THEN pa
    WHEN t1 IS NULL THEN p0 ELSE p0 + (p1-p0)*((t_ms-t0)/(t1-t0)) END)), 6) AS pos FROM j""")
def _(spark, sf):
    return rounded(R.resample(actions(spark, sf), grids(spark, sf), "linear", start_sec="start_sec", block_ms=DAY), "pos")


@query("resample_nearest", "grid_times actions", f"""WITH {BRACKET}
SELECT series_id, frame_idx, t_ms, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t0 IS NULL THEN pa
    WHEN t1 IS NULL OR t_ms-t0 <= t1-t_ms THEN p0 ELSE p1 END)) AS pos FROM j""")
def _(spark, sf):
    return R.resample(actions(spark, sf), grids(spark, sf), "nearest", start_sec="start_sec", block_ms=DAY)


def pchip_ctes(knots: str, grid: str, by: str = "series_id") -> str:
    return f"""{knots},
kd AS (SELECT *, t - lag(t) OVER w AS h0, (p - lag(p) OVER w)/(t - lag(t) OVER w) AS d0,
    lead(t) OVER w - t AS h1, (lead(p) OVER w - p)/(lead(t) OVER w - t) AS d1
    FROM knots WINDOW w AS (PARTITION BY series_id ORDER BY t)),
kn AS (SELECT *, lag(h0) OVER w AS hm, lag(d0) OVER w AS dm, lead(h1) OVER w AS h2, lead(d1) OVER w AS d2
    FROM kd WINDOW w AS (PARTITION BY series_id ORDER BY t)),
e AS (SELECT *, CASE WHEN d0 IS NULL THEN ((2*h1+h2)*d1 - h1*d2)/(h1+h2)
    WHEN d1 IS NULL THEN ((2*h0+hm)*d0 - h0*dm)/(h0+hm) END AS em FROM kn),
ks AS (SELECT *, CASE
    WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN CASE WHEN d0*d1 <= 0 THEN 0.0::DOUBLE ELSE
        ((2*h1+h0)+(h1+2*h0))/((2*h1+h0)/d0 + (h1+2*h0)/d1) END
    WHEN em IS NULL THEN coalesce(d0, d1)
    WHEN d0 IS NULL THEN CASE WHEN sign(em) <> sign(d1) THEN 0.0::DOUBLE
        WHEN sign(d1) <> sign(d2) AND abs(em) > 3*abs(d1) THEN 3*d1 ELSE em END
    ELSE CASE WHEN sign(em) <> sign(d0) THEN 0.0::DOUBLE
        WHEN sign(d0) <> sign(dm) AND abs(em) > 3*abs(d0) THEN 3*d0 ELSE em END END AS m FROM e),
nx AS (SELECT series_id, t AS t0, p AS p0, m AS m0, lead(t) OVER w AS t1, lead(p) OVER w AS p1, lead(m) OVER w AS m1
    FROM ks WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ends AS (SELECT series_id, min(t) AS ta, arg_min(p, t) AS pa FROM knots GROUP BY series_id),
j AS (SELECT g.*, n.t0, n.p0, n.m0, n.t1, n.p1, n.m1, x.pa, (g.t_ms - n.t0)/(n.t1 - n.t0) AS s, n.t1 - n.t0 AS h
    FROM {grid} g ASOF LEFT JOIN nx n ON g.{by} = n.series_id AND g.t_ms >= n.t0
    LEFT JOIN ends x ON g.{by} = x.series_id)"""


PCHIP_VALUE = """round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t0 IS NULL THEN coalesce(pa, 0.0::DOUBLE)
    WHEN t1 IS NULL THEN p0
    ELSE (1+2*s)*(1-s)*(1-s)*p0 + s*(1-s)*(1-s)*h*m0 + s*s*(3-2*s)*p1 + s*s*(s-1)*h*m1 END)), 6)"""


@query("resample_pchip", "grid_times actions",
       f"WITH {pchip_ctes(KNOTS, 'grid_times')} SELECT series_id, frame_idx, t_ms, {PCHIP_VALUE} AS pos FROM j")
def _(spark, sf):
    return rounded(R.resample(actions(spark, sf), grids(spark, sf), "pchip", start_sec="start_sec", block_ms=DAY), "pos")


SEGMENT_TIMES = """seg_times AS (SELECT scene_id, series_id, CAST(i AS INTEGER) AS frame_idx,
    (segment_start_sec + i/fps)*1000.0::DOUBLE AS t_ms FROM (SELECT *, unnest(range(total_frames)) AS i FROM segments))"""


@query("extract_labels", "segments actions", f"""WITH {SEGMENT_TIMES}, {pchip_ctes(KNOTS, 'seg_times', 'scene_id')}
SELECT scene_id, series_id, frame_idx, t_ms, {PCHIP_VALUE} AS pos FROM j""")
def _(spark, sf):
    a = actions(spark, sf).withColumnRenamed("series_id", "scene_id")
    return rounded(R.extract_labels(segments(spark, sf), a, block_ms=DAY), "pos")


@query("sample_at", "actions", f"""WITH {KNOTS},
q AS (SELECT o_custkey % 150 AS series_id, o_orderkey, (1704067200 + (o_orderkey*7919) % 7776000)*1000.0::DOUBLE AS t_ms FROM orders),
nx AS (SELECT *, lead(t) OVER w AS t1, lead(p) OVER w AS p1 FROM knots WINDOW w AS (PARTITION BY series_id ORDER BY t)),
ends AS (SELECT series_id, arg_min(p, t) AS pa FROM knots GROUP BY series_id)
SELECT q.series_id, q.o_orderkey, q.t_ms, round(CASE WHEN n.t IS NULL THEN coalesce(pa, 0.0::DOUBLE) WHEN t1 IS NULL THEN p
    ELSE p + (p1-p)*((t_ms-t)/(t1-t)) END, 6) AS pos
FROM q ASOF LEFT JOIN nx n ON q.series_id = n.series_id AND q.t_ms >= n.t LEFT JOIN ends e ON q.series_id = e.series_id
""")
def _(spark, sf):
    q = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 150).alias("series_id"), "o_orderkey",
        ((F.lit(1704067200) + (F.col("o_orderkey") * 7919) % 7776000) * F.lit(1000.0)).alias("t_ms"))
    return rounded(R.sample_at(R.dedup_last(actions(spark, sf)), q, block_ms=DAY), "pos")


@query("effective_fps", "segments", """SELECT scene_id % 3 AS half, fps, CAST(count(*) AS BIGINT) AS n,
    CASE WHEN fps > 0 AND scene_id % 3 = 0 THEN fps/2.0::DOUBLE ELSE fps END AS effective_fps
    FROM (SELECT scene_id, CASE WHEN scene_id % 5 = 0 THEN -1.0::DOUBLE ELSE scene_id::DOUBLE END AS fps FROM segments) GROUP BY ALL""")
def _(spark, sf):
    s = segments(spark, sf).withColumn("fps", F.when(F.col("scene_id") % 5 == 0, -1.0).otherwise(F.col("scene_id").cast("double")))
    s = s.select((F.col("scene_id") % 3).alias("half"), "fps",
                 R.effective_fps(F.col("fps"), F.col("scene_id") % 3 == 0).alias("effective_fps"))
    return s.groupBy("half", "fps", "effective_fps").agg(F.count("*").alias("n"))


PLAN_SQL = """plan0 AS (SELECT series_id, n, dur, CASE WHEN st > 0 THEN greatest(0, floor(st*25.0::DOUBLE)) ELSE 0 END AS s0, half
    FROM (SELECT series_id, CASE WHEN series_id % 7 = 3 THEN NULL ELSE count(*) END AS n, (series_id % 4)*0.5::DOUBLE AS st,
    CASE WHEN series_id % 6 = 1 THEN NULL ELSE 1.3::DOUBLE END AS dur, series_id % 2 = 0 AS half FROM frames GROUP BY series_id)),
plan1 AS (SELECT *, CASE WHEN n IS NOT NULL THEN least(CASE WHEN dur IS NULL THEN n ELSE s0+floor(dur*25.0::DOUBLE) END, n)
    WHEN dur IS NULL THEN NULL ELSE s0+floor(dur*25.0::DOUBLE) END AS e0, CASE WHEN n IS NOT NULL THEN least(s0, n) ELSE s0 END AS f0 FROM plan0),
plan AS (SELECT series_id, CAST(f0 AS BIGINT) AS start_frame, CAST(e0 AS BIGINT) AS end_frame, CASE WHEN half THEN 2 ELSE 1 END AS frame_step,
    CAST(CASE WHEN e0 IS NULL THEN NULL WHEN e0 <= f0 THEN 0 ELSE ceil((e0-f0)/(CASE WHEN half THEN 2 ELSE 1 END)::DOUBLE) END AS BIGINT) AS num_frames FROM plan1)"""


def clip_requests(spark, sf):
    s = F.col("series_id")
    n = frames(spark, sf).groupBy("series_id").agg(F.count("*").alias("c"))
    p = R.sampling_plan(F.lit(25.0), F.when(s % 7 == 3, None).otherwise(F.col("c")), (s % 4) * F.lit(0.5),
                        F.when(s % 6 == 1, None).otherwise(F.lit(1.3)), s % 2 == 0)
    return n.select("series_id", *[c.alias(k) for k, c in p.items()])


@query("sampling_plan", "frames", f"WITH {PLAN_SQL} SELECT * FROM plan")
def _(spark, sf):
    return clip_requests(spark, sf)


@query("slice_frames", "frames", f"""WITH {PLAN_SQL} SELECT f.series_id, f.frame_idx, f.pos, start_frame, end_frame, frame_step, num_frames
    FROM frames f JOIN plan p ON f.series_id = p.series_id AND f.frame_idx >= start_frame AND f.frame_idx < end_frame
    WHERE (f.frame_idx - start_frame) % frame_step = 0""")
def _(spark, sf):
    return R.slice_frames(frames(spark, sf), clip_requests(spark, sf))


@query("half_rate", "frames", "SELECT series_id, CAST(frame_idx/2 AS INTEGER) AS frame_idx, pos FROM frames WHERE frame_idx % 2 = 0")
def _(spark, sf):
    return R.half_rate(frames(spark, sf))


@query("frames_to_actions", "frames", """SELECT series_id, frame_idx AS ord,
    CAST(round_even((frame_idx/29.97::DOUBLE + 1.5::DOUBLE)*1000.0::DOUBLE, 0) AS BIGINT) AS at_ms,
    greatest(0, least(100, CAST(round_even(pos*100.0::DOUBLE, 0) AS INTEGER))) AS pos FROM frames""")
def _(spark, sf):
    return R.frames_to_actions(frames(spark, sf), F.lit(29.97), F.lit(1.5))


@query("simplify", "frames", """WITH RECURSIVE x AS (SELECT series_id, frame_idx AS i, pos*100.0::DOUBLE AS x, lead(pos*100.0::DOUBLE) OVER (PARTITION BY series_id ORDER BY frame_idx) AS nx FROM frames),
r AS (SELECT series_id, i, x AS last, true AS kept, x FROM x WHERE i = 0 UNION ALL
    SELECT series_id, i, CASE WHEN k THEN x ELSE last END, k, x FROM (SELECT x.series_id, x.i, x.x, r.last,
        x.nx IS NULL OR (x.x >= r.last AND x.x >= x.nx) OR (x.x <= r.last AND x.x <= x.nx) OR abs(x.x - (r.last + (x.nx - r.last)*0.5::DOUBLE)) > 2.0 AS k FROM r JOIN x ON x.series_id = r.series_id AND x.i = r.i + 1))
SELECT series_id, i AS frame_idx, CAST(round_even(i*1000.0::DOUBLE/30.0::DOUBLE, 0) AS BIGINT) AS at_ms, CAST(round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, x)), 0) AS INTEGER) AS pos FROM r WHERE kept""")
def _(spark, sf):
    return R.simplify(frames(spark, sf), F.lit(30.0), 2.0)


OVERRIDES = "marks AS (SELECT series_id, frame_idx, pos*0.5::DOUBLE AS pos FROM frames WHERE (series_id + frame_idx) % 9 = 4)"


def marks(spark, sf):
    f = frames(spark, sf)
    return f.where((F.col("series_id") + F.col("frame_idx")) % 9 == 4).withColumn("pos", F.col("pos") * F.lit(0.5))


@query("asof_step", "frames", f"""WITH {OVERRIDES} SELECT f.series_id, f.frame_idx, coalesce(m.pos, f.pos) AS pos
    FROM frames f ASOF LEFT JOIN marks m ON f.series_id = m.series_id AND f.frame_idx >= m.frame_idx""")
def _(spark, sf):
    return R.asof_step(frames(spark, sf), marks(spark, sf), "pos")


@query("interval_lerp", "frames", f"""WITH {OVERRIDES}, nx AS (SELECT *, lead(frame_idx) OVER w AS i1, lead(pos) OVER w AS p1
    FROM marks WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx))
SELECT f.series_id, f.frame_idx, CASE WHEN m.frame_idx = f.frame_idx THEN m.pos WHEN m.frame_idx IS NOT NULL AND i1 IS NOT NULL
    THEN m.pos + (f.frame_idx - m.frame_idx)/(i1 - m.frame_idx)::DOUBLE*(p1 - m.pos) ELSE f.pos END AS pos
FROM frames f ASOF LEFT JOIN nx m ON f.series_id = m.series_id AND f.frame_idx >= m.frame_idx""")
def _(spark, sf):
    return R.interval_lerp(frames(spark, sf), marks(spark, sf), ["pos"])


@query("visibility", "frames", """SELECT vis, CASE vis WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 3.0::DOUBLE END AS conf,
    count(*) AS n FROM (SELECT CASE WHEN pos*3 >= 2.0 OR pos*3 BETWEEN 0.45 AND 0.55 THEN 2 WHEN pos*3 >= 0.25 THEN 1 ELSE 0 END AS vis FROM frames) GROUP BY vis""")
def _(spark, sf):
    f = frames(spark, sf).select(R.visibility(F.col("pos") * 3).alias("vis"))
    return f.groupBy("vis").agg(F.count("*").alias("n")).withColumn("conf", R.visibility_conf(F.col("vis")))


# ---------------------------------------------------------------- wave clean-up


@query("fill_nonfinite", "frames", """WITH g AS (SELECT series_id, frame_idx, CASE WHEN (series_id*31 + frame_idx) % 4 = 0 THEN NULL
    WHEN (series_id*31 + frame_idx) % 7 = 0 THEN NULL ELSE pos END AS pos FROM frames),
k AS (SELECT series_id, frame_idx, pos, lead(frame_idx) OVER w AS i1, lead(pos) OVER w AS p1 FROM g WHERE pos IS NOT NULL
    WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)),
e AS (SELECT series_id, arg_min(pos, frame_idx) AS pa FROM k GROUP BY series_id)
SELECT g.series_id, g.frame_idx, round(CASE WHEN k.frame_idx IS NULL THEN coalesce(pa, 0.0::DOUBLE) WHEN k.frame_idx = g.frame_idx OR i1 IS NULL THEN k.pos
    ELSE k.pos + (p1-k.pos)*((g.frame_idx-k.frame_idx)/(i1-k.frame_idx)::DOUBLE) END, 6) AS pos
FROM g ASOF LEFT JOIN k ON g.series_id = k.series_id AND g.frame_idx >= k.frame_idx LEFT JOIN e ON g.series_id = e.series_id""")
def _(spark, sf):
    k = F.col("series_id") * 31 + F.col("frame_idx")
    f = frames(spark, sf).withColumn("pos", F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("inf")))
                                     .otherwise(F.col("pos")))
    return rounded(V.fill_nonfinite(f), "pos")


@query("smooth_gaussian", "frames", """WITH w0 AS (SELECT k, exp(-0.5::DOUBLE*(k/1.2::DOUBLE)*(k/1.2::DOUBLE)) AS w FROM (SELECT unnest(range(-5, 6)) AS k)),
w AS (SELECT k, w/(SELECT sum(w) FROM w0) AS w FROM w0), n AS (SELECT series_id, max(frame_idx) AS last FROM frames GROUP BY series_id)
SELECT f.series_id, f.frame_idx, round(sum(w.w*g.pos), 6) AS smooth FROM frames f JOIN n ON f.series_id = n.series_id CROSS JOIN w
JOIN frames g ON g.series_id = f.series_id AND g.frame_idx = greatest(0, least(last, f.frame_idx + w.k)) GROUP BY f.series_id, f.frame_idx""")
def _(spark, sf):
    return rounded(V.smooth_gaussian(frames(spark, sf), 10.0, 0.12), "smooth").select("series_id", "frame_idx", "smooth")


cte("graded", """SELECT series_id, frame_idx, pos, coalesce((lead(pos) OVER w - lag(pos) OVER w)/2.0::DOUBLE,
    lead(pos) OVER w - pos, pos - lag(pos) OVER w, 0) AS gradient FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)""", "frames")


@query("gradient", "graded", "SELECT series_id, frame_idx, pos, gradient FROM graded")
def _(spark, sf):
    return V.gradient(frames(spark, sf))


CHUNK = ["series_id", "chunk"]


def chunked_gradient(spark, sf):
    """Gradients with the number of a chunk of 50 frames: thresholds belong to a chunk."""
    return V.gradient(frames(spark, sf)).withColumn("chunk", F.floor(F.col("frame_idx") / 50).cast("int"))


@query("gradient_thresholds", "graded", """WITH chunked AS (SELECT *, frame_idx // 50 AS chunk FROM graded), q AS (SELECT series_id, chunk, quantile_cont(abs(gradient), 0.25) AS l, quantile_cont(abs(gradient), 0.9) AS h
    FROM chunked WHERE abs(gradient) > 0 GROUP BY ALL), s AS (SELECT DISTINCT series_id, chunk FROM chunked)
SELECT s.series_id, s.chunk, round(coalesce(greatest(0.00075::DOUBLE, l), 0), 10) AS low, round(coalesce(greatest(h, greatest(0.00075::DOUBLE, l)), 0), 10) AS high
FROM s LEFT JOIN q USING (series_id, chunk)""")
def _(spark, sf):
    return rounded(V.gradient_thresholds(chunked_gradient(spark, sf), chunk=CHUNK), "low", "high", digits=10)


RUNS = """isl AS (SELECT series_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS g
    FROM frames WHERE pos >= 0.3), r AS (SELECT series_id, CAST(min(frame_idx) AS INTEGER) AS start, CAST(max(frame_idx)+1 AS INTEGER) AS "end" FROM isl GROUP BY series_id, g)"""


@query("runs", "frames", f'WITH {RUNS} SELECT series_id, start, "end" FROM r')
def _(spark, sf):
    return V.runs(frames(spark, sf), F.col("pos") >= 0.3, block=16)


@query("merge_runs", "frames", f"""WITH {RUNS}, m AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 2 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY series_id ORDER BY start)),
g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY start) AS g FROM m)
SELECT series_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end" FROM g GROUP BY series_id, g""")
def _(spark, sf):
    return V.merge_runs(V.runs(frames(spark, sf), F.col("pos") >= 0.3, block=16), 2, block=16)


GRADSEG = """q AS (SELECT series_id, frame_idx // 50 AS chunk, quantile_cont(abs(gradient), 0.25) AS l, quantile_cont(abs(gradient), 0.9) AS h FROM graded WHERE abs(gradient) > 0 GROUP BY ALL),
b AS (SELECT g.*, greatest(0.00075::DOUBLE, l) AS low, greatest(h, greatest(0.00075::DOUBLE, l)) AS high FROM graded g JOIN q ON g.series_id = q.series_id AND g.frame_idx // 50 = q.chunk),
isl AS (SELECT series_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY series_id ORDER BY frame_idx) AS g FROM b WHERE abs(gradient) >= low AND abs(gradient) <= high),
r AS (SELECT series_id, min(frame_idx) AS start, max(frame_idx)+1 AS "end" FROM isl GROUP BY series_id, g),
m AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY series_id ORDER BY start) <= 1 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY start) AS g FROM m),
mr AS (SELECT series_id, CAST(min(start) AS INTEGER) AS start, CAST(max("end") AS INTEGER) AS "end" FROM g GROUP BY series_id, g),
st AS (SELECT mr.series_id, mr.start, mr."end", abs(avg(CASE WHEN abs(gradient) >= low THEN sign(gradient) END)) AS balance, max(pos) - min(pos) AS range
    FROM mr JOIN b ON b.series_id = mr.series_id AND b.frame_idx >= start AND b.frame_idx < "end" WHERE "end" - start >= 3 GROUP BY ALL),
seg AS (SELECT * FROM st WHERE balance >= 0.65 AND range >= 0.08)"""
SLOW = V.WaveConfig(min_gradient_length_seconds=0.6, merge_gap_seconds=0.15)


def slow_segments(spark, sf):
    g = chunked_gradient(spark, sf)
    return V.gradient_segments(g.join(V.gradient_thresholds(g, chunk=CHUNK), CHUNK), 5.0, SLOW)


@query("gradient_segments", "graded", f'WITH {GRADSEG} SELECT series_id, start, "end", round(balance, 6) AS balance, round(range, 6) AS range FROM seg')
def _(spark, sf):
    return rounded(slow_segments(spark, sf), "balance", "range")


STRETCH = """x AS (SELECT f.series_id, f.frame_idx, f.pos, s.start FROM frames f LEFT JOIN seg s ON f.series_id = s.series_id AND f.frame_idx >= s.start AND f.frame_idx < s."end"),
a AS (SELECT series_id, start, min(pos) AS lo, max(pos) AS hi, avg(pos) AS mean, stddev_pop(pos) AS sd FROM x WHERE start IS NOT NULL GROUP BY series_id, start)"""


@query("stretch_linear", "graded", f"""WITH {GRADSEG}, {STRETCH} SELECT x.series_id, x.frame_idx, x.start IS NOT NULL AS stretched,
    round(CASE WHEN x.start IS NULL THEN pos ELSE (pos-lo)/greatest(hi-lo, 1e-6::DOUBLE) END, 6) AS pos FROM x LEFT JOIN a USING (series_id, start)""")
def _(spark, sf):
    return rounded(V.stretch(frames(spark, sf), slow_segments(spark, sf), "linear"), "pos")


@query("stretch_tanh", "graded", f"""WITH {GRADSEG}, {STRETCH} SELECT x.series_id, x.frame_idx, x.start IS NOT NULL AS stretched,
    round(CASE WHEN x.start IS NULL THEN pos ELSE 0.5::DOUBLE*(tanh(4.0::DOUBLE*(pos-mean)/CASE WHEN sd <= 1e-6 THEN greatest((hi-lo)/6, 1e-6::DOUBLE) ELSE sd END)+1) END, 6) AS pos
    FROM x LEFT JOIN a USING (series_id, start)""")
def _(spark, sf):
    return rounded(V.stretch(frames(spark, sf), slow_segments(spark, sf), "tanh"), "pos")


@query("clip01", "frames", """SELECT series_id, CAST(count(*) FILTER (WHERE pos*1.5-0.2 < 0 OR pos*1.5-0.2 > 1) AS BIGINT) AS num_clipped,
    round(sum(greatest(0.0::DOUBLE, least(1.0::DOUBLE, pos*1.5::DOUBLE-0.2::DOUBLE))), 10) AS total FROM frames GROUP BY series_id""")
def _(spark, sf):
    x = F.col("pos") * F.lit(1.5) - F.lit(0.2)
    return frames(spark, sf).groupBy("series_id").agg(F.count_if((x < 0) | (x > 1)).alias("num_clipped"),
                                                     r6(F.sum(R.clip01(x)), 10).alias("total"))


CHUNKS = """n AS (SELECT series_id, count(*) AS n FROM long_frames GROUP BY series_id),
c AS (SELECT series_id, n, k AS chunk, k*{step} AS start, least(n, k*{step}+{size}) AS "end" FROM
    (SELECT *, unnest(range(greatest(CAST(ceil((n-{size})/{step}.0::DOUBLE) AS BIGINT), 0) + 1)) AS k FROM n))""".format(step=220, size=250)


@query("chunks", "long_frames", f"""WITH {CHUNKS} SELECT series_id, CAST(n AS INTEGER) AS n, chunk, start, "end", start > 0 AS fade_in, "end" < n AS fade_out FROM c""")
def _(spark, sf):
    return V.chunk_table(V.lengths_of(long_frames(spark, sf)), 250, 30)


@query("taper_blend", "long_frames", f"""WITH {CHUNKS}, x AS (SELECT f.series_id, f.frame_idx, f.pos*(1+chunk%2) AS v, frame_idx-start AS i, "end"-start AS len, start > 0 AS fi, "end" < n AS fo
    FROM long_frames f JOIN c ON f.series_id = c.series_id AND frame_idx >= start AND frame_idx < "end"),
y AS (SELECT *, (CASE WHEN fi AND i < least(30, len) THEN (i+1)/(least(30, len)+1)::DOUBLE ELSE 1 END)*(CASE WHEN fo AND len-i <= least(30, len) THEN (len-i)/(least(30, len)+1)::DOUBLE ELSE 1 END) AS w FROM x)
SELECT series_id, frame_idx, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(v*w)/greatest(sum(w), 1e-6::DOUBLE))), 6) AS pos FROM y GROUP BY series_id, frame_idx""")
def _(spark, sf):
    f = long_frames(spark, sf)
    c = V.chunk_frames(f, V.chunk_table(V.lengths_of(f), 250, 30).drop("n"))
    c = c.withColumn("pos", F.col("pos") * (1 + F.col("chunk") % 2))
    return rounded(V.taper_blend(c, 30), "pos")


def chunked(spark, sf):
    return long_frames(spark, sf).select("series_id", F.floor(F.col("frame_idx") / 900).alias("chunk"), "frame_idx", F.col("pos").cast("double").alias("pos"))


@query("troughs", "long_frames", """WITH e AS (SELECT series_id, frame_idx // 900 AS chunk, frame_idx, CAST(pos AS FLOAT) AS pos,
        CASE WHEN CAST(pos AS FLOAT) = lag(CAST(pos AS FLOAT)) OVER w THEN 0 ELSE 1 END AS new FROM long_frames WINDOW w AS (PARTITION BY series_id, frame_idx // 900 ORDER BY frame_idx)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY series_id, chunk ORDER BY frame_idx) AS k FROM e),
    r AS (SELECT series_id, chunk, k, min(frame_idx) AS a, max(frame_idx) AS b, any_value(pos) AS v FROM g GROUP BY ALL),
    t AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM r WINDOW w AS (PARTITION BY series_id, chunk ORDER BY k))
    SELECT series_id, CAST((a + b) // 2 AS INTEGER) AS frame_idx FROM t WHERE p > v AND n > v""")
def _(spark, sf):
    """Border case that SQL can express: every local minimum, neither spacing nor depth is asked for (see troughs_spaced)."""
    return V.troughs(chunked(spark, sf), 15.0, 0.0, 0.0).where("trough").select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"))


@query("lowpass", "long_frames", "SELECT series_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(CAST(CAST(pos AS FLOAT) AS DOUBLE), 6) AS low FROM long_frames")
def _(spark, sf):
    """Border case that SQL can express: a cut-off above the Nyquist rate passes everything (see lowpass_4hz)."""
    return rounded(V.lowpass(chunked(spark, sf), 15.0, 8.0).select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"), "low"), "low")


def filtered(source: str, by: str, fps: float, cutoff: float) -> str:
    """Definitions that end in ``low`` (by, i, v): the low-pass of second order of ``source`` (by, i, v), sample by sample."""
    (b0, b1, b2), (_, a1, a2) = (tuple(f"({c!r}::DOUBLE)" for c in map(float, k)) for k in kernels.butterworth(2, cutoff / (fps / 2)))
    z1, z2 = (f"({c!r}::DOUBLE)" for c in map(float, kernels.step_state(*kernels.butterworth(2, cutoff / (fps / 2)))))

    def run(name, given):
        y = lambda v, s: f"({b0} * {v} + {s})"
        state = lambda v, s, t: f"{b1} * {v} - {a1} * {y(v, s)} + {t} AS s1, {b2} * {v} - {a2} * {y(v, s)} AS s2"
        same = " AND ".join(f"e.{c} = f.{c}" for c in by.split(", "))
        return f"""{name} AS (SELECT {by}, 0::BIGINT AS k, {y('v', f'{z1} * v')} AS y, {state('v', f'{z1} * v', f'{z2} * v')} FROM {given} WHERE k = 0
            UNION ALL SELECT {', '.join(f'e.{c}' for c in by.split(', '))}, e.k, {y('e.v', 'f.s1')}, {state('e.v', 'f.s1', 'f.s2')} FROM {name} f JOIN {given} e ON {same} AND e.k = f.k + 1)"""
    return f"""src AS (SELECT *, count(*) OVER (PARTITION BY {by}) AS n, first_value(v) OVER (PARTITION BY {by} ORDER BY i) AS va,
            last_value(v) OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vz FROM {source}),
        ext AS (SELECT {by}, n, (i + 9)::BIGINT AS k, v FROM src WHERE n > 9 UNION ALL SELECT {by}, n, 9 - i, 2 * va - v FROM src WHERE n > 9 AND i BETWEEN 1 AND 9
            UNION ALL SELECT {by}, n, 2 * (n - 1) - i + 9, 2 * vz - v FROM src WHERE n > 9 AND i BETWEEN n - 10 AND n - 2),
        {run('forth', 'ext')}, turned AS (SELECT {by}, max(k) OVER (PARTITION BY {by}) - k AS k, y AS v FROM forth), {run('back', 'turned')},
        low AS (SELECT {by}, (max(k) OVER (PARTITION BY {by}) - k - 9)::INTEGER AS i, CAST(CAST(y AS FLOAT) AS DOUBLE) AS v, max(k) OVER (PARTITION BY {by}) - 17 AS n FROM back
            QUALIFY i BETWEEN 0 AND n - 1 UNION ALL SELECT {by}, i::INTEGER, CAST(CAST(v AS FLOAT) AS DOUBLE), n FROM src WHERE n <= 9)"""


def spaced_troughs(by: str, distance: int, depth: float) -> str:
    """Definitions that end in ``found`` (by, i): troughs of ``low`` by the plain rules."""
    same = " AND ".join(f"a.{c} = b.{c}" for c in by.split(", "))
    return f"""flat AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY {by} ORDER BY i) THEN 0 ELSE 1 END AS new FROM low),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY i) AS part FROM flat),
        parts AS (SELECT {by}, part, (min(i) + max(i)) // 2 AS pos, any_value(v) AS v FROM numbered GROUP BY {by}, part),
        minima AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v, pos DESC) AS rank FROM (SELECT * FROM parts
            QUALIFY lag(v) OVER (PARTITION BY {by} ORDER BY part) > v AND lead(v) OVER (PARTITION BY {by} ORDER BY part) > v)),
        chosen AS (SELECT {by}, rank, [pos] AS kept FROM minima WHERE rank = 1 UNION ALL SELECT {', '.join(f'b.{c}' for c in by.split(', '))}, b.rank,
            CASE WHEN len(list_filter(kept, lambda k: abs(k - b.pos) < {distance})) = 0 THEN list_append(kept, b.pos) ELSE kept END FROM chosen a JOIN minima b ON {same} AND b.rank = a.rank + 1),
        spaced AS (SELECT {by}, unnest(kept) AS pos FROM (SELECT {by}, arg_max(kept, rank) AS kept FROM chosen GROUP BY {by})),
        valued AS (SELECT a.*, v FROM spaced a JOIN low b ON {same} AND a.pos = b.i),
        walls AS (SELECT {', '.join(f'a.{c}' for c in by.split(', '))}, a.pos, a.v, coalesce(max(b.i) FILTER (WHERE b.i < a.pos AND b.v < a.v), -1) AS l,
            coalesce(min(b.i) FILTER (WHERE b.i > a.pos AND b.v < a.v), 1 << 30) AS r FROM valued a JOIN low b ON {same} GROUP BY ALL),
        found AS (SELECT {', '.join(f'a.{c}' for c in by.split(', '))}, a.pos::INTEGER AS i FROM walls a JOIN low b ON {same} AND b.i > a.l AND b.i < a.r GROUP BY {', '.join(f'a.{c}' for c in by.split(', '))}, a.pos, a.v
            HAVING least(max(b.v) FILTER (WHERE b.i <= a.pos), max(b.v) FILTER (WHERE b.i >= a.pos)) - a.v >= {depth}::DOUBLE)"""


WHOLE = "given AS (SELECT series_id, frame_idx AS i, pos::DOUBLE AS v FROM long_frames)"
CHUNKS = "given AS (SELECT series_id, frame_idx // 900 AS chunk, frame_idx % 900 AS i, pos::DOUBLE AS v FROM long_frames)"


@query("lowpass_whole", "long_frames", f"WITH RECURSIVE {WHOLE}, {filtered('given', 'series_id', 15.0, 4.0)} SELECT series_id, i AS frame_idx, round(v, 6) AS low FROM low")
def _(spark, sf):
    return rounded(P.lowpass_whole(long_frames(spark, sf), 15.0, 4.0), "low")


@query("troughs_whole", "long_frames", f"""WITH RECURSIVE {WHOLE}, {filtered('given', 'series_id', 15.0, 4.0)}, {spaced_troughs('series_id', 4, 0.035)}
    SELECT series_id, i AS frame_idx FROM found""")
def _(spark, sf):
    low = P.lowpass_whole(long_frames(spark, sf), 15.0, 4.0)
    return P.troughs_whole(low, 15.0, 0.035, 0.3, x="low").select("series_id", "frame_idx")


@query("troughs_spaced", "long_frames", f"""WITH RECURSIVE {CHUNKS}, {filtered('given', 'series_id, chunk', 15.0, 4.0)}, {spaced_troughs('series_id, chunk', 4, 0.035)}
    SELECT series_id, CAST(chunk * 900 + i AS INTEGER) AS frame_idx FROM found""")
def _(spark, sf):
    """Troughs of the filtered frames by depth and spacing, compared with plain loops in tests/test_flows.py. The default of 0.15 s
    is two frames at 15 fps, which any two minima keep, so four frames are asked for."""
    return V.troughs(V.lowpass(chunked(spark, sf), 15.0, 4.0), 15.0, 0.035, 0.3, x="low").where("trough").select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"))


@query("lowpass_4hz", "long_frames", f"""WITH RECURSIVE {CHUNKS}, {filtered('given', 'series_id, chunk', 15.0, 4.0)}
    SELECT series_id, CAST(chunk * 900 + i AS INTEGER) AS frame_idx, round(v, 6) AS low FROM low""")
def _(spark, sf):
    """Every frame filtered; compared with the plain recursion in tests/test_flows.py."""
    return rounded(V.lowpass(chunked(spark, sf), 15.0, 4.0).select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"), "low"), "low")


CYCLE_BOUNDS = """bounds AS (SELECT series_id, chunk, lag(i) OVER (PARTITION BY series_id, chunk ORDER BY i) AS a, i AS b FROM found),
    ranged AS (SELECT u.series_id, u.chunk, u.a, u.b FROM bounds u JOIN low l ON l.series_id = u.series_id AND l.chunk = u.chunk AND l.i BETWEEN u.a AND u.b
        WHERE u.b - u.a BETWEEN 2 AND 30 GROUP BY ALL HAVING CAST(max(l.v) AS FLOAT) - CAST(min(l.v) AS FLOAT) >= 0.3::FLOAT),
    inside AS (SELECT r.series_id, r.chunk, r.a, r.b, min(CAST(g.v AS FLOAT)) AS least, max(CAST(g.v AS FLOAT)) AS most FROM ranged r JOIN given g ON g.series_id = r.series_id
        AND g.chunk = r.chunk AND g.i BETWEEN r.a + 1 AND r.b GROUP BY ALL),
    cycles AS (SELECT s.*, CAST(g.v AS FLOAT) AS own, row_number() OVER (PARTITION BY s.series_id, s.chunk ORDER BY s.a) AS k FROM inside s JOIN given g
        ON g.series_id = s.series_id AND g.chunk = s.chunk AND g.i = s.a),
    told AS (SELECT series_id, chunk, a, b, k, own AS border, least(own, least) AS shift, greatest(own, most) - least(own, least) AS spread FROM cycles WHERE k = 1
        UNION ALL SELECT series_id, chunk, a, b, k, border, least(border, least), greatest(border, most) - least(border, least) FROM (
            SELECT c.*, CASE WHEN c.a = t.b AND t.spread > 1e-6 THEN CAST((c.own - t.shift) / t.spread AS FLOAT) ELSE c.own END AS border
            FROM told t JOIN cycles c ON c.series_id = t.series_id AND c.chunk = t.chunk AND c.k = t.k + 1)),
    good AS (SELECT * FROM told WHERE spread > 1e-6),
    moved AS (SELECT g.series_id, g.chunk, g.i, CAST((CAST(g.v AS FLOAT) - t.shift) / t.spread AS FLOAT) AS v FROM given g JOIN good t ON t.series_id = g.series_id AND t.chunk = g.chunk AND g.i > t.a AND g.i <= t.b),
    first AS (SELECT series_id, chunk, a AS i, CAST((border - shift) / spread AS FLOAT) AS v FROM good),
    waved AS (SELECT g.series_id, g.chunk, g.i, coalesce(s.v, m.v, CAST(g.v AS FLOAT)) AS v, s.v IS NOT NULL OR m.v IS NOT NULL AS inside
        FROM given g LEFT JOIN moved m USING (series_id, chunk, i) LEFT JOIN first s USING (series_id, chunk, i))"""
CYCLES = f"WITH RECURSIVE {CHUNKS}, {filtered('given', 'series_id, chunk', 15.0, 4.0)}, {spaced_troughs('series_id, chunk', 2, 0.035)}, {CYCLE_BOUNDS}"


@query("normalize_cycles", "long_frames", f"""{CYCLES}
    SELECT g.series_id, g.chunk::BIGINT AS chunk, CAST(g.chunk * 900 + g.i AS INTEGER) AS frame_idx, round(l.v, 6) AS low, f.i IS NOT NULL AS trough,
        round(CAST(g.v AS DOUBLE), 6) AS pos, g.inside AS in_cycle
    FROM waved g JOIN low l USING (series_id, chunk, i) LEFT JOIN found f USING (series_id, chunk, i)""")
def _(spark, sf):
    marked = V.troughs(V.lowpass(chunked(spark, sf), 15.0, 4.0), 15.0, x="low")
    return rounded(V.normalize_cycles(marked, 15.0, reference="low"), "pos", "low")


def savgol_weights():
    """Rows (window, target place, sample place, weight) of a parabola fitted to windows of 5, 7 and 9 samples."""
    import numpy as np
    out = []
    for w in (5, 7, 9):
        basis = np.vander(np.arange(w) - w // 2, 3, increasing=True)
        fit = basis @ np.linalg.pinv(basis)
        out += [f"({w}, {t}, {k}, {float(fit[t, k])!r}::DOUBLE)" for t in range(w) for k in range(w)]
    return ", ".join(out)


@query("smooth_savgol", "long_frames", f"""WITH x AS (SELECT series_id, frame_idx // 900 AS chunk, frame_idx, frame_idx % 900 AS i, pos::DOUBLE AS pos, CAST(CAST(pos AS FLOAT) AS DOUBLE) AS v,
        count(*) OVER (PARTITION BY series_id, frame_idx // 900) AS n FROM long_frames),
    y AS (SELECT *, CASE WHEN n >= 9 THEN 9 WHEN n >= 7 THEN 7 WHEN n >= 5 THEN 5 ELSE 0 END AS w FROM x),
    z AS (SELECT *, CASE WHEN i < w // 2 THEN i WHEN i >= n - w // 2 THEN i - (n - w) ELSE w // 2 END AS t FROM y),
    c(w, t, k, weight) AS (VALUES {savgol_weights()}),
    f AS (SELECT z.series_id, z.frame_idx, sum(c.weight * o.v) AS smooth FROM z JOIN c ON c.w = z.w AND c.t = z.t
        JOIN x o ON o.series_id = z.series_id AND o.chunk = z.chunk AND o.i = z.i - z.t + c.k GROUP BY z.series_id, z.frame_idx)
    SELECT z.series_id, z.chunk::BIGINT AS chunk, z.frame_idx, z.pos, round(CAST(CAST(coalesce(f.smooth, z.v) AS FLOAT) AS DOUBLE), 6) AS smooth
    FROM z LEFT JOIN f USING (series_id, frame_idx)""")
def _(spark, sf):
    return rounded(V.smooth(chunked(spark, sf), 15.0, "savgol"), "smooth")


WAVE = V.WaveConfig(chunk_seconds=20.0, chunk_overlap_seconds=2.0, lowpass_cutoff_hz=4.0)


def clean(source: str, cutoff: float = 4.0, linear: bool = False) -> str:
    """The clean-up of ``source`` in chunks of 300 frames that overlap by 30, rule by rule: ``cleaned`` (series_id, chunk, i, v), ``blended``."""
    low = filtered("given", "series_id, chunk", 15.0, cutoff) if cutoff else (
        "low AS (SELECT series_id, chunk, i::INTEGER AS i, v, count(*) OVER (PARTITION BY series_id, chunk) AS n FROM given)")
    stretched = "(w.v::DOUBLE - floor_) / greatest(height, 1e-6)" if linear else (
        "0.5::DOUBLE + 0.5::DOUBLE * tanh(4.0::DOUBLE * (w.v::DOUBLE - mean) / CASE WHEN dev <= 1e-6 THEN greatest(height / 6.0::DOUBLE, 1e-6) ELSE dev END)")
    return f"""total AS (SELECT series_id, max(frame_idx) + 1 AS total FROM {source} GROUP BY 1),
    chunks AS (SELECT series_id, total, unnest(range(0, greatest((total - 300 + 269) // 270, 0) + 1)) AS chunk FROM total),
    given AS (SELECT c.series_id, chunk, frame_idx - chunk * 270 AS i, CAST(CAST(pos AS FLOAT) AS DOUBLE) AS v FROM chunks c JOIN {source} f
        ON f.series_id = c.series_id AND frame_idx >= chunk * 270 AND frame_idx < chunk * 270 + 300),
    {low}, {spaced_troughs('series_id, chunk', 2, 0.035)}, {CYCLE_BOUNDS},
    wide AS (SELECT *, CASE WHEN n >= 7 THEN 7 WHEN n >= 5 THEN 5 ELSE 0 END AS w FROM low),
    placed AS (SELECT *, CASE WHEN i < w // 2 THEN i WHEN i >= n - w // 2 THEN i - (n - w) ELSE w // 2 END AS t FROM wide),
    fits(w, t, k, weight) AS (VALUES {savgol_weights()}),
    fitted AS (SELECT p.series_id, p.chunk, p.i, sum(f.weight * o.v) AS v FROM placed p JOIN fits f ON f.w = p.w AND f.t = p.t
        JOIN low o ON o.series_id = p.series_id AND o.chunk = p.chunk AND o.i = p.i - p.t + f.k GROUP BY ALL),
    base AS (SELECT l.series_id, l.chunk, l.i, l.n, CAST(coalesce(f.v, l.v) AS FLOAT) AS v FROM low l LEFT JOIN fitted f USING (series_id, chunk, i)),
    slopes AS (SELECT *, CASE WHEN n < 3 THEN 0::FLOAT WHEN i = 0 THEN lead(v) OVER o - v WHEN i = n - 1 THEN v - lag(v) OVER o
        ELSE CAST((lead(v) OVER o - lag(v) OVER o) / 2::FLOAT AS FLOAT) END AS g FROM base WINDOW o AS (PARTITION BY series_id, chunk ORDER BY i)),
    sized AS (SELECT s.*, abs(g) AS size, inside FROM slopes s JOIN waved w USING (series_id, chunk, i)),
    limits AS (SELECT series_id, chunk, greatest(0.00075::DOUBLE, quantile_cont(size::DOUBLE, 0.25)) AS lo, quantile_cont(size::DOUBLE, 0.9) AS hi
        FROM sized WHERE NOT inside AND size > 0 GROUP BY 1, 2),
    marked AS (SELECT s.*, lo, greatest(lo, hi) AS hi, size >= CAST(lo AS FLOAT) AS strong, size >= CAST(lo AS FLOAT) AND size <= CAST(greatest(lo, hi) AS FLOAT) AND NOT inside AS slow
        FROM sized s JOIN limits USING (series_id, chunk)),
    runs AS (SELECT series_id, chunk, i, sum(new) OVER (PARTITION BY series_id, chunk ORDER BY i) AS run FROM (
        SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY series_id, chunk ORDER BY i) <= 3 THEN 0 ELSE 1 END AS new FROM marked WHERE slow)),
    spans AS (SELECT series_id, chunk, min(i) AS a, max(i) + 1 AS b FROM runs GROUP BY series_id, chunk, run),
    steady AS (SELECT p.series_id, p.chunk, a, b FROM spans p JOIN marked m ON m.series_id = p.series_id AND m.chunk = p.chunk AND m.i >= a AND m.i < b
        GROUP BY ALL HAVING b - a >= 9 AND count(*) FILTER (WHERE strong) > 0
        AND abs(sum(CASE WHEN strong THEN sign(g) ELSE 0 END)) / greatest(count(*) FILTER (WHERE strong), 1)::DOUBLE >= 0.65 AND max(m.v)::DOUBLE - min(m.v)::DOUBLE >= 0.08),
    changed AS (SELECT s.series_id, s.chunk, a, b, avg(w.v::DOUBLE) AS mean, stddev_pop(w.v::DOUBLE) AS dev, min(w.v)::DOUBLE AS floor_, max(w.v)::DOUBLE - min(w.v)::DOUBLE AS height FROM steady s
        JOIN waved w ON w.series_id = s.series_id AND w.chunk = s.chunk AND w.i >= a AND w.i < b GROUP BY ALL HAVING max(w.v)::DOUBLE - min(w.v)::DOUBLE >= 0.08),
    cleaned AS (SELECT w.series_id, w.chunk, w.i, CASE WHEN c.a IS NULL THEN w.v ELSE CAST({stretched} AS FLOAT) END AS v FROM waved w
        LEFT JOIN changed c ON c.series_id = w.series_id AND c.chunk = w.chunk AND w.i >= c.a AND w.i < c.b),
    tapered AS (SELECT c.series_id, chunk * 270 + i AS frame_idx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) AS v,
        CASE WHEN chunk > 0 AND i < 30 THEN (i + 1) / 31.0::DOUBLE ELSE 1.0::DOUBLE END
        * CASE WHEN chunk * 270 + 300 < total AND 300 - i <= 30 THEN (300 - i) / 31.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM cleaned c JOIN total USING (series_id)),
    blended AS (SELECT series_id, frame_idx, sum(v * w) / sum(w) AS pos FROM tapered GROUP BY series_id, frame_idx)"""


CLEAN = "WITH RECURSIVE " + clean("long_frames")


@query("postprocess", "long_frames", f"{CLEAN} SELECT series_id, CAST(frame_idx AS INTEGER) AS frame_idx, round(pos, 6) AS pos FROM blended")
def _(spark, sf):
    return rounded(V.postprocess(long_frames(spark, sf), 15.0, WAVE), "pos")


@query("postprocess_stats", "long_frames", f"""{CLEAN},
    each AS (SELECT c.series_id, c.chunk, least(c.chunk * 270 + 300, total) AS over,
        (SELECT count(*) FROM found x WHERE x.series_id = c.series_id AND x.chunk = c.chunk) AS troughs,
        (SELECT count(*) FROM good x WHERE x.series_id = c.series_id AND x.chunk = c.chunk) AS cycles,
        (SELECT count(*) FROM changed x WHERE x.series_id = c.series_id AND x.chunk = c.chunk) AS segments,
        (SELECT count(*) FROM waved x WHERE x.series_id = c.series_id AND x.chunk = c.chunk AND inside) AS in_cycle,
        (SELECT coalesce(sum(b - a), 0) FROM steady x WHERE x.series_id = c.series_id AND x.chunk = c.chunk) AS in_slope,
        (SELECT count(*) FROM cleaned x WHERE x.series_id = c.series_id AND x.chunk = c.chunk AND (v < 0 OR v > 1)) AS clipped,
        coalesce((SELECT lo FROM limits x WHERE x.series_id = c.series_id AND x.chunk = c.chunk), 0) AS lo,
        coalesce((SELECT greatest(lo, hi) FROM limits x WHERE x.series_id = c.series_id AND x.chunk = c.chunk), 0) AS hi FROM chunks c)
    SELECT series_id, max(over)::BIGINT AS num_samples, count(*) AS num_chunks, sum(troughs)::BIGINT AS num_troughs, sum(cycles)::BIGINT AS num_normalized_cycles,
        sum(segments)::BIGINT AS num_gradient_segments, sum(in_cycle)::BIGINT AS num_cycle_samples, sum(in_slope)::BIGINT AS num_gradient_samples,
        sum(clipped)::BIGINT AS num_clipped_samples, round(max(lo), 6) AS gradient_low_threshold, round(max(hi), 6) AS gradient_high_threshold FROM each GROUP BY series_id""")
def _(spark, sf):
    return rounded(V.postprocess_stats(long_frames(spark, sf), 15.0, WAVE), "gradient_low_threshold", "gradient_high_threshold")


@query("postprocess_segments", "long_frames", f"""{CLEAN}
    SELECT series_id, chunk::BIGINT AS chunk, 'cycle' AS kind, (chunk * 270 + a)::BIGINT AS start, (chunk * 270 + b + 1)::BIGINT AS "end" FROM good
    UNION ALL SELECT series_id, chunk::BIGINT, 'gradient', (chunk * 270 + a)::BIGINT, (chunk * 270 + b)::BIGINT FROM changed""")
def _(spark, sf):
    return V.postprocess_segments(long_frames(spark, sf), 15.0, WAVE)


@query("postprocess_sweep", "long_frames", " UNION ALL ".join(f"""SELECT {k} AS config_id, * FROM (WITH RECURSIVE {clean('long_frames', *settings)}
    SELECT series_id, count(*) AS frames, round(avg(pos), 6) AS mean FROM blended GROUP BY series_id)""" for k, settings in enumerate([(4.0,), (4.0, True), (0.0,)])))
def _(spark, sf):
    import dataclasses as D
    configs = [WAVE, D.replace(WAVE, stretch_mode="linear"), D.replace(WAVE, lowpass_cutoff_hz=0.0)]
    out = V.postprocess_sweep(long_frames(spark, sf), 15.0, configs)
    return out.groupBy("config_id", "series_id").agg(F.count("*").alias("frames"), r6(F.avg("pos")).alias("mean"))


# ---------------------------------------------------------------- metrics

cte("diffs", """SELECT series_id, frame_idx, pos, coalesce(pos - lag(pos) OVER w, 0) AS diff1,
    coalesce(pos - 2*lag(pos) OVER w + lag(pos, 2) OVER w, 0) AS diff2 FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)""", "frames")


@query("differences", "diffs", "SELECT series_id, frame_idx, pos, diff1, diff2, abs(diff1) + 0.5::DOUBLE*abs(diff2) AS activity FROM diffs")
def _(spark, sf):
    return M.with_differences(frames(spark, sf))


@query("activity", "diffs", "SELECT series_id, frame_idx, round(2.0::DOUBLE*pow(abs(diff1) + 0.5::DOUBLE*abs(diff2), 1.5::DOUBLE), 6) AS activity FROM diffs")
def _(spark, sf):
    d = M.with_differences(frames(spark, sf), gain=2.0, power=1.5)
    return d.select("series_id", "frame_idx", r6("activity").alias("activity"))


@query("event_weights", "diffs", """SELECT series_id, frame_idx, round((1+a)/greatest(avg(1+a) OVER (PARTITION BY series_id), 1e-6::DOUBLE), 10) AS weight
    FROM (SELECT *, 3.0::DOUBLE*(abs(diff1) + 0.5::DOUBLE*abs(diff2)) AS a FROM diffs)""")
def _(spark, sf):
    return M.event_weights(frames(spark, sf)).select("series_id", "frame_idx", r6("weight", 10).alias("weight"))


@query("active_frames", "diffs", """WITH a AS (SELECT *, 3.0::DOUBLE*(abs(diff1) + 0.5::DOUBLE*abs(diff2)) AS activity FROM diffs),
t AS (SELECT series_id, quantile_cont(activity, 0.8) AS threshold FROM a GROUP BY series_id)
SELECT series_id, round(any_value(threshold), 10) AS threshold, CAST(count(*) FILTER (WHERE activity >= threshold) AS BIGINT) AS active,
    round(sum(CASE WHEN activity >= threshold THEN pos ELSE 0 END)/greatest(count(*) FILTER (WHERE activity >= threshold), 1), 10) AS active_mean
FROM a JOIN t USING (series_id) GROUP BY series_id""")
def _(spark, sf):
    f = M.active_frames(frames(spark, sf))
    return f.groupBy("series_id").agg(r6(F.max("threshold"), 10).alias("threshold"), F.count_if("active").alias("active"),
                                      r6(M.masked_mean(F.col("pos"), F.col("active")), 10).alias("active_mean"))


#: The eleven error metrics per series_id of ``source`` (series_id, frame_idx, pred, target).
METRICS_OF = """WITH b AS (SELECT *, pred - target AS e, lag(target) OVER w AS t1, lag(target, 2) OVER w AS t2, lag(pred) OVER w AS p1, lag(pred, 2) OVER w AS p2,
    row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
    sum(target) OVER k AS ts, sum(pred) OVER k AS ps, first_value(target) OVER u AS tf, last_value(target) OVER u AS tl, first_value(pred) OVER u AS pf, last_value(pred) OVER u AS pl
    FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx), k AS (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING),
    u AS (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
c AS (SELECT *, coalesce(target-t1, 0) AS td1, coalesce(target-2*t1+t2, 0) AS td2, coalesce(pred-p1, 0) AS pd1, coalesce(pred-2*p1+p2, 0) AS pd2,
    (pred - (ps + greatest(0, 7-i)*pf + greatest(0, 7-(n-1-i))*pl)/15) - (target - (ts + greatest(0, 7-i)*tf + greatest(0, 7-(n-1-i))*tl)/15) AS hf FROM b),
d AS (SELECT *, 3.0::DOUBLE*(abs(td1)+0.5::DOUBLE*abs(td2)) AS act FROM c),
q AS (SELECT series_id, quantile_cont(act, 0.8) AS cut FROM d GROUP BY series_id)
SELECT d.series_id, avg(e*e) AS pos_mse, avg(abs(e)) AS pos_mae, avg(e*e*(1+act))/greatest(avg(1+act), 1e-6) AS event_mse,
    sum(CASE WHEN act >= cut THEN e*e ELSE 0 END)/greatest(count(*) FILTER (WHERE act >= cut), 1) AS active_mse,
    sum(CASE WHEN act >= cut THEN abs(e) ELSE 0 END)/greatest(count(*) FILTER (WHERE act >= cut), 1) AS active_mae,
    avg((pd1-td1)*(pd1-td1)) AS vel_mse, avg(abs(pd1-td1)) AS vel_mae, avg((pd2-td2)*(pd2-td2)) AS acc_mse, avg(abs(pd2-td2)) AS acc_mae,
    avg(hf*hf) AS spec_mse, avg(act) AS activity_mean FROM d JOIN q USING (series_id) GROUP BY d.series_id"""
cte("metrics", METRICS_OF.format(source="pairs"), "pairs")
METRICS_SQL = ", ".join(f"round({m}, 10) AS {m}" for m in M.REGRESSION_METRICS)


@query("regression_metrics", "metrics", f"SELECT series_id, {METRICS_SQL} FROM metrics")
def _(spark, sf):
    return rounded(M.regression_metrics(pairs(spark, sf)), *M.REGRESSION_METRICS, digits=10)


@query("highfreq_mse", "metrics", "SELECT series_id, round(spec_mse, 10) AS spec_mse FROM metrics")
def _(spark, sf):
    return rounded(M.highfreq_mse(pairs(spark, sf)), "spec_mse", digits=10)


@query("composite_error", "metrics", """SELECT series_id, round(pos_mse*(1.0::DOUBLE-0.3::DOUBLE-0.1::DOUBLE) + 0.3::DOUBLE*vel_mse*60 + 0.1::DOUBLE*acc_mse*60, 10) AS composite FROM metrics""")
def _(spark, sf):
    m = M.composite_error(M.regression_metrics(pairs(spark, sf)), 0.3, 0.1)
    return m.select("series_id", r6("composite", 10).alias("composite"))


@query("scene_evaluation", "metrics", """SELECT series_id, round(pos_mse, 10) AS mse, round(event_mse, 10) AS event_mse, round(active_mse, 10) AS active_mse,
    round(vel_mae, 10) AS vel_mae, round(acc_mae, 10) AS acc_mae, round(spec_mse, 10) AS spec_mse FROM metrics""")
def _(spark, sf):
    p = pairs(spark, sf)
    out = M.scene_evaluation(p.select("series_id", "frame_idx", F.col("target").alias("pos")),
                             p.select("series_id", "frame_idx", F.col("pred").alias("pos")))
    return rounded(out, *M.SCENE_METRICS, digits=10)


@query("upsert_metrics", "metrics", """WITH s AS (SELECT series_id, round(pos_mse, 10) AS pos_mse FROM metrics WHERE series_id % 3 <> 0 UNION ALL
    SELECT series_id, -1.0::DOUBLE FROM metrics WHERE series_id % 3 = 0) SELECT * FROM s""")
def _(spark, sf):
    m = M.regression_metrics(pairs(spark, sf)).select("series_id", r6("pos_mse", 10).alias("pos_mse"))
    fresh = frames(spark, sf).select("series_id").distinct().where(F.col("series_id") % 3 == 0).withColumn("pos_mse", F.lit(-1.0))
    return M.upsert_metrics(m, fresh)


@query("label_stats", "frames", """SELECT series_id, count(*) AS frames, round(stddev_pop(pos), 10) AS label_std, round(max(pos)-min(pos), 10) AS label_range,
    round(avg(pos), 10) AS label_mean, min(pos) AS label_min, max(pos) AS label_max FROM frames GROUP BY series_id""")
def _(spark, sf):
    return rounded(M.label_stats(frames(spark, sf)), "label_std", "label_range", "label_mean", digits=10)


@query("align_series", "frames", """SELECT series_id, count(*) AS n FROM frames WHERE frame_idx < 40 + series_id % 20 GROUP BY series_id""")
def _(spark, sf):
    f = frames(spark, sf)
    short = f.where(F.col("frame_idx") < 40 + F.col("series_id") % 20).withColumnRenamed("pos", "other")
    return M.align_series(f, short).groupBy("series_id").agg(F.count("*").alias("n"))


MISMATCH = """mm AS (SELECT series_id, round(stddev_pop(target), 10) AS stored_std, round(avg((target <= 1e-4 OR target >= 1-1e-4)::INT), 10) AS flat_frac,
    round(sqrt(avg((target-pred)*(target-pred))), 10) AS rmse, round(max(abs(target-pred)), 10) AS max_abs FROM pairs GROUP BY series_id)"""


def mismatch(spark, sf):
    p = pairs(spark, sf)
    return rounded(M.label_mismatch(p.select("series_id", "frame_idx", F.col("target").alias("pos")),
                                    p.select("series_id", "frame_idx", F.col("pred").alias("pos"))),
                   "stored_std", "flat_frac", "rmse", "max_abs", digits=10)


@query("label_mismatch", "pairs", f"WITH {MISMATCH} SELECT * FROM mm")
def _(spark, sf):
    return mismatch(spark, sf)


@query("rank_mismatches", "pairs", f"""WITH {MISMATCH} SELECT *, (series_id % 5)::DOUBLE AS similarity FROM mm
    ORDER BY rmse DESC, 1.0 - similarity DESC, flat_frac DESC, series_id LIMIT 25""")
def _(spark, sf):
    m = mismatch(spark, sf).withColumn("similarity", (F.col("series_id") % 5).cast("double"))
    return M.rank_mismatches(m, 25)


@query("best_offset", "pairs", """WITH l AS (SELECT unnest(range(-4, 5))::INT AS lag), d AS (SELECT a.series_id, lag, avg(abs(a.target - b.pred)) AS score
    FROM pairs a CROSS JOIN l JOIN pairs b ON a.series_id = b.series_id AND b.frame_idx = a.frame_idx + lag GROUP BY a.series_id, lag)
SELECT series_id, arg_min(lag, (round(score, 9), lag)) AS lag, round(arg_min(lag, (round(score, 9), lag))/25.0::DOUBLE, 10) AS offset_sec, round(min(score), 10) AS score FROM d GROUP BY series_id""")
def _(spark, sf):
    return rounded(M.best_offset(pairs(spark, sf), 4, 25.0, a="target", b="pred"), "offset_sec", "score", digits=10)


@query("pred_vs_baseline", "pairs", """SELECT series_id, count(*) AS frames, round(avg((pred-target)*(pred-target)), 10) AS mse, round(max(abs(pred-target)), 10) AS max_abs,
    avg((pred-target)*(pred-target)) < 1e-6 AS identical FROM pairs GROUP BY series_id""")
def _(spark, sf):
    return rounded(M.pred_vs_baseline(pairs(spark, sf)), "mse", "max_abs", digits=10)


@query("values_close", "frames", """SELECT series_id, series_id % 4 <> 1 AND NOT (series_id % 6 = 2) AS close FROM frames GROUP BY series_id""")
def _(spark, sf):
    f = frames(spark, sf)
    other = f.withColumn("pos", F.when((F.col("series_id") % 4 == 1) & (F.col("frame_idx") == 5), F.col("pos") + 0.1).otherwise(F.col("pos")))
    other = other.where((F.col("series_id") % 6 != 2) | (F.col("frame_idx") < 30))
    return M.values_close(f, other)


@query("benchmark_summary", "metrics", """WITH l AS (UNPIVOT (SELECT series_id % 4 AS label, pos_mse, event_mse, active_mse, vel_mse, vel_mae, acc_mae, spec_mse FROM metrics)
    ON pos_mse, event_mse, active_mse, vel_mse, vel_mae, acc_mae, spec_mse INTO NAME metric VALUE value)
SELECT label, metric, count(*) AS n, round(avg(value), 10) AS mean, round(stddev_pop(value), 10) AS std FROM l GROUP BY label, metric""")
def _(spark, sf):
    m = M.regression_metrics(pairs(spark, sf)).withColumn("label", F.col("series_id") % 4)
    return rounded(M.benchmark_summary(m), "mean", "std", digits=10)


@query("exact_quantile", "long_frames", """SELECT series_id, round(quantile_cont(pos, 0.37), 6) AS threshold FROM long_frames GROUP BY series_id""")
def _(spark, sf):
    return rounded(exact_quantile(long_frames(spark, sf), F.col("pos"), 0.37), "threshold")


# ---------------------------------------------------------------- flagship

@query("flagship", "grid_times actions", f"""WITH {BRACKET},
g AS (SELECT series_id, frame_idx, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t0 IS NULL THEN pa WHEN t1 IS NULL THEN p0 ELSE p0 + (p1-p0)*((t_ms-t0)/(t1-t0)) END)) AS target FROM j),
pr AS (SELECT *, avg(target) OVER (PARTITION BY series_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pred FROM g)
SELECT series_id, count(*) AS frames, round(avg((pred-target)*(pred-target)), 10) AS pos_mse, round(avg(abs(pred-target)), 10) AS pos_mae FROM pr GROUP BY series_id""")
def flagship(spark, sf):
    """Dedup, grid, linear interpolation, and error of a smoothed copy, per user."""
    g = R.resample(actions(spark, sf), grids(spark, sf), "linear", start_sec="start_sec", block_ms=DAY)
    w = B.block_window().rowsBetween(-2, 2)
    p = B.halo_columns(g.select("series_id", "frame_idx", F.col("pos").alias("target")),
                       [("pred", F.avg("target").over(w))], 2, 2)
    out = M.pred_vs_baseline(p).join(
        p.groupBy("series_id").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("pos_mae")), "series_id")
    return out.select("series_id", "frames", r6("mse", 10).alias("pos_mse"), r6("pos_mae", 10).alias("pos_mae"))
