"""Queries over windows, augmentations, per-frame features and keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as A, blocks as B, features as H, keyed as K, metrics as M, waves as V, windows as G
from .roles import actions, cte, drawn, frames, normal, pairs, query, r6, rounded, segments, table, unit
from .catalog_queries import analysis
from .series_queries import METRICS_OF

SEQ, STRIDE = 12, 5

# ---------------------------------------------------------------- windows

cte("lengths", "SELECT series_id, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY series_id", "frames")
cte("fit_windows", f"""SELECT series_id, n, CAST(k*{STRIDE} AS INTEGER) AS start FROM (SELECT *, unnest(range((n-{SEQ})//{STRIDE}+1)) AS k FROM lengths WHERE n >= {SEQ})""", "lengths")
cte("cut_windows", f"""SELECT series_id, start, frame_idx - start AS i, pos FROM fit_windows JOIN frames USING (series_id) WHERE frame_idx >= start AND frame_idx < start + {SEQ}""", "fit_windows", "frames")


def lengths(spark, sf):
    return V.lengths_of(frames(spark, sf))


def windows(spark, sf):
    f = frames(spark, sf)
    return G.materialize_windows(f, G.window_index(V.lengths_of(f), SEQ, STRIDE), ["pos"], SEQ)


def unrolled(df, column="pos", *extra):
    return rows_of(df, column, ["series_id", "start", *extra], "i", column)


def rows_of(df, column, kept, *names):
    """``posexplode`` that works its array out once: the inner one is given a filter on the size of the array, which holds the whole expression again."""
    return df.select(*kept, F.posexplode_outer(column).alias(*names)).where(F.col(names[0]).isNotNull())


@query("window_index", "fit_windows", "SELECT series_id, n, start FROM fit_windows")
def _(spark, sf):
    return G.window_index(lengths(spark, sf), SEQ, STRIDE)


@query("window_index_full", "", """WITH l AS (SELECT l_suppkey % 500 AS series_id, l_orderkey AS part, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY ALL),
w AS (SELECT series_id, part, n, CAST(k*3 AS INTEGER) AS start FROM (SELECT *, unnest(range((n-4)//3+1)) AS k FROM l WHERE n >= 4)
    UNION ALL SELECT series_id, part, n, n-4 FROM l WHERE n > 4 AND (n-4) % 3 <> 0 UNION ALL SELECT series_id, part, n, 0 FROM l WHERE n < 4)
SELECT *, least(n, 4) AS length FROM w""")
def _(spark, sf):
    parts = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 500).alias("series_id"), F.col("l_orderkey").alias("part"))
    # nearly every row is a part of its own: counted in all shuffle partitions, which are not merged by their small size
    l = B.spread(parts, "series_id", "part").groupBy("series_id", "part").agg(F.count("*").cast("int").alias("n"))
    return G.window_index_full(l, 4, 3)


@query("materialize_windows", "cut_windows", "SELECT series_id, start, i, pos FROM cut_windows")
def _(spark, sf):
    return unrolled(windows(spark, sf))


@query("assemble_features", "frames", """SELECT series_id, frame_idx, pos, pos*2.0::DOUBLE AS emb, CASE WHEN frame_idx % 3 = 0 THEN pos*3.0::DOUBLE ELSE 0.0::DOUBLE END AS flow FROM frames WHERE series_id % 4 <> 0""")
def _(spark, sf):
    f = frames(spark, sf)
    emb = f.where(F.col("series_id") % 4 != 0).select("series_id", "frame_idx", (F.col("pos") * F.lit(2.0)).alias("emb"))
    flow = f.where(F.col("frame_idx") % 3 == 0).select("series_id", "frame_idx", (F.col("pos") * F.lit(3.0)).alias("flow"))
    return G.assemble_features(f, [emb], {"flow": (flow, F.lit(0.0))})


def two_channels(x):
    import numpy as np
    return np.stack([x * 2.0, 1.0 - x], axis=1)


@query("score_windows", "cut_windows", """SELECT series_id, start, c AS channel, i, CASE c WHEN 0 THEN pos*2.0::DOUBLE ELSE 1.0::DOUBLE - pos END AS value FROM cut_windows, (SELECT unnest(range(2))::INTEGER AS c)""")
def _(spark, sf):
    s = G.score_windows(windows(spark, sf), two_channels)
    return s.select("series_id", "start", F.posexplode("pred").alias("channel", "p")).select(
        "series_id", "start", "channel", F.posexplode("p").alias("i", "value"))


@query("blend_windows", "cut_windows", f"""SELECT series_id, start + i AS frame_idx, 0 AS channel, round(sum(pos*(1+start%3)*w)/sum(w), 6) AS pos
    FROM (SELECT *, 1.0::DOUBLE - abs(2.0::DOUBLE*i/{SEQ - 1} - 1.0::DOUBLE) + 0.01::DOUBLE AS w FROM cut_windows) GROUP BY ALL""")
def _(spark, sf):
    w = windows(spark, sf)
    s = w.select("series_id", "start", "length", F.array(F.transform("pos", lambda x: x * (1 + F.col("start") % 3))).alias("pred"))
    return rounded(G.blend_windows(s, SEQ), "pos")


#: Blend of a model of two channels whose answer depends on the first frame of the window.
BLENDED = """WITH n AS (SELECT series_id, max(frame_idx) + 1 AS n FROM frames GROUP BY 1),
    w AS (SELECT series_id, unnest(CASE WHEN n < {seq} THEN [0] ELSE list_distinct(list_concat(range(0, n - {seq} + 1, {stride}), [n - {seq}])) END) AS s FROM n),
    x AS (SELECT f.series_id, f.frame_idx, f.pos, g.pos AS p0, 1 - abs(2 * (f.frame_idx - s) / ({seq} - 1)::DOUBLE - 1) + 0.01::DOUBLE AS t FROM w
        JOIN frames f ON f.series_id = w.series_id AND f.frame_idx >= s AND f.frame_idx < s + {seq} JOIN frames g ON g.series_id = w.series_id AND g.frame_idx = s)
    SELECT series_id, CAST(frame_idx AS {kind}) AS frame_idx, c AS channel, round(sum(t * CASE c WHEN 0 THEN 2 * pos + p0 ELSE 1 - pos + 3 * p0 END) / sum(t), 6) AS pos
    FROM x, (SELECT unnest(range(2))::INTEGER AS c) GROUP BY series_id, frame_idx, c"""


def window_model(x):
    import numpy as np
    return np.stack([2.0 * x + x[:, :1], 1.0 - x + 3.0 * x[:, :1]], axis=1)


@query("sliding_predict", "frames", BLENDED.format(seq=60, stride=25, kind="INTEGER"))
def _(spark, sf):
    return rounded(G.sliding_predict(frames(spark, sf), window_model, seq=60, stride=25), "pos")


@query("epoch_subset", "fit_windows", """SELECT series_id, n, start FROM (SELECT *, row_number() OVER (ORDER BY (series_id*7919 + start*104729) % 1000003, series_id, start) AS rn FROM fit_windows) WHERE rn <= 300""")
def _(spark, sf):
    h = ((F.col("series_id") * 7919 + F.col("start").cast("bigint") * 104729) % 1000003) * F.lit(1 << 43)
    return G.epoch_subset(G.window_index(lengths(spark, sf), SEQ, STRIDE).withColumn("h", h), 300, hash_column="h").drop("h")


@query("epoch_subset_seeded", "fit_windows", "SELECT least(300, count(*)) AS n, least(300, count(*)) AS known FROM fit_windows")
def _(spark, sf):
    ix = G.window_index(lengths(spark, sf), SEQ, STRIDE)
    e = G.epoch_subset(ix, 300, 42, 3)
    return e.agg(F.count("*").alias("n"), F.count_if((F.col("start") >= 0) & (F.col("start") + SEQ <= F.col("n"))).alias("known"))


@query("epoch_subset_drawn", "fit_windows", f"""SELECT series_id, n, start FROM fit_windows
    QUALIFY row_number() OVER (ORDER BY {drawn(45, 'series_id', 'start')}, series_id, start) <= 300""")
def _(spark, sf):
    """The windows of the fourth epoch themselves (see epoch_subset_seeded, which counts them)."""
    return G.epoch_subset(G.window_index(lengths(spark, sf), SEQ, STRIDE), 300, 42, 3)


@query("epoch_subset_first", "fit_windows", "SELECT series_id, n, start FROM fit_windows ORDER BY series_id, start LIMIT 300")
def _(spark, sf):
    return G.epoch_subset(G.window_index(lengths(spark, sf), SEQ, STRIDE), 300, shuffle=False)


@query("sample_windows", "fit_windows", f"""SELECT series_id, n, start FROM fit_windows
    QUALIFY row_number() OVER (ORDER BY {drawn(42, 'series_id', 'start')}, series_id, start) <= 10""")
def _(spark, sf):
    return G.sample_windows(G.window_index(lengths(spark, sf), SEQ, STRIDE), 10, 42)


@query("sample_windows_explicit", "fit_windows", "SELECT series_id, n, start FROM fit_windows WHERE start = 10 AND series_id % 3 = 0")
def _(spark, sf):
    ix = G.window_index(lengths(spark, sf), SEQ, STRIDE)
    want = ix.select("series_id").distinct().where(F.col("series_id") % 3 == 0).withColumn("start", F.lit(10))
    return G.sample_windows(ix, explicit=want)


@query("unknown_windows", "lengths", f"SELECT series_id, 50 AS start FROM lengths WHERE n < 50 + {SEQ}")
def _(spark, sf):
    l = lengths(spark, sf)
    return G.unknown_windows(G.window_index(l, SEQ, STRIDE), l.select("series_id", F.lit(50).alias("start")))


SUITE = f"""WITH w AS (SELECT series_id AS s, k * 30 AS start FROM (SELECT series_id, unnest(range((n - 30) // 30 + 1)) AS k FROM lengths WHERE n >= 30)
        QUALIFY row_number() OVER (ORDER BY {drawn(42, 'series_id', 'k * 30')}, series_id, k) <= 40),
    cut AS (SELECT s, start, frame_idx - start AS frame_idx, pos AS target FROM w JOIN frames f ON f.series_id = w.s AND frame_idx >= start AND frame_idx < start + 30),
    scored AS (SELECT label || '/' || s || '/' || start AS series_id, frame_idx, target * a + b AS pred, target FROM cut, (VALUES ('identity', 1.0::DOUBLE, 0.0::DOUBLE), ('damped', 0.8, 0.1)) m(label, a, b)),
    m AS ({METRICS_OF.format(source='scored')}),
    p AS (SELECT series_id, avg(pred) AS pred_mean, stddev_pop(pred) AS pred_std FROM scored GROUP BY series_id),
    l AS (UNPIVOT (SELECT split_part(series_id, '/', 1) AS label, {', '.join(f'{n}::DOUBLE AS {n}' for n in M.BENCHMARK_METRICS)} FROM m JOIN p USING (series_id))
        ON {', '.join(M.BENCHMARK_METRICS)} INTO NAME metric VALUE value)
    SELECT label, metric, count(value) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM l GROUP BY label, metric"""


@query("benchmark_suite", "lengths", SUITE)
def _(spark, sf):
    """The same sampled windows for two models: score, metrics per window, summary per model."""
    from .flows import benchmark_suite
    models = {"identity": G.LinearScorer((1.0,)), "damped": G.LinearScorer((0.8,), 0.1)}
    return rounded(benchmark_suite(frames(spark, sf), models, seq=30, stride=30, count=40, seed=42), "mean", "std", digits=9)


@query("choose_segments", "", f"""WITH v AS (SELECT o_orderkey AS scene_id, o_totalprice / 1000.0::DOUBLE AS duration FROM orders),
    f AS (SELECT *, least(3, floor(duration / 40.0::DOUBLE))::INTEGER AS fits FROM v),
    k AS (SELECT *, unnest(range(1, fits + 1))::INTEGER AS k FROM f WHERE duration > 40),
    d AS (SELECT *, {unit(42, 'scene_id', 'k')} * (duration - fits * 40.0::DOUBLE) AS cut FROM k)
    SELECT scene_id, duration, round(cut + 40.0::DOUBLE * (row_number() OVER (PARTITION BY scene_id ORDER BY cut) - 1), 6) AS segment_start_sec FROM d
    UNION ALL SELECT scene_id, duration, 0.0::DOUBLE FROM f WHERE duration <= 40 AND duration >= 20""")
def _(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scene_id"), (F.col("o_totalprice") / F.lit(1000.0)).alias("duration"))
    return rounded(G.choose_segments(v, 40.0, 3), "segment_start_sec")


#: Seconds from 1e9 up to 1e10 as Spark prints them: a digit, the further digits up to milliseconds without zeros at the end, E9.
PRINTED = "regexp_replace(regexp_replace(substr(CAST(round(t * 1000) AS BIGINT)::VARCHAR, 1, 1) || '.' || substr(CAST(round(t * 1000) AS BIGINT)::VARCHAR, 2), '0+$', ''), '\\.$', '.0') || 'E9'"
BY_BIN = f"""WITH RECURSIVE target AS (SELECT bin_id FROM analysis WHERE bin_id <> 0 GROUP BY bin_id ORDER BY count(*), bin_id LIMIT 3),
    v AS (SELECT scene_id, max(start_time_sec)::DOUBLE AS duration FROM analysis GROUP BY scene_id),
    cand AS (SELECT DISTINCT scene_id, start_time_sec::DOUBLE AS t FROM analysis JOIN target USING (bin_id)),
    fit AS (SELECT scene_id, duration, t, row_number() OVER (PARTITION BY scene_id ORDER BY {drawn(42, 'scene_id', PRINTED)}, t) AS rank
        FROM cand JOIN v USING (scene_id) WHERE t + 86400 <= duration),
    taken AS (SELECT scene_id, duration, rank, [t] AS kept FROM fit WHERE rank = 1 UNION ALL SELECT f.scene_id, f.duration, f.rank,
        CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda k: abs(k - f.t) < 86400)) = 0 THEN list_append(kept, f.t) ELSE kept END
        FROM taken t JOIN fit f ON f.scene_id = t.scene_id AND f.rank = t.rank + 1),
    free AS (SELECT *, least(3, floor(duration / 86400.0::DOUBLE))::INTEGER AS fits FROM v WHERE scene_id NOT IN (SELECT scene_id FROM cand)),
    k AS (SELECT *, unnest(range(1, fits + 1))::INTEGER AS k FROM free WHERE duration > 86400),
    d AS (SELECT *, {unit(42, 'scene_id', 'k')} * (duration - fits * 86400.0::DOUBLE) AS cut FROM k)
    SELECT scene_id, duration, unnest(arg_max(kept, rank)) AS segment_start_sec FROM taken GROUP BY scene_id, duration
    UNION ALL SELECT scene_id, duration, round(cut + 86400.0::DOUBLE * (row_number() OVER (PARTITION BY scene_id ORDER BY cut) - 1), 6) FROM d
    UNION ALL SELECT scene_id, duration, 0.0::DOUBLE FROM free WHERE duration <= 86400 AND duration >= 43200"""


@query("choose_segments_by_bin", "analysis", BY_BIN)
def _(spark, sf):
    a = analysis(spark, sf)
    bins = a.groupBy("bin_id").agg(F.count("*").alias("count"))
    v = a.groupBy("scene_id").agg(F.max("start_time_sec").alias("duration"))
    return rounded(G.choose_segments_by_bin(v, a, bins, 86_400.0, 3, [0]), "segment_start_sec")


@query("update_bins", "analysis", """SELECT bin_id, count(*) + count(*) FILTER (WHERE scene_id % 2 = 0) AS count FROM analysis GROUP BY bin_id""")
def _(spark, sf):
    a = analysis(spark, sf)
    return G.update_bins(a.groupBy("bin_id").agg(F.count("*").alias("count")), a.where(F.col("scene_id") % 2 == 0))


# ---------------------------------------------------------------- augmentations (flag: every second series)

def flag():
    return F.col("series_id") % 2 == 0


@query("augment_time_reverse", "cut_windows", f"SELECT series_id, start, CASE WHEN series_id % 2 = 0 THEN {SEQ - 1} - i ELSE i END AS i, pos FROM cut_windows")
def _(spark, sf):
    return unrolled(A.time_reverse(windows(spark, sf), flag(), ["pos"]))


@query("augment_invert", "cut_windows", "SELECT series_id, start, i, CASE WHEN series_id % 2 = 0 THEN 1.0::DOUBLE - pos ELSE pos END AS pos FROM cut_windows")
def _(spark, sf):
    return unrolled(A.invert(windows(spark, sf), flag()))


@query("augment_roll", "cut_windows", f"SELECT series_id, start, CASE WHEN series_id % 2 = 0 THEN (i + (start % 11 - 5) + {2 * SEQ}) % {SEQ} ELSE i END AS i, pos FROM cut_windows")
def _(spark, sf):
    return unrolled(A.roll(windows(spark, sf), flag(), F.col("start") % 11 - 5, ["pos"]))


@query("augment_speed", "cut_windows", f"""WITH a AS (SELECT * FROM cut_windows), t AS (SELECT series_id, start, i, CAST(floor({SEQ}*1.1::DOUBLE) AS INTEGER) AS m FROM a)
SELECT t.series_id, t.start, t.i, b.pos FROM t JOIN a b ON b.series_id = t.series_id AND b.start = t.start
    AND b.i = CASE WHEN t.series_id % 2 = 0 THEN least({SEQ - 1}, CAST(floor(least(t.i, m-1)*{SEQ - 1}/(m-1)::DOUBLE) AS INTEGER)) ELSE t.i END""")
def _(spark, sf):
    return unrolled(A.speed(windows(spark, sf), flag(), F.lit(1.1), ["pos"]))


@query("augment_label_noise", "cut_windows", f"""SELECT series_id, start, i, round(CASE WHEN series_id % 2 = 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    pos + 0.02::DOUBLE * {normal(42, "'label'", "'0'", 'series_id', 'start', 'i')})) ELSE pos END, 6) AS pos FROM cut_windows""")
def _(spark, sf):
    return rounded(unrolled(A.label_noise(windows(spark, sf), flag(), 42, 0, ["series_id", "start"])), "pos")


def vector_windows(spark, sf):
    v = vectors(spark, sf)
    ix = G.window_index(V.lengths_of(v), 8, 8)
    w = G.materialize_windows(v.withColumn("pos", F.col("v")[0]), ix, ["pos", "v"], 8)
    return w


def wide(df):
    return rows_of(rows_of(df, "v", ["series_id", "start"], "i", "x"), "x", ["series_id", "start", "i"], "dim", "value")


cte("vectors", "SELECT label AS series_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS frame_idx, embedding AS v FROM embeddings")
cte("vector_values", "SELECT series_id, frame_idx, CAST(unnest(range(len(v))) AS INTEGER) AS dim, unnest(v)::DOUBLE AS x FROM vectors", "vectors")
cte("vector_windows", """SELECT series_id, frame_idx // 8 * 8 AS start, frame_idx % 8 AS i, dim, x FROM vector_values JOIN (SELECT series_id, count(*) AS n FROM vectors GROUP BY series_id) USING (series_id) WHERE frame_idx // 8 * 8 + 8 <= n""", "vector_values")


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("series_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return B.dense_index(e, "frame_idx", series="series_id", order="vec_id", block=65_536).select("series_id", "frame_idx", "v")


@query("augment_slice_dropout", "vector_windows", "SELECT series_id, start, i, dim, CASE WHEN series_id % 2 = 0 AND dim >= 8 AND dim < 24 THEN 0.0::DOUBLE ELSE x END AS value FROM vector_windows")
def _(spark, sf):
    return wide(A.slice_dropout(vector_windows(spark, sf), flag(), "v", F.lit(8), F.lit(24)))


@query("augment_hflip", "vector_windows", "SELECT series_id, start, i, CASE WHEN series_id % 2 = 0 THEN dim // 8 * 8 + 7 - dim % 8 ELSE dim END AS dim, x AS value FROM vector_windows")
def _(spark, sf):
    return wide(A.hflip(vector_windows(spark, sf), flag(), "v", 8))


@query("augment_dim_dropout", "vector_windows", f"""SELECT series_id, start, i, dim, CASE WHEN series_id % 2 = 0
    AND {unit(42, "'dim'", "'0'", 'series_id', 'start', 'dim')} < 0.1::DOUBLE THEN 0.0::DOUBLE ELSE x END AS value FROM vector_windows""")
def _(spark, sf):
    return wide(A.dim_dropout(vector_windows(spark, sf), flag(), "v", 42, 0, ["series_id", "start"]))


@query("augment_feature_noise", "vector_windows", f"""SELECT series_id, start, i, dim, round(CASE WHEN series_id % 2 = 0
    THEN x + 0.02::DOUBLE * stddev_samp(x) OVER (PARTITION BY series_id, start) * {normal(42, "'feature'", "'0'", 'series_id', 'start', 'i', 'dim')}
    ELSE x END, 6) AS value FROM vector_windows""")
def _(spark, sf):
    return rounded(wide(A.feature_noise(vector_windows(spark, sf), flag(), "v", 42, 0, ["series_id", "start"])), "value")


def pose_windows(spark, sf):
    p = poses(spark, sf).where(F.col("slot") == 0)
    return G.materialize_windows(p.withColumn("pos", F.lit(0.5)), G.window_index(V.lengths_of(p), 4, 4), ["pos", "kp"], 4)


def points(df):
    x = rows_of(rows_of(df, "kp", ["series_id", "start"], "i", "kp"), "kp", ["series_id", "start", "i"], "k", "p")
    return x.select("series_id", "start", "i", "k", "p.x", "p.y", "p.conf")


POINTS = """WITH n AS (SELECT series_id, max(frame_idx) + 1 AS n FROM pose_points GROUP BY series_id),
    w AS (SELECT series_id, frame_idx // 4 * 4 AS start, frame_idx % 4 AS i, k, x, y, conf FROM pose_points JOIN n USING (series_id)
        WHERE slot = 0 AND frame_idx // 4 * 4 + 4 <= n)"""


def shaken(axis):
    moved = f"{axis} + 0.01::DOUBLE * {normal(42, f"'pose_{axis}'", "'0'", 'series_id', 'start', 'i', 'k')}"
    return f"round(CASE WHEN series_id % 2 = 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {moved})) ELSE {axis} END, 6) AS {axis}"


@query("augment_pose_noise", "pose_points", f"{POINTS} SELECT series_id, start, i, k, {shaken('x')}, {shaken('y')}, conf FROM w")
def _(spark, sf):
    return rounded(points(A.pose_noise(pose_windows(spark, sf), flag(), "kp", 42, 0, ["series_id", "start"])), "x", "y")


@query("augment_keypoint_dropout", "pose_points", f"""{POINTS}, d AS (SELECT *, series_id % 2 = 0 AND
    {unit(42, "'point'", "'0'", 'series_id', 'start', 'i', 'k')} < 0.1::DOUBLE AS gone FROM w)
    SELECT series_id, start, i, k, CASE WHEN gone THEN 0 ELSE x END AS x, CASE WHEN gone THEN 0 ELSE y END AS y, CASE WHEN gone THEN 0 ELSE conf END AS conf FROM d""")
def _(spark, sf):
    return points(A.keypoint_dropout(pose_windows(spark, sf), flag(), "kp", 42, 0, ["series_id", "start"]))


@query("augment_invert_pose", "pose_points", """WITH n AS (SELECT series_id, max(frame_idx) + 1 AS n FROM pose_points GROUP BY series_id)
SELECT series_id, frame_idx // 4 * 4 AS start, frame_idx % 4 AS i, k, x, CASE WHEN series_id % 2 = 0 THEN 1.0::DOUBLE - y ELSE y END AS y, conf
    FROM pose_points JOIN n USING (series_id) WHERE slot = 0 AND frame_idx // 4 * 4 + 4 <= n""")
def _(spark, sf):
    return points(A.invert(pose_windows(spark, sf), flag(), "pos", "kp"))


def augmented(spark, sf):
    return A.augment(vector_windows(spark, sf), ["pos", "v"], 42, 1, grid="v", grid_width=8, slices=[(0, 16), (16, 64)])


def chances(epoch):
    return ", ".join(f"{unit(42, f"'{n}'", f"'{epoch}'", 'series_id', 'start')} < {r}::DOUBLE AS {n}" for n, r in A.RATES.items())


@query("augment", "vector_windows", f"""WITH f AS (SELECT *, {chances(1)}, CAST(floor({unit(42, "'shift'", "'1'", 'series_id', 'start')} * 11) AS INTEGER) - 5 AS shift,
        {unit(42, "'slice'", "'1'", 'series_id', 'start')} < 0.5::DOUBLE AS low FROM vector_windows),
    r AS (SELECT *, CASE WHEN time_reverse THEN 7 - i ELSE i END AS t FROM f)
    SELECT series_id, start, CAST(CASE WHEN roll THEN (t + shift + 8) % 8 ELSE t END AS INTEGER) AS i,
        CAST(CASE WHEN hflip THEN dim // 8 * 8 + 7 - dim % 8 ELSE dim END AS INTEGER) AS dim,
        CASE WHEN slice_dropout AND (dim < 16) = low THEN 0.0::DOUBLE ELSE x END AS value FROM r""")
def _(spark, sf):
    return wide(augmented(spark, sf))


@query("augmentation_rates", "fit_windows", f"""WITH f AS (SELECT {chances(0)}, CAST(floor({unit(42, "'shift'", "'0'", 'series_id', 'start')} * 11) AS INTEGER) - 5 AS shift FROM fit_windows)
    SELECT unnest(['time_reverse', 'roll', 'slice_dropout', 'hflip']) AS augmentation, round(unnest([avg(time_reverse::INTEGER), avg((roll AND shift <> 0)::INTEGER), 0, 0]), 9) AS rate,
        count(*) AS windows FROM f""")
def _(spark, sf):
    """How often each augmentation applied; without a grid the last two never do."""
    w = windows(spark, sf)
    return rounded(M.augmentation_rates(A.augment(w, ["pos"], 42, 0), list(A.RATES)), "rate", digits=9)


# ---------------------------------------------------------------- vectors and channels


@query("feature_stats", "vector_values", """SELECT dim, round(avg(x), 6) AS mean, round(greatest(sqrt(greatest(var_pop(x), 1e-12)), 1e-6), 6) AS std, count(*) AS n FROM vector_values GROUP BY dim""")
def _(spark, sf):
    return rounded(H_stats(spark, sf), "mean", "std")


def H_stats(spark, sf):
    return M.feature_stats(vectors(spark, sf), width=64)


@query("normalize_features", "vector_values", """WITH s AS (SELECT dim, avg(x) AS mean, greatest(sqrt(greatest(var_pop(x), 1e-12)), 1e-6) AS std FROM vector_values GROUP BY dim)
SELECT series_id, frame_idx, dim, round((x - mean)/(std + 1e-8::DOUBLE), 6) AS value FROM vector_values JOIN s USING (dim)""")
def _(spark, sf):
    n = G.normalize_features(vectors(spark, sf), H_stats(spark, sf))
    return n.select("series_id", "frame_idx", F.posexplode("v").alias("dim", "value")).withColumn("value", r6("value"))


@query("flatten_slots", "vector_values", "SELECT series_id, frame_idx // 3 AS frame_idx, CAST(frame_idx % 3 * 64 + dim AS INTEGER) AS dim, x AS value FROM vector_values WHERE frame_idx % 3 < 2")
def _(spark, sf):
    v = vectors(spark, sf)
    g = v.groupBy("series_id", F.floor(F.col("frame_idx") / 3).cast("int").alias("frame_idx")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "v"))), lambda s: s["v"]).alias("slots"))
    return g.select("series_id", "frame_idx", F.posexplode(G.flatten_slots(F.col("slots"), 2)).alias("dim", "value"))


@query("temporal_delta", "vector_values", """SELECT series_id, frame_idx, dim, x AS value FROM vector_values UNION ALL
SELECT series_id, frame_idx, dim + 64, coalesce(x - lag(x) OVER (PARTITION BY series_id, dim ORDER BY frame_idx), 0) FROM vector_values""")
def _(spark, sf):
    d = H.temporal_delta(vectors(spark, sf))
    return d.select("series_id", "frame_idx", F.posexplode("delta").alias("dim", "value"))


def grids(spark, sf):
    v = vectors(spark, sf).select("series_id", "frame_idx", F.lit(0).alias("slot"), "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("channel"))
    return v.withColumn("v", F.slice("v", F.col("channel") * 8 + 1, F.lit(8)))


QUANT = """c AS (SELECT series_id, frame_idx, dim // 8 AS channel, dim % 8 AS i, x FROM vector_values),
s AS (SELECT series_id, channel, greatest(max(abs(x)){div}, 1e-8) AS scale FROM c GROUP BY ALL),
q AS (SELECT series_id, frame_idx, channel, i, scale, CAST(greatest(-127, least(127, round_even(x/scale, 0))) AS TINYINT) AS q FROM c JOIN s USING (series_id, channel))"""


def codes(df, name):
    return df.select("series_id", "frame_idx", "channel", F.posexplode(name).alias("i", name))


@query("quantize_channels", "vector_values", f"WITH {QUANT.format(div='/127.0::DOUBLE')} SELECT series_id, frame_idx, channel, i, q FROM q")
def _(spark, sf):
    return codes(H.quantize_channels(grids(spark, sf)), "q")


@query("quantize_channels_compat", "vector_values", f"WITH {QUANT.format(div='')} SELECT series_id, frame_idx, channel, i, q FROM q")
def _(spark, sf):
    return codes(H.quantize_channels(grids(spark, sf), compat=True), "q")


@query("dequantize_channels", "vector_values", f"WITH {QUANT.format(div='/127.0::DOUBLE')} SELECT series_id, frame_idx, channel, i, q*scale AS v FROM q")
def _(spark, sf):
    return codes(H.dequantize_channels(H.quantize_channels(grids(spark, sf))), "v")


@query("channel_slices", "", """WITH p AS (SELECT p_brand AS model, p_type AS name, CAST(sum(p_size) AS BIGINT) AS channels FROM part GROUP BY ALL)
SELECT model, name, channels, CAST(sum(channels) OVER w - channels AS BIGINT) AS start, CAST(sum(channels) OVER w AS BIGINT) AS "end" FROM p WINDOW w AS (PARTITION BY model ORDER BY name)""")
def _(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("name")).agg(F.sum("p_size").alias("channels"))
    return H.channel_slices(p.withColumn("ord", F.col("name"))).select("model", "name", "channels", "start", "end")


@query("slice_errors", "", """WITH p AS (SELECT p_brand AS model, p_partkey AS ord, p_size*20 - 15 AS s, p_size*20 + p_partkey % 60 - 20 AS e FROM part)
SELECT model, ord, CASE WHEN s < 0 OR e <= s THEN 'invalid slice' WHEN s < lag(e) OVER (PARTITION BY model ORDER BY ord) THEN 'overlapping slices' END AS error FROM p""")
def _(spark, sf):
    p = table(spark, sf, "part")
    s = p.select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("ord"), (F.col("p_size") * 20 - 15).alias("start"),
                 (F.col("p_size") * 20 + F.col("p_partkey") % 60 - 20).alias("end"))
    return H.slice_errors(s).select("model", "ord", "error")


# ---------------------------------------------------------------- detections

def detections(spark, sf):
    li = table(spark, sf, "lineitem")
    one = li.select((F.col("l_orderkey") % 10).alias("series_id"), F.col("l_orderkey").alias("frame_idx"), F.col("l_partkey").alias("det"), "l_suppkey", "l_linenumber",
                    F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("cls"), F.col("l_extendedprice").alias("conf"),
                    (F.col("l_quantity") * F.lit(30.0)).alias("x1"), (F.col("l_tax") * F.lit(4000.0)).alias("y1"),
                    (F.col("l_quantity") * F.lit(30.0) + 50).alias("x2"))
    return one


cte("dets", """SELECT l_orderkey % 10 AS series_id, l_orderkey AS frame_idx, l_partkey AS det, l_suppkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS cls, l_extendedprice AS conf,
    l_quantity*30.0::DOUBLE AS x1, l_tax*4000.0::DOUBLE AS y1, l_quantity*30.0::DOUBLE + 50 AS x2 FROM lineitem""")
TIES = ["det", "l_suppkey", "l_linenumber"]


@query("slot_detections", "dets", """SELECT series_id, frame_idx, det, conf, CAST(rn-1 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det, l_suppkey, l_linenumber) AS rn FROM dets) WHERE rn <= 3""")
def _(spark, sf):
    return H.slot_detections(detections(spark, sf), 3, ties=TIES).select("series_id", "frame_idx", "det", "conf", "slot")


@query("slot_detections_by_class", "dets", """SELECT series_id, frame_idx, det, cls, conf, CAST(rn-1 + cls*2 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx, cls ORDER BY conf DESC, det, l_suppkey, l_linenumber) AS rn FROM dets) WHERE rn <= CASE cls WHEN 0 THEN 2 ELSE 1 END""")
def _(spark, sf):
    return H.slot_detections_by_class(detections(spark, sf), 2, 1, ties=TIES).select("series_id", "frame_idx", "det", "cls", "conf", "slot")


@query("fill_slots", "dets", """WITH s AS (SELECT series_id, frame_idx, conf, CAST(rn-1 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det, l_suppkey, l_linenumber) AS rn FROM dets) WHERE rn <= 3),
e AS (SELECT DISTINCT series_id, frame_idx, k AS slot FROM dets, (SELECT unnest(range(3))::INTEGER AS k)) SELECT e.series_id, e.frame_idx, e.slot, coalesce(conf, 0) AS conf FROM e LEFT JOIN s ON e.frame_idx = s.frame_idx AND e.slot = s.slot""")
def _(spark, sf):
    d = detections(spark, sf)
    return H.fill_slots(H.slot_detections(d, 3, ties=TIES), d.select("series_id", "frame_idx").distinct(), 3, {"conf": F.lit(0.0)})


@query("primary_box", "dets", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY frame_idx ORDER BY conf DESC, det, l_suppkey, l_linenumber) AS rn FROM dets WHERE cls = 0), f AS (SELECT DISTINCT series_id, frame_idx FROM dets)
SELECT f.series_id, f.frame_idx, greatest(0, least(1000.0::DOUBLE, coalesce(x1, 250))) AS x1, greatest(0, least(300.0::DOUBLE, coalesce(y1, 150))) AS y1, greatest(0, least(1000.0::DOUBLE, coalesce(x2, 750))) AS x2, 300.0::DOUBLE AS y2, coalesce(conf, 0) AS conf
FROM f LEFT JOIN (SELECT * EXCLUDE (series_id) FROM b WHERE rn = 1) b USING (frame_idx)""")
def _(spark, sf):
    d = detections(spark, sf)
    return H.primary_box(d.select("series_id", "frame_idx").distinct(), d, 1000.0, 300.0, ties=TIES)


# ---------------------------------------------------------------- vector fields (2 x 4 x 8)

cte("field_cells", """SELECT vec_id, c // 8 AS r, c % 8 AS c, embedding[c+1]::DOUBLE AS fx, embedding[c+33]::DOUBLE AS fy FROM (SELECT *, unnest(range(32)) AS c FROM embeddings)""")


def fields(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", F.lit(4).alias("h"), F.lit(8).alias("w"), F.slice(v, 1, 32).alias("fx"), F.slice(v, 33, 32).alias("fy"))


def cells(df, *names):
    z = F.posexplode(F.arrays_zip(*names)).alias("cell", "z")
    return df.select("vec_id", z).select("vec_id", "cell", *[f"z.{n}" for n in names])


@query("field_normalize", "field_cells", "SELECT vec_id, CAST(r*8+c AS INTEGER) AS cell, fx/8 AS fx, fy/4 AS fy FROM field_cells")
def _(spark, sf):
    return cells(H.field_normalize(fields(spark, sf)), "fx", "fy")


@query("field_downsample", "field_cells", "SELECT vec_id, CAST(r//2*2 + c//4 AS INTEGER) AS cell, round(avg(fx), 6) AS fx, round(avg(fy), 6) AS fy FROM field_cells GROUP BY ALL")
def _(spark, sf):
    return rounded(cells(H.field_downsample(fields(spark, sf), 2), "fx", "fy"), "fx", "fy")


SUMMARY = """g AS (SELECT vec_id, sqrt(fx*fx+fy*fy) AS m, fx, fy, atan2(fy, fx) AS a, r, c FROM field_cells),
k AS (SELECT vec_id, r*4 + c//2 AS cell, [avg(m), stddev_pop(m), avg(fx), avg(fy)] AS s FROM g WHERE {where} GROUP BY vec_id, r, c//2),
o AS (SELECT vec_id, [avg(m), stddev_pop(m), avg(fx), avg(fy), quantile_cont(m, 0.9), avg(a)] AS s FROM g GROUP BY vec_id),
v AS (SELECT vec_id, CAST(cell*4 + unnest(range(4)) AS INTEGER) AS dim, unnest(s) AS value FROM k UNION ALL SELECT vec_id, CAST({base} + unnest(range(6)) AS INTEGER), unnest(s) FROM o),
d AS (SELECT vec_id, CAST(unnest(range({size})) AS INTEGER) AS dim FROM embeddings)
SELECT d.vec_id, d.dim, round(coalesce(value, 0), 6) AS value FROM d LEFT JOIN v ON d.vec_id = v.vec_id AND d.dim = v.dim"""


@query("field_summary", "field_cells", "WITH " + SUMMARY.format(where="r = 0", base=16, size=64))
def _(spark, sf):
    f = H.field_summary(fields(spark, sf), 64, "compat")
    return f.select("vec_id", F.posexplode("f").alias("dim", "value")).withColumn("value", r6("value"))


@query("field_summary_full", "field_cells", "WITH " + SUMMARY.format(where="true", base=64, size=70))
def _(spark, sf):
    f = H.field_summary(fields(spark, sf), 64, "full")
    return f.select("vec_id", F.posexplode("f").alias("dim", "value")).withColumn("value", r6("value"))


@query("field_flip", "field_cells", "SELECT vec_id, CAST((3-r)*8 + 7-c AS INTEGER) AS cell, -fx AS fx, -fy AS fy FROM field_cells")
def _(spark, sf):
    return cells(H.field_flip(fields(spark, sf), "hvflip"), "fx", "fy")


@query("field_sample", "field_cells", """WITH p AS (SELECT vec_id, greatest(0, least(1, embedding[1]::DOUBLE*3+0.5::DOUBLE))*7 AS px, greatest(0, least(1, embedding[2]::DOUBLE*3+0.5::DOUBLE))*3 AS py FROM embeddings),
q AS (SELECT *, floor(px) AS x0, floor(py) AS y0, least(floor(px)+1, 7) AS x1, least(floor(py)+1, 3) AS y1 FROM p)
SELECT q.vec_id, round((a.fy*(1-(px-x0)) + b.fy*(px-x0))*(1-(py-y0)) + (c.fy*(1-(px-x0)) + d.fy*(px-x0))*(py-y0), 6) AS flow FROM q
JOIN field_cells a ON a.vec_id = q.vec_id AND a.r = y0 AND a.c = x0 JOIN field_cells b ON b.vec_id = q.vec_id AND b.r = y0 AND b.c = x1
JOIN field_cells c ON c.vec_id = q.vec_id AND c.r = y1 AND c.c = x0 JOIN field_cells d ON d.vec_id = q.vec_id AND d.r = y1 AND d.c = x1""")
def _(spark, sf):
    f = fields(spark, sf)
    at = lambda k: F.col("fx")[k] * 3 + F.lit(0.5)
    return f.select("vec_id", r6(H.field_sample(at(0), at(1))).alias("flow"))


# ---------------------------------------------------------------- keypoints (two slots per frame, 21 points)

cte("pose_points", """SELECT series_id, CAST(frame_idx // 2 AS INTEGER) AS frame_idx, CAST(frame_idx % 2 AS INTEGER) AS slot, CAST(k AS INTEGER) AS k, v[3*k+1]::DOUBLE AS x, v[3*k+2]::DOUBLE AS y,
    CASE WHEN abs(v[3*k+3]::DOUBLE) < 0.02 THEN 0 ELSE abs(v[3*k+3]::DOUBLE) END AS conf FROM (SELECT *, unnest(range(21)) AS k FROM vectors)""", "vectors")


def poses(spark, sf):
    v = vectors(spark, sf)
    at = lambda i: F.element_at("v", i)
    p = F.array(*[F.struct(at(3 * k + 1).alias("x"), at(3 * k + 2).alias("y"),
                           F.when(F.abs(at(3 * k + 3)) < 0.02, 0.0).otherwise(F.abs(at(3 * k + 3))).alias("conf")) for k in range(21)])
    i = F.col("frame_idx")
    return v.select("series_id", F.floor(i / 2).cast("int").alias("frame_idx"), (i % 2).cast("int").alias("slot"), p.alias("kp"))


KEY = ["series_id", "frame_idx", "slot"]
ROOT = """root AS (SELECT series_id, frame_idx, slot, CASE WHEN any_value(conf) FILTER (WHERE k = 17) > 1e-6 THEN any_value(x) FILTER (WHERE k = 17)
    WHEN sum(conf) FILTER (WHERE k IN (11, 12))*0.5 > 1e-6 THEN sum(x) FILTER (WHERE k IN (11, 12))*0.5 ELSE sum(x*greatest(conf, 1e-6))/greatest(sum(greatest(conf, 1e-6)), 1e-6) END AS rx,
    CASE WHEN any_value(conf) FILTER (WHERE k = 17) > 1e-6 THEN any_value(y) FILTER (WHERE k = 17)
    WHEN sum(conf) FILTER (WHERE k IN (11, 12))*0.5 > 1e-6 THEN sum(y) FILTER (WHERE k IN (11, 12))*0.5 ELSE sum(y*greatest(conf, 1e-6))/greatest(sum(greatest(conf, 1e-6)), 1e-6) END AS ry FROM pose_points GROUP BY ALL)"""


@query("pose_root", "pose_points", f"WITH {ROOT} SELECT series_id, frame_idx, slot, round(rx, 6) AS x, round(ry, 6) AS y FROM root")
def _(spark, sf):
    p = poses(spark, sf).withColumn("r", H.pose_root(F.col("kp"), 21))
    return p.select(*KEY, r6("r.x").alias("x"), r6("r.y").alias("y"))


@query("pose_relative", "pose_points", f"WITH {ROOT} SELECT series_id, frame_idx, slot, k, round((x-rx)*conf, 6) AS x, round((y-ry)*conf, 6) AS y FROM pose_points JOIN root USING (series_id, frame_idx, slot)")
def _(spark, sf):
    p = poses(spark, sf).withColumn("root", H.pose_root(F.col("kp"), 21))
    p = p.select(*KEY, F.posexplode(H.pose_relative(F.col("kp"), F.col("root"))).alias("k", "p"))
    return p.select(*KEY, "k", r6("p.x").alias("x"), r6("p.y").alias("y"))


BONE_ROWS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(H.BONES_21))


@query("pose_bones", "pose_points", f"""SELECT a.series_id, a.frame_idx, a.slot, i AS bone, b.x - a.x AS x, b.y - a.y AS y FROM (VALUES {BONE_ROWS}) t(i, s, e)
JOIN pose_points a ON a.k = s JOIN pose_points b ON b.k = e AND a.series_id = b.series_id AND a.frame_idx = b.frame_idx AND a.slot = b.slot""")
def _(spark, sf):
    p = poses(spark, sf).select(*KEY, F.posexplode(H.pose_bones(F.col("kp"), H.BONES_21)).alias("bone", "p"))
    return p.select(*KEY, "bone", "p.x", "p.y")


@query("pose_velocity", "pose_points", """WITH v AS (SELECT *, coalesce(x - lag(x) OVER w, 0) AS vx, coalesce(y - lag(y) OVER w, 0) AS vy FROM pose_points WINDOW w AS (PARTITION BY series_id, slot, k ORDER BY frame_idx))
SELECT series_id, frame_idx, slot, k, vx, vy, CASE WHEN frame_idx >= 2 THEN vx - lag(vx) OVER w ELSE 0 END AS ax, CASE WHEN frame_idx >= 2 THEN vy - lag(vy) OVER w ELSE 0 END AS ay FROM v WINDOW w AS (PARTITION BY series_id, slot, k ORDER BY frame_idx)""")
def _(spark, sf):
    p = H.pose_velocity(poses(spark, sf)).select(*KEY, F.posexplode(F.arrays_zip("velocity", "acceleration")).alias("k", "z"))
    return p.select(*KEY, "k", F.col("z.velocity.x").alias("vx"), F.col("z.velocity.y").alias("vy"), F.col("z.acceleration.x").alias("ax"), F.col("z.acceleration.y").alias("ay"))


@query("pose_confidence", "pose_points", """SELECT series_id, frame_idx, slot, round(sum(conf)/greatest(count(*) FILTER (WHERE conf > 0), 1), 6) AS mean_visible, count(*) FILTER (WHERE conf > 0)/21 AS visible, round(avg(conf), 6) AS mean FROM pose_points GROUP BY ALL""")
def _(spark, sf):
    k = F.col("kp")
    return poses(spark, sf).select(*KEY, r6(H.mean_visible_conf(k)).alias("mean_visible"), H.visible_ratio(k).alias("visible"), r6(H.mean_conf(k)).alias("mean"))


CENTER = "center AS (SELECT series_id, frame_idx, slot, count(*) FILTER (WHERE conf > 0) AS seen, avg(conf) AS mc, sum(x*conf)/greatest(sum(conf), 1e-6) AS cx, sum(y*conf)/greatest(sum(conf), 1e-6) AS cy FROM pose_points GROUP BY ALL)"


@query("primary_slot", "pose_points", f"""WITH {CENTER} SELECT series_id, frame_idx, slot FROM (SELECT *, row_number() OVER (PARTITION BY series_id, frame_idx ORDER BY seen DESC, sqrt((cx-0.5)*(cx-0.5)+(cy-0.5)*(cy-0.5)), slot) AS rn FROM center) WHERE rn = 1""")
def _(spark, sf):
    return H.primary_slot(poses(spark, sf))


@query("collapse_slots", "pose_points", """SELECT series_id, frame_idx, k, round(CASE WHEN count(*) = 1 THEN max(x) ELSE sum(x*conf)/greatest(sum(conf), 1e-6) END, 6) AS x,
    round(CASE WHEN count(*) = 1 THEN max(y) ELSE sum(y*conf)/greatest(sum(conf), 1e-6) END, 6) AS y, max(conf) AS conf FROM pose_points GROUP BY series_id, frame_idx, k""")
def _(spark, sf):
    c = H.collapse_slots(poses(spark, sf)).select("series_id", "frame_idx", F.posexplode("kp").alias("k", "p"))
    return c.select("series_id", "frame_idx", "k", r6("p.x").alias("x"), r6("p.y").alias("y"), "p.conf")


def two_poses(spark, sf):
    p = poses(spark, sf)
    a = p.where("slot = 0").select("series_id", "frame_idx", F.slice("kp", 1, 7).alias("kp"))
    return a, p.where("slot = 1")


@query("pair_distances", "pose_points", """SELECT a.series_id, a.frame_idx, a.k AS kb, b.slot, b.k AS kp, round(CASE WHEN a.conf*b.conf > 0 THEN sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) ELSE 0 END, 6) AS distance, a.conf*b.conf AS conf
    FROM pose_points a JOIN pose_points b ON a.series_id = b.series_id AND a.frame_idx = b.frame_idx WHERE a.slot = 0 AND b.slot = 1 AND a.k < 7""")
def _(spark, sf):
    return rounded(H.pair_distances(*two_poses(spark, sf)), "distance")


def with_field(spark, sf):
    v = vectors(spark, sf)
    i = F.col("frame_idx")
    f = v.where(i % 2 == 0).select("series_id", F.floor(i / 2).cast("int").alias("frame_idx"), F.lit(4).alias("h"), F.lit(8).alias("w"),
                                   F.slice("v", 1, 32).alias("fx"), F.slice("v", 33, 32).alias("fy"))
    a, b = two_poses(spark, sf)
    j = a.withColumnRenamed("kp", "kp_b").join(b.select("series_id", "frame_idx", F.col("kp").alias("kp_a")), ["series_id", "frame_idx"])
    return j.join(f, ["series_id", "frame_idx"])


#: Bilinear value of the field at the points of ``p`` (x, y): the second half of the even vectors as 4 x 8 cells.
SAMPLED = """f AS (SELECT series_id, CAST(frame_idx // 2 AS INTEGER) AS frame_idx, v AS fv FROM vectors WHERE frame_idx % 2 = 0),
    u AS (SELECT p.*, fv, greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))*7 AS px, greatest(0.0::DOUBLE, least(1.0::DOUBLE, y))*3 AS py FROM p JOIN f USING (series_id, frame_idx)),
    c AS (SELECT *, floor(px) AS x0, floor(py) AS y0, least(floor(px) + 1, 7) AS x1, least(floor(py) + 1, 3) AS y1 FROM u),
    s AS (SELECT *, (fv[CAST(33 + y0*8 + x0 AS INTEGER)]::DOUBLE*(1 - (px - x0)) + fv[CAST(33 + y0*8 + x1 AS INTEGER)]::DOUBLE*(px - x0))*(1 - (py - y0))
        + (fv[CAST(33 + y1*8 + x0 AS INTEGER)]::DOUBLE*(1 - (px - x0)) + fv[CAST(33 + y1*8 + x1 AS INTEGER)]::DOUBLE*(px - x0))*(py - y0) AS flow FROM c)"""
POSE_ROOTS = """SELECT series_id, frame_idx, slot, sum(x*conf)/greatest(sum(conf), 1e-6) AS x, sum(y*conf)/greatest(sum(conf), 1e-6) AS y,
    avg(conf) AS mean, count(*) FILTER (WHERE conf > 0)/count(*)::DOUBLE AS visible FROM pose_points WHERE slot = 1 OR k < 7 GROUP BY series_id, frame_idx, slot"""


@query("pair_features", "pose_points vectors", f"""WITH p AS ({POSE_ROOTS}), {SAMPLED}
SELECT a.series_id, a.frame_idx, round(a.x - b.x, 6) AS dx, round(a.y - b.y, 6) AS dy, round(a.flow - b.flow, 6) AS dflow, round(a.mean, 6) AS conf_a, round(b.mean, 6) AS conf_b,
    round(a.visible, 6) AS visible_a, round(b.visible, 6) AS visible_b FROM s a JOIN s b ON a.series_id = b.series_id AND a.frame_idx = b.frame_idx WHERE a.slot = 1 AND b.slot = 0""")
def _(spark, sf):
    return rounded(H.pair_features(with_field(spark, sf)).select("series_id", "frame_idx", "pair.*"),
                   "dx", "dy", "dflow", "conf_a", "conf_b", "visible_a", "visible_b")


@query("point_features", "pose_points vectors", f"""WITH r AS ({POSE_ROOTS}), p AS (SELECT q.series_id, q.frame_idx, q.k, q.x, q.y, q.conf, r.x AS cx, r.y AS cy FROM pose_points q
    JOIN r ON q.series_id = r.series_id AND q.frame_idx = r.frame_idx AND q.slot = r.slot WHERE q.slot = 1), {SAMPLED}
SELECT series_id, frame_idx, k, round(x, 6) AS x, round(y, 6) AS y, round(x - cx, 6) AS rx, round(y - cy, 6) AS ry, round(conf, 6) AS conf, round(flow, 6) AS flow FROM s""")
def _(spark, sf):
    p = with_field(spark, sf).select("series_id", "frame_idx", F.posexplode(H.point_features(F.col("kp_a"))).alias("k", "p"))
    return p.select("series_id", "frame_idx", "k", *[r6(f"p.{c}").alias(c) for c in ("x", "y", "rx", "ry", "conf", "flow")])


STRIP_ROWS = ", ".join(f"({i}, {y}::DOUBLE)" for i, y in enumerate(H.STRIP_Y))


@query("strip_points", "pose_points", f"""WITH c AS (SELECT series_id, frame_idx, slot, any_value(x) FILTER (WHERE k = 4) AS px, any_value(conf) FILTER (WHERE k = 4) AS pc, max(conf) AS mx, avg(conf) AS mc,
    sum(x*conf)/greatest(sum(conf), 1e-6) AS cx FROM pose_points WHERE slot = 0 AND k < 7 GROUP BY ALL)
SELECT series_id, frame_idx, i, round(CASE WHEN pc > 1e-6 THEN px WHEN mc > 1e-6 THEN cx ELSE 0.5 END, 6) AS x, y, CASE WHEN pc > 1e-6 THEN pc ELSE mx END AS conf FROM c, (VALUES {STRIP_ROWS}) t(i, y)""")
def _(spark, sf):
    a, _ = two_poses(spark, sf)
    p = a.select("series_id", "frame_idx", F.posexplode(H.strip_points(F.col("kp"))).alias("i", "p"))
    return p.select("series_id", "frame_idx", "i", r6("p.x").alias("x"), "p.y", "p.conf")


@query("softmax_pool", "vector_values", """WITH s AS (SELECT series_id, frame_idx // 2 AS f, frame_idx % 2 AS slot, dim, x, max(x) OVER (PARTITION BY series_id, frame_idx) AS conf FROM vector_values),
w AS (SELECT *, exp(any_value(CASE WHEN dim = 0 THEN x END) OVER (PARTITION BY series_id, f, slot) + ln(greatest(conf, 1e-6))) AS e FROM s)
SELECT series_id, CAST(f AS INTEGER) AS frame_idx, dim, round(sum(x*e)/sum(e), 6) AS value FROM w GROUP BY series_id, f, dim""")
def _(spark, sf):
    v = vectors(spark, sf)
    i = F.col("frame_idx")
    s = v.select("series_id", F.floor(i / 2).cast("int").alias("frame_idx"), F.col("v")[0].alias("score"), F.array_max("v").alias("conf"), "v")
    return rounded(H.softmax_pool(s), "value")


@query("detection_rate", "pose_points", "SELECT series_id, round(avg(hit), 6) AS detection_rate FROM (SELECT series_id, frame_idx, max((conf > 0.25)::INT) AS hit FROM pose_points WHERE slot = 0 GROUP BY ALL) GROUP BY series_id")
def _(spark, sf):
    return rounded(M.detection_rate(poses(spark, sf)), "detection_rate")


# ---------------------------------------------------------------- keyed tables

cte("keyed_rows", """SELECT o_orderpriority || '.' || o_orderstatus || '.' || month(o_orderdate) AS key, month(o_orderdate) AS m, o_orderstatus AS st, o_orderkey, o_totalprice AS p FROM orders""")
cte("keyed_a", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS pos, p AS v, CASE WHEN m = 7 THEN 'int64' ELSE 'float32' END AS dtype FROM keyed_rows WHERE NOT (st = 'P' AND m = 1)", "keyed_rows")
cte("keyed_b", """SELECT key, row_number() OVER (PARTITION BY key ORDER BY o_orderkey) - 1 AS pos, p*1.01::DOUBLE + o_orderkey % 7 AS v, CASE WHEN m IN (5, 7) THEN 'int64' ELSE 'float32' END AS dtype
    FROM keyed_rows WHERE m <> 12 AND NOT (m = 3 AND o_orderkey % 10 = 0)""", "keyed_rows")
cte("key_diff", """WITH ma AS (SELECT key, count(*) AS na, any_value(dtype) AS da FROM keyed_a GROUP BY key), mb AS (SELECT key, count(*) AS nb, any_value(dtype) AS db FROM keyed_b GROUP BY key),
s AS (SELECT key, CASE WHEN na IS NULL THEN 'missing_in_a' WHEN nb IS NULL THEN 'missing_in_b' WHEN na <> nb THEN 'shape_mismatch' WHEN da <> db THEN 'dtype_mismatch' ELSE 'compatible' END AS status FROM ma FULL JOIN mb USING (key)),
d AS (SELECT key, count(*) AS n, sum(a.v) AS sa, sum(b.v) AS sb, sum(a.v*a.v) AS qa, sum(b.v*b.v) AS qb, sum(abs(b.v-a.v)) AS ad, sum((b.v-a.v)*(b.v-a.v)) AS sd, max(abs(b.v-a.v)) AS mx
    FROM keyed_a a JOIN keyed_b b USING (key, pos) JOIN s USING (key) WHERE status = 'compatible' GROUP BY key)
SELECT key, status, coalesce(n, 0) AS n, sa, sb, qa, qb, ad, sd, mx FROM s LEFT JOIN d USING (key)""", "keyed_a", "keyed_b")


def keyed(spark, sf, side):
    o = table(spark, sf, "orders")
    m = F.month("o_orderdate")
    o = o.select(F.concat_ws(".", "o_orderpriority", "o_orderstatus", m.cast("string")).alias("key"), m.alias("m"), F.col("o_orderstatus").alias("st"), "o_orderkey", F.col("o_totalprice").alias("p"))
    m = F.col("m")
    if side == "a":
        o = o.where(~((F.col("st") == "P") & (m == 1))).withColumn("dtype", F.when(m == 7, "int64").otherwise("float32"))
    else:
        o = o.where((m != 12) & ~((m == 3) & (F.col("o_orderkey") % 10 == 0))).withColumn("dtype", F.when(m.isin(5, 7), "int64").otherwise("float32"))
        o = o.withColumn("p", F.col("p") * F.lit(1.01) + F.col("o_orderkey") % 7)
    o = B.dense_index(o, "pos", series="key", order="o_orderkey", block=65_536)
    n = o.groupBy("key").agg(F.array(F.count("*").cast("int")).alias("shape"))
    t = o.groupBy("key", F.floor(F.col("pos") / 64).alias("tile")).agg(
        F.first("dtype").alias("dtype"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("v"))
    return t.join(n, "key").select("key", "tile", "shape", "dtype", "v")


def diff(spark, sf):
    return K.compare_keyed(keyed(spark, sf, "a"), keyed(spark, sf, "b"))


STATS = ["mean_a", "mean_b", "std_a", "std_b", "mean_abs_diff", "rms_diff", "max_abs_diff"]


def stats_sql():
    return """round(sa/n, 3) AS mean_a, round(sb/n, 3) AS mean_b, CASE WHEN sa IS NOT NULL THEN round(sqrt(greatest(qa/n - sa/n*sa/n, 0)), 2) END AS std_a, CASE WHEN sb IS NOT NULL THEN round(sqrt(greatest(qb/n - sb/n*sb/n, 0)), 2) END AS std_b,
    round(ad/n, 3) AS mean_abs_diff, round(sqrt(sd/n), 3) AS rms_diff, round(mx, 3) AS max_abs_diff"""


def shown(df, *cols):
    return df.select(*cols, *[F.round(c, 2 if c.startswith("std") else 3).alias(c) for c in STATS])


@query("compare_keyed", "key_diff", f"SELECT key, status, n, {stats_sql()} FROM key_diff")
def _(spark, sf):
    return shown(diff(spark, sf), "key", "status", "n")


cte("rolled", """WITH p AS (SELECT *, unnest(['', split_part(key, '.', 1), split_part(key, '.', 1) || '.' || split_part(key, '.', 2), key]) AS path FROM key_diff)
SELECT path, CASE WHEN path = '' THEN 0 ELSE CAST(len(string_split(path, '.')) AS INTEGER) END AS depth, count(*) AS key_count, count(*) FILTER (WHERE status = 'compatible') AS compatible_keys,
    count(*) FILTER (WHERE status = 'missing_in_a') AS missing_in_a, count(*) FILTER (WHERE status = 'missing_in_b') AS missing_in_b, count(*) FILTER (WHERE status LIKE '%mismatch') AS mismatched,
    CASE WHEN count(*) FILTER (WHERE status <> 'compatible') = 0 THEN 'compatible' WHEN count(*) FILTER (WHERE status = 'compatible') > 0 THEN 'partial' ELSE 'incompatible' END AS status,
    CAST(sum(n) AS BIGINT) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(qa) AS qa, sum(qb) AS qb, sum(ad) AS ad, sum(sd) AS sd, max(mx) AS mx FROM p GROUP BY path""", "key_diff")
ROLL = ["path", "depth", "key_count", "compatible_keys", "missing_in_a", "missing_in_b", "mismatched", "status", "n"]


@query("rollup_prefixes", "rolled", f"SELECT {', '.join(ROLL)}, {stats_sql().replace('/n', '/nullif(n, 0)')} FROM rolled")
def _(spark, sf):
    return shown(K.rollup_prefixes(diff(spark, sf)), *ROLL)


@query("top_components", "rolled", "SELECT path, n FROM rolled WHERE path <> '' AND n > 0 AND compatible_keys > 0 AND key_count > 1 AND depth <= 4 ORDER BY round(sqrt(sd/n), 6) DESC, n DESC, path LIMIT 16")
def _(spark, sf):
    return K.top_components(K.rollup_prefixes(diff(spark, sf)), 16).select("path", "n")


def chosen(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat_ws(".", "o_orderpriority", "o_orderstatus", F.lit("7")).alias("path")).distinct()


@query("select_keys", "key_diff", "SELECT key FROM key_diff WHERE key LIKE '%.7'")
def _(spark, sf):
    return K.select_keys(diff(spark, sf), chosen(spark, sf))


@query("selection_errors", "rolled", """WITH c AS (SELECT '' AS path UNION SELECT path FROM rolled WHERE depth = 3 UNION SELECT 'none.' || path FROM rolled WHERE depth = 1)
SELECT c.path, CASE WHEN status IS NULL THEN 'Unknown component path: ' || CASE WHEN c.path = '' THEN 'model' ELSE c.path END ELSE CASE WHEN c.path = '' THEN 'model' ELSE c.path END || ' is not fully compatible: ' ||
    concat_ws('; ', CASE WHEN missing_in_a > 0 THEN 'missing in a: ' || missing_in_a END, CASE WHEN missing_in_b > 0 THEN 'missing in b: ' || missing_in_b END, CASE WHEN mismatched > 0 THEN 'shape/dtype mismatches: ' || mismatched END) END AS error
FROM c LEFT JOIN rolled r ON r.path = c.path WHERE status IS NULL OR status <> 'compatible'""")
def _(spark, sf):
    roll = K.rollup_prefixes(diff(spark, sf))
    c = roll.where(F.col("depth").isin(0, 3)).select("path").union(
        roll.where(F.col("depth") == 1).select(F.concat(F.lit("none."), "path")))
    return K.selection_errors(roll, c)


@query("merge_weighted", "keyed_a keyed_b", """SELECT a.key, CAST(a.pos AS INTEGER) AS pos, CASE WHEN a.key LIKE '%.9' OR na IS DISTINCT FROM nb THEN a.v WHEN a.dtype = 'float32' THEN round(a.v*(3.0::DOUBLE/4) + b.v*(1.0::DOUBLE/4), 6) ELSE a.v END AS v
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS na FROM keyed_a) a LEFT JOIN keyed_b b USING (key, pos)
    LEFT JOIN (SELECT key, count(*) AS nb FROM keyed_b GROUP BY key) USING (key)""")
def _(spark, sf):
    a, b = keyed(spark, sf, "a"), keyed(spark, sf, "b")
    sel = a.select("key").distinct().where(~F.endswith("key", F.lit(".9")))
    m = K.merge_weighted(a, b, 3.0, 1.0, "a", sel)
    m = m.select("key", "tile", F.posexplode("v").alias("i", "v"))
    return m.select("key", (F.col("tile") * 64 + F.col("i")).cast("int").alias("pos"), r6("v").alias("v"))


@query("config_diff", "", """WITH a AS (SELECT p_brand AS name, max(p_retailprice) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_brand AS name, max(p_retailprice) AS v FROM part WHERE p_partkey % 3 = 0 AND p_brand <> 'Brand#3' GROUP BY 1)
SELECT name, a.v AS value_a, b.v AS value_b FROM a FULL JOIN b USING (name) WHERE name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6') AND a.v IS DISTINCT FROM b.v""")
def _(spark, sf):
    p = table(spark, sf, "part")
    side = lambda d: d.groupBy(F.col("p_brand").alias("name")).agg(F.max("p_retailprice").alias("value"))
    a = side(p.where(F.col("p_partkey") % 2 == 0))
    b = side(p.where((F.col("p_partkey") % 3 == 0) & (F.col("p_brand") != "Brand#3")))
    return K.config_diff(a, b, [f"Brand#{i}" for i in range(1, 7)])


@query("systematic_sample", "keyed_a", """WITH n AS (SELECT key, count(*) AS n, floor(8000/count(*) OVER ()) AS cap FROM keyed_a GROUP BY key),
s AS (SELECT key, cap, CASE WHEN n <= cap THEN 1 ELSE greatest(1, floor(n/cap)) END AS step FROM n)
SELECT key, CAST(pos AS BIGINT) AS pos, v AS value FROM keyed_a JOIN s USING (key) WHERE pos % step = 0 AND pos < cap*step""")
def _(spark, sf):
    t = keyed(spark, sf, "a").select("key", "tile", F.posexplode("v").alias("i", "value"))
    return K.systematic_sample(t.select("key", (F.col("tile") * 64 + F.col("i")).alias("pos"), "value"), 8000)
