"""Cases that only larger or odd tables hold: each failed before the change it came with."""

import json

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from wavetable.sources import scripts as SC

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


def test_active_frames_where_the_quantile_lies_between_neighbours_equal_but_for_rounding(spark, tmp_path):
    series = [[19, 15, 29, 23, 14, 7, 20, 17, 8, 26, 11, 0], [17, 21, 2, 11, 15, 1, 4, 4, 8, 21, 25, 10],
              [19, 26, 10, 10, 26, 21, 1, 8, 19, 25, 0, 15], [8, 27, 2, 9, 18, 22, 8, 6, 21, 27, 18, 13]]
    rows = ", ".join(f"({100 * u + i}::BIGINT, {u}::BIGINT, TIMESTAMP '2024-01-01' + to_minutes({i}), {v}::DOUBLE)"
                     for u, s in enumerate(series) for i, v in enumerate(s))
    got, want = both(spark, tmp_path, "active_frames", events=f"SELECT * FROM (VALUES {rows}) t(event_id, user_id, ts, value)")
    assert got == want


def test_audit_sources_of_scenes_above_99999(spark, tmp_path):
    documents = """SELECT i AS doc_id, 'x' AS text, ['de', 'en', NULL][i % 3 + 1] AS lang, 's' || i % 4 AS source, i % 90 AS n_chars
        FROM (SELECT unnest([4, 10000, 10001, 99998, 100000, 100001, 100006, 1000010, 1000014]::BIGINT[]) AS i)"""
    got, want = both(spark, tmp_path, "resolve_audit_sources", documents=documents)
    assert got == want


def test_bundled_scripts_are_lines_of_few_files(spark, tmp_path):
    names = ['s/1', 'a "b" \\c', 'zwei\nzeilen', '']
    rows = [(n, i, i * 40 - i % 2 * 80, float(i % 101)) for n in names for i in range(95)]
    a = spark.createDataFrame(rows, "series_id string, ord bigint, at_ms bigint, pos double")
    m = spark.createDataFrame([("s/1", {"even": "y\nz"})], "series_id string, metadata map<string, string>")
    SC.write_scripts(a, str(tmp_path / "files"), m, per_document=10)
    SC.write_scripts(a, str(tmp_path / "lines"), m, per_document=10, bundled=True)
    lines = [json.loads(line) for f in (tmp_path / "lines").glob("*.txt") for line in f.read_text().split("\n") if line.strip()]
    assert sorted((d["series_id"], d["part"], len(d["actions"])) for d in lines) == sorted((n, k, 10 if k < 9 else 5) for n in names for k in range(10))
    assert len(list((tmp_path / "lines").glob("*.txt"))) <= 4 < 40
    got = [tuple(r) for r in SC.read_actions(spark, str(tmp_path / "lines"), bundled=True).orderBy("series_id", "ord").collect()]
    want = []
    for n in sorted(names):
        want += [(n, k, at, pos) for k, (at, _, pos) in enumerate(sorted((r[2], r[1], r[3]) for r in rows if r[0] == n))]
    assert got == want
    scripts = {r["series_id"]: r["metadata"] for r in SC.read_scripts(spark, str(tmp_path / "lines"), bundled=True).collect()}
    assert scripts == {n: {"even": "y\nz"} if n == "s/1" else {} for n in names}


@pytest.mark.parametrize("name", ["scripts_round_trip", "script_documents"])
def test_documents_of_many_series_make_few_files(spark, name, tmp_path, monkeypatch):
    from wavetable.plans import flow_queries
    monkeypatch.setattr(flow_queries, "shared_folder", lambda spark, name: str(tmp_path / "out"))
    QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert 0 < len(list((tmp_path / "out").rglob("*.txt"))) <= 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_that_share_or_cross_batches(spark):
    from pyspark.sql import functions as F
    from wavetable.operators import blocks as B
    size = F.when(F.col("g") % 50 == 7, 2500).otherwise(F.col("g") % 4 + 1)
    df = spark.range(300).select(F.when(F.col("id") == 3, None).otherwise(F.col("id")).alias("g"), F.col("id").alias("key")).withColumn("n", F.coalesce(size, F.lit(9)))
    rows = df.withColumn("frame_idx", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).orderBy(F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        def work(t):
            at = t["frame_idx"].to_pylist()
            assert at == list(range(len(at))) and len(set(t["key"].to_pylist())) == 1
            return t.slice(0, 1).select(["g", "frame_idx"]).set_column(1, "frame_idx", pa.array([len(at)], pa.int32()))
        out = B.each_group(rows, ["g"], work, rows.select("g", "frame_idx").schema)
        assert "FlatMapGroups" not in plan_of(out)
        assert sorted((map(tuple, out.collect())), key=str) == sorted(map(tuple, df.select("g", "n").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")


@pytest.mark.parametrize("name", ["postprocess_sweep", "postprocess", "postprocess_segments"])
def test_chunks_are_cleaned_once_and_many_to_a_batch(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroups" not in plan and (name == "postprocess_segments" or "InArrow" not in plan)


@pytest.mark.parametrize("name", ["lowpass_whole", "troughs_whole"])
def test_blocks_of_short_series_share_batches(spark, name, monkeypatch):
    from wavetable.operators import passes as P
    plans = []
    monkeypatch.setattr(P, "stored", lambda df, name, kept=P.stored: plans.append(plan_of(df)) or kept(df, name))
    plans.append(plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")))
    assert not [p for p in plans if "FlatMapGroups" in p or "FlatMapCoGroups" in p]


def test_edit_curves_of_short_series_share_batches(spark):
    from wavetable.operators import edits as E
    pts = spark.createDataFrame([(s, i * 3, (i * s % 7) / 7) for s in range(40) for i in range(s % 9 + 1)], "series_id bigint, frame_idx int, value double")
    got = E.edit_curves(pts)
    assert "FlatMapGroups" not in plan_of(got) and got.select("series_id").distinct().count() == 40


@pytest.mark.parametrize("name, least", [("discover_video", 1), ("window_index_full", 2)])
def test_one_file_is_worked_on_by_many_tasks(spark, name, least):
    assert plan_of(QUERIES[name](spark, "/root/testdata/sf0.001")).count("REPARTITION_BY_NUM") >= least


def test_feature_noise_of_windows_with_absent_values(spark, tmp_path):
    embeddings = """SELECT i AS vec_id, (i % 3)::INTEGER AS label, CASE WHEN i = 20 THEN NULL ELSE list_transform(range(64),
        lambda k: CASE WHEN i % 11 = 4 AND k = 5 THEN NULL ELSE ((i * 31 + k * 17) % 97 / 97.0)::FLOAT END) END AS embedding FROM range(60) t(i)"""
    got, want = both(spark, tmp_path, "augment_feature_noise", embeddings=embeddings)
    assert len(want) == 6 * 8 * 64 - 64 and got == want        # two windows to a label, all values of 48 vectors but of the absent one


def test_feature_noise_is_worked_out_once_and_spread(spark):
    df = QUERIES["augment_feature_noise"](spark, "/root/testdata/sf0.001")
    best = df._jdf.queryExecution().optimizedPlan().toString()
    assert best.count("md5(") == 2 and best.count("aggregate(") == 2    # two draws; the sums and the squares
    assert "REPARTITION_BY_NUM" in plan_of(df)


def test_windows_meet_frames_in_short_blocks(spark):
    from pyspark.sql import functions as F
    from wavetable.operators import windows as G
    f = spark.range(20_000).select(F.lit("s").alias("series_id"), F.col("id").cast("int").alias("frame_idx"), F.col("id").alias("pos"))
    w = G.materialize_windows(f, G.window_index(f.groupBy("series_id").agg(F.count("*").alias("n")), 10, 5), ["pos"], 10)
    assert "/ 40.0" in plan_of(w) and w.where(F.col("pos")[9] == F.col("start") + 9).count() == w.count() == 3999


def test_live_windows_of_many_short_series_share_calls(spark, tmp_path, monkeypatch):
    """Series that meet in a call, rows of a call worked on in parts, names that a float cannot hold and a null one."""
    from wavetable.operators import windows as G
    from wavetable.streaming import live as L
    monkeypatch.setattr(L._WindowState, "HELD", 50)
    names = [None, 2 ** 60 + 1, 2 ** 60 + 2, *range(30)]
    rows = [(s, i, (i * 37 + k) % 101 / 100.0, False) for k, s in enumerate(names) for i in range(13 + k * 5 % 60)]
    data = spark.createDataFrame(rows, "series_id bigint, frame_idx int, pos double, is_end boolean")
    ends = spark.createDataFrame([(s, 13 + k * 5 % 60, 0.0, True) for k, s in enumerate(names)], data.schema)
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    wave = lambda x: __import__("numpy").stack([x + x[:, :1], 1 - x], 1)
    for late in (True, False):                                       # the later frames come first
        part = data.unionByName(ends).where((data["frame_idx"] >= 30) == late)
        part.coalesce(1).write.mode("append").parquet(src)
        s = L.stream_windows(L.stream_table(spark, src, data.schema), wave, 20, 5, block=40, groups=3)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    want = sorted(map(tuple, G.sliding_predict(data.drop("is_end"), wave, seq=20, stride=5, block=25).select(*spark.read.parquet(out).columns).collect()), key=str)
    assert len(got) == 2 * len(rows) and [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-9)
