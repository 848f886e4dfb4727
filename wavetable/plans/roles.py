"""The role each test table plays for the operators, in Spark and, for the oracle, in SQL.

``CTE`` holds the same derivations as DuckDB common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import blocks as B
from ..session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, str]] = {}
CTE: dict[str, str] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name], _NEEDS[name] = sql, needs


def _expand(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in (*_expand(list(_NEEDS[n])), n):
            if m not in out:
                out.append(m)
    return out


def oracle(using: str, body: str) -> str:
    """``body`` with the named derivations in front; it may start with WITH itself."""
    parts = [f"{n} AS ({CTE[n]})" for n in _expand(using.split())]
    body = body.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return head + ", ".join([*parts, body[len(head):]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def oracles() -> dict[str, str]:
    return {name: oracle(using, body) for name, (using, body) in _SQL.items()}


def query(name: str, using: str = "", sql: str | None = None):
    """Register a query and, if it can be said in SQL, its oracle."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (using, sql)
        return fn
    return register


def drawn(seed: int, *columns: str) -> str:
    """SQL of ``order_stats.seeded_hash``; columns are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(columns)})), 1, 15))::BIGINT"


def unit(seed: int, *columns: str) -> str:
    """SQL of ``order_stats.unit_hash``."""
    return f"(({drawn(seed, *columns)} >> 7) / 9007199254740992.0::DOUBLE)"


def normal(seed: int, *columns: str) -> str:
    """SQL of ``order_stats.normal_hash``."""
    u, v = (unit(seed, f"'{k}'", *columns) for k in "uv")
    return f"(sqrt(-2.0::DOUBLE * ln(greatest({u}, 1e-300::DOUBLE))) * cos(6.283185307179586::DOUBLE * {v}))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- series


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def actions(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """Control points: one series per user. ``daily`` cuts times to days, which makes ties."""
    e = table(spark, sf_dir, "events")
    at = F.floor(micros("ts") / F.lit(1000)).cast("bigint")
    if daily:
        at = F.floor(at / F.lit(86_400_000)).cast("bigint") * 86_400_000
    return e.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("ord"), at.alias("at_ms"),
                    F.least("value", F.lit(100.0)).alias("pos"))


cte("actions", """SELECT user_id AS series_id, event_id AS ord, epoch_us(ts)//1000 AS at_ms,
    least(value, 100.0::DOUBLE) AS pos FROM events""")
cte("actions_daily", """SELECT series_id, ord, (at_ms // 86400000) * 86400000 AS at_ms, pos FROM actions""", "actions")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense series per user: positions in [0, 1], indexed in time order."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), "event_id", micros("ts").alias("us"),
        (F.least("value", F.lit(100.0)) / F.lit(100.0)).alias("pos"))
    out = B.dense_index(e, "frame_idx", series="series_id", order="us", ties=["event_id"],
                        block=30 * 86_400_000_000)
    return out.select("series_id", "frame_idx", "pos")


cte("frames", """SELECT user_id AS series_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
    least(value, 100.0::DOUBLE) / 100.0::DOUBLE AS pos FROM events""")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target frames with a prediction: the centred mean of five."""
    f = frames(spark, sf_dir).withColumnRenamed("pos", "target")
    w = B.block_window().rowsBetween(-2, 2)
    return B.halo_columns(f, [("pred", F.avg("target").over(w))], 2, 2)


cte("pairs", """SELECT series_id, frame_idx, pos AS target, avg(pos) OVER (PARTITION BY series_id
    ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pred FROM frames""", "frames")


def long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer series: the line items of a supplier by ship date. Its key is not unique, so the
    order runs over every column."""
    li = table(spark, sf_dir, "lineitem")
    us = micros("l_shipdate")
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    li = li.select(F.col("l_suppkey").alias("series_id"), us.alias("us"), *ties)
    out = B.dense_index(li, "frame_idx", series="series_id", order="us", ties=ties, block=365 * 86_400_000_000)
    return out.select("series_id", "frame_idx", (F.col("l_discount") * F.lit(10.0)).alias("pos"))


cte("long_frames", """SELECT l_suppkey AS series_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY
    l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus) - 1 AS INTEGER) AS frame_idx, l_discount * 10.0::DOUBLE AS pos FROM lineitem""")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A six-hour grid per user from a day before the first to a day after the last point."""
    a = actions(spark, sf_dir)
    g = a.groupBy("series_id").agg(F.min("at_ms").alias("t0"), F.max("at_ms").alias("t1"))
    return g.select("series_id", F.lit(1.0 / 21600.0).alias("fps"),
                    ((F.col("t0") - 86_400_000) / F.lit(1000.0)).alias("start_sec"),
                    (F.floor((F.col("t1") - F.col("t0") + 172_800_000) / F.lit(21_600_000)) + 1)
                    .cast("int").alias("total_frames"))


cte("grids", """SELECT series_id, 1.0::DOUBLE/21600.0::DOUBLE AS fps, (min(at_ms) - 86400000)/1000.0::DOUBLE AS start_sec,
    CAST((max(at_ms) - min(at_ms) + 172800000) // 21600000 + 1 AS INTEGER) AS total_frames
    FROM actions GROUP BY series_id""", "actions")
cte("grid_times", """SELECT series_id, CAST(i AS INTEGER) AS frame_idx, (start_sec + i/fps)*1000.0::DOUBLE AS t_ms
    FROM (SELECT *, unnest(range(total_frames)) AS i FROM grids)""", "grids")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour pieces around every tenth control point of a user, named like stored segments."""
    a = actions(spark, sf_dir)
    first = a.groupBy("series_id").agg(F.min("at_ms").alias("t0"), F.max("at_ms").alias("t1"))
    days = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("t1") - F.col("t0")) / F.lit(2_160_000_000)))
    s = first.withColumn("k", F.explode(days))
    return s.select(
        F.col("series_id").alias("scene_id"), F.concat_ws("-", "series_id", "k").alias("series_id"),
        (F.col("t0") / F.lit(1000.0) + F.col("k") * F.lit(2_160_000.0)).alias("segment_start_sec"),
        F.lit(604_800.0).alias("segment_duration_sec"), F.lit(1.0 / 3600.0).alias("fps"),
        F.lit(168).alias("total_frames"))


cte("segments", """SELECT series_id AS scene_id, series_id || '-' || k AS series_id,
    t0/1000.0::DOUBLE + k*2160000.0::DOUBLE AS segment_start_sec, 604800.0::DOUBLE AS segment_duration_sec,
    1.0::DOUBLE/3600.0::DOUBLE AS fps, 168 AS total_frames
    FROM (SELECT *, unnest(range((t1 - t0)//2160000000 + 1)) AS k
          FROM (SELECT series_id, min(at_ms) AS t0, max(at_ms) AS t1 FROM actions GROUP BY series_id))""", "actions")
