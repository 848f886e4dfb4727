"""Compare, roll up and merge two tables of keyed arrays.

A table has one row per ``(key, tile)``: ``shape`` and ``dtype`` of the whole array and ``v``, a tile
of its flattened values. Tiles bound the size of a row and spread a large key over many tasks.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .order_stats import smallest_by

SUMS = ("sum_a", "sum_b", "sq_a", "sq_b", "abs_diff", "sq_diff")
FLOATS = ("float16", "float32", "float64", "bfloat16", "complex64", "complex128")


def _meta(t: DataFrame, side: str) -> DataFrame:
    return t.groupBy("key").agg(F.first("shape").alias(f"shape_{side}"), F.first("dtype").alias(f"dtype_{side}"))


def compare_keyed(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per key: status, and for compatible keys count, moments and differences.

    The sums fold map-side per tile, so a key with most of the values does not gather anywhere.
    """
    meta = _meta(a, "a").join(_meta(b, "b"), "key", "full")
    status = (F.when(F.col("dtype_a").isNull(), "missing_in_a").when(F.col("dtype_b").isNull(), "missing_in_b")
               .when(F.col("shape_a") != F.col("shape_b"), "shape_mismatch")
               .when(F.col("dtype_a") != F.col("dtype_b"), "dtype_mismatch").otherwise("compatible"))
    pair = a.select("key", "tile", F.col("v").alias("a")).join(b.select("key", "tile", F.col("v").alias("b")), ["key", "tile"])
    rows = pair.select("key", F.explode(F.arrays_zip("a", "b")).alias("z"))
    x, y = F.col("z.a").cast("double"), F.col("z.b").cast("double")
    d = y - x
    sums = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(x).alias("sum_a"), F.sum(y).alias("sum_b"), F.sum(x * x).alias("sq_a"),
        F.sum(y * y).alias("sq_b"), F.sum(F.abs(d)).alias("abs_diff"), F.sum(d * d).alias("sq_diff"),
        F.max(F.abs(d)).alias("max_abs_diff"))
    out = meta.withColumn("status", status).join(sums, "key", "left")
    ok = F.col("status") == "compatible"
    filled = {c: F.when(ok, F.coalesce(F.col(c), F.lit(0.0))) for c in (*SUMS, "max_abs_diff")}
    out = out.withColumns({"n": F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)), **filled})
    return _moments(out)


def _moments(df: DataFrame) -> DataFrame:
    n = F.col("n")
    mean = lambda c: F.when(n > 0, F.col(c) / F.greatest(n, F.lit(1))).otherwise(F.when(F.col(c).isNotNull(), 0.0))
    df = df.withColumns({"mean_a": mean("sum_a"), "mean_b": mean("sum_b"), "mean_sq_a": mean("sq_a"),
                         "mean_sq_b": mean("sq_b"), "mean_abs_diff": mean("abs_diff"), "mean_sq_diff": mean("sq_diff")})
    root = lambda x: F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    std = lambda s: root(F.col(f"mean_sq_{s}") - F.col(f"mean_{s}") * F.col(f"mean_{s}"))
    return df.withColumns({"std_a": std("a"), "std_b": std("b"), "rms_diff": root(F.col("mean_sq_diff"))})


def rollup_prefixes(diff: DataFrame) -> DataFrame:
    """Every dotted prefix with what lies below it; the root is the empty path."""
    parts = F.split("key", r"\.")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    rows = diff.select("status", "n", *SUMS, "max_abs_diff", F.explode(F.array_distinct(paths)).alias("path"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = rows.groupBy("path").agg(
        F.count("*").alias("key_count"), is_("compatible").alias("compatible_keys"),
        is_("missing_in_a").alias("missing_in_a"), is_("missing_in_b").alias("missing_in_b"),
        F.count_if(F.col("status").isin("shape_mismatch", "dtype_mismatch")).alias("mismatched"),
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS], F.max("max_abs_diff").alias("max_abs_diff"))
    whole = (F.col("missing_in_a") + F.col("missing_in_b") + F.col("mismatched")) == 0
    some = F.col("compatible_keys") > 0
    g = g.withColumn("status", F.when(some & whole, "compatible").when(some, "partial").otherwise("incompatible"))
    g = g.withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", r"\."))))
    g = g.withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in (*SUMS, "max_abs_diff")})
    return _moments(g)


def top_components(rollup: DataFrame, k: int | None = 16, depth: int | None = 4) -> DataFrame:
    """Components that differ most: not the root, at least two keys, at most ``depth`` levels deep. ``None`` lifts a limit."""
    out = rollup.where((F.col("path") != "") & (F.col("n") > 0) & (F.col("compatible_keys") > 0) & (F.col("key_count") > 1))
    out = out if depth is None else out.where(F.col("depth") <= depth)
    out = out.orderBy(F.desc_nulls_last("rms_diff"), F.desc("n"), "path")
    return out if k is None else out.limit(k)


def selection_errors(rollup: DataFrame, paths: DataFrame) -> DataFrame:
    """Chosen paths that cannot be merged, and why."""
    j = paths.join(rollup, "path", "left")
    name = F.when(F.col("path") == "", "model").otherwise(F.col("path"))
    part = lambda label, c: F.when(F.col(c) > 0, F.concat(F.lit(label + ": "), F.col(c).cast("string")))
    detail = F.concat_ws("; ", part("missing in a", "missing_in_a"), part("missing in b", "missing_in_b"),
                         part("shape/dtype mismatches", "mismatched"))
    error = (F.when(F.col("status").isNull(), F.concat(F.lit("Unknown component path: "), name))
              .when(F.col("status") != "compatible", F.concat(name, F.lit(" is not fully compatible: "), detail)))
    return j.select("path", error.alias("error")).where(F.col("error").isNotNull())


def select_keys(diff: DataFrame, paths: DataFrame) -> DataFrame:
    """Keys at or below the chosen paths (the root selects all)."""
    parts = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    return diff.select("key", F.explode(above).alias("path")).join(paths, "path", "left_semi").select("key").distinct()


def merge_weighted(a: DataFrame, b: DataFrame, weight_a: float, weight_b: float, base: str = "a",
                   selected: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the selected keys, tile by tile; other keys, and keys whose shapes differ, come from the base.

    Values that are not floating point follow the heavier side, and the base on a tie.
    """
    total = weight_a + weight_b
    if total <= 0:
        raise ValueError("the weights must sum to more than zero")
    wa, wb = weight_a / total, weight_b / total
    this, other = (a, b) if base == "a" else (b, a)
    j = this.join(other.select("key", "tile", F.col("shape").alias("_shape"), F.col("v").alias("_o")), ["key", "tile"], "left")
    if selected is None:
        pick = F.col("shape").eqNullSafe(F.col("_shape"))
    else:
        j = j.join(selected.select("key").withColumn("_sel", F.lit(True)), "key", "left")
        pick = F.col("_sel").isNotNull() & F.col("shape").eqNullSafe(F.col("_shape"))
    w_this, w_other = (wa, wb) if base == "a" else (wb, wa)
    mixed = F.zip_with("v", "_o", lambda x, y: x * F.lit(w_this) + y * F.lit(w_other))
    heavier = F.col("v") if w_this >= w_other else F.col("_o")
    value = F.when(~pick, F.col("v")).when(F.col("dtype").isin(*FLOATS), mixed).otherwise(heavier)
    return j.select("key", "tile", "shape", "dtype", value.alias("v"))


def config_diff(a: DataFrame, b: DataFrame, names: Sequence[str]) -> DataFrame:
    """Listed settings (name, value) that differ; an absent one counts as null."""
    l = a.where(F.col("name").isin(*names)).select("name", F.col("value").alias("value_a"))
    r = b.where(F.col("name").isin(*names)).select("name", F.col("value").alias("value_b"))
    return l.join(r, "name", "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def systematic_sample(values: DataFrame, maximum: int = 20_000) -> DataFrame:
    """Every k-th value of each key, at most ``maximum`` in all.

    ``values`` is long: key, pos (from 0), value. Every key gets the same quota, ``maximum`` over the number of keys; below
    32 a hash decides which keys take the remainder, so no key loses its share for coming late in an order.
    """
    sizes = values.groupBy("key").agg((F.max("pos") + 1).alias("_n"))
    # the number of keys is one row; copies of it, one per bucket, meet the keys by an equi-join
    count = sizes.groupBy().agg(F.count("*").alias("_keys")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(63))))
    sizes = sizes.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(64)).cast("int")).join(F.broadcast(count), "_b")
    whole = F.floor(F.lit(maximum) / F.col("_keys"))
    # the keys with the smallest hashes take one value more, as many as the remainder holds
    left = sizes.select("key", F.xxhash64("key").alias("_h"))
    extra = smallest_by(left, "_h", F.when(F.col("_total") * 32 <= maximum, F.lit(0)).otherwise(F.pmod(F.lit(maximum), F.col("_total"))), ties=["key"])
    sizes = sizes.join(extra.select("key", F.lit(1).alias("_more")), "key", "left").withColumn("_more", F.coalesce("_more", F.lit(0)))
    sizes = sizes.withColumn("_cap", whole + F.col("_more")).where("_cap > 0").withColumn(
        "_step", F.when(F.col("_n") <= F.col("_cap"), 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_cap")))))
    j = values.join(sizes.select("key", "_cap", "_step"), "key")
    j = j.where((F.col("pos") % F.col("_step") == 0) & (F.col("pos") < F.col("_cap") * F.col("_step")))
    return j.select("key", "pos", "value")
