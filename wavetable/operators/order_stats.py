"""Exact order statistics and exact seeded samples without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stored
from .blocks import Key, keys


DIGITS = 4
RANKED = 1 << 17


def with_digits(df: DataFrame, names: list[str], value: str = "_v") -> DataFrame:
    """Digits of a double in its order: sign, exponent and four bits first (at most 70 000 values), then 16 bits each.

    Powers of two divide exactly, so four digits name a value. NaN is above all, as in sorting. The steps are columns of their own, so
    that each is worked out once.
    """
    v = F.col(value)
    kept = df.columns
    size = F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (v != 0), F.abs(v))
    df = df.withColumn("_size", size)
    tiny = F.col("_size") < 2.0 ** -900                   # lifted, so that all powers below are in range
    df = df.withColumn("_lift", F.when(tiny, F.col("_size") * 2.0 ** 200).otherwise(F.col("_size")))
    df = df.withColumn("_guess", F.floor(F.log2("_lift"))).withColumn("_power", F.pow(F.lit(2.0), F.col("_guess")))
    # the logarithm may be off by one next to a power of two
    off = F.when(F.col("_lift") / 2 >= F.col("_power"), 1).when(F.col("_lift") < F.col("_power"), -1).otherwise(0)
    df = df.withColumn("_exp", F.col("_guess") + off)
    df = df.withColumn("_part", (F.col("_lift") / F.pow(F.lit(2.0), F.col("_exp")) - 1) * 16)
    for level, name in enumerate(names):
        digit = F.floor("_part")
        if level == 0:
            whole = ((F.col("_exp") - F.when(tiny, 200).otherwise(0) + 1075) * 16 + digit).cast("int")
            end = F.when(F.isnan(v), 60_001).when(v == float("inf"), 60_000).when(v == float("-inf"), -60_000).otherwise(0)
            out = F.when(F.col("_size").isNull(), end).when(v < 0, -whole).otherwise(whole)
        else:
            out = F.when(F.col("_size").isNull(), 0).when(v < 0, 65535 - digit.cast("int")).otherwise(digit.cast("int"))
        df = df.withColumn(name, out)
        if level + 1 < len(names):
            df = df.withColumn("_part", (F.col("_part") - digit) * 65536)
    return df.select(*kept, *names)


def exact_quantile(df: DataFrame, value: Column, q: float, *, series: Key = "series_id",
                   out: str = "threshold", resolution: float | None = None, length: str | None = None,
                   order: str = "frame_idx", ranked: int = RANKED, weighted: bool = False) -> DataFrame:
    """Linear quantile of ``value`` per series, equal to sorting the series; nulls do not count.

    Values are counted by the first digit of their bits, which combines map-side and leaves a bounded number of rows per series,
    whatever the range of the values. Only the one or two digits that hold the wanted ranks are looked into: if one of them
    holds more than ``ranked`` values that are not all equal, by the next digit, else by ranking its values. So no task ranks
    more than that, however values crowd; a table of no more rows is ranked at once. ``length`` names an extra column with the number of frames, which the first count sees anyway.
    ``resolution`` is taken from earlier calls and has no effect. ``weighted`` interpolates as SQL's ``quantile_cont`` does, to the last bit.
    """
    by = keys(series)
    v = df.select(*by, value.cast("double").alias("_v"), *([F.col(order).alias("_i")] if length else [])).where(F.col("_v").isNotNull())
    v = stored(v, "quantile")                             # one or two numbers a row; they are read twice or more
    picks, path = None, []
    # a table that no task could rank too much of needs no digits
    few = v.count() <= ranked
    for level in range(0 if few else DIGITS):
        name = f"_d{level}"
        found = v if picks is None else _within(v, picks, by, path, [*path, name])
        bins = (with_digits(found, [name]) if not path else found).groupBy(*by, *path, name).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), *([F.max("_i").alias("_top")] if length and not path else []))
        whole = W.partitionBy(*by)
        if picks is None:
            bins = bins.withColumn("_rank", F.lit(q) * (F.sum("_n").over(whole) - 1)).withColumn("_from", F.lit(0))
            if length:
                bins = bins.withColumn("_top", F.max("_top").over(whole) + 1)
        else:
            bins = bins.join(picks.select(*by, *path, "_rank", F.col("_start").alias("_from"), *(["_top"] if length else [])), [*by, *path])
        before = W.partitionBy(*by, *path).orderBy(name).rowsBetween(W.unboundedPreceding, 0)
        bins = bins.withColumn("_end", F.col("_from") + F.sum("_n").over(before)).withColumn("_start", F.col("_end") - F.col("_n"))
        held = (F.col("_start") <= F.ceil("_rank")) & (F.col("_end") > F.floor("_rank"))
        done = None if picks is None else picks.where("_least = _most")
        path = [*path, name]
        now = bins.where(held).drop("_from")
        if done is not None:
            now = now.unionByName(done.withColumn(name, F.lit(0)))
        picks = stored(now, "quantile")
        if picks.where((F.col("_n") > ranked) & (F.col("_least") < F.col("_most"))).isEmpty():
            break
    tops = ["_top"] if length else []
    inner = W.partitionBy(*by, *path).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    if few:
        near = v.groupBy(*by, "_v").agg(F.count("*").alias("_m"), *([F.max("_i").alias("_top")] if length else []))
        near = near.withColumn("_rank", F.lit(q) * (F.sum("_m").over(W.partitionBy(*by)) - 1)).withColumn("_start", F.lit(0))
        near = near.withColumn("_top", F.max("_top").over(W.partitionBy(*by)) + 1) if length else near
    else:
        open_ = picks.where("_least < _most").select(*by, *path, "_start", "_rank", *tops)
        near = with_digits(v.select(*by, "_v"), path).join(open_, [*by, *path])
        near = near.groupBy(*by, *path, "_start", "_rank", *tops, "_v").agg(F.count("*").alias("_m"))
    near = near.withColumn("_end", F.col("_start") + F.sum("_m").over(inner)).withColumn("_first", F.col("_end") - F.col("_m"))
    near = near.select(*by, "_v", "_first", "_end", "_rank", *tops)
    if not few:
        near = near.unionByName(picks.where("_least = _most").select(*by, F.col("_least").alias("_v"), F.col("_start").alias("_first"), "_end", "_rank", *tops))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_end")), F.col("_v")))

    picked = near.groupBy(*by).agg(at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"),
                                   F.max(F.col("_rank") - F.floor("_rank")).alias("_f"),
                                   *([F.max("_top").alias(length)] if length else []))
    between = _weighted("_a", "_b", "_f") if weighted else F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return picked.select(*by, between.alias(out), *([length] if length else []))


def _weighted(a: str, b: str, f: str) -> Column:
    """``a * (1 - f) + b * f`` with one rounding of the first product and the sum, as DuckDB's ``quantile_cont`` works it out.

    Neighbours that are equal but for rounding are common among differences of decimals. There the last bit of the quantile says how
    many values reach it, so it has to be the same bit. The error of the product is found by splitting the factors, that of the sum
    by undoing it.
    """
    x, w, c = F.col(a), 1 - F.col(f), F.col(b) * F.col(f)

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (xh, xl), (wh, wl) = halves(x), halves(w)
    product = x * w
    lost = ((xh * wh - product) + xh * wl + xl * wh) + xl * wl
    total = product + c
    back = total - product
    lost = lost + ((product - (total - back)) + (c - back))
    fine = (F.abs(x) < 2.0 ** 900) & (F.abs(c) < 2.0 ** 900)
    return F.when((F.col(f) == 0) | (x == F.col(b)), x).when(fine, total + lost).otherwise(total)


def _within(v: DataFrame, picks: DataFrame, by: list[str], path: list[str], names: list[str]) -> DataFrame:
    """Values whose digits are picked and that are not all equal, with ``names`` of their digits; a hot digit is split by the join,
    which needs no order."""
    digits = with_digits(v.select(*by, "_v"), names)
    return digits.join(picks.where("_least < _most").select(*by, *path), [*by, *path], "left_semi")


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """60 bits that depend only on the seed and the columns: the first 15 digits of the MD5 of their texts, joined by ``|``.

    Nulls are left out. Any engine with MD5 repeats the draw.
    """
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def unit_hash(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends only on the seed and the columns."""
    return F.shiftright(seeded_hash(seed, *columns), 7).cast("double") / F.lit(float(1 << 53))


def normal_hash(seed: int, *columns: Column | str) -> Column:
    """A standard normal number from two unit hashes (Box and Muller)."""
    u = F.greatest(unit_hash(seed, F.lit("u"), *columns), F.lit(1e-300))
    v = unit_hash(seed, F.lit("v"), *columns)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def smallest_by(df: DataFrame, hash_column: str, quota: Column, *, ties: list[str],
                by: Key = (), sums: dict[str, Column] | None = None) -> DataFrame:
    """The ``quota`` rows with the smallest hash, exactly, in every group of ``by``.

    The hash (60 bits) is cut into 65 536 bins. Counting them finds the one bin the quota ends in;
    only rows of that bin and below are shuffled and only within bins are they ranked. ``quota``
    may use ``_total`` (rows of the group) and the group ``sums``.
    """
    group = keys(by) if by else []
    sums = sums or {}
    df = df.withColumn("_bin", F.shiftright(F.col(hash_column), 44))
    whole = W.partitionBy(*group)
    bins = df.groupBy(*group, "_bin").agg(F.count("*").alias("_n"),
                                          *[F.sum(c).alias(f"_p_{k}") for k, c in sums.items()])
    bins = bins.withColumn("_total", F.sum("_n").over(whole))
    for name in sums:
        bins = bins.withColumn(name, F.sum(f"_p_{name}").over(whole))
    run = whole.orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_left", quota - F.sum("_n").over(run) + F.col("_n"))
    bins = bins.where(F.col("_left") > 0).select(*group, "_bin", "_n", "_left")
    if not group:                                   # at most 131 072 rows, whatever the table
        bins = F.broadcast(bins)
    inside = W.partitionBy(*group, "_bin").orderBy(hash_column, *ties)
    return (df.join(bins, [*group, "_bin"])
              .withColumn("_rn", F.row_number().over(inside))
              .where(F.col("_rn") <= F.col("_left"))
              .drop("_bin", "_n", "_left", "_rn"))
