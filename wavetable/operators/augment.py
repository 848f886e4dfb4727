"""Augmentations of window rows. Whether and how one applies is a hash of the seed, the epoch and
the window, so a retried task gives the same result. Each function takes the flag as a column."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import Key, keys
from .order_stats import normal_hash, unit_hash

# Chance of each augmentation, newer and older recipe.
RATES = {"time_reverse": 0.3, "roll": 0.3, "slice_dropout": 0.3, "hflip": 0.3}
RATES_DENSE = {"time_reverse": 0.5, "invert": 0.5, "dim_dropout": 0.25, "noise": 0.3, "pose_noise": 0.4,
               "keypoint_dropout": 0.2, "label_noise": 0.3, "speed": 0.15}


def chance(name: str, rate: float, seed: int, epoch: int, window: Sequence[str]) -> Column:
    return unit_hash(seed, F.lit(name), F.lit(epoch), *window) < F.lit(rate)


def _apply(df: DataFrame, flag: Column, new: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(flag, v).otherwise(F.col(c)) for c, v in new.items()})


def time_reverse(df: DataFrame, flag: Column, columns: Sequence[str], negate: Sequence[str] = ()) -> DataFrame:
    """Reverse every column in time; ``negate`` (vectors per frame) also changes sign."""
    new = {c: F.reverse(c) for c in columns}
    for c in negate:
        new[c] = F.transform(new.get(c, F.reverse(c)), lambda v: F.transform(v, lambda x: -x))
    return _apply(df, flag, new)


def invert(df: DataFrame, flag: Column, label: str = "pos", keypoints: str | None = None) -> DataFrame:
    """``1 - x`` for labels and for the y of keypoints."""
    new = {label: F.transform(label, lambda x: F.lit(1.0) - x)}
    if keypoints:
        new[keypoints] = F.transform(keypoints, lambda kp: F.transform(kp, lambda p: p.withField("y", F.lit(1.0) - p["y"])))
    return _apply(df, flag, new)


def roll(df: DataFrame, flag: Column, shift: Column, columns: Sequence[str]) -> DataFrame:
    """Circular shift: position ``t`` moves to ``t + shift``."""
    def rolled(c):
        n = F.size(c)
        k = F.pmod(shift.cast("int"), n)
        return F.concat(F.slice(c, n - k + 1, k), F.slice(c, F.lit(1), n - k))
    return _apply(df, flag, {c: rolled(c) for c in columns})


def roll_shift(seed: int, epoch: int, window: Sequence[str], reach: int = 5) -> Column:
    return (F.floor(unit_hash(seed, F.lit("shift"), F.lit(epoch), *window) * (2 * reach + 1)) - reach).cast("int")


def dim_dropout(df: DataFrame, flag: Column, column: str, seed: int, epoch: int, window: Sequence[str],
                rate: float = 0.1) -> DataFrame:
    """Zero the same random dimensions in every frame of a window."""
    def drop(v):
        return F.transform(v, lambda x, d: F.when(
            unit_hash(seed, F.lit("dim"), F.lit(epoch), *window, d) < F.lit(rate), F.lit(0.0)).otherwise(x))
    return _apply(df, flag, {column: F.transform(column, drop)})


def slice_dropout(df: DataFrame, flag: Column, column: str, start: Column, end: Column) -> DataFrame:
    """Zero channels ``[start, end)`` in every frame."""
    def drop(v):
        return F.transform(v, lambda x, d: F.when((d >= start) & (d < end), F.lit(0.0)).otherwise(x))
    return _apply(df, flag, {column: F.transform(column, drop)})


def label_noise(df: DataFrame, flag: Column, seed: int, epoch: int, window: Sequence[str], sigma: float = 0.02,
                label: str = "pos") -> DataFrame:
    noisy = F.transform(label, lambda x, t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x + F.lit(sigma) * normal_hash(
        seed, F.lit("label"), F.lit(epoch), *window, t))))
    return _apply(df, flag, {label: noisy})


def feature_noise(df: DataFrame, flag: Column, column: str, seed: int, epoch: int, window: Sequence[str],
                  share: float = 0.02) -> DataFrame:
    """Gaussian noise of ``share`` times the deviation of all values of the window; absent values count as nothing and stay so.

    Mean and deviation are bound as the one element of an array, or the optimiser would work them out anew for every value.
    """
    flat = F.filter(F.flatten(F.filter(column, lambda v: v.isNotNull())), lambda x: x.isNotNull())
    sums = F.aggregate(flat, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                       lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))

    def sigma(t):
        square = F.aggregate(flat, F.lit(0.0), lambda a, x: a + (x - t["s"] / t["n"]) * (x - t["s"] / t["n"]))
        return F.when(t["n"] > 1, F.lit(share) * F.sqrt(square / (t["n"] - 1))).otherwise(F.lit(0.0))

    def noisy(s):
        return F.transform(column, lambda v, t: F.transform(v, lambda x, d: x + s * normal_hash(
            seed, F.lit("feature"), F.lit(epoch), *window, t, d)))
    return _apply(df, flag, {column: F.transform(F.transform(F.array(sums), sigma), noisy)[0]})


def pose_noise(df: DataFrame, flag: Column, column: str, seed: int, epoch: int, window: Sequence[str],
               sigma: float = 0.01) -> DataFrame:
    def shake(p, t, k):
        out = p
        for axis in ("x", "y"):
            moved = p[axis] + F.lit(sigma) * normal_hash(seed, F.lit("pose_" + axis), F.lit(epoch), *window, t, k)
            out = out.withField(axis, F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))
        return out
    return _apply(df, flag, {column: F.transform(column, lambda kp, t: F.transform(kp, lambda p, k: shake(p, t, k)))})


def keypoint_dropout(df: DataFrame, flag: Column, column: str, seed: int, epoch: int, window: Sequence[str],
                     rate: float = 0.1) -> DataFrame:
    """Zero single points of single frames."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("conf"))
    new = F.transform(column, lambda kp, t: F.transform(kp, lambda p, k: F.when(
        unit_hash(seed, F.lit("point"), F.lit(epoch), *window, t, k) < F.lit(rate), zero).otherwise(p)))
    return _apply(df, flag, {column: new})


def speed(df: DataFrame, flag: Column, scale: Column, columns: Sequence[str]) -> DataFrame:
    """Read the window at ``int(T * scale)`` even positions, cut or repeat the last row to length T."""
    def resampled(c):
        n = F.size(c)
        m = (n * scale).cast("int")
        pick = lambda k: F.element_at(c, F.least(n, F.floor(
            k * (n - 1) / F.greatest(m - 1, F.lit(1))).cast("int") + 1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: pick(F.least(k, m - 1)))
    return _apply(df, flag, {c: resampled(c) for c in columns})


def speed_scale(seed: int, epoch: int, window: Sequence[str]) -> Column:
    return F.lit(0.9) + unit_hash(seed, F.lit("scale"), F.lit(epoch), *window) * F.lit(0.2)


def hflip(df: DataFrame, flag: Column, column: str, width: int) -> DataFrame:
    """Reverse the last axis of a grid stored row by row per frame."""
    rows = lambda v: F.flatten(F.transform(
        F.sequence(F.lit(0), (F.size(v) / F.lit(width)).cast("int") - 1),
        lambda r: F.reverse(F.slice(v, r * width + 1, F.lit(width)))))
    return _apply(df, flag, {column: F.transform(column, rows)})


def augment(df: DataFrame, columns: Sequence[str], seed: int = 42, epoch: int = 0, *, grid: str | None = None,
            grid_width: int = 1, slices: Sequence[tuple[int, int]] = (), series: Key = "series_id") -> DataFrame:
    """The four augmentations of the current recipe, with a flag column for each."""
    window = [*keys(series), "start"]
    for name, rate in RATES.items():
        df = df.withColumn(name, chance(name, rate, seed, epoch, window))
    df = time_reverse(df, F.col("time_reverse"), columns)
    shift = roll_shift(seed, epoch, window)
    df = roll(df, F.col("roll"), shift, columns).withColumn("roll", F.col("roll") & (shift != 0))
    if grid and slices:
        pick = F.floor(unit_hash(seed, F.lit("slice"), F.lit(epoch), *window) * len(slices)).cast("int")
        table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in slices])
        df = slice_dropout(df, F.col("slice_dropout"), grid, F.get(table, pick)["a"], F.get(table, pick)["b"])
    else:
        df = df.withColumn("slice_dropout", F.lit(False))
    return hflip(df, F.col("hflip"), grid, grid_width) if grid else df.withColumn("hflip", F.lit(False))
