"""Simplification against the plain rule, in blocks of any width and over long rising series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavetable.functions import kernels as N
from wavetable.operators import resample as R


def plain(x, tolerance=2.0):
    """Frame by frame: ends and extrema stay, others where they leave the chord from the last kept point to the next."""
    x = [float(np.float64(v)) * 100.0 for v in x]
    kept, last = [], None
    for i, c in enumerate(x):
        a, b = (x[i - 1] if i else None), (x[i + 1] if i + 1 < len(x) else None)
        if a is None or b is None or (c >= a and c >= b) or (c <= a and c <= b) or abs(c - (last + (b - last) * 0.5)) > tolerance:
            kept.append(i)
            last = c
    return kept


def series():
    rng = np.random.default_rng(6)
    ramp = np.linspace(0, 1, 4000)
    return {"noise": rng.random(400), "steps": np.repeat(rng.random(60), 5), "ramp": ramp, "fall": ramp[::-1].copy(), "bent": ramp ** 3,
            "jumps": np.sort(np.concatenate([rng.random(30), rng.random(300) * 1e-3 + .5])), "slow": np.cumsum(rng.random(3000)) / 3000,
            "wave": .5 + .5 * np.sin(np.arange(3000) / 250), "one": np.array([.4]), "two": np.array([.4, .6]), "flat": np.full(50, .5),
            "narrow": .5 + ramp * 1e-3}


@pytest.mark.parametrize("block, tolerance", [(97, 2.0), (400, 0.5), (65_536, 2.0), (65_536, 0.1)])
def test_equals_the_plain_rule(spark, block, tolerance):
    data = series()
    frames = spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "frame_idx": np.arange(len(v), dtype=np.int32), "pos": v}) for k, v in data.items()]))
    got = {}
    for r in R.simplify(frames, F.lit(30.0), tolerance, block=block).orderBy("series_id", "frame_idx").collect():
        got.setdefault(r["series_id"], []).append(r)
    for name, x in data.items():
        want = plain(x, tolerance)
        assert [r["frame_idx"] for r in got[name]] == want, name
        assert [r["pos"] for r in got[name]] == [int(np.rint(min(100.0, max(0.0, x[i] * 100.0)))) for i in want]
        assert [r["at_ms"] for r in got[name]] == [int(np.rint(i * 1000.0 / 30.0)) for i in want]


def test_one_long_rising_series(spark):
    """A million rising frames: no row and no task holds more than a block, and the rounds are few."""
    n, block = 1_000_000, 65_536
    frames = spark.range(n, numPartitions=8).select(F.lit("s").alias("series_id"), F.col("id").cast("int").alias("frame_idx"),
                                                    (F.pow(F.col("id") / n, 2.0)).alias("pos"))
    rounds, plain_entering = [], R._entering
    try:
        R._entering = lambda *a: rounds.append(1) or plain_entering(*a)
        got = [r["frame_idx"] for r in R.simplify(frames, F.lit(30.0), block=block).orderBy("frame_idx").collect()]
    finally:
        R._entering = plain_entering
    x = (np.arange(n) / n) ** 2.0
    turns, far, _ = N.chord_points(x * 100.0, None, None, None, 2.0)
    assert got == np.flatnonzero(turns | far).tolist() and 10 < len(got) < 60 and len(rounds) <= 60


def test_empty(spark):
    frames = spark.createDataFrame([], "series_id string, frame_idx int, pos double")
    assert R.simplify(frames, F.lit(30.0)).count() == 0
