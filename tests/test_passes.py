"""Single passes over whole series against the kernels and plain loops, at any block width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_kernels import plain_peaks, plain_prominence
from wavetable.functions import kernels as N
from wavetable.operators import passes as P


def frames_of(spark, series):
    import pandas as pd
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "frame_idx": np.arange(len(v), dtype=np.int32), "pos": v}) for k, v in series.items()]))


def by_series(df, value):
    out = {}
    for r in df.orderBy("series_id", "frame_idx").collect():
        out.setdefault(r["series_id"], []).append((r["frame_idx"], r[value]))
    return out


def plain_lowpass(x, fps, cutoff, order):
    """The recursion sample by sample."""
    pad = 3 * (order + 1)
    if len(x) <= pad:
        return np.asarray(x, np.float32)
    b, a = N.butterworth(order, cutoff / (fps / 2))
    ext = [2 * x[0] - v for v in x[pad:0:-1]] + list(x) + [2 * x[-1] - v for v in x[-2:-pad - 2:-1]]

    def run(values):
        z = [float(c) * values[0] for c in N.step_state(b, a)]
        out = []
        for v in values:
            y = b[0] * v + z[0]
            z = [b[k] * v - a[k] * y + (z[k] if k < order else 0.0) for k in range(1, order + 1)]
            out.append(y)
        return out
    return np.array(run(run(ext)[::-1])[::-1][pad:-pad], np.float32)


def waves(seed=2):
    rng = np.random.default_rng(seed)
    t = np.arange(2000) / 30
    return {"long": np.clip(.5 + .4 * np.sin(t * 5) + rng.normal(0, .08, len(t)), 0, 1), "short": rng.random(9), "one": np.array([.3]),
            "ten": rng.random(10), "flat": np.full(300, .25), "steps": np.repeat(rng.integers(0, 4, 120) / 4, 7), "ramp": np.linspace(0, 1, 500),
            "spike": np.where(np.arange(900) == 450, 0.0, .2 + .1 * (np.arange(900) % 5 > 2))}


@pytest.mark.parametrize("block, order", [(7, 2), (64, 1), (64, 3), (65_536, 2)])
def test_lowpass_whole(spark, block, order):
    series = waves()
    got = by_series(P.lowpass_whole(frames_of(spark, series), 30.0, 4.0, order, block=block), "low")
    for name, x in series.items():
        assert [i for i, _ in got[name]] == list(range(len(x)))
        np.testing.assert_allclose([v for _, v in got[name]], plain_lowpass(x, 30.0, 4.0, order), atol=3e-7)
        np.testing.assert_allclose([v for _, v in got[name]], N.lowpass(x, 30.0, 4.0, order), atol=3e-7)


def test_lowpass_passes_where_it_is_not_defined(spark):
    series = {"a": np.linspace(0, 1, 40)}
    for fps, cutoff in ((0.0, 4.0), (30.0, 0.0), (30.0, 15.0)):
        assert [v for _, v in by_series(P.lowpass_whole(frames_of(spark, series), fps, cutoff), "low")["a"]] == series["a"].astype(np.float32).tolist()
    assert P.lowpass_whole(frames_of(spark, series).limit(0), 30.0, 4.0).count() == 0


@pytest.mark.parametrize("block, depth, seconds", [(13, 0.0, 0.0), (13, .1, 0.0), (128, .1, 0.0), (13, .035, .5), (128, .3, .2), (65_536, .035, .5)])
def test_troughs_whole(spark, block, depth, seconds):
    series = waves(3)
    series["rising"] = np.repeat(np.linspace(0, 1, 300), 2) + np.tile([0, .01], 300)          # one chain of falling peaks over many blocks
    series["falling"] = series["rising"][::-1].copy()
    series["saturated"] = np.clip(np.sin(np.arange(1500) / 4) * 2, 0, 1)                      # many equal bottoms
    got = by_series(P.troughs_whole(frames_of(spark, series), 30.0, depth, seconds, block=block, salts=3), "pos")
    for name, x in series.items():
        want = N.troughs(x, 30.0, depth, seconds).tolist()
        assert [i for i, _ in got.get(name, [])] == want, name
        assert [v for _, v in got.get(name, [])] == [x[i] for i in want]
        if seconds == 0:
            y = -x.astype(np.float32).astype(float)
            assert want == [p for p in plain_peaks(y) if depth == 0 or plain_prominence(y, p) >= depth]


def test_pass_over_a_filtered_long_series(spark):
    rng = np.random.default_rng(8)
    x = np.clip(np.cumsum(rng.normal(0, .02, 60_000)) % 1.0, 0, 1)
    frames = frames_of(spark, {"s": x})
    low = P.lowpass_whole(frames, 30.0, 3.0, block=4096)
    want = N.lowpass(x, 30.0, 3.0)
    found = by_series(low, "low")["s"]
    np.testing.assert_allclose([v for _, v in found], want, atol=3e-7)
    got = by_series(P.troughs_whole(low, 30.0, .05, .4, x="low", block=2048), "low")["s"]
    assert [i for i, _ in got] == N.troughs(np.array([v for _, v in found]), 30.0, .05, .4).tolist()


def test_spacing_in_one_block_equals_the_plain_rule():
    rng = np.random.default_rng(4)
    for _ in range(200):
        at = np.unique(rng.integers(0, 200, 60))
        x = rng.integers(0, 6, 200).astype(float)
        d = int(rng.integers(1, 20))
        state = N.spaced_state(at, x[at], np.zeros(len(at), bool), d, -10, 10_000)
        assert at[state == 1].tolist() == N.spaced_peaks(x, at, d).tolist() and not (state == 0).any()
