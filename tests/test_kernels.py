"""Chunk kernels against published coefficients and plain definitions."""

import math

import numpy as np
import pytest

from wavetable.functions import kernels as N
from wavetable.operators.waves import WaveConfig

RNG = np.random.default_rng(5)


def test_butterworth_known_coefficients():
    b, a = N.butterworth(2, 0.5)
    np.testing.assert_allclose(b, [0.29289322, 0.58578644, 0.29289322], atol=1e-8)
    np.testing.assert_allclose(a, [1.0, 0.0, 0.17157288], atol=1e-8)
    b, a = N.butterworth(1, 0.25)
    c = math.tan(math.pi / 8)
    np.testing.assert_allclose(b, [c / (1 + c)] * 2, atol=1e-12)
    np.testing.assert_allclose(a, [1.0, (c - 1) / (c + 1)], atol=1e-12)


def test_lowpass_passes_constants_and_slow_waves():
    np.testing.assert_allclose(N.lowpass(np.full(50, 0.7), 30, 5), 0.7, atol=1e-6)
    t = np.arange(600) / 30.0
    slow, fast = np.sin(2 * np.pi * 0.3 * t), np.sin(2 * np.pi * 12 * t)
    out = N.lowpass(slow + fast, 30, 3)
    assert np.abs(out - slow)[50:-50].max() < 0.02
    assert (N.lowpass(slow, 30, 15) == slow.astype(np.float32)).all()
    assert (N.lowpass(slow[:9], 30, 3) == slow[:9].astype(np.float32)).all()


def test_lowpass_is_symmetric_in_time():
    x = RNG.random(200)
    np.testing.assert_allclose(N.lowpass(x[::-1], 30, 4)[::-1][30:-30], N.lowpass(x, 30, 4)[30:-30], atol=1e-4)


def plain_peaks(x):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def plain_prominence(x, p):
    i = p
    while i >= 0 and x[i] <= x[p]:
        i -= 1
    j = p
    while j < len(x) and x[j] <= x[p]:
        j += 1
    return x[p] - max(x[i + 1:p + 1].min(), x[p:j].min())


@pytest.mark.parametrize("seed", range(6))
def test_peaks_and_prominence(seed):
    x = np.random.default_rng(seed).integers(0, 6, 120).astype(float)
    found = N.local_peaks(x)
    assert found.tolist() == plain_peaks(x)
    np.testing.assert_allclose(N.prominences(x, found), [plain_prominence(x, p) for p in found])
    kept = N.spaced_peaks(x, found, 5)
    assert (np.diff(kept) >= 5).all()
    for p in set(found.tolist()) - set(kept.tolist()):
        assert any(abs(p - k) < 5 and x[k] >= x[p] for k in kept)


def test_peak_spacing_prefers_height():
    x = np.array([0, 3, 0, 5, 0, 4, 0, 0, 0, 2, 0], dtype=float)
    assert N.spaced_peaks(x, N.local_peaks(x), 3).tolist() == [3, 9]


def test_f19_cycles_share_their_border():
    x = np.array([0.2, 0.8, 0.3, 0.9, 0.1])
    out, mask, done = N.stretch_cycles(x, x, np.array([0, 2, 4]), 30.0, 0.3, 0.5)
    np.testing.assert_allclose(out, [0, 1, 0.083333, 1, 0], atol=1e-5)
    assert mask.all() and done == [(0, 3), (2, 5)]


def test_savgol_known_weights_and_polynomials():
    x = np.zeros(11)
    x[5] = 1.0
    np.testing.assert_allclose(N.savgol(x, 5, 2)[3:8], np.array([-3, 12, 17, 12, -3]) / 35, atol=1e-6)
    t = np.arange(20.0)
    y = 0.3 - 0.02 * t + 0.001 * t * t
    np.testing.assert_allclose(N.savgol(y, 7, 2), y, atol=1e-6)


def test_gaussian_keeps_constants():
    assert sum(N.gaussian_weights(1.2)) == pytest.approx(1.0)
    assert len(N.gaussian_weights(1.2)) == 2 * int(4 * 1.2 + 0.5) + 1
    np.testing.assert_allclose(N.gaussian(np.full(30, 0.4), 1.2), 0.4, atol=1e-6)


def test_edit_pieces_reproduce_a_cubic_and_split_cleanly():
    x = np.array([0, 3, 4, 9, 15, 21, 22, 30], dtype=float)
    f = lambda t: 0.2 + 0.01 * t - 0.002 * t ** 2 + 0.00004 * t ** 3
    for i0, i1, *c in N.edit_pieces(x, f(x)):
        t = np.arange(i0, i1 + 1)
        np.testing.assert_allclose(np.polyval(c[::-1], t - i0), f(t), atol=1e-9)
    assert N.edit_pieces(np.array([4.0]), np.array([0.5]))[0][2] == 0.5
    (i0, i1, *c), = N.edit_pieces(np.array([2.0, 6.0]), np.array([0.0, 1.0]))
    assert np.polyval(c[::-1], 2.0) == pytest.approx(0.5)


def test_clean_wave_stays_in_range_and_counts():
    t = np.arange(900) / 30.0
    x = 0.5 + 0.3 * np.sin(2 * np.pi * t) * (t < 15) + 0.02 * (t >= 15) * (t - 15)
    x[100] = np.nan
    y, stats = N.clean_wave(x, 30.0, WaveConfig())
    assert y.min() >= 0 and y.max() <= 1 and len(y) == len(x)
    assert stats["num_samples"] == 900 and stats["num_normalized_cycles"] >= 12
    cycles = y[60:400]
    assert cycles.max() == pytest.approx(1.0) and cycles.min() == pytest.approx(0.0)


def test_config_checks():
    for bad in ({"stretch_mode": "cubic"}, {"gradient_smoothing": "box"}, {"merge_gap_seconds": -1.0},
                {"gradient_low_quantile": 0.95}):
        with pytest.raises(ValueError):
            WaveConfig(**bad)
    with pytest.raises(ValueError):
        WaveConfig(chunk_seconds=2.0).chunking(30.0)


def test_block_filter_is_the_plain_recursion():
    b, a = N.butterworth(3, 0.3)
    for n in (1, 63, 64, 65, 300):
        x = RNG.normal(size=n)
        z, want = [0.2, -0.1, 0.05], []
        state = np.array(z)
        for v in x:
            y = b[0] * v + z[0]
            z = [b[1] * v + z[1] - a[1] * y, b[2] * v + z[2] - a[2] * y, b[3] * v - a[3] * y]
            want.append(y)
        np.testing.assert_allclose(N.recurse(b, a, x, state), want, atol=1e-10)


def test_runs_and_merging():
    mask = np.array([0, 1, 1, 0, 1, 0, 0, 0, 1], bool)
    assert [v.tolist() for v in N.run_bounds(mask)] == [[1, 4, 8], [3, 5, 9]]
    assert [v.tolist() for v in N.run_bounds(mask, 1)] == [[1, 8], [5, 9]]
    assert [v.tolist() for v in N.run_bounds(mask, 3)] == [[1], [9]]
    assert len(N.run_bounds(np.zeros(4, bool))[0]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_cycles_against_a_plain_loop(seed):
    r = np.random.default_rng(seed)
    x = r.random(200).astype(np.float32)
    at = np.unique(r.integers(0, 200, 30))
    got, mask, done = N.stretch_cycles(x, x, at, 30.0, 0.2, 2.0)
    want = x.astype(np.float64)
    kept = []
    for s, e in zip(at, at[1:]):
        if 2 <= e - s <= 15 and np.ptp(x[s:e + 1]) >= np.float32(0.2) and np.ptp(want[s:e + 1]) > 1e-6:
            low, high = want[s:e + 1].min(), want[s:e + 1].max()
            want[s:e + 1] = (want[s:e + 1] - low) / (high - low)
            kept.append((s, e + 1))
    assert done == kept
    np.testing.assert_allclose(got, want, atol=1e-5)
    assert mask.sum() == len({i for s, e in kept for i in range(s, e)})


def test_steps_on_chunks_equal_the_kernels(spark):
    from pyspark.sql import functions as F
    from wavetable.operators import waves as V
    n = 500
    rows = [(c, i, float(0.5 + 0.4 * math.sin(i / (5 + c)))) for c in range(2) for i in range(n)]
    f = spark.createDataFrame(rows, "chunk int, frame_idx int, pos double").withColumn("series_id", F.lit("s")).repartition(5)
    low = V.troughs(V.lowpass(f, 30.0, 3.0), 30.0, x="low")
    out = V.smooth(V.normalize_cycles(low, 30.0, reference="low"), 30.0, x="low").orderBy("chunk", "frame_idx").toPandas()
    for c in range(2):
        x = np.array([p for k, _, p in rows if k == c])
        quiet = N.lowpass(x, 30.0, 3.0)
        at = N.troughs(quiet, 30.0, 0.035, 0.15)
        y, mask, _ = N.stretch_cycles(x, quiet, at, 30.0, 0.3, 0.5)
        g = out[out.chunk == c]
        np.testing.assert_allclose(g.low, quiet, atol=1e-6)
        assert np.flatnonzero(g.trough).tolist() == at.tolist() and g.in_cycle.tolist() == mask.tolist()
        np.testing.assert_allclose(g.pos, y, atol=1e-6)
        np.testing.assert_allclose(g.smooth, N.smooth(quiet, 30.0, "savgol", 0.5, 2, 0.12), atol=1e-6)


def test_stages_of_a_sweep_run_once():
    import dataclasses as D
    x = np.clip(.5 + .4 * np.sin(np.arange(900) / 6) + RNG.normal(0, .05, 900), 0, 1)
    base = WaveConfig()
    configs = [base, D.replace(base, stretch_mode="linear"), D.replace(base, stretch_gain=2.0), D.replace(base, trough_prominence=.1),
               D.replace(base, lowpass_cutoff_hz=4.0), D.replace(base, gradient_smoothing="gaussian"), D.replace(base, gradient_sigma_seconds=.3),
               D.replace(base, chunk_seconds=60.0), D.replace(base, gradient_smoothing="none", min_cycle_amplitude=.6)]
    stages = N.Stages()
    for c in configs:
        (a, sa), (b, sb) = N.clean_wave(x, 30.0, c, stages), N.clean_wave(x, 30.0, c)
        assert (a == b).all() and sa == sb
    assert stages.runs == {"fill": 1, "lowpass": 2, "troughs": 3, "cycles": 4, "smooth": 4, "slopes": 5, "stretch": 7}
