"""Whitening against a plain computation, and the spectral divide and conquer against known spectra."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.llm import whitening
from wavetable.llm.whitening import components, polar


def orthogonal(n, seed=0):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


SPECTRA = {
    "even": np.linspace(1, 2, 40), "steep": 10.0 ** -np.arange(14), "ties": np.array([5, 5, 5, 1, 1, 0, 0.0]), "one large": np.array([1e9, *[1.0] * 9]),
    "close": np.array([3, 2, 1 + 2e-9, 1 + 1e-9, 1.0]), "constant": np.ones(6), "zero": np.zeros(5), "single": np.array([7.0]), "rank one": np.array([4.0, 0, 0, 0]),
    "pair": np.array([2.0, 1.0]), "around its mean": np.array([3, 2, 2, 1.0]),
}


@pytest.mark.parametrize("name", list(SPECTRA))
def test_components_of_known_spectra(name):
    want = np.sort(SPECTRA[name])[::-1]
    q = orthogonal(len(want))
    a = q @ np.diag(want) @ q.T
    e, v = components(a)
    size = max(abs(want[0]), 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * size
    assert np.abs(a @ v - v * e).max() <= 1e-13 * size
    assert np.abs(v.T @ v - np.eye(len(want))).max() <= 1e-9
    assert np.allclose(np.linalg.norm(v, axis=0), 1, atol=1e-14)


def test_polar_factor_is_the_sign():
    q = orthogonal(12, 3)
    d = np.array([5, 1, 1e-3, 1e-9, 3, 2, -1, -4, -1e-6, -1e-12, -2, -9.0])
    u = polar(q @ np.diag(d) @ q.T)
    assert np.abs(u - q @ np.diag(np.sign(d)) @ q.T).max() < 1e-3 and np.abs(u @ u - np.eye(12)).max() < 1e-13
    assert np.abs(polar(q @ np.diag(np.where(np.abs(d) < 1e-4, 1, d)) @ q.T) - q @ np.diag(np.where(np.abs(d) < 1e-4, 1, np.sign(d))) @ q.T).max() < 1e-11


def plain(rows, count):
    """{length of vectors: (ids, n, deviations, whitened, explained)} by exact sums and a dense eigensolver."""
    out = {}
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    for dims in {len(v) for _, v in good if v}:
        part = [(i, v) for i, v in good if len(v) == dims]
        fit = np.array(sorted({tuple(v) for _, v in part}), float)
        n, s = len(fit), [int(c) for c in fit.sum(0)]
        y = fit - np.array(s) / n
        e, u = np.linalg.eigh(y.T @ y / n)
        order = [k for k in np.argsort(-e) if e[k] > 1e-9 * max(e.max(), 1e-30)][:count]
        x = np.array([v for _, v in part], float)
        deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for _, v in part]
        out[dims] = ([i for i, _ in part], n, deviation, (x - np.array(s) / n) @ u[:, order] / np.sqrt(e[order]), e[order] / max(e.sum(), 1e-300))
    return out


def check(spark, rows, count):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("n", "x", "deviation", "whitened", "label")})
    got = whitening.whiten(frame, count)
    assert got.columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    used = 0
    sizes = {i: len(v) for i, v in rows if v is not None}
    for dims, (ids, n, deviation, y, explained) in plain(rows, count).items():
        mine = sorted((r for r in found if sizes[r["vec_id"]] == dims), key=lambda r: (r["vec_id"], r["deviation"]))
        order = sorted(range(len(ids)), key=lambda k: (ids[k], deviation[k]))
        assert [(r["vec_id"], r["n"], r["deviation"]) for r in mine] == [(ids[k], n, deviation[k]) for k in order]
        w = np.array([r["whitened"] for r in mine]).reshape(len(mine), -1)
        assert w.shape == y.shape and all(r["identity_error"] < 1e-9 for r in mine)
        assert np.allclose([r["explained"] for r in mine], np.tile(explained, (len(mine), 1)), rtol=1e-9)
        sign = np.sign((w * y[order]).sum(0))
        assert np.allclose(w, y[order] * sign, rtol=1e-7, atol=1e-8)
        used += len(mine)
    return found, used


def test_against_plain(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    rows = [(i, (mix @ rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(7, rows[7][1])]          # a vector that many rows share counts once
    for count in (4, None):
        found, used = check(spark, rows, count)
        assert used == len(rows) == len(found)


def test_nulls_lengths_and_lost_rank(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(50)]
    rows += [(100 + i, [float(i % 5), 1.0, 2.0 * (i % 5), -1.0]) for i in range(20)]    # one direction only
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (203, [1.0, float("inf"), 1.0]), (204, [0.5, 0.5])]
    found, used = check(spark, rows, 4)
    assert used == 71 == len(found) and {len(r["whitened"]) for r in found if 100 <= r["vec_id"] < 200} == {1}
    assert [r["whitened"] for r in found if r["vec_id"] == 204] == [[]]
    empty = spark.createDataFrame([(1, []), (None, []), (2, None)], "vec_id long, embedding array<double>")
    assert sorted((r["n"], r["deviation"], r["whitened"]) for r in whitening.whiten(empty).collect()) == [(1, 0, []), (1, 0, [])]
    assert whitening.whiten(empty.limit(0)).count() == 0


def test_exact_or_error(spark):
    rows = [(i, [1e4 * i, -3e3 * i * i]) for i in range(8)]
    check(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in rows], None)
    with pytest.raises(Exception, match="bits"):
        whitening.whiten(spark.createDataFrame([(i, [1e13 * i]) for i in range(8)], "vec_id long, embedding array<double>")).collect()
