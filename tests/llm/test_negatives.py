"""Hard negatives against a plain loop: ties, repeats, nulls, hot labels, many small blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label string"


def plain(rows, is_anchor, positives=5, count=3, lower=50, upper=95):
    good = [(k, i, [math.floor(256 * c) for c in v], lab) for k, (i, v, lab) in enumerate(rows)
            if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    place = lambda i: (i is None, i)
    for k, i, x, lab in good:
        if not is_anchor(i):
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), place(j), j, other) for m, j, y, other in good if m != k and len(y) == len(x)]
        scored.sort(key=lambda r: (r[0], r[1]))
        for p in [r for r in scored if r[3] == lab][:positives]:
            ok = [r for r in scored if r[3] != lab and lower * -p[0] <= 100 * -r[0] <= upper * -p[0]]
            out += [(i, p[2], rank + 1, r[2], -p[0], -r[0]) for rank, r in enumerate(ok[:count])]
    return sorted(out, key=str)


def check(spark, rows, step=3, **options):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], lab) for i, v, lab in rows]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("rank", "uid", "id", "score", "anchor", "anchor_id", "part", "ups")})
    got = negatives.mine(frame, F.col("vec_id") % step == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, lambda i: i is not None and i % step == 0, options.get("positives", 5), options.get("negatives", 3),
                 options.get("lower", 50), options.get("upper", 95))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    return want


@pytest.mark.parametrize("row_bytes, anchor_bytes", [(1 << 20, 1 << 20), (64, 48)])
def test_against_plain_loop(spark, row_bytes, anchor_bytes):
    rng = random.Random(5)
    centre = [rng.gauss(0, .4) for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, .25) for c in centre], rng.choice("aaab") if i % 2 else rng.choice("cdef")) for i in range(150)]
    rows += [(i, rows[i][1], rows[i][2]) for i in range(0, 30)]                     # repeated rows
    assert check(spark, rows, row_bytes=row_bytes, anchor_bytes=anchor_bytes)


def test_ties_and_few_values(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice((-.5, .25, .5)) for _ in range(3)], rng.choice("ab")) for i in range(90)]
    assert check(spark, rows, row_bytes=96)
    assert check(spark, rows, positives=2, negatives=4, lower=0, upper=100)


def test_nulls_lengths_and_bad_components(spark):
    rng = random.Random(7)
    vector = lambda n: [abs(rng.gauss(0, 1)) for _ in range(n)]
    rows = [(i, vector(4), rng.choice("ab")) for i in range(40)]
    rows += [(None, vector(4), "a"), (None, vector(4), "b"), (42, None, "a"), (45, vector(4), None), (48, [1.0, None, 1.0, 1.0], "a"),
             (51, [1.0, float("nan"), 1.0, 1.0], "b"), (54, [1.0, float("inf"), 1.0, 1.0], "b"), (57, [], "a"), (58, [], "b"), (60, [], "a"),
             *[(i, vector(2), rng.choice("ab")) for i in range(60, 80)], (81, [0.0] * 4, "a"), (84, [-1.0] * 4, "z")]
    assert check(spark, rows)


def test_no_rows_no_anchors(spark):
    for rows, step in (([], 3), ([(1, [1.0], "a"), (2, [1.0], "b")], 50), ([(3, [1.0], "a")], 3)):
        assert check(spark, rows, step) == []


def test_exact_at_large_numbers(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(1e5, 1e6) for _ in range(3)], rng.choice("ab")) for i in range(60)]      # beyond 53 bits
    assert check(spark, rows)
    with pytest.raises(Exception, match="bits"):
        negatives.mine(spark.createDataFrame([(i, [1e15], "ab"[i % 2]) for i in range(4)], SCHEMA), F.col("vec_id") == 0).collect()


def test_slots_cover_every_window():
    limits, floors = negatives._slots([[100, 80, 80], [-10], [7, 0]], 50, 95)
    assert limits[0].tolist()[:2] == [95, 76] and floors.tolist() == [40, -5, 0] and limits[1][0] == -10 and limits[2].tolist()[:2] == [6, 0]
