"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text and their beginnings (4 to 6 letters, so inflected forms of a stem
share evidence). Training adds to the log loss a penalty on how much a score moves when identity terms are swapped
for other terms of the same group: ``strength * mean (logit(x) - logit(x'))^2``. A text that names a group in
a neutral way then cannot be scored as toxic for the name alone.

Fitted on a bounded sample of labelled rows (``per_class`` of either label, chosen by a hash of the id; rows equal in id
and text count once). Features of the sample are counted in Spark; the driver gets the vocabulary and, for each row,
the places of its features in it. Scoring reads every row and the whole text in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

#: Identity terms that may stand for one another.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    ("immigrants", "refugees", "citizens", "foreigners", "natives"),
    ("old", "young", "disabled", "deaf", "blind"),
)
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words and, marked by a caret, their first 4, 5 and 6 letters."""
    words = set(WORD.findall(text.lower())) if text else set()
    starts = {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) >= n}
    return words | starts


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, texts: list[str | None]) -> list[float]:
        """Probability of the toxic label. Looks at each distinct word once."""
        w, out = self.weights, []
        keys = w.keys()
        for text in texts:
            z = self.bias
            if text:
                words = set(WORD.findall(text.lower()))
                z += sum(w[k] for k in words & keys)
                for n in (4, 5, 6):
                    z += sum(w[k] for k in {"^" + x[:n] for x in words if len(x) >= n} & keys)
            out.append(float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))))
        return out


def identity_features(groups=IDENTITY_GROUPS) -> list[str]:
    return sorted({f for g in groups for t in g for f in features(t)})


def train(samples: list[tuple[set[str], int]], groups=IDENTITY_GROUPS, top: int = 1500, min_count: int = 3, **options) -> Model:
    """Fit on (features, label). The vocabulary holds the ``top`` features by difference in frequency and every identity term."""
    if not samples:
        return Model({}, 0.0)
    y = np.array([v for _, v in samples], float)
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    pos, neg = Counter(), Counter()
    for found, label in samples:
        (pos if label else neg).update(found)
    gap = {k: abs(pos[k] / n1 - neg[k] / n0) / np.sqrt((pos[k] + neg[k] + 4) / (n1 + n0))
           for k in pos.keys() | neg.keys() if pos[k] + neg[k] >= min_count}
    chosen = sorted(gap, key=lambda k: (-gap[k], k))[:top]
    names = [*chosen, *sorted(set(identity_features(groups)) - set(chosen))]
    index = {k: i for i, k in enumerate(names)}
    rows = [np.array(sorted(index[k] for k in found if k in index), np.int32) for found, _ in samples]
    return solve(names, [(pos[k], neg[k]) for k in names], rows, y, groups, **options)


def solve(names: list[str], counts: list[tuple[int, int]], rows: list[np.ndarray], y: np.ndarray, groups=IDENTITY_GROUPS,
          strength: float = 4.0, steps: int = 200, reg: float = 2e-3, rate: float = 0.1, pairs_per_term: int = 4) -> Model:
    """Weights of the features ``names``, which hold every identity term. ``counts`` are their toxic and neutral rows in the
    sample, ``rows`` the places of each row's features in ``names``.

    Where labelled sentences hold no identity term, terms are added to neutral ones, so that the penalty always sees each.
    """
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    # a feature counts by its log odds, so what stands in one class only needs little weight however rare it is
    scale = np.array([max(abs(np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1))), 0.1) for p, q in counts])
    index = {k: i for i, k in enumerate(names)}
    own = {t: frozenset(index[f] for f in features(t)) for g in groups for t in g}
    following = {index[t]: (t, g[(i + 1) % len(g)]) for g in groups for i, t in enumerate(g)}
    at, sign = [], []                          # of each pair that should score alike: features of one side only

    def differ(a: set[int], b: set[int]) -> None:
        at.append([*(a - b), *(b - a)])
        sign.append([1.0] * len(a - b) + [-1.0] * len(b - a))

    for row in rows:
        found = set(row.tolist())
        for k in sorted(found & following.keys()):
            term, other = following[k]
            differ(found, (found - own[term]) | own[other])
    neutral = [r for r, label in zip(rows, y) if not label] or [rows[0]]
    for g in groups:
        for i, term in enumerate(g):
            for k in range(pairs_per_term):
                base = set(neutral[(7 * i + k) % len(neutral)].tolist())
                differ(base | own[term], base | own[g[(i + 1 + k) % len(g)]])
                differ(base | own[term], base)
    # sparse rows: the row, place and value of each entry
    n, m, size = len(rows), len(at), len(names)
    xr, xc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows).astype(np.int32)
    dr, dc = np.repeat(np.arange(m), [len(a) for a in at]), np.array([k for a in at for k in a], np.int64)
    dv = np.array([v for a in sign for v in a]) * scale[dc]
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(size), 0.0
    a1, a2, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(xr, (w * scale)[xc], n) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        moved = np.bincount(dr, dv * w[dc], m)
        g = np.bincount(xc, err[xr], size) * scale + reg * w + 2 * strength / m * np.bincount(dc, dv * moved[dr], size)
        gb = err.sum()
        a1, a2 = 0.9 * a1 + 0.1 * g, 0.999 * a2 + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (a1 / (1 - 0.9 ** t)) / (np.sqrt(a2 / (1 - 0.999 ** t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-8)
        if t % 70 == 0:
            rate *= 0.3
    w = w * scale
    return Model({k: float(v) for k, v in zip(names, w) if abs(v) > 1e-3}, float(b))


def fit(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = 5000, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", groups=IDENTITY_GROUPS, top: int = 1500, min_count: int = 3, **options) -> Model:
    """Fit on labelled rows where ``use`` holds (on the id). Null labels are left out, a document labelled twice counts
    as toxic if any label says so. Without both classes the model is the share of the label."""
    spark = ready(docs.sparkSession)
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("y")).where(use(F.col("_id")))
    # ids drawn by hash, about 1.5 times the rows wanted of either label; only their texts are joined
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}                       # two rows
    share = F.create_map(*[F.lit(v) for y, n in counts.items() for v in (y, min(1.0, 1.5 * per_class / n))]) if counts else F.lit(0.0)
    drawn = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < (share[F.col("y")] if counts else share) * (1 << 20))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), "_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = pa.array([sorted(features(t)) for t in batch.column(3).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], names=["h", "t", "y", "f"])

    got = rows.select(F.xxhash64("_id").alias("h"), F.xxhash64("text").alias("t"), "y", "text").mapInArrow(
        read, "h long, t long, y int, f array<string>")
    got = stored(got.dropDuplicates(["h", "t"]), "toxicity-sample")
    taken: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(got.select("h", "t", "y").collect()):
        if len(own := taken.setdefault(int(r["y"]), [])) < per_class:
            own.append((r["h"], r["t"]))
    if len(taken) < 2:
        return Model({}, 30.0 if taken and 1 in taken else -30.0)
    n1, n0 = len(taken[1]), len(taken[0])
    last = {y: own[-1] for y, own in taken.items()}              # rows up to this hash are the sample
    upto = [(F.col("y") == y) & ((F.col("h") < h) | ((F.col("h") == h) & (F.col("t") <= t))) for y, (h, t) in last.items()]
    sample = got.where(upto[0] | upto[1])
    seen = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    gap = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt((F.col("p") + F.col("q") + 4) / (n1 + n0))
    known = identity_features(groups)
    best = seen.where(F.col("p") + F.col("q") >= min_count).orderBy(gap.desc(), "f").limit(top).withColumn("best", gap)
    found = best.unionByName(seen.where(F.col("f").isin(known)).withColumn("best", F.lit(-1.0))).collect()
    found = sorted(found, key=lambda r: (-r["best"], r["f"]))
    number = {k: (0, 0) for k in [*dict.fromkeys(r["f"] for r in found), *known]} | {r["f"]: (r["p"], r["q"]) for r in found}
    index = spark.sparkContext.broadcast({k: i for i, k in enumerate(number)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = [np.array(sorted(index.value[k] for k in f if k in index.value), np.int32).tobytes() for f in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["h", "t", "y", "ids"])

    rows = sorted(sample.select("h", "t", "y", "f").mapInArrow(place, "h long, t long, y int, ids binary").collect())
    return solve(list(number), list(number.values()), [np.frombuffer(r["ids"], np.int32) for r in rows],
                 np.array([r["y"] for r in rows], float), groups, **options)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` and ``predicted``. Null and empty texts get the score of no words."""
    ready(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)      # at most ``top`` weights and the identity terms

    @F.pandas_udf("double")
    def rate(texts):
        import pandas as pd
        return pd.Series(known.value.score(texts.tolist()), dtype="float64")

    found = docs.withColumn("_score", rate(F.col(text).cast("string")))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*names, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
