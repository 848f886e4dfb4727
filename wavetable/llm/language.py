"""Hierarchical language identification with linear support vector machines.

A text is a vector of hashed byte n-grams (1 to 3 bytes of the ASCII-lower-cased text, square roots of the counts, unit
length). A first set of machines, one family against the rest, finds the language family; inside the family one machine for
each pair of languages votes, so closely related languages are told apart by what differs between just these two.

Machines are fitted by stochastic sub-gradient steps on a bounded sample: at most ``per_language`` labelled rows of
each language, chosen by a hash of the text. Counting and prediction cover every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

DIM = 4096
#: Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
}


def vector(raw: bytes, dim: int = DIM) -> np.ndarray:
    """Unit vector of hashed byte n-grams of a whole text; zeros for an empty one."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    upper = (b >= 65) & (b <= 90)
    b = np.where(upper, b + 32, b)
    counts = np.zeros(dim)
    h = b
    for n in range(3):
        if n:
            h = h[:-1] * np.uint32(0x01000193) + b[n:] + np.uint32(n)
        if not len(h):
            break
        counts += np.bincount(((h * np.uint32(0x9E3779B1)) >> np.uint32(20)) & np.uint32(dim - 1), minlength=dim)
    counts = np.sqrt(counts)
    norm = np.sqrt((counts * counts).sum())
    return (counts / norm if norm else counts).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit_machine(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, reg: float = 1e-4, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias of a linear machine for labels +1 and -1: hinge loss, averaged sub-gradient steps, balanced classes.

    ``rows`` says which rows of ``x`` the labels belong to (default: all), so that machines share one array.
    """
    rng = np.random.default_rng(seed)
    rows = np.arange(len(x)) if rows is None else rows
    weight = np.where(y > 0, len(y) / max(2 * (y > 0).sum(), 1), len(y) / max(2 * (y < 0).sum(), 1))
    w = np.zeros(x.shape[1] + 1)
    mean, steps, t = np.zeros_like(w), 0, 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            t += 1
            rate = 1.0 / (reg * (t + 1000))
            given = x[rows[part]]
            inside = y[part] * (given @ w[:-1] + w[-1]) < 1
            push = weight[part] * y[part] * inside
            w *= 1 - rate * reg
            w[:-1] += rate / len(part) * (push @ given)
            w[-1] += rate / len(part) * push.sum()
            size = np.sqrt(w @ w)
            w *= min(1.0, 1 / np.sqrt(reg) / size) if size else 1.0
            if epoch >= epochs // 2:
                mean += w
                steps += 1
    return mean / max(steps, 1)


@dataclass
class Model:
    """families: name -> languages; first: family -> weights; pairs: (language, language) -> weights."""
    families: dict[str, list[str]]
    first: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]
    dim: int = DIM

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of whole texts. The score multiplies the confidence in the family and in the language."""
        out = []
        for text in texts:
            if not text or not has_letter(text) or not self.families:
                out.append(("und", 0.0))
                continue
            v = vector(text.encode("utf-8", "surrogatepass"), self.dim)
            margin = {f: float(v @ w[:-1] + w[-1]) for f, w in self.first.items()}
            family = max(sorted(margin), key=margin.get) if margin else next(iter(self.families))
            best = [margin[f] for f in margin if f != family]
            score = _confidence(margin[family] - max(best)) if best else 1.0
            votes = dict.fromkeys(self.families[family], (0, 0.0))
            for (a, b), w in self.pairs.items():
                if a in votes and b in votes:
                    m = float(v @ w[:-1] + w[-1])
                    won = a if m >= 0 else b
                    votes[won] = (votes[won][0] + 1, votes[won][1] + abs(m))
            lang = max(sorted(votes), key=votes.get)
            if len(votes) > 1:
                score *= _confidence(votes[lang][1] / (len(votes) - 1))
            out.append((lang, score))
        return out


def _confidence(margin: float) -> float:
    return float(1 / (1 + np.exp(-2.0 * min(max(margin, -30.0), 30.0))))


def _sparse(v: np.ndarray) -> bytes:
    """Places and values of the entries of a vector that are not zero."""
    where = np.flatnonzero(v).astype(np.uint16 if len(v) <= 1 << 16 else np.uint32)
    return np.uint32(len(where)).tobytes() + v[where].astype(np.float32).tobytes() + where.tobytes()


def _dense(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    kind = np.uint16 if len(raw) == 4 + 6 * n else np.uint32
    return np.frombuffer(raw, kind, n, 4 + 4 * n), np.frombuffer(raw, np.float32, n, 4)


def fit(docs: DataFrame, train: Column, per_language: int = 600, families: dict[str, str] | None = None, dim: int = DIM,
        text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows where ``train`` holds. At most ``per_language`` rows of each language, the smallest by a hash of the
    text, reach the driver as vectors. Rows without text or language are left out; no rows give a model without languages."""
    ready(docs.sparkSession)
    families = FAMILIES if families is None else families
    rows = docs.where(train).where(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    # the hash below which a language has about 1.5 times the rows wanted; one count for each language comes to the driver
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, {}, {}, dim)
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, 65536 * min(1.0, 1.5 * per_language / n))])
    near = rows.where(F.shiftright("h", 48) + 32768 <= share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vs = [_sparse(vector(t.encode("utf-8", "surrogatepass"), dim)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(vs, pa.binary())], names=["lang", "h", "v"])

    got = near.select("lang", "text", "h").mapInArrow(work, "lang string, h long, v binary").collect()
    by: dict[str, list] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["h"])):
        if len(by.setdefault(row["lang"], [])) < per_language:
            by[row["lang"]].append(row["v"])
    del got
    # one array for all machines, filled row by row
    x = np.zeros((sum(map(len, by.values())), dim), np.float32)
    at, place = {}, 0
    for language in sorted(by):
        at[language] = np.arange(place, place + len(by[language]))
        for v in by[language]:
            where, value = _dense(v)
            x[place, where] = value
            place += 1
        by[language] = []
    members: dict[str, list[str]] = {}
    for language in at:
        members.setdefault(families.get(language, language), []).append(language)
    first, pairs = {}, {}
    if len(members) > 1:
        own = np.concatenate([[families.get(k, k)] * len(at[k]) for k in at])
        first = {f: fit_machine(x, np.where(own == f, 1.0, -1.0), 1) for f in sorted(members)}
    for group in members.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                y = np.concatenate([np.ones(len(at[a])), -np.ones(len(at[b]))])
                pairs[a, b] = fit_machine(x, y, 2, rows=np.concatenate([at[a], at[b]]))
    return Model(members, first, pairs, dim)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; the prediction uses the text alone.

    ``und`` with score 0 where the text is null, empty or without letters, or the model knows no language. One pass, no shuffle.
    """
    ready(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)     # (languages^2 + families) * dim weights, whatever the corpus

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd
        return pd.DataFrame(known.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    found = docs.withColumn("_found", predict(F.col(text).cast("string")))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*[F.col(f"`{c}`") for c in names], "_found.lang_pred", "_found.score")


def filter_documents(docs: DataFrame, model: Model, wanted: list[str] | None = None, min_score: float = 0.0,
                     text: str = "text") -> DataFrame:
    """Documents whose predicted language is wanted (default: any that was learned) with at least ``min_score``."""
    languages = wanted or [k for group in model.families.values() for k in group]
    found = identify(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), model, "_text")
    return found.where(F.col("lang_pred").isin(languages) & (F.col("score") >= min_score)).select("_row.*")
