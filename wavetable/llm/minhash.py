"""Near-duplicate documents by minhash signatures and a multi-index Hamming join.

A document is its set of distinct word shingles. Its signature holds ``chunks * 5`` minhash values of 16 bits. Two signatures
that differ in at most ``2 * chunks - 1`` values have, by the pigeonhole principle, a chunk of five values with at most one
error; each chunk is therefore filed under its five ways to leave one value out. All pairs under that distance meet
in a bucket. At 12 chunks a pair of similarity 0.8 is over it with a probability near 1e-4.

Links are confirmed on the full sets. Equal sets are one node from the start. In a bucket every node is first held
against the most typical one; nodes that are connected by then need not be compared with each other, only pairs that
are still apart are, and of these only pairs whose parity bits allow the similarity: each set keeps the parity of its
number of elements in each of 512 hash classes, and sets differ in at least as many elements as they do in
parities. In a bucket of more than ``hot`` nodes, those outside its largest component are held against all, in parts of
about ``hot`` nodes; pairs within that component are connected already. So every bucket finds all its pairs, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, ready, stored

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = U(0x9E3779B97F4A7C15)
_RI = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict = {}
WIDTH = 5                       # values in a chunk
PARITIES = 512


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 14, 2 * (0 if have is None else len(have)))
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of every word of the ASCII-lower-cased bytes, by differences of one running polynomial."""
    b = np.frombuffer(raw.lower(), np.uint8)
    space = _SPACE[b]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * _powers(_R, len(b)), out=total[1:])
    return mix((total[end] - total[start]) * _powers(_RI, len(b) + 1)[start] + (end - start).astype(U))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a whole text; fewer words than ``width`` are one shingle."""
    if not text:
        return np.zeros(0, U)
    w = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    span = min(width, len(w))
    h = np.full(len(w) - span + 1, U(span))
    for k in range(span):
        h = mix(h * U(0xD6E8FEB86659FD93) + w[k:len(w) - span + 1 + k])
    return np.unique(h)


def signature(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` minhash values of 16 bits of a non-empty set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, U) * U(2) + U(1)
    b = rng.integers(0, 1 << 63, n, U)
    low = np.full(n, ~U(0))
    for at in range(0, len(h), 2048):
        part = h[at:at + 2048]
        low = np.minimum(low, mix_light(part[None, :] * a[:, None] + b[:, None]).min(1))
    return (mix(low) >> U(48)).astype(np.uint16)


def parities(h: np.ndarray) -> list[int]:
    """Whether an odd number of elements falls into each of 512 classes, as 64-bit words."""
    odd = np.bincount((h >> U(55)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def mix_light(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)


def chunk_keys(sig: Column, chunks: int) -> Column:
    """The bucket keys of a signature (array of values): for each chunk and each place left out, a hash of place and other values.

    ``chunk`` goes along, so that two keys of one document can be told to come from different chunks.
    """
    out = []
    for c in range(chunks):
        for skip in range(WIDTH):
            kept = [sig[WIDTH * c + k] for k in range(WIDTH) if k != skip]
            out.append(F.struct(F.lit(c).alias("chunk"), F.xxhash64(F.lit(WIDTH * c + skip), *kept).alias("key")))
    return F.array(*out)


def summaries(docs: DataFrame, width: int, chunks: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, two sums that stand for the set, and the keys of its signature (null without words)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, s1, s2, sig, bits = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingles(t, width)
                n.append(len(h))
                s1.append(int(mix(h).sum().astype(np.int64)) if len(h) else 0)
                s2.append(int(mix(h * U(0xC2B2AE3D27D4EB4F) + U(11)).sum().astype(np.int64)) if len(h) else 0)
                sig.append(signature(h, WIDTH * chunks).astype(np.int32).tolist() if len(h) else None)
                bits.append(parities(h))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                                              pa.array(s2, pa.int64()), pa.array(sig, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))],
                                             names=["doc_id", "n_shingles", "s1", "s2", "sig", "bits"])

    return source.mapInArrow(work, f"doc_id {kind}, n_shingles long, s1 long, s2 long, sig array<int>, bits array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """node, set (binary) of the documents named in ``nodes``; of repeated ids the text whose set the node stands for."""
    source = docs.select(F.col(doc_id).alias("node"), F.col(text).cast("string").alias("text")).join(nodes, "node")
    kind = source.schema["node"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, t, s in zip(*(batch.column(k).to_pylist() for k in ("node", "text", "s1"))):
                h = shingles(t, width)
                if len(h) and int(mix(h).sum().astype(np.int64)) == s:
                    rows.append((node, h.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("node").type),
                                                  pa.array([r[1] for r in rows], pa.binary())], names=["node", "set"])

    return source.select("node", "text", "s1").mapInArrow(work, f"node {kind}, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have ``100 * intersection >= percent * union``."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    good.append(i)
            if good:
                yield batch.select(["a", "b"]).take(pa.array(good))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, chunks: int = 12, hot: int = 2000,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, its own included) and kept, one row per row of ``docs``.

    Null, empty and wordless texts have no set and link with nothing. Rows with a null id keep it as component, are kept
    and link with nothing. Repeated ids are rows of their own text. Other columns are ignored.
    """
    ready(docs.sparkSession)
    rows = stored(summaries(docs, width, chunks, doc_id, text), "minhash-rows")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(
        F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    classes = stored(classes, "minhash-classes")
    filed = classes.select("node", F.col("n_shingles").alias("n"), F.inline(chunk_keys(F.col("sig"), chunks)))
    sizes = filed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = stored(filed.join(sizes, "key").select("key", "chunk", "node", "n", "size"), "minhash-buckets")
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    # the node that shares most keys with others is the most typical of its bucket, and the same in many buckets
    score = buckets.groupBy("node").agg(F.sum("size").alias("score"))
    rated = stored(buckets.join(score, "node"), "minhash-rated")
    tops = rated.groupBy("key").agg(F.max(F.struct("score", F.struct("node", "n").alias("top"))).alias("m")).select("key", "m.top")
    star = rated.join(tops, "key").where(near(F.col("n"), F.col("top.n")) & (F.col("node") != F.col("top.node"))).select(
        F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b")).distinct()
    star = stored(star, "minhash-pairs")
    members = buckets.select("node").distinct()
    sets = stored(_sets(docs, classes.select("node", "s1").join(members, "node", "left_semi"), width, doc_id, text), "minhash-sets")
    links = stored(_confirmed(star, sets, percent), "minhash-links")
    joined = components(links, name="minhash-graph")
    # what is still apart within a bucket
    found = buckets.select("key", "chunk", "node", "n", "size").join(joined, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    apart = found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    left = stored(found.join(apart.select("key"), "key"), "minhash-apart")      # buckets with nodes that are still apart
    left = left.join(classes.select("node", "bits"), "node")
    # sets differ at least in as many elements as their parities do; 80 % leave a ninth of both sizes
    differ = sum((F.bit_count(F.col("xa")[k].bitwiseXOR(F.col("xb")[k])) for k in range(PARITIES // 64)), F.lit(0))
    possible = (F.col("ca") != F.col("cb")) & (differ * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))
    small = left.where(F.col("size") <= hot).select("key", "node", "n", "bits", "component")
    more = small.toDF("key", "a", "na", "xa", "ca").join(small.toDF("key", "b", "nb", "xb", "cb"), "key").where((F.col("a") < F.col("b")) & possible)
    large = left.where(F.col("size") > hot)
    most = large.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(
        F.max_by("component", F.struct("m", "component")).alias("main"))
    parts = F.ceil(F.col("size") / hot).cast("int")
    asking = large.join(most, "key").where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    asked = large.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    asking = asking.select("key", "part", "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("component").alias("ca"))
    asked = asked.select("key", "part", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("component").alias("cb"))
    once = (F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))        # both ask unless one is in the largest component
    wide = asking.join(asked, ["key", "part"]).where(once & possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = more.select("a", "b").unionByName(wide)
    more = more.select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    extra = stored(_confirmed(stored(more, "minhash-more"), sets, percent), "minhash-extra")
    if not extra.isEmpty():
        joined = components(links.unionByName(extra), name="minhash-graph")
    classed = classes.join(joined.withColumnRenamed("component", "component_id"), "node", "left").select(
        "n_shingles", "s1", "s2", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.drop("sig", "bits").join(classed, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one of each group of near duplicates (the one with the smallest id).

    Rows with null ids and texts without words stay. Of rows with equal id and text one stays; of rows with equal ids and
    different texts all stay if any is kept.
    """
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col(doc_id).isNotNull()).join(kept, F.col(doc_id) == F.col("_kept"), "left_semi")
    return named.dropDuplicates([doc_id, text]).unionByName(docs.where(F.col(doc_id).isNull()))
