"""Removal of long repeated byte strings by a distributed sort of suffixes.

A byte goes if it lies in a string of ``span`` bytes that starts at another place too. Every such string holds, at the same
place in all its copies, the anchor that a content-defined choice (the smallest hash of ``gram`` bytes in it, leftmost first)
puts there. So only suffixes at anchors are sorted, and of these only where the anchor's ``gram`` bytes occur again.

1. Anchors of all texts; anchors whose hash is unique are dropped (a count that combines map-side).
2. Anchors with equal surroundings (all strings of ``span`` bytes around them) are one class, however many copies there are.
3. Sorted runs of suffixes, one per task and range, are exchanged front-coded: the length of the prefix shared with the
   suffix before, and the bytes that follow it.
4. Each range is merged by a tree of losers that carries the known common prefixes: two suffixes are compared only from
   the first byte that is not known to be equal.
5. Neighbours with ``gram`` bytes in common form a group, in which strings of ``span`` bytes are held against each
   other. A group of more than ``group_limit`` classes is cut into several ranges and decided by further shuffles, cell by cell.

Ranges are cut at sampled suffixes, so no task gathers the copies of a passage.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored
from .minhash import U, _R, _RI, _powers, mix
from .packing import slices

SPAN, GRAM = 400, 100
CELL = 16
_RNG = np.random.default_rng(11)
_BYTE = _RNG.integers(1, 1 << 63, 256).astype(U)


def _running(b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * _powers(_R, len(b)), out=total[1:])
    return total


def anchors(raws: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, position, hash of the gram, hash of the surroundings) of the anchors of several texts, each text on its own."""
    lens = np.array([len(r) for r in raws], np.int64)
    begin = np.cumsum(lens) - lens
    b = np.frombuffer(b"".join(raws), np.uint8)
    n = len(b) - span + 1
    empty = np.zeros(0, np.int64)
    if n < 1:
        return empty, empty, empty, empty
    total = _running(b)
    inverse = _powers(_RI, len(b) + 1)
    low = mix((total[gram:] - total[:-gram]) * inverse[:len(b) - gram + 1])
    grams, at = low.copy(), np.arange(len(low), dtype=np.int32)
    width, want = 1, span - gram + 1
    while width < want:                                   # leftmost minimum of growing windows
        step = min(width, want - width)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        width += step
    doc = np.repeat(np.arange(len(raws)), np.maximum(lens - span + 1, 0))
    first = np.cumsum(np.maximum(lens - span + 1, 0)) - np.maximum(lens - span + 1, 0)
    window = np.arange(len(doc)) - first[doc] + begin[doc]
    p = at[window].astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    p, doc = p[new], doc[new]
    lo, hi = np.maximum(p - (span - gram), begin[doc]), np.minimum(p + span, begin[doc] + lens[doc])
    around = mix((total[hi] - total[lo]) * inverse[lo] + mix((p - lo).astype(U) * U(1 << 20) + (hi - p).astype(U)))
    return doc, p - begin[doc], grams[p].view(np.int64), around.view(np.int64)


def item_key(raw: bytes, p: int, span: int, gram: int) -> bytes:
    """The suffix at an anchor up to ``span`` bytes, then the bytes before it backwards; bytes that no text holds fill up."""
    side = span - gram
    left = raw[max(0, p - side):p][::-1]
    return raw[p:p + span].ljust(span, b"\xfe") + left.ljust(side, b"\xff")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``; never looks at the known part."""
    low, high = known, min(len(a), len(b))
    step = 8
    while low < high:
        end = min(low + step, high)
        if a[low:end] == b[low:end]:
            low, step = end, step * 4
        elif end - low == 1:
            return low
        else:
            high, step = end, max(1, (end - low) // 2)
    return low


def encode_run(keys: np.ndarray, meta: np.ndarray) -> bytes:
    """Front-code sorted keys (rows of bytes): shared prefixes, their rests, and 64-bit numbers for each."""
    n, width = keys.shape
    shared = np.zeros(n, np.uint16)
    if n > 1:
        differs = keys[1:] != keys[:-1]
        shared[1:] = np.where(differs.any(1), differs.argmax(1), width)
    rest = keys[np.arange(width)[None, :] >= shared[:, None]].tobytes()
    return zstandard.compress(struct.pack("<II", n, width) + shared.tobytes() + np.ascontiguousarray(meta, np.int64).tobytes() + rest, 3)


def decode_run(blob: bytes, columns: int) -> Iterator[tuple[int, bytes, tuple]]:
    """(prefix shared with the key before, key, numbers) in order."""
    raw = zstandard.decompress(blob)
    n, width = struct.unpack_from("<II", raw)
    shared = np.frombuffer(raw, np.uint16, n, 8)
    meta = np.frombuffer(raw, np.int64, n * columns, 8 + 2 * n).reshape(n, columns)
    at, key = 8 + 2 * n + 8 * n * columns, b""
    for h, numbers in zip(shared.tolist(), meta.tolist()):
        end = at + width - h
        key = key[:h] + raw[at:end]
        at = end
        yield h, key, tuple(numbers)


def merge(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge sorted runs with a tree of losers; yields (prefix shared with the key before, key, numbers).

    ``h[i]`` is the prefix that the head of run ``i`` shares with the last key given out. Of two heads the one that shares
    more is smaller; only where both share the same are they compared, from there on.
    """
    k = len(runs)
    heads = [next(r, None) for r in runs]
    h = [0 if x is not None else -1 for x in heads]
    keys = [x[1] if x is not None else b"" for x in heads]
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if h[a] != h[b]:
            return (a, b) if h[a] > h[b] else (b, a)
        if h[a] < 0:
            return a, b
        x, y = keys[a], keys[b]
        m = common(x, y, h[a])
        if m == len(y) or (m < len(x) and x[m] > y[m]):
            if not (m == len(x) and a < b):
                a, b = b, a
        h[b] = m
        return a, b

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not k:
        return
    winner = build(1) if k > 1 else 0
    while h[winner] >= 0:
        yield h[winner], keys[winner], heads[winner][2]
        new = next(runs[winner], None)
        heads[winner] = new
        h[winner], keys[winner] = (new[0], new[1]) if new is not None else (-1, b"")
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def around(keys: list[bytes], span: int, gram: int) -> np.ndarray:
    """The surroundings in reading order, one row each; the anchor is at column ``span - gram``."""
    out = np.empty((len(keys), 2 * span - gram), np.uint8)
    for at in range(0, len(keys), 1000):
        x = np.frombuffer(b"".join(keys[at:at + 1000]), np.uint8).reshape(-1, out.shape[1])
        out[at:at + 1000, :span - gram], out[at:at + 1000, span - gram:] = x[:, span:][:, ::-1], x[:, :span]
    return out


def shared_windows(x: np.ndarray, left: np.ndarray, right: np.ndarray, span: int, gram: int, block: int = 22) -> np.ndarray:
    """flags[row, d]: the string that starts ``d`` bytes before the anchor occurs in another row too, at the same distance.

    Hashes of ``block`` distances are held at a time, so memory is a few hundred bytes a row.
    """
    side = span - gram
    out = np.zeros((len(x), side + 1), bool)
    for at in range(0, side + 1, block):
        d = np.arange(at, min(at + block, side + 1))
        window = np.concatenate([_windows(x[k:k + 1000], d, span, side) for k in range(0, len(x), 1000)])
        valid = (d[None, :] <= left[:, None]) & (span - d[None, :] <= right[:, None])      # others hold filling, so never equal one of these
        order = np.argsort(window, 0, kind="stable")
        ranked = np.take_along_axis(window, order, 0)
        ok = np.take_along_axis(valid, order, 0)
        same = (ranked[1:] == ranked[:-1]) & ok[1:] & ok[:-1]
        flag = np.zeros(window.shape, bool)
        flag[1:] |= same
        flag[:-1] |= same
        part = np.zeros_like(flag)
        np.put_along_axis(part, order, flag, 0)
        out[:, at:at + len(d)] = part
    return out


def _windows(x: np.ndarray, d: np.ndarray, span: int, side: int) -> np.ndarray:
    first = side - int(d[-1])
    part = x[:, first:side - int(d[0]) + span]
    total = np.zeros((len(x), part.shape[1] + 1), U)
    np.cumsum(_BYTE[part] * _powers(_R, part.shape[1])[None, :], 1, out=total[:, 1:])
    return total[:, side - d + span - first] - total[:, side - d - first]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


RESULT = "kg long, xh long, lo int, hi int"


def judge_group(group: list[tuple[bytes, tuple]], span: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(kg, xh, lo, hi): distances from the anchor at which strings of ``span`` bytes start that occur elsewhere."""
    meta = np.array([m for _, m in group], np.int64)
    kg, xh, n, left, right = meta.T
    out = []
    flags = shared_windows(around([k for k, _ in group], span, gram), left, right, span, gram) if len(group) > 1 else None
    for i in range(len(group)):
        if n[i] > 1:
            lo, hi = span - int(right[i]), int(left[i])
            if max(lo, 0) <= hi:
                out.append((int(kg[i]), int(xh[i]), max(lo, 0), hi))
        elif flags is not None:
            out += [(int(kg[i]), int(xh[i]), lo, hi) for lo, hi in ranges(flags[i])]
    return out


def repeated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, text: str = "text", group_limit: int = 40_000) -> DataFrame:
    """digest, text, spans (see ``intervals``) of the distinct texts with strings that occur elsewhere. Null and empty texts, and texts shorter than ``span`` bytes, have none."""
    spark = ready(docs.sparkSession)
    side = span - gram
    raw = F.col(text).cast("string")
    source = docs.select(F.unhex(F.md5(raw.cast("binary"))).alias("digest"), raw.alias("text")).where(
        F.octet_length("text") >= span)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                raws = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                doc, p, kg, xh = anchors(raws, span, gram)
                # a text that repeats itself has many anchors with equal surroundings; they are one row
                order = np.lexsort((p, xh, kg, doc))
                doc, p, kg, xh = doc[order], p[order].astype(np.int32), kg[order], xh[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (kg[1:] != kg[:-1]) | (xh[1:] != xh[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(doc)))
                more = [p[a + 1:a + k].tobytes() if k > 1 else None for a, k in zip(first.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[first])), pa.array(p[first]), pa.array(more, pa.binary()),
                                                  pa.array(kg[first]), pa.array(xh[first])], names=["digest", "p", "more", "kg", "xh"])

    marks = stored(source.mapInArrow(find, "digest binary, p int, more binary, kg long, xh long"), "suffix-anchors")
    number = F.coalesce(F.length("more") / 4, F.lit(0)).cast("int") + 1
    # stored, so that the join reads two plain shuffles, which Spark splits where a gram is hot
    again = stored(marks.groupBy("kg").agg(F.sum(number).alias("n")).where("n > 1").select("kg"), "suffix-grams")
    candidates = stored(marks.join(again, "kg").select("digest", "p", "more", "kg", "xh"), "suffix-candidates")
    classes = candidates.groupBy("kg", "xh").agg(F.sum(number).cast("int").alias("n"), F.min(F.struct("digest", "p")).alias("rep"))
    chosen = classes.groupBy(F.col("rep.digest").alias("digest")).agg(
        F.collect_list(F.struct(F.col("rep.p").alias("p"), "kg", "xh", "n")).alias("items"))       # bounded by a text's length
    once = source.groupBy("digest").agg(F.first("text").alias("text"))
    held = candidates.select("digest").distinct()
    texts = stored(once.join(held, "digest").join(chosen, "digest", "left"), "suffix-texts")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = t.encode("utf-8", "surrogatepass")
                rows += [(item_key(b, i["p"], span, gram), i["kg"], i["xh"], i["n"], min(side, i["p"]), min(span, len(b) - i["p"]))
                         for i in items]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), *[pa.int64()] * 5])],
                                                 names=["key", "kg", "xh", "n", "left", "right"])

    items = stored(texts.where("items is not null").select("text", "items").mapInArrow(
        build, "key binary, kg long, xh long, n long, left long, right long"), "suffix-items")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = items.count()
    # cuts between ranges: about 40 suffixes a range, drawn by hash; only used to balance the tasks
    every = max(1, total // (40 * parts))
    drawn = items.where(F.pmod(F.xxhash64("xh"), F.lit(every)) == 0).select("key").collect()
    sample = sorted(bytes(r["key"]) for r in drawn)
    often = Counter(k[:gram] for k in sample)
    cuts = {sample[len(sample) * k // parts] for k in range(1, parts)} if sample else set()
    # a cut moves to the beginning of its group unless the group is large; only large groups lie in several ranges
    split = {c[:gram] for c in cuts if often[c[:gram]] * every > group_limit // 2}
    cuts = sorted({c if c[:gram] in split else c[:gram] for c in cuts})

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back, count = [], 0

        def flush():
            t = pa.Table.from_batches(held_back).combine_chunks()
            keys = np.array(t.column("key").to_pylist(), dtype=f"S{2 * span - gram}")
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            where = np.searchsorted(keys, np.array(cuts, dtype=keys.dtype), "left") if cuts else np.zeros(0, np.int64)
            meta = np.stack([t.column(c).to_numpy() for c in ("kg", "xh", "n", "left", "right")], 1)[order]
            matrix = keys.view(np.uint8).reshape(len(keys), -1)
            ends = [0, *where.tolist(), len(keys)]
            rows = [(k, encode_run(matrix[a:b], meta[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                              names=["part", "run"])

        for batch in batches:
            if batch.num_rows:
                held_back.append(batch)
                count += batch.num_rows
            if count >= 12_000:                      # a run holds about 8 MB
                yield flush()
                held_back, count = [], 0
        if held_back:
            yield flush()

    runs = items.mapInArrow(sort_runs, "part int, run binary")

    def merge_range(pdf):
        import pandas as pd
        out, rest, group, large = [], [], [], False

        def finish():
            if group and (large or group[0][0][:gram] in split):
                rest.extend({m[0] for _, m in group})
            elif group:
                out.extend(judge_group(group, span, gram))

        for shared, key, numbers in merge([decode_run(bytes(b), 5) for b in pdf["run"]]):
            if shared < gram and group:
                finish()
                group, large = [], False
            if len(group) >= group_limit:            # decided by shuffles; a few members name its hashes
                large = True
                if any(numbers[0] == m[0] for _, m in group[:4]):
                    continue
            group.append((key, numbers))
        finish()
        out += [(kg, 0, -1, -1) for kg in set(rest)]                      # left open
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 4), columns=["kg", "xh", "lo", "hi"])

    merged = stored(runs.groupBy("part").applyInPandas(merge_range, RESULT), "suffix-merged")
    open_groups = stored(merged.where("lo < 0").select("kg").distinct(), "suffix-open")      # few: each holds thousands of classes
    found = merged.where("lo >= 0").join(open_groups, "kg", "left_anti")
    if not open_groups.isEmpty():
        found = found.unionByName(_by_cells(items.join(open_groups, "kg"), span, gram))
    found = stored(found.select("kg", "xh", "lo", "hi"), "suffix-found")
    hits = candidates.join(found, ["kg", "xh"]).select("digest", "p", "more", "lo", "hi").distinct()
    spans = hits.groupBy("digest").agg(F.collect_list(F.struct("p", "more", "lo", "hi")).alias("spans"))   # bounded by a text's length
    return texts.select("digest", "text").join(spans, "digest")


def _by_cells(items: DataFrame, span: int, gram: int) -> DataFrame:
    """Groups that no single range decides: strings are compared by hash in shuffles, first whole cells of distances.

    A cell of ``CELL`` neighbouring strings is looked into only if what they all share occurs elsewhere and the cell as a
    whole does not; equal cells are one row from the first map-side combine on. Counts are stored before they are joined:
    a cell within a common passage is one key for all its classes, and Spark splits such a key only between plain shuffles.
    """
    side = span - gram
    starts = list(range(0, side + 1, CELL))

    def hashes(total: np.ndarray, a: int, b: int) -> np.ndarray:
        return mix(total[:, b] - total[:, a]).view(np.int64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                x = around([bytes(k) for k in batch.column(0).to_pylist()], span, gram)
                kg, xh, n, left, right = (batch.column(i).to_numpy() for i in range(1, 6))
                total = np.zeros((len(x), x.shape[1] + 1), U)
                np.cumsum(_BYTE[x] * _powers(_R, x.shape[1])[None, :], 1, out=total[:, 1:])
                cols = []
                for c in starts:
                    last = min(c + CELL - 1, side)
                    lo, hi = np.maximum(c, span - right), np.minimum(last, left)      # strings inside the text
                    cols.append((kg, xh, n, np.full(len(x), c), lo, hi, hashes(total, side - c, side - last + span),
                                 mix(hashes(total, side - last, side - c + span).view(U) + (lo * 1000 + hi + 1).astype(U)).view(np.int64)))
                arrays = [np.concatenate([np.asarray(c[k], np.int64) for c in cols]) for k in range(8)]
                keep = arrays[4] <= arrays[5]
                windows = np.concatenate([np.stack([hashes(total, side - min(d, side), side - min(d, side) + span)
                                                    for d in range(c, c + CELL)], 1) for c in starts])[keep]
                names = ["kg", "xh", "n", "cell", "lo", "hi", "core", "whole"]
                yield pa.RecordBatch.from_arrays([*[pa.array(a[keep]) for a in arrays], pa.FixedSizeListArray.from_arrays(
                    pa.array(windows.ravel()), CELL).cast(pa.list_(pa.int64()))], names=[*names, "windows"])

    cells = items.select("key", "kg", "xh", "n", "left", "right").mapInArrow(
        expand, "kg long, xh long, n long, cell long, lo long, hi long, core long, whole long, windows array<long>")
    cells = stored(cells, "suffix-cells")
    kinds = stored(cells.groupBy("kg", "cell", "core", "whole").agg(
        F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("windows").alias("windows")), "suffix-kinds")
    cores = stored(kinds.groupBy("kg", "cell", "core").agg(F.sum("n").alias("all")).where("all > 1"), "suffix-cores")
    kinds = stored(kinds.join(cores, ["kg", "cell", "core"]), "suffix-cell-kinds")
    d = F.posexplode("windows").alias("k", "w")
    single = kinds.select("kg", "cell", "core", "whole", "n", "lo", "hi", d).withColumn("d", F.col("cell") + F.col("k")).where("d between lo and hi")
    twice = stored(single.groupBy("kg", "d", "w").agg(F.sum("n").alias("m")).where("m > 1").select("kg", "d", "w"), "suffix-windows")
    # the strings of a cell as bits, so a class joins one row a cell
    good = stored(single.join(twice, ["kg", "d", "w"]).groupBy("kg", "cell", "core", "whole").agg(
        F.sum(F.expr("shiftleft(1L, k)")).alias("bits")), "suffix-cell-bits")
    marked = cells.select("kg", "xh", "cell", "core", "whole").join(good, ["kg", "cell", "core", "whole"]).select("kg", "xh", "cell", "bits")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kg, xh, cell, bits in zip(*(c.to_pylist() for c in batch.columns)):
                flags = np.array([bits >> k & 1 for k in range(CELL)])
                out += [(kg, xh, cell + lo, cell + hi) for lo, hi in ranges(flags)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                                 names=["kg", "xh", "lo", "hi"])

    return marked.mapInArrow(runs, RESULT)


def intervals(spans: list[dict], span: int) -> list[tuple[int, int]]:
    """(start, end) of the strings that a row of anchors and distances stands for."""
    out = []
    for s in spans:
        out += [(p - s["hi"], p - s["lo"] + span) for p in [s["p"], *np.frombuffer(s["more"] or b"", np.int32).tolist()]]
    return out


def keep_bytes(raw: bytes, spans: list[tuple[int, int]], whole_characters: bool = False) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs). With ``whole_characters`` a run gives up parts of characters."""
    gone = np.zeros(len(raw) + 1, np.int32)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    mask = np.cumsum(gone)[:-1] > 0
    b = np.frombuffer(raw, np.uint8)
    if whole_characters:
        lead = np.flatnonzero((b & 0xC0) != 0x80)
        if len(lead):
            mask = np.repeat(np.minimum.reduceat(mask, lead), np.diff(np.append(lead, len(b))))
    runs = int(mask[:1].sum() + ((mask[1:] == 1) & (mask[:-1] == 0)).sum()) if len(mask) else 0
    return b[~mask].tobytes(), int(mask.sum()), runs


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per row of ``docs``. A null text is empty. Ids are only
    carried: nulls and repeats are rows of their own. Other columns are ignored."""
    found = repeated(docs, text=text, **options)
    span = options.get("span", SPAN)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                kept, removed, runs = keep_bytes(t.encode("utf-8", "surrogatepass"), intervals(spans, span))
                rows.append((digest, removed, runs, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "n_removed", "n_spans", "sha"])

    changed = found.select("digest", "text", "spans").mapInArrow(cut, "digest binary, n_removed long, n_spans long, sha string")
    raw = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw")).select(
        "doc_id", F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("own"), F.unhex(F.md5("raw")).alias("digest"))
    return rows.join(changed, "digest", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def remove(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The documents, all columns, without the bytes that are repeated; characters are removed whole or kept whole."""
    found = repeated(docs, text=text, **options)
    span = options.get("span", SPAN)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                kept, _, _ = keep_bytes(t.encode("utf-8", "surrogatepass"), intervals(spans, span), True)
                rows.append((digest, kept.decode("utf-8", "replace")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.string()))],
                                                 names=["_digest", "_new"])

    changed = found.select("digest", "text", "spans").mapInArrow(cut, "_digest binary, _new string")
    keyed = docs.withColumn("_digest", F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))))
    out = keyed.join(changed, "_digest", "left").withColumn(text, F.coalesce("_new", text))
    if n_chars:
        out = out.withColumn(n_chars, F.when(F.col("_new").isNotNull(), F.length("_new").cast("long")).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)
