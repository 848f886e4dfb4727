"""Packing token sequences into windows of a fixed size with non-negative least squares on the length histogram.

Whole windows are cut off first; what is left of a document is shorter than a window. The histogram of these
rests (at most ``size - 1`` numbers, whatever the corpus size) is matched by few shallow combinations of lengths
that fill a window exactly: the repeat counts solve ``min |A x - b|, x >= 0``, are rounded and limited to
what is there. Rests that no combination takes are packed greedily, longest first, cut where a window ends.
The last window would need padding; it is cut into powers of two instead, which need none.

Only the histogram reaches the driver. Documents find their place by their rank within their length.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

CACHE_WORDS = 600_000
_ENCODERS: dict = {}


class WordEncoder:
    """Encodes pieces between ASCII white space, each distinct one once, and keeps up to ``limit`` of them.

    Valid for tokenizers that normalise to NFC, fold case, drop white space and never join letters with the punctuation behind
    them: pieces that differ in case or in the punctuation at their end share a stem. Stems of lower-case letters skip
    normalisation; everything else goes through the whole tokenizer as it stands.
    """

    TAIL = ".,;:!?#$%&*"

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers
        self.full, self.letters, self.limit = Tokenizer.from_file(path), Tokenizer.from_file(path), limit
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        bar = self.letters.encode(["|"], is_pretokenized=True, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None                # letters never give its id
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.type = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")

    def fresh(self, stems: list[str]) -> dict[str, bytes]:
        out, wide = {}, self.type.itemsize
        plain = [w for w in stems if w.isalpha() and w.islower()] if self.bar is not None else []
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            barred = list(itertools.chain.from_iterable(zip(part, itertools.repeat("|"))))    # a bar behind each stem
            ids = np.asarray(self.letters.encode_batch_fast([barred], is_pretokenized=True, add_special_tokens=False)[0].ids, self.type)
            bars = np.flatnonzero(ids == self.bar)
            raw, ends = ids.tobytes(), (bars * wide).tolist()
            out.update(zip(part, map(lambda a, b: raw[a:b], [0, *[e + wide for e in ends]], ends)))
        rest = [w for w in stems if w not in out]
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            for w, e in zip(part, self.full.encode_batch_fast(part, add_special_tokens=False)):
                out[w] = np.asarray(e.ids, self.type).tobytes()
        return out

    def parts(self, word: str) -> tuple[str, str]:
        """(stem, punctuation behind it), or the piece as it is."""
        if not word.isascii() and ("\u03a3" in word or not unicodedata.is_normalized("NFC", word)):
            return word, ""
        low = word.lower()
        stem = low.rstrip(self.TAIL)
        return (stem, low[len(stem):]) if stem.isalpha() and stem.islower() else (word, "")

    def lookup(self, distinct: list[str]) -> list[bytes]:
        got = list(map(self.words.get, distinct))
        missing = [i for i, v in enumerate(got) if v is None]
        if missing:
            new = [distinct[i] for i in missing]
            cut = [self.parts(w) for w in new]
            found = self.fresh(list({x for pair in cut for x in pair if x and x not in self.stems}))
            found.update({x: self.stems[x] for pair in cut for x in pair if x in self.stems})
            made = [found[a] + found[b] if b else found[a] if a else b"" for a, b in cut]
            for i, v in zip(missing, made):
                got[i] = v
            if len(self.stems) < self.limit * 2 // 3:
                self.stems.update(found)
            if len(self.words) < self.limit:
                self.words.update(zip(new, made))
        return got

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """(ids of each text with ``end_id`` behind as bytes, their numbers). Words are split and numbered by Arrow."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_doc = np.diff(split.offsets.to_numpy()).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        known = self.lookup(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.type.itemsize
        flat = np.frombuffer(b"".join(known), self.type)
        # a further entry for the end id, put behind the last word of each text
        start = np.concatenate([np.cumsum(size) - size, [len(flat)]])
        flat, size = np.concatenate([flat, np.asarray([end_id], self.type)]), np.concatenate([size, [1]])
        which = np.insert(which, np.cumsum(per_doc), len(known))
        n = size[which]
        upto = np.cumsum(n)
        tokens = flat[np.repeat(start[which] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[np.cumsum(per_doc + 1) - 1] if len(per_doc) else upto
        offsets = np.concatenate([[0], ends]) * self.type.itemsize
        ids = pa.Array.from_buffers(pa.large_binary(), len(per_doc), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(tokens)])
        return ids.cast(pa.binary()), np.diff(np.concatenate([[0], ends]))


def encoder(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, kept for the life of the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``limit`` bytes, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def combinations(size: int) -> np.ndarray:
    """Shallow ways to fill a window: all pairs, and per length the triples whose other two are (nearly) equal or halve.

    Rows of three lengths, 0 where only two are used; about 2.5 times ``size`` rows.
    """
    a = np.arange(1, size // 2 + 1)
    pairs = np.stack([a, size - a, 0 * a], 1)
    a = np.arange(1, size - 1)
    half = (size - a) // 2
    even = np.stack([a, half, size - a - half], 1)
    third = (size - a) // 3
    uneven = np.stack([a, third, size - a - third], 1)
    rows = np.sort(np.concatenate([pairs, even, uneven[third > 0]]), 1)[:, ::-1]
    return np.unique(rows[(rows[:, 1] > 0)], axis=0)


def solve(histogram: np.ndarray, size: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, repeats): non-negative least squares by accelerated projected gradient, rounded within the stock."""
    sets = combinations(size)
    b = histogram.astype(np.float64)
    real = (sets > 0) & (b[sets] > 0)
    sets = sets[(real | (sets == 0)).all(1)]
    if not len(sets):
        return sets, np.zeros(0, np.int64)

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(sets[:, k], x, len(b)) for k in range(3))
        out[0] = 0
        return out

    uses = forward(np.ones(len(sets)))
    step = 1.0 / max(3.0 * uses.max(), 1.0)
    x = momentum = np.zeros(len(sets))
    t = 1.0
    for _ in range(steps):
        off = forward(momentum) - b
        off[0] = 0
        new = np.maximum(momentum - step * off[sets].sum(1), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    left = histogram.astype(np.int64).copy()
    repeats = np.zeros(len(sets), np.int64)
    for i in np.argsort(-x, kind="stable"):
        want = int(np.rint(x[i]))
        if not want:
            break
        lengths, need = np.unique(sets[i][sets[i] > 0], return_counts=True)
        repeats[i] = max(0, min(want, int((left[lengths] // need).min())))
        left[lengths] -= repeats[i] * need
    return sets[repeats > 0], repeats[repeats > 0]


def layout(histogram: np.ndarray, size: int, first: int) -> dict[str, np.ndarray]:
    """Where the r-th rest of each length goes, as ranges of ranks: sequence id, offset; the others by position."""
    sets, repeats = solve(histogram, size)
    taken = np.zeros(size + 1, np.int64)
    length, start, base, offset = [], [], [], []
    sequence = first
    for row, n in zip(sets, repeats):
        at = 0
        for v in row[row > 0]:
            length.append(v), start.append(taken[v]), base.append(sequence), offset.append(at)
            taken[v] += n
            at += v
        sequence += n
    left = histogram - taken[:len(histogram)]
    tokens = left * np.arange(len(left))
    before = np.concatenate([np.cumsum(tokens[::-1])[::-1][1:], [0]])   # tokens of longer rests left over
    total = int(tokens.sum())
    ends = list(range(size, total + 1, size))
    rest = total % size
    for power in range(size.bit_length() - 1, -1, -1):
        if rest >> power & 1:
            ends.append((ends[-1] if ends else 0) + (1 << power))
    order = np.lexsort((start, length)) if length else np.zeros(0, int)
    pick = lambda v: np.asarray(v, np.int64)[order]
    return {"length": pick(length), "start": pick(start), "base": pick(base), "offset": pick(offset), "taken": taken,
            "before": before, "full": np.int64(total // size), "tail": np.asarray(ends[total // size:], np.int64),
            "residual": np.int64(sequence)}


def place(plan: dict[str, np.ndarray], size: int, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of one rest."""
    if not length:
        return []
    if rank < plan["taken"][length]:
        key = np.searchsorted(plan["length"], length), np.searchsorted(plan["length"], length, "right")
        i = key[0] + np.searchsorted(plan["start"][key[0]:key[1]], rank, "right") - 1
        return [(0, length, int(plan["base"][i] + rank - plan["start"][i]), int(plan["offset"][i]))]
    at = int(plan["before"][length] + (rank - plan["taken"][length]) * length)
    out, done, full = [], 0, int(plan["full"])
    while done < length:
        here = at + done
        if here < full * size:
            number, begin, end = here // size, here // size * size, here // size * size + size
        else:
            i = int(np.searchsorted(plan["tail"], here, "right"))
            number, end = full + i, int(plan["tail"][i])
            begin = int(plan["tail"][i - 1]) if i else full * size
        n = min(length - done, end - here)
        out.append((done, n, int(plan["residual"]) + number, here - begin))
        done += n
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Ids may be null or repeat: rows are told apart by position. An empty
    table gives none. Very long texts are cut into whole windows and a rest. Other columns are ignored.
    """
    spark = ready(docs.sparkSession, 1500)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1):
                ids, n = encoder(tokenizer)(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), part.column(0), ids, pa.array(n, pa.int64())],
                                                 names=["row", "doc_id", "ids", "n"])
                row += len(n)

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    tokens = stored(source.mapInArrow(encode, f"row long, doc_id {kind}, ids binary, n long"), "pack-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lens = tokens.select("row", (F.col("n") % size).cast("int").alias("rest"), F.floor(F.col("n") / size).alias("full"))
    ordered = lens.repartitionByRange(parts, "rest", "row").sortWithinPartitions("rest", "row")
    # rank in the sorted order and whole windows before, counted inside each range partition
    ranked = stored(ordered.mapInPandas(_count, "row long, rest int, full long, part int, pos long, windows long"), "pack-order")
    sizes = sorted(ranked.groupBy("part").agg(F.count("*"), F.sum("full")).collect())    # one row per range partition
    rows_before, windows_before, rows, windows = {}, {}, 0, 0
    for part, n, full in sizes:
        rows_before[part], windows_before[part] = rows, windows
        rows, windows = rows + n, windows + full
    histogram = np.zeros(size, np.int64)
    for rest, n in ranked.groupBy("rest").count().collect():                              # at most ``size`` rows
        histogram[rest] = n
    first = np.concatenate([[0], np.cumsum(histogram)])[:-1]                               # rank where a length begins
    solved = histogram.copy()
    solved[0] = 0
    plan = layout(solved, size, windows)

    def assign(frames):
        import pandas as pd
        for pdf in frames:
            if not len(pdf):
                continue
            rank = pdf["part"].map(rows_before).to_numpy() + pdf["pos"].to_numpy() - first[pdf["rest"].to_numpy()]
            window = pdf["part"].map(windows_before).to_numpy() + pdf["windows"].to_numpy()
            spots = [place(plan, size, int(v), int(r)) for v, r in zip(pdf["rest"].to_numpy(), rank)]
            yield pd.DataFrame({"row": pdf["row"], "window": window, "spots": [[list(s) for s in v] for v in spots]})

    spots = ranked.mapInPandas(assign, "row long, window long, spots array<array<long>>")
    both = tokens.join(spots, "row").select("doc_id", "ids", "n", "window", "spots")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, ids, n, window, where in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                whole = n // size
                pieces = [(k * size, size, window + k, 0) for k in range(whole)]
                pieces += [(whole * size + s, m, q, o) for s, m, q, o in where]
                out += [(doc, s, m, v[s:s + m].tobytes(), n, q, o) for s, m, q, o in pieces]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return both.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
                                "sequence_id long, offset long")


def _count(frames):
    from pyspark import TaskContext
    part, pos, windows = TaskContext.get().partitionId(), 0, 0
    for pdf in frames:
        n = len(pdf)
        total = pdf["full"].cumsum()
        yield pdf.assign(part=np.int32(part), pos=np.arange(pos, pos + n), windows=windows + total - pdf["full"])
        pos += n
        windows += int(total.iloc[-1]) if n else 0

