"""Sampled segmentation into the pieces of a SentencePiece model, and lossless decoding.

All segmentations of a text form a lattice. Forward filtering sums the weights of the ways to reach each position, backward
sampling then draws the last piece, the one before it and so on, each with its exact probability. The draws are
hashes of a seed, the key of the row and the position, so a row gets the same segmentation wherever and however often it is
encoded. The vocabulary comes from a merge model, which has ranks and no probabilities: a piece of rank r weighs
``(2 + r) ** -alpha``. Characters without a piece fall back to byte pieces.

No piece of a word crosses the space before it, so the lattice of a text falls apart into those of its words. These are
built once for each distinct word, and the draws for all words of a batch are made together, one piece a step.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .packing import slices

U = np.uint64
MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_SAMPLERS: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sampler:
    """Lattices of distinct words as flat tables. State = (word, position); each state lists the pieces that may end there with
    running probabilities, the state before, and the piece."""

    def __init__(self, path: str, alpha: float = 0.5, seed: int = 1, limit: int = 500_000):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.alpha, self.seed, self.limit, self.size = alpha, seed, limit, size
        self.weight, self.id, self.bytes = {}, {}, [b""] * size
        self.byte = [0] * 256
        for i in range(size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) and "\n" not in piece \
                    and (MARK not in piece[1:] or not piece.strip(MARK)):
                rank = min(-m.get_score(i), size)
                self.id[piece] = i
                self.weight[piece] = (2.0 + rank) ** -alpha
                self.bytes[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.id))
        # every beginning of a piece, with (weight, id) where it is one
        self.begin = {piece[:k]: None for piece in self.id for k in range(1, len(piece))}
        self.begin.update({piece: (self.weight[piece], i) for piece, i in self.id.items()})
        self.single = {piece for piece in self.id if len(piece) == 1}
        nodes = {"": 0, **{piece: k for k, piece in enumerate(sorted(self.begin), 1)}}
        self.node_piece = np.full(len(nodes), -1, np.int64)
        self.piece_weight = np.zeros(size)
        for piece, i in self.id.items():
            self.node_piece[nodes[piece]], self.piece_weight[i] = i, self.weight[piece]
        steps = sorted((nodes[piece[:-1]] << 21 | ord(piece[-1]), k) for piece, k in nodes.items() if piece)
        self.tree, self.tree_node = (np.array(v, np.int64) for v in zip(*steps))
        self.spans = {pair for piece in self.id for pair in zip(piece, piece[1:])}
        self.low = (2.0 + size) ** -alpha
        self.spelt = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spelt_size = np.fromiter(map(len, self.bytes), np.int64, size)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}              # part of a word -> its last state
        self.first = array("i", [0])       # per state: where its choices begin
        self.back, self.cum, self.piece = array("i"), array("d"), array("i")
        self.forget_words()

    def forget_words(self) -> None:
        self.word: dict = {}               # word -> number; its parts with their last states and ends within the word
        self.part_at, self.part_state, self.part_end = array("i", [0]), array("i"), array("i")

    def forget(self) -> None:
        """Drop the latest third of the lattices; frequent ones came early, and states are numbered as they come."""
        while len(self.known) > self.limit * 2 // 3:
            self.known.popitem()
        states = next(reversed(self.known.values())) + 1
        choices = self.first[states] if states < len(self.first) else len(self.cum)
        del self.first[states:], self.cum[choices:], self.back[choices:], self.piece[choices:]
        self.forget_words()

    def learn(self, words: list) -> None:
        """Number new words. Where no piece spans two neighbouring characters, the lattices on both sides are independent."""
        known, spans, cut = self.known, self.spans, []
        for word in words:
            inner = word[1:]
            if isinstance(word, bytes) or inner.isascii() and inner.isalpha():      # letters are mostly spanned
                ends = [len(word)]
            else:
                ends = [*[i for i, pair in enumerate(zip(word, inner), 1) if pair not in spans], len(word)]
            cut.append((ends, [word] if len(ends) == 1 else [word[a:b] for a, b in zip([0, *ends], ends)]))
        self.add_all(list(dict.fromkeys(p for _, parts in cut for p in parts if p not in known)))
        for word, (ends, parts) in zip(words, cut):
            self.part_state.extend([known[p] for p in parts])
            self.part_end.extend(ends)
            self.part_at.append(len(self.part_state))
            self.word[word] = len(self.word)

    def add_all(self, parts: list) -> None:
        """Build the lattices of many short parts together; long ones and those with byte pieces one by one."""
        plain = [p for p in parts if isinstance(p, str) and len(p) <= 40 and not (set(p) - self.single)]
        some = set(plain)
        for p in parts:
            if p not in some:
                self.add(p)
        if not plain:
            return
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        code = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.int64)
        word_at = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(plain)), size)
        stop = (word_at + size)[owner]
        # all pieces at all places: walk down the tree of beginnings from every character at once
        at = np.arange(len(code))
        node, depth, found = np.zeros(len(code), np.int64), 0, []
        while len(at):
            key = node << 21 | code[at + depth]
            child = np.searchsorted(self.tree, key)
            hit = (child < len(self.tree)) & (self.tree[np.minimum(child, len(self.tree) - 1)] == key)
            at, node, depth = at[hit], self.tree_node[child[hit]], depth + 1
            whole = self.node_piece[node] >= 0
            found.append((at[whole], np.full(int(whole.sum()), depth), self.node_piece[node[whole]]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        begin, span, piece = (np.concatenate(v) for v in zip(*found))
        last = begin + span - 1                                     # a state stands behind each character
        order = np.lexsort((begin, last))
        begin, last, piece = begin[order], last[order], piece[order]
        weight = self.piece_weight[piece]
        new = np.concatenate([[True], last[1:] != last[:-1]])
        first = np.flatnonzero(new)                                 # every character ends a piece, itself
        level = (np.arange(len(code)) - word_at[owner])[last]
        reach, ways = np.zeros(len(code)), np.zeros(len(last))
        inside = begin > word_at[owner[begin]]
        by_level = np.argsort(level, kind="stable")
        for part in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
            ways[part] = weight[part] * np.where(inside[part], reach[begin[part] - 1], 1.0)
            edge = np.flatnonzero(np.concatenate([[True], last[part][1:] != last[part][:-1]]))
            reach[last[part][edge]] = np.add.reduceat(ways[part], edge)
        total = np.cumsum(ways / reach[last])
        group = np.cumsum(new) - 1
        before_group = np.concatenate([[0.0], total])[first]
        cum = total - before_group[group]
        cum[np.append(first[1:], len(cum)) - 1] = 1.0
        states, choices = len(self.first), len(self.cum)
        self.first.frombytes((first + choices).astype(np.int32).tobytes())
        self.cum.frombytes(cum.tobytes())
        self.piece.frombytes(piece.astype(np.int32).tobytes())
        self.back.frombytes(np.where(inside, begin - 1 + states, 0).astype(np.int32).tobytes())
        for p, s, n in zip(plain, (word_at + states).tolist(), size.tolist()):
            self.known[p] = s + n - 1

    def add(self, word: str | bytes) -> int:
        """Build the lattice of a word; returns its last state. State 0 ends every walk."""
        if isinstance(word, bytes):        # fixed bytes
            state = 0
            for b in word:
                state = self._state(state, self.byte[b])
            self.known[word] = state
            return state
        n, get = len(word), self.begin.get
        ends: list[list] = [[] for _ in range(n + 1)]
        state, reach = 0, 1.0
        first, cum, back, piece, single = self.first, self.cum, self.back, self.piece, self.id
        for i in range(n):
            for k in range(i + 1, n + 1):
                found = get(word[i:k], 0)
                if found:
                    ends[k].append((reach * found[0], state, found[1]))
                elif found == 0:
                    break
            own = ends[i + 1]
            if word[i] not in single:                      # byte pieces, one after the other
                raw = word[i].replace(MARK, " ").encode()
                for b in raw[:-1]:
                    state = self._state(state, self.byte[b])
                own.append((reach * self.low ** len(raw), state, self.byte[raw[-1]]))
            if len(own) == 1:
                reach, s, p = own[0]
                state = self._state(s, p)
            else:
                reach = 0.0
                for c in own:
                    reach += c[0]
                scale, upto = 1.0 / reach, 0.0
                first.append(len(cum))
                for c, s, p in own:
                    upto += c * scale
                    cum.append(upto)
                    back.append(s)
                    piece.append(p)
                cum[-1] = 1.0
                state = len(first) - 1
            if reach < 1e-200:                             # only ratios matter: long words are scaled
                reach *= 1e200
                for later in ends[i + 2:i + 1 + self.longest]:
                    later[:] = [(c * 1e200, s, p) for c, s, p in later]
        self.known[word] = state
        return state

    def _state(self, before: int, piece: int) -> int:
        """A state that one piece ends."""
        self.first.append(len(self.cum))
        self.cum.append(1.0)
        self.back.append(before)
        self.piece.append(piece)
        return len(self.first) - 1

    def words(self, text: str) -> list:
        """Words of a text with the space mark before them; a mark that stands in the text itself is bytes."""
        if not text:
            return []
        if MARK not in text:
            return SEGMENT.findall(MARK + text.replace(" ", MARK))
        out = []
        for k, part in enumerate(text.split(MARK)):
            out += [MARK.encode()] * (k > 0)
            out += SEGMENT.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
        return out

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, their number in each text). ``keys``: 64-bit hashes of the row keys."""
        if len(self.known) > self.limit:
            self.forget()
        if len(self.word) > self.limit:
            self.forget_words()
        split = [self.words(t) for t in texts]
        flat = [w for own in split for w in own]
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        numbers = list(map(self.word.get, flat))
        missing = [i for i, v in enumerate(numbers) if v is None]
        if missing:
            new = [flat[i] for i in missing]
            self.learn(list(dict.fromkeys(new)))
            for i, v in zip(missing, map(self.word.get, new)):
                numbers[i] = v
        first, back, cum, piece, part_at, part_state, part_end = (np.frombuffer(v, t) for v, t in (
            (self.first, np.int32), (self.back, np.int32), (self.cum, np.float64), (self.piece, np.int32),
            (self.part_at, np.int32), (self.part_state, np.int32), (self.part_end, np.int32)))
        which = np.array(numbers, np.int64)
        per = np.fromiter(map(len, split), np.int64, len(split))
        word_row = np.repeat(np.arange(len(split)), per)
        length = np.fromiter(map(len, flat), np.int64, len(flat))
        upto = np.cumsum(length)
        start = (upto - length) - np.concatenate([[0], upto])[np.cumsum(per) - per][word_row]     # of the word within its text
        parts = part_at[which + 1] - part_at[which]
        at = np.repeat(part_at[which] - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
        row = np.repeat(word_row, parts)
        end = np.repeat(start, parts) + part_end[at]
        state = part_state[at]
        base = _mix(keys.astype(np.int64).view(U) ^ U(self.seed * 0x9E3779B97F4A7C15 % (1 << 64)))[row]
        steps = np.zeros(len(row), np.int64)
        who, drawn, k = np.arange(len(row)), [], 0
        while len(who):
            s = state[who]
            u = (_mix(base[who] + ((end[who] << 20) + k).astype(U) * U(0xD6E8FEB86659FD93)) >> U(11)).astype(np.float64) * 2.0 ** -53
            at = first[s]
            late = np.flatnonzero(cum[at] <= u)
            while len(late):
                at[late] += 1
                late = late[cum[at[late]] <= u[late]]
            drawn.append((who, piece[at]))
            state[who] = back[at]
            steps[who] += 1
            who = who[back[at] > 0]
            k += 1
        finish = np.cumsum(steps)
        ids = np.zeros(int(finish[-1]) if len(finish) else 0, np.int32)
        for k, (who, p) in enumerate(drawn):
            ids[finish[who] - 1 - k] = p
        counts = np.bincount(row, steps, len(split)).astype(np.int64)
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of the texts."""
        size = self.spelt_size[ids]
        upto = np.cumsum(size)
        raw = self.spelt[np.repeat(self.spelt_at[ids] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = np.concatenate([[0], upto])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return [raw[a + 1:b] if b > a else b"" for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def sampler(path: str, alpha: float, seed: int) -> Sampler:
    key = (path, alpha, seed)
    if key not in _SAMPLERS:
        _SAMPLERS[key] = Sampler(path, alpha, seed)
    return _SAMPLERS[key]


def encode(docs: DataFrame, model: str, alpha: float = 0.5, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian 32 bit), n_pieces, lossless (decoding gives the text back); one row per row of ``docs``.

    Null and empty texts have no pieces. Rows with equal ids draw alike; null ids share a key. One pass, no shuffle, whole
    texts. Other columns are ignored.
    """
    ready(docs.sparkSession, 1200)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(doc_id).alias("key"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model, alpha, seed)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                texts = part.column(1).to_pylist()
                ids, counts = s.encode(texts, part.column(2).to_numpy())
                same = [a == (b or "").encode() for a, b in zip(s.decode(ids, counts), texts)]
                offsets = np.concatenate([[0], np.cumsum(counts)]) * 4
                raw = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), raw.cast(pa.binary()), pa.array(counts), pa.array(same, pa.bool_())],
                                                 names=["doc_id", "ids", "n_pieces", "lossless"])

    return source.mapInArrow(work, f"doc_id {kind}, ids binary, n_pieces long, lossless boolean")


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``text`` from the ids of ``encode``, all other columns kept; null ids give null."""
    ready(rows.sparkSession)

    @F.pandas_udf("string")
    def spell(values):
        import pandas as pd
        s = sampler(model, 0.5, 1)
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            x = np.frombuffer(v, np.int32)
            out.append(s.decode(x, np.array([len(x)]))[0].decode())
        return pd.Series(out, dtype=object)

    return rows.withColumn("text", spell(F.col(ids)))
