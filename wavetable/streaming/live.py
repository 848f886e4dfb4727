"""Incremental work: new items as they arrive, the review state, and windows over live series."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import BLOCK_FRAMES
from ..operators.curation import apply_decisions


def stream_table(spark: SparkSession, path: str, schema, *, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


# ---------------------------------------------------------------- watch


def watch(items: DataFrame, work: Callable[[DataFrame], DataFrame], *, done: str, failed: str, checkpoint: str,
          key: str = "series_id", poll: str | None = None, attempts: int = 5, wait_seconds: float = 0.0, splits: int = 200):
    """Process every new item. ``work`` returns one row per item with a nullable ``error``.

    Finished rows go below ``done``, failed ones below ``failed``, in a folder per batch that a replayed batch overwrites.
    If ``work`` raises, the items go back and are tried apart from new ones with the next batch, halved until what raises
    stands alone, so the other items are done; after ``splits`` exceptions the parts that are left go back and are divided otherwise in
    the batch after. So a fault that passes costs one call, and an item that always raises delays those it came with
    by one batch. A failed item stays pending below ``failed``-items with the number of its attempts and the time it is due again, ``wait_seconds`` after the first attempt
    and twice as long after each further one; at ``attempts`` it is given up and goes below ``failed``-given-up. Items are
    tried with the next batch that runs when they are due. A key that came before is not taken again; the stream keeps the
    keys it has seen in its state, so no earlier batch is read. ``poll`` sets the interval; without it the query takes what is
    there and stops. Returns the running query.
    """
    spark = items.sparkSession
    waiting, given_up = f"{failed.rstrip('/')}-items", f"{failed.rstrip('/')}-given-up"

    def step(batch: DataFrame, batch_id: int) -> None:
        now = time.time()
        names = batch.columns
        left = _left_over(spark, waiting, batch_id)
        pending = batch.withColumns({"_tries": F.lit(0), "_due": F.lit(0.0), "_apart": F.lit(False)})
        pending = (pending if left is None else pending.unionByName(left)).persist()
        outs: list[DataFrame] = []
        try:
            ready = pending.where(F.col("_due") <= now)
            lone, whole = [], []
            for apart in (True, False):
                part = ready.where(F.col("_apart") == apart).select(*names)
                if not (apart and part.isEmpty()):
                    for kept, more in zip((outs, lone, whole), _isolate(part, work, key, batch_id, splits if apart else 0)):
                        kept += more
            bad = [o.where(F.col("error").isNotNull()) for o in outs]
            if outs:
                _union(outs).where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{done}/batch={batch_id}")
            told = _union([*bad, *lone, *whole]) if bad or lone or whole else ready.select(key, F.lit(None).cast("string").alias("error")).limit(0)
            told.write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
            counted = _union([b.select(key, "error") for b in [*bad, *lone]]) if bad or lone else told.select(key, "error").limit(0)
            counted = counted.groupBy(key).agg(F.max("error").alias("_error"))
            tried = ready.join(counted, key).withColumn("_tries", F.col("_tries") + 1)
            tried.where(F.col("_tries") >= attempts).select(*names, F.col("_tries").alias("attempts"), F.col("_error").alias("error")).write.mode(
                "overwrite").parquet(f"{given_up}/batch={batch_id}")
            again = tried.where(F.col("_tries") < attempts).withColumn("_due", F.lit(now) + F.lit(wait_seconds) * F.pow(F.lit(2.0), F.col("_tries") - 1))
            back = [again.select(*pending.columns), pending.where(F.col("_due") > now)]
            if whole:
                back.append(ready.join(_union(whole).select(key).distinct(), key, "left_semi").withColumn("_apart", F.lit(True)).select(*pending.columns))
            _union(back).write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
        finally:
            for o in outs:
                o.unpersist()
            pending.unpersist()

    w = items.dropDuplicates([key]).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=poll) if poll else w.trigger(availableNow=True)).start()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _isolate(items: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, seed: int,
             splits: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """(results, items that raise alone, parts that raise and were not divided any more); the last two as (key, error)."""
    outs, lone, whole, raised = [], [], [], 0
    todo = [(items, 0)]
    while todo:
        part, depth = todo.pop()
        out = None
        try:
            out = work(part).persist()
            out.count()
            outs.append(out)
            continue
        except Exception as exc:  # noqa: BLE001  told in ``failed``
            if out is not None:
                out.unpersist()
            error = part.select(key).distinct().withColumn("error", F.lit(f"{type(exc).__name__}: {exc}"[:2000]))
            raised += 1
        if error.limit(2).count() < 2:
            lone.append(error)
        elif raised > splits or depth > 60:
            whole.append(error)
        else:
            bit = F.pmod(F.shiftright(F.xxhash64(F.lit(seed), F.col(key)), depth), F.lit(2))
            todo += [(part.where(bit == 1), depth + 1), (part.where(bit == 0), depth + 1)]
    return outs, lone, whole


def _left_over(spark: SparkSession, waiting: str, batch_id: int) -> DataFrame | None:
    """Items that the batch before left pending; each batch takes over what the one before could not do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{waiting}/batch={batch_id - 1}")
    if batch_id == 0 or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{waiting}/batch={batch_id - 1}")


def watch_counts(spark: SparkSession, done: str, failed: str) -> DataFrame:
    ok = spark.read.parquet(done).groupBy("batch").agg(F.count("*").alias("ok"))
    bad = spark.read.parquet(failed).groupBy("batch").agg(F.count("*").alias("failed"))
    return ok.join(bad, "batch", "full").na.fill(0)


def isolated(fn: Callable, key: list[str], schema: str):
    """A per-group function that turns an exception into a row with ``error``, for ``applyInPandas``.

    Returns the function and its schema.
    """
    from pyspark.sql.types import StringType, StructType
    full = StructType.fromDDL(schema).add("error", StringType()) if isinstance(schema, str) else schema.add("error", StringType())

    def run(pdf):
        import pandas as pd
        try:
            return fn(pdf).assign(error=None)
        except Exception as exc:
            row = {name: None for name in full.fieldNames()}
            row.update({k: pdf[k].iloc[0] for k in key}, error=f"{type(exc).__name__}: {exc}")
            return pd.DataFrame([row])

    return run, full


# ---------------------------------------------------------------- review state


def review_stream(events: DataFrame, *, ties: tuple[str, ...] = ()) -> DataFrame:
    """Current state per series, updated as decisions arrive. The fold is associative, so it is a
    streaming aggregation with map-side partials; run it in update mode."""
    return apply_decisions(events, ties=ties, streaming=True)


def update_log(stream: DataFrame, path: str, checkpoint: str):
    """Write the changed rows of an update-mode aggregation below ``path``, one folder per batch."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return (stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def latest(log: DataFrame, key: str = "series_id") -> DataFrame:
    """Last written row per key of an update log."""
    rest = [c for c in log.columns if c not in (key, "batch")]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


# ---------------------------------------------------------------- live windows

#: Calls to Python a batch of live windows makes at most; also the tasks it can be spread over.
GROUPS = 512


class _WindowState(StatefulProcessor):
    """Sliding windows over stretches of series, many stretches to a call.

    Kept per stretch, in a map of its group: frames that a coming window may need, and blend sums of frames that are not final. A
    frame is final once the head is ``seq`` frames past it: no regular window and no tail window can reach it any more. With
    ``idle_ms`` a group is one stretch, and one that gets nothing for so long ends where its frames end. A frame is a number or a
    vector; what is kept of a stretch are flat arrays as bytes, with the width beside them. Rows of a group are gathered up to
    ``HELD`` values, then each stretch among them goes on from its own state, so a group may be of any size.
    """

    KEY = "series string, blk bigint"
    SCHEMA = ("head bigint, next bigint, length bigint, idx binary, val binary, width int, "
              "given bigint, channels int, total binary, weight binary")
    HELD = 1 << 22

    def __init__(self, scorer, seq: int, stride: int, block: int, idle_ms: int | None = None, vector: bool = False):
        self.scorer, self.seq, self.stride, self.block, self.idle_ms, self.vector = scorer, seq, stride, block, idle_ms, vector

    def _values(self, given) -> "np.ndarray":
        """One row per frame; numbers are vectors of one."""
        import numpy as np
        if not self.vector:
            return given.astype(np.float64)[:, None]
        rows = [np.asarray(v, dtype=np.float64) for v in given]
        if len({len(r) for r in rows}) > 1:
            raise ValueError("frames of a series must have vectors of one width")
        return np.stack(rows) if rows else np.zeros((0, 0))

    @staticmethod
    def _joined(parts) -> "np.ndarray":
        import numpy as np
        parts = [p for p in parts if len(p)]
        if len({p.shape[1] for p in parts}) > 1:
            raise ValueError("frames of a series must have vectors of one width")
        return np.concatenate(parts) if parts else np.zeros((0, 1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("windows", self.KEY, self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        held, size = [], 0
        for pdf in rows:
            held.append(pdf)
            size += sum(len(v) for v in pdf["pos"] if v is not None) if self.vector else len(pdf)
            if size >= self.HELD:
                yield from self._frames(self._stretches(held))
                held, size = [], 0
        if held:
            yield from self._frames(self._stretches(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import numpy as np
        known = self.state.getValue(key)
        if known is not None:
            yield from self._frames([self._advance(tuple(key), known, np.zeros(0, np.int64), np.zeros((0, 1)), -1, True)])

    def _stretches(self, held) -> Iterator:
        """Final frames of each stretch that has rows in ``held``."""
        import numpy as np
        import pandas as pd
        pdf = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        codes, names = pd.factorize(pdf["series_id"], use_na_sentinel=False)
        blocks = pdf["blk"].to_numpy(dtype=np.int64)
        order = np.lexsort((blocks, codes))                             # stable: rows of a stretch stay as they came
        codes, blocks = codes[order], blocks[order]
        ends = pdf["is_end"].to_numpy(dtype=bool)[order]
        at = pdf["frame_idx"].to_numpy(dtype=np.int64)[order]
        pos = pdf["pos"].to_numpy()[order]
        bounds = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *bounds.tolist()], [*bounds.tolist(), len(order)]):
            name = names[codes[a]]
            key = (None if pd.isna(name) else name, int(blocks[a]))
            end = ends[a:b]
            length = int(at[a:b][end].max()) if end.any() else -1
            yield self._advance(key, self.state.getValue(key), at[a:b][~end], self._values(pos[a:b][~end]), length, False)

    @staticmethod
    def _frames(parts) -> Iterator:
        """(series, frames, one row of values per channel) as tables of many stretches."""
        import numpy as np
        import pandas as pd
        made, size = [], 0

        def table():
            sizes = [y.size for _, _, y in made]
            return pd.DataFrame({"series_id": np.repeat(np.array([s for s, _, _ in made], object), sizes),
                                 "frame_idx": np.concatenate([np.tile(i, len(y)) for _, i, y in made]),
                                 "channel": np.concatenate([np.repeat(np.arange(len(y), dtype=np.int32), len(i)) for _, i, y in made]),
                                 "pos": np.concatenate([y.ravel() for _, _, y in made])})
        for part in parts:
            if part is not None:
                made.append(part)
                size += part[2].size
            if size >= 100_000:
                yield table()
                made, size = [], 0
        if made:
            yield table()

    def _advance(self, key, known, idx, val, length: int, over: bool):
        """The frames of a stretch that are final now, or None; its state goes on from ``known``."""
        import numpy as np
        series, blk = key
        seq, stride = self.seq, self.stride
        lo, hi = blk * self.block, (blk + 1) * self.block
        total, weight, given = None, np.zeros(self.block), lo
        if known is not None:
            head, start, told, old, old_val, width, given, channels, kept_total, kept_weight = known
            old, kept_weight = np.frombuffer(old, np.int64), np.frombuffer(kept_weight)
            idx = np.concatenate([old, idx])
            val = self._joined([np.frombuffer(old_val).reshape(len(old), width), val])
            length = max(length, told)
            if channels:
                n = len(kept_weight)
                total = np.zeros((channels, self.block))
                total[:, given - lo:given - lo + n] = np.frombuffer(kept_total).reshape(channels, n)
                weight[given - lo:given - lo + n] = kept_weight
        else:
            head = max(0, lo - seq)
            start = max(0, -(-(lo - seq + 1) // stride) * stride)
        # a frame that came twice counts as it came last
        idx, last = np.unique(idx[::-1], return_index=True)
        val = val[::-1][last]
        from_head = idx[np.searchsorted(idx, head):]
        gap = np.flatnonzero(from_head != head + np.arange(len(from_head)))
        head += int(gap[0]) if len(gap) else len(from_head)             # all frames before the head have arrived
        length = head if over and length < 0 else length
        finished = 0 <= length <= head
        starts = list(range(start, min(hi, head - seq + 1), stride))
        start = starts[-1] + stride if starts else start
        windows = [(s, seq) for s in starts]
        if finished and length > lo:
            if length < seq:
                windows.append((0, length))
            elif (length - seq) % stride:
                windows.append((length - seq, seq))
        tri = 1.0 - np.abs(2.0 * np.arange(seq) / max(seq - 1, 1) - 1.0) + 0.01
        for at in range(0, len(windows), 256):
            part = windows[at:at + 256]
            x = np.zeros((len(part), seq, val.shape[1]))
            for row, (s, n) in zip(x, part):
                k = np.searchsorted(idx, s)
                row[:n] = val[k:k + n]
            y = np.asarray(self.scorer(x if self.vector else x[:, :, 0]), dtype=float)
            y = y[:, None, :] if y.ndim == 2 else y
            total = np.zeros((y.shape[1], self.block)) if total is None else total
            for p, (s, n) in zip(y, part):
                a, b = max(s, lo), min(s + n, hi)
                if a < b:
                    total[:, a - lo:b - lo] += p[:, a - s:b - s] * tri[a - s:b - s]
                    weight[a - lo:b - lo] += tri[a - s:b - s]
        final = min(length if finished else min(start, head - seq), hi)
        out = None
        if total is not None and final > given:
            ready = np.arange(given, final)
            ready = ready[weight[ready - lo] > 0]
            if len(ready):
                out = series, ready, total[:, ready - lo] / weight[ready - lo]
        if finished or final >= hi:
            if known is not None:
                self.state.removeKey(key)
            return out
        given = max(given, final)
        keep = idx >= min(start, head - seq)
        size = int(np.flatnonzero(weight)[-1]) + 1 - (given - lo) if weight.any() else 0
        size = max(size, 0) if total is not None else 0
        held = slice(given - lo, given - lo + size)
        self.state.updateValue(key, (head, start, length, idx[keep].tobytes(), val[keep].tobytes(), val.shape[1], given, 0 if total is None else len(total),
                                     b"" if total is None else total[:, held].tobytes(), weight[held].tobytes()))
        return out

    def close(self) -> None:
        pass


def _travel_by_value(scorer) -> None:
    """The worker that prepares a stateful stream gets no added files, so what it runs is pickled whole."""
    for name in {__name__, getattr(scorer, "__module__", None) or type(scorer).__module__}:
        if name.startswith("wavetable."):
            cloudpickle.register_pickle_by_value(sys.modules[name])


def stream_windows(frames: DataFrame, scorer: Callable, seq: int = 120, stride: int = 60, *,
                   block: int = BLOCK_FRAMES, idle_seconds: float | None = None, column: str = "pos", groups: int = GROUPS) -> DataFrame:
    """Blended predictions of live series per channel, append mode; equal to ``sliding_predict`` over the whole.

    ``frames`` is a stream of series_id, frame_idx, ``column`` and is_end; the end row carries the number of
    frames as its index. A frame is a number or a vector (an array of one width per series), as in ``sliding_predict``. A series without one ends after ``idle_seconds`` without frames, if
    that is set; timers need a trigger that keeps running, not one that takes what is there and stops. State is kept per series and stretch of ``block`` frames, so that even a
    backlog of one long series spreads over many tasks. Stretches are dealt to ``groups`` by their hash, and a group is one call to Python: a call
    for each of many short series costs far more than its windows. Like ``block``, ``groups`` must stay what it was when a checkpoint is taken up again. With
    ``idle_seconds`` each stretch is a group of its own, as timers are kept by group.
    """
    if block % stride or block < seq:
        raise ValueError("the stretch must be a multiple of the stride and at least one window long")
    i = F.col("frame_idx").cast("bigint")
    low, high = i - seq, F.when(F.col("is_end"), i - 1 + seq).otherwise(i + seq)
    span = F.sequence(F.greatest(F.floor(low / F.lit(block)), F.lit(0)).cast("bigint"),
                      F.greatest(F.floor(high / F.lit(block)), F.lit(0)).cast("bigint"))
    _travel_by_value(scorer)
    vector = frames.schema[column].dataType.typeName() == "array"
    value = F.col(column).cast("array<double>" if vector else "double").alias("pos")
    rows = frames.select("series_id", i.alias("frame_idx"), value, "is_end").withColumn("blk", F.explode(span))
    kind = rows.schema["series_id"].dataType
    bucket = F.pmod(F.xxhash64("series_id", "blk"), F.lit(groups)).cast("int").alias("bucket")
    rows = rows.select(F.col("series_id").cast("string").alias("series_id"), "frame_idx", "pos", "is_end", "blk", bucket)
    out = rows.groupBy(*(["bucket"] if idle_seconds is None else ["series_id", "blk"])).transformWithStateInPandas(
        _WindowState(scorer, seq, stride, block, None if idle_seconds is None else int(idle_seconds * 1000), vector),
        "series_id string, frame_idx bigint, channel int, pos double", "Append", "None" if idle_seconds is None else "ProcessingTime")
    return out.withColumn("series_id", F.col("series_id").cast(kind))
