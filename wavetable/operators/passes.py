"""Filters and troughs over a whole series of any length, in one exact pass.

A series is cut into blocks of frames, each packed as one array, and what must be known from beyond a block is carried as
one small row per block: the state of a recursive filter by a power of its step matrix, the neighbourhood of a peak by
copies of the peaks next to the border, the depth of a peak by a hierarchy of block minima and maxima. No task holds more than a
block, its neighbours' peaks or the summaries of the blocks of one series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels
from ..session import stored
from .blocks import BLK, BLOCK_FRAMES, Carry, Key, attach, block_of, block_window, each_group, halo_columns, keys, scan

FLUSH = 1 << 18


def _fields(df: DataFrame, names: list[str], *more: tuple[str, str]) -> T.StructType:
    schema = T.StructType([df.schema[c] for c in names])
    for name, kind in more:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def _pack(rows: DataFrame, by: list[str], value: str, extra: list[tuple[str, str]], work: Callable) -> DataFrame:
    """One row per (series, block): ``_lo`` (first index), ``_v`` (values in order) and what ``work`` makes of the values."""
    schema = _fields(rows, [*by, BLK], ("_lo", "bigint"), ("_v", "array<double>"), *extra)
    arrow = to_arrow_schema(schema)

    def run(t):
        import numpy as np
        import pyarrow as pa
        v = t[value].to_numpy().astype(np.float64)
        lo = t["frame_idx"][0].as_py()
        columns = [t[c].slice(0, 1).combine_chunks() for c in (*by, BLK)]
        made = [pa.array([lo], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)),
                *[pa.array([m], f.type) for m, f in zip(work(v, lo), list(arrow)[len(columns) + 2:])]]
        return pa.Table.from_arrays([*columns, *[m.cast(f.type) for m, f in zip(made, list(arrow)[len(columns):])]], schema=arrow)

    return each_group(rows.select(*by, BLK, "frame_idx", value), [*by, BLK], run, schema)


def _batches(tables):
    """Tables of a few rows as batches of many values."""
    import pyarrow as pa
    held, size = [], 0
    for t in tables:
        held.append(t)
        size += t.nbytes // 8
        if size >= FLUSH:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


# ---------------------------------------------------------------- zero-phase low-pass


def lowpass_whole(frames: DataFrame, fps: float, cutoff: float = 8.0, order: int = 2, x: str = "pos", *, out: str = "low",
                  series: Key = "series_id", block: int = BLOCK_FRAMES) -> DataFrame:
    """(series, frame_idx, out): the zero-phase Butterworth low-pass of every whole series, at any block width.

    ``frame_idx`` must be dense from 0. Both ends are extended by odd reflection, the filter runs forwards and then backwards. A block gives
    the state that its own samples leave behind; the state before every block follows from these by powers of the step
    matrix, and with it the block is filtered exactly. Series that are too short for the reflection, and cut-offs outside
    (0, half the rate), pass unchanged. Values must be finite (see ``waves.fill_nonfinite``).
    """
    by = keys(series)
    order = max(1, int(order))
    pad = 3 * (order + 1)
    given = frames.select(*by, "frame_idx", F.col(x).cast("double").alias("_x"))
    plain = F.col("_x").cast("float").cast("double").alias(out)
    if fps <= 0 or cutoff <= 0 or cutoff >= 0.5 * fps:
        return given.select(*by, "frame_idx", plain)
    given = stored(given, "pass")                         # read for the lengths, the ends and the samples
    lengths = stored(given.groupBy(*by).agg((F.max("frame_idx") + 1).alias("n")), "pass")
    i, n = F.col("frame_idx"), F.col("n")
    short = attach(given, lengths.where(n <= pad), length="n", series=series, block=block).select(*by, "frame_idx", plain)
    rows = attach(given, lengths.where(n > pad), length="n", series=series, block=block)
    near = stored(rows.where((i <= pad) | (i >= n - 1 - pad)), "pass")
    ends = near.groupBy(*by).agg(F.max(F.when(i == 0, F.col("_x"))).alias("_a"), F.max(F.when(i == n - 1, F.col("_x"))).alias("_b"))
    near = near.join(ends, by)
    head = near.where((i > 0) & (i <= pad)).select(*by, (-i).alias("frame_idx"), (2 * F.col("_a") - F.col("_x")).alias("_x"))
    tail = near.where((i < n - 1) & (i >= n - 1 - pad)).select(*by, (2 * (n - 1) - i).alias("frame_idx"), (2 * F.col("_b") - F.col("_x")).alias("_x"))
    every = rows.select(*by, i.cast("bigint").alias("frame_idx"), "_x")
    for side in (head, tail):
        every = every.unionByName(side.select(*by, F.col("frame_idx").cast("bigint").alias("frame_idx"), "_x"))
    b, a = kernels.butterworth(order, cutoff / (0.5 * fps))
    zero = [0.0] * order

    def summary(v, _):
        return [len(v), kernels.filtered(b, a, v, zero)[1].tolist(), float(v[0])]

    packs = stored(_pack(every.withColumn(BLK, block_of(i + pad, block)), by, "_x",
                              [("_n", "bigint"), ("_s", "array<double>"), ("_edge", "double")], summary), "pass")
    states = _states(packs, by, b, a, backwards=False)
    schema = _fields(packs, [*by, BLK], ("_lo", "bigint"), ("_v", "array<double>"), ("_n", "bigint"), ("_s", "array<double>"), ("_edge", "double"))

    def forwards(rows):
        y = [kernels.filtered(b, a, v, z)[0] for v, z in zip(_lists(rows["_v"]), _lists(rows["_z"]))]
        return [rows["_lo"], [v.tolist() for v in y], rows["_n"], [kernels.filtered(b, a, v[::-1], zero)[1].tolist() for v in y],
                [float(v[-1]) for v in y]]

    packs = stored(_each(packs.join(states, [*by, BLK]), [*by, BLK], schema, forwards), "pass")
    states = _states(packs, by, b, a, backwards=True)
    schema = _fields(packs, by, ("frame_idx", dict(frames.dtypes)["frame_idx"]), (out, "double"))
    arrow = to_arrow_schema(schema)

    def backwards(batches):
        import numpy as np
        import pyarrow as pa

        def done(row):
            get = lambda c: row.column(row.schema.get_field_index(c))
            v = kernels.filtered(b, a, get("_v").values.to_numpy()[get("_v").offsets[0].as_py():get("_v").offsets[1].as_py()][::-1],
                                 get("_z")[0].as_py())[0][::-1]
            at = get("_lo")[0].as_py() + np.arange(len(v))
            keep = (at >= 0) & (at < get("_total")[0].as_py() - 2 * pad)
            same = pa.array(np.zeros(int(keep.sum()), np.int64))
            return pa.Table.from_arrays(
                [*[get(c).take(same) for c in by], pa.array(at[keep]).cast(arrow.field("frame_idx").type),
                 pa.array(v[keep].astype(np.float32).astype(np.float64))], schema=arrow)

        yield from _batches((done(batch.slice(k, 1)) for batch in batches for k in range(batch.num_rows)))

    return packs.join(states, [*by, BLK]).mapInArrow(backwards, schema).unionByName(short.select(*by, "frame_idx", out))


def _lists(column) -> list:
    import numpy as np
    return [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in column]


def _each(df: DataFrame, names: list[str], schema: T.StructType, work: Callable) -> DataFrame:
    """``names`` as they are and the columns that ``work`` makes of a row, one row of arrays at a time."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        def done(t):
            made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type)
                    for c, f in zip(work(t), list(arrow)[len(names):])]
            return pa.Table.from_arrays([*[t[c].combine_chunks() for c in names], *made], schema=arrow)

        yield from _batches((done(pa.Table.from_batches([batch.slice(k, 1)])) for batch in batches for k in range(batch.num_rows)))

    return df.mapInArrow(run, schema)


def _states(packs: DataFrame, by: list[str], b, a, backwards: bool) -> DataFrame:
    """The filter state before every block, and the number of samples of the series; one small row per block is read."""
    schema = _fields(packs, [*by, BLK], ("_z", "array<double>"), ("_total", "bigint"))
    arrow = to_arrow_schema(schema)

    step, rest, powers = kernels.state_step(a), kernels.step_state(b, a), {}

    def run(t):
        import numpy as np
        import pyarrow as pa
        t = t.take(pa.array(np.arange(t.num_rows)[::-1 if backwards else 1]))
        z = np.array(rest) * t["_edge"][0].as_py()
        before = []
        for n, s in zip(t["_n"].to_pylist(), t["_s"].to_pylist()):
            before.append(z.tolist())
            if n not in powers:
                powers[n] = np.linalg.matrix_power(step, n)
            z = powers[n] @ z + np.array(s)
        total = sum(t["_n"].to_pylist())
        return pa.Table.from_arrays([*[t[c].combine_chunks() for c in (*by, BLK)], pa.array(before, pa.list_(pa.float64())),
                                     pa.array([total] * t.num_rows, pa.int64())], names=[f.name for f in arrow])

    return each_group(packs.select(*by, BLK, "_n", "_s", "_edge"), by, run, schema, order=BLK)


# ---------------------------------------------------------------- troughs


def troughs_whole(frames: DataFrame, fps: float, prominence: float = 0.035, min_distance: float = 0.15, x: str = "pos", *,
                  series: Key = "series_id", block: int = BLOCK_FRAMES, salts: int = 32) -> DataFrame:
    """(series, frame_idx, x): local minima of every whole series that are spaced and deep enough, at any block width.

    ``frame_idx`` must be dense from 0 and values finite. A flat bottom counts at its middle. Of two minima closer than the distance
    the lower stays, of equal ones the later. Depth is the rise to the lower of the two highest points before a lower sample.
    """
    by = keys(series)
    v = -F.col(x).cast("float").cast("double")
    rows = stored(frames.select(*by, "frame_idx", F.col(x).alias("_given"), v.alias("_v")), "pass")
    peaks = stored(_peaks(rows, by, series, block), "pass")
    distance = max(1, kernels.half_even(min_distance * fps))
    if distance > 1:
        peaks = _spaced(peaks, by, distance, block)
    if prominence > 0:
        peaks = _deep(rows, peaks, by, prominence, block, salts)
    return peaks.select(*by, "frame_idx", F.col("_given").alias(x))


def _peaks(rows: DataFrame, by: list[str], series: Key, block: int) -> DataFrame:
    """Middle of every flat top that both neighbours lie below; tops at the ends of a series do not count."""
    before = F.lag("_v").over(block_window(series))
    out = halo_columns(rows, {"_before": before}, 1, 0, series=series, block=block)
    begins = F.col("_before").isNull() | (F.col("_before") != F.col("_v"))
    out = scan(out, [Carry("_from", F.struct(F.col("frame_idx").alias("i"), F.col("_before").alias("v")), begins),
                     Carry("_to", F.struct(F.col("frame_idx").alias("i"), F.col("_v").alias("v")), begins, ahead=True, inclusive=False)],
               series=series, block=block)
    middle = F.floor((F.col("_from.i") + F.col("_to.i") - 1) / 2)
    top = (F.col("_from.v") < F.col("_v")) & (F.col("_to.v") < F.col("_v")) & (F.col("frame_idx") == middle)
    return out.where(top).select(*by, "frame_idx", "_given", "_v", F.lit(False).alias("_kept"))


def _spaced(peaks: DataFrame, by: list[str], distance: int, block: int) -> DataFrame:
    """Higher peaks first, drop every other closer than ``distance``.

    A peak is decided in its block, from copies of the peaks next to the border, unless that depends on one farther away. What is
    left open is decided in further rounds, in which the peaks kept so far are known; the highest open peak of any
    neighbourhood is decided in each, so rounds are as many as blocks that one falling chain of close peaks crosses.
    """
    halo = 4 * distance
    names = peaks.columns
    schema = _fields(peaks, names, ("_open", "boolean"))
    arrow = to_arrow_schema(schema)

    def run(t):
        import numpy as np
        import pyarrow as pa
        at, v, kept = t["frame_idx"].to_numpy().astype(np.int64), t["_v"].to_numpy(), t["_kept"].to_numpy(zero_copy_only=False)
        blk = t[BLK][0].as_py()
        state = kernels.spaced_state(at, v, kept, distance, blk * block - halo, (blk + 1) * block + halo)
        own = (at // block == blk) & (state >= 0)
        t, state = t.filter(pa.array(own)), state[own]
        columns = [t[c].combine_chunks() if c != "_kept" else pa.array(state == 1) for c in names]
        return pa.Table.from_arrays([*columns, pa.array(state == 0)], schema=arrow)

    first = F.greatest(F.floor((F.col("frame_idx") - halo) / block), F.lit(0)).cast("bigint")
    last = F.floor((F.col("frame_idx") + halo) / block).cast("bigint")
    while True:
        near = peaks.withColumn(BLK, F.explode(F.sequence(first, last)))
        out = stored(each_group(near, [*by, BLK], run, schema), "pass")
        peaks = out.drop("_open")
        if out.where("_open").isEmpty():
            return peaks


def _deep(rows: DataFrame, peaks: DataFrame, by: list[str], least: float, block: int, salts: int) -> DataFrame:
    """Peaks that rise by ``least`` above the lowest point on either side before a higher sample.

    Most are decided within their block. A side that reaches the border first is looked up by height: the summaries of the other
    blocks name the first block with a higher sample and the lowest point on the way, and that block says how low it gets there.
    """
    packs = stored(_pack(rows.withColumn(BLK, block_of("frame_idx", block)), by, "_v", [("_max", "double"), ("_min", "double")],
                              lambda v, _: [float(v.max()), float(v.min())]), "pass")
    marked = peaks.withColumn(BLK, block_of("frame_idx", block))
    here = [*by, BLK]
    names = [c for c in peaks.columns if c not in by]
    schema = _fields(marked, [*here, *names], ("_l", "boolean"), ("_r", "boolean"))
    arrow = to_arrow_schema(schema)

    def inside(v, lo, own, t):
        """Per side: deep enough, not, or (null) not known inside the block."""
        import pyarrow as pa
        left, right = kernels.side_depths(v, t["frame_idx"].to_numpy() - lo, least)
        return [*own, *[t[c] for c in names], pa.array(left, pa.bool_()), pa.array(right, pa.bool_())]

    judged = stored(_beside(packs, marked, here, names, inside, schema), "pass")
    sides = [judged.where(f"{c} is null").select(*here, F.lit(s).alias("_side"), F.col("_v").alias("_h")) for c, s in (("_l", 0), ("_r", 1))]
    asked = sides[0].unionByName(sides[1]).distinct()
    # where to look: the summaries of a series beside its questions, in as many groups as its questions need
    salt = F.pmod(F.col(BLK), F.lit(salts)).cast("int").alias("_salt")
    asked = asked.select("*", salt)
    by_salt = [*by, "_salt"]
    summary = packs.select(*here, "_max", "_min").join(asked.select(*by_salt).distinct(), by)
    found = _fields(asked, [*here, "_side", "_h"], ("_at", "bigint"), ("_deep", "boolean"))
    found_arrow = to_arrow_schema(found)

    def search(rows):
        import pyarrow as pa
        import pyarrow.compute as pc
        told = pc.is_null(rows["_side"])
        blocks, t = rows.filter(told), rows.filter(pc.invert(told))
        place, deep = kernels.first_higher(blocks["_max"].to_numpy(), blocks["_min"].to_numpy(),
                                           t[BLK].to_numpy(), t["_side"].to_numpy(), t["_h"].to_numpy(), least)
        return pa.Table.from_arrays([*[t[c].combine_chunks() for c in (*here, "_side", "_h")], pa.array(place, pa.int64()),
                                     pa.array(deep, pa.bool_())], names=[f.name for f in found_arrow])

    found_rows = each_group(summary.unionByName(asked, allowMissingColumns=True), by_salt, search, found, order=BLK)
    found_rows = stored(found_rows, "pass")
    # how low it gets in the block that holds the higher sample
    last = found_rows.where("_deep is null").select(*by, F.col(BLK).alias("_of"), F.col("_at").alias(BLK), "_side", "_h")
    answer = _fields(last, [*by, "_of", "_side", "_h"], ("_deep", "boolean"))

    def finish(v, _, own, t):
        import pyarrow as pa
        deep = kernels.border_depths(v, t["_side"].to_numpy(), t["_h"].to_numpy(), least)
        return [*own[:-1], *[t[c] for c in ("_of", "_side", "_h")], pa.array(deep, pa.bool_())]

    answers = _beside(packs, last, here, ["_of", "_side", "_h"], finish, answer).withColumnRenamed("_of", BLK)
    known = found_rows.where("_deep is not null").select(*here, "_side", "_h", "_deep").unionByName(answers.select(*here, "_side", "_h", "_deep"))
    out = judged
    for side, c in ((0, "_l"), (1, "_r")):
        part = known.where(F.col("_side") == side).select(*here, F.col("_h").alias("_v"), F.col("_deep").alias(f"{c}x"))
        out = out.join(part, [*here, "_v"], "left")
    return out.where(F.coalesce("_l", "_lx") & F.coalesce("_r", "_rx")).select(*peaks.columns)


def _beside(packs: DataFrame, rows: DataFrame, here: list[str], names: list[str], work: Callable, schema: T.StructType) -> DataFrame:
    """What ``work`` makes of (values of a block, its first index, its keys, its ``rows`` in the order of ``names``), many blocks to a batch."""
    arrow = to_arrow_schema(schema)
    listed = rows.groupBy(*here).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(row):
            get = lambda c: row.column(row.schema.get_field_index(c))
            t = pa.Table.from_struct_array(get("_rows").flatten())
            same = pa.array(np.zeros(t.num_rows, np.int64))
            made = work(get("_v").flatten().to_numpy(zero_copy_only=False), get("_lo")[0].as_py(), [get(c).take(same) for c in here], t)
            return pa.Table.from_arrays(made, names=[f.name for f in arrow]).cast(arrow)

        yield from _batches((done(batch.slice(k, 1)) for batch in batches for k in range(batch.num_rows)))

    return packs.select(*here, "_lo", "_v").join(listed, here).mapInArrow(run, schema)
