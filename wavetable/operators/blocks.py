"""Ordered computation over series of any length.

A window ``PARTITION BY series`` puts a whole series into one task, and one series may hold
a third of all rows. Everything in this library that needs order therefore works on blocks:
the order value is cut into fixed stretches and ``(series, block)`` is the shuffle key.

* ``with_halo``     copies the few rows next to a block border into the neighbour, so that
                    bounded frames (lag, moving sums) are exact inside a block;
* ``scan``          running sums and nearest non-null values without a bound: computed inside
                    a block, and carried between blocks through one summary row per block;
* ``attach``        joins one row per series to the frames, copied once per block;
* ``range_join``    finds the ranges that hold a point, through the blocks they touch;
* ``explode_range`` expands an integer range in two bounded steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_FRAMES = 65_536
BLOCK_MS = 86_400_000
BLK = "_blk"
OWN = "_own"

Key = str | Sequence[str]


def keys(series: Key) -> list[str]:
    return [series] if isinstance(series, str) else list(series)


def block_of(order: Column | str, block: float) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.floor(col / F.lit(block)).cast("bigint")


def with_block(df: DataFrame, order: Column | str, block: float) -> DataFrame:
    return df.withColumn(BLK, block_of(order, block))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash by ``columns`` into all shuffle partitions.

    For work that is heavy per byte, such as Python kernels: adaptive execution merges partitions by
    their size and would leave a few tasks. It takes the place of the shuffle the grouping needs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def each_group(df: DataFrame, names: Sequence[str], work: Callable, schema: T.StructType, *, order: str = "frame_idx") -> DataFrame:
    """What ``work`` makes of each group of ``names``, an Arrow table in ``order``; as ``applyInArrow``, but with many groups to a batch.

    A group that is small costs more to hand over by itself than to work on. Groups must be bounded; one that goes over the end of a
    batch is held until it is whole. Rows are sorted by Spark, which spills.
    """
    names = list(names)
    out_schema = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def starts(t):
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in names:
                a, b = t[c].slice(1), t[c].slice(0, t.num_rows - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                new[1:] |= np.asarray(differ.to_numpy(), bool)
            return np.flatnonzero(new).tolist()

        def told(t, bounds):
            made = [work(t.slice(a, b - a)).cast(out_schema) for a, b in zip(bounds, bounds[1:])]
            if made:
                yield from pa.concat_tables(made).combine_chunks().to_batches()

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            last = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), part]) if held else None
            if last is not None and len(starts(last)) == 1:
                held.append(part)                         # all of the batch goes on with the group held
                continue
            t = pa.concat_tables([*held, part]).combine_chunks()
            bounds = starts(t)
            yield from told(t, bounds)
            held = [t.slice(bounds[-1])]
        if held:
            t = pa.concat_tables(held).combine_chunks()
            yield from told(t, [*starts(t), t.num_rows])

    return spread(df, *names).sortWithinPartitions(*names, order).mapInArrow(run, schema)


# ---------------------------------------------------------------- bounded frames


def with_halo(df: DataFrame, before: int, after: int, *, order: str = "frame_idx",
              block: int = BLOCK_FRAMES) -> DataFrame:
    """Give every block the ``before`` rows ahead of it and the ``after`` rows behind it.

    ``order`` must be a dense integer index from 0. Rows carry their own block in ``_own``;
    after the window call ``own_rows`` to drop the copies.
    """
    if before == 0 and after == 0:
        return with_block(df, order, block).withColumn(OWN, F.col(BLK))
    i = F.col(order)
    first = F.greatest(F.floor((i - after) / F.lit(block)), F.lit(0))
    last = F.floor((i + before) / F.lit(block))
    return (df.withColumn(OWN, block_of(order, block))
              .withColumn(BLK, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))))


def block_window(series: Key = "series_id", order: str | Sequence = "frame_idx") -> W:
    by = [order] if isinstance(order, (str, Column)) else list(order)
    return W.partitionBy(*keys(series), BLK).orderBy(*by)


def own_rows(df: DataFrame, keep_block: bool = False) -> DataFrame:
    own = df.where(F.col(OWN) == F.col(BLK)).drop(OWN)
    return own if keep_block else own.drop(BLK)


def halo_columns(df: DataFrame, columns: dict[str, Column] | list[tuple[str, Column]], before: int,
                 after: int, *, series: Key = "series_id", order: str = "frame_idx",
                 block: int = BLOCK_FRAMES, keep_block: bool = False) -> DataFrame:
    """Add window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``keep_block`` leaves the block column, by which the rows are then partitioned: ``attach`` joins
    on it without another shuffle.
    """
    out = with_halo(df, before, after, order=order, block=block)
    for name, column in (columns.items() if isinstance(columns, dict) else columns):
        out = out.withColumn(name, column)
    return own_rows(out, keep_block)


# ---------------------------------------------------------------- unbounded scans


@dataclass(frozen=True)
class Carry:
    """Nearest earlier (``ahead=False``) or later row where ``when`` holds; its ``value``."""
    name: str
    value: Column
    when: Column | None = None
    ahead: bool = False
    inclusive: bool = True


@dataclass(frozen=True)
class Running:
    """Sum of ``value`` over the rows up to and including this one."""
    name: str
    value: Column
    dtype: str = "bigint"


def scan(df: DataFrame, specs: Sequence[Carry | Running], *, series: Key = "series_id",
         order: str = "frame_idx", ties: Sequence[str] = (), block: float = BLOCK_FRAMES,
         keep_block: bool = False) -> DataFrame:
    """Running sums and nearest values over each whole series, one shuffle by ``(series, block)``.

    ``(order, *ties)`` must order a series completely. What crosses a block border is one
    summary row per block, so the only window per series runs over block summaries.
    """
    by = keys(series)
    ordering = [order, *ties]
    rank = F.struct(*[F.col(c) for c in ordering])
    df = with_block(df, order, block)

    aggs, carried, local = [], [], []
    before_blocks = W.partitionBy(*by).orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    # looking ahead runs backwards: a frame that grows from the start is updated row by row, one
    # that shrinks towards the end would be computed anew for every row
    after_blocks = W.partitionBy(*by).orderBy(F.desc(BLK)).rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*by, BLK).orderBy(*ordering)
    backwards = W.partitionBy(*by, BLK).orderBy(*[F.desc(c) for c in ordering])
    for n, spec in enumerate(specs):
        tmp = f"_s{n}"
        if isinstance(spec, Running):
            aggs.append(F.sum(spec.value).alias(tmp))
            carried.append(F.coalesce(F.sum(tmp).over(before_blocks), F.lit(0)).alias(f"_c{n}"))
            own = F.sum(spec.value).over(inside.rowsBetween(W.unboundedPreceding, 0))
            local.append((spec.name, (F.coalesce(own, F.lit(0)) + F.col(f"_c{n}")).cast(spec.dtype)))
            continue
        when = F.lit(True) if spec.when is None else spec.when
        boxed = F.when(when, F.struct(spec.value.alias("v")))
        key = F.when(when, rank)
        if spec.ahead:
            aggs.append(F.min_by(boxed, key).alias(tmp))
            carried.append(F.last(tmp, True).over(after_blocks).alias(f"_c{n}"))
            frame = backwards.rowsBetween(W.unboundedPreceding, 0 if spec.inclusive else -1)
            own = F.last(boxed, True).over(frame)
        else:
            aggs.append(F.max_by(boxed, key).alias(tmp))
            carried.append(F.last(tmp, True).over(before_blocks).alias(f"_c{n}"))
            frame = inside.rowsBetween(W.unboundedPreceding, 0 if spec.inclusive else -1)
            own = F.last(boxed, True).over(frame)
        local.append((spec.name, F.coalesce(own, F.col(f"_c{n}"))["v"]))

    summary = df.groupBy(*by, BLK).agg(*aggs).select(*by, BLK, *carried)
    kept = df.columns
    out = df.join(summary, [*by, BLK])
    out = out.select(*kept, *[column.alias(name) for name, column in local])
    return out if keep_block else out.drop(BLK)


def dense_index(df: DataFrame, name: str, *, series: Key, order: str, ties: Sequence[str] = (),
                block: float) -> DataFrame:
    """Position of each row in its series, from 0: ``row_number() - 1`` without a per-series task."""
    out = scan(df, [Running(name, F.lit(1))], series=series, order=order, ties=ties, block=block)
    return out.withColumn(name, (F.col(name) - 1).cast("int"))


# ---------------------------------------------------------------- joins


def attach(frames: DataFrame, per_series: DataFrame, *, length: str, series: Key = "series_id",
           order: str = "frame_idx", block: int = BLOCK_FRAMES, how: str = "inner",
           blocked: bool = False) -> DataFrame:
    """Join one row per series to its frames on ``(series, block)``; ``blocked`` frames carry the block.

    ``length`` names the column of ``per_series`` with the number of frames. Each row is copied
    once per block of its series, so a long series spreads over as many tasks as it has blocks.
    """
    last = F.greatest(F.ceil(F.col(length) / F.lit(block)) - 1, F.lit(0))
    copies = explode_range(per_series, F.lit(0), last, BLK)
    frames = frames if blocked else with_block(frames, order, block)
    return frames.join(copies, [*keys(series), BLK], how).drop(BLK)


def range_join(points: DataFrame, ranges: DataFrame, *, at: str, lo: str, hi: str,
               series: Key = "series_id", block: float, closed: bool = False,
               how: str = "inner") -> DataFrame:
    """Pairs of a point and a range with ``lo <= at < hi`` (``<= hi`` when ``closed``).

    A range is copied to every block it touches and a point lies in one block, so each pair
    meets exactly once and the shuffle key ``(series, block)`` stays even for a long series.
    """
    last = F.col(hi) if closed else F.greatest(F.ceil(F.col(hi)) - 1, F.floor(F.col(lo)))
    span = F.sequence(block_of(lo, block), F.greatest(block_of(last, block), block_of(lo, block)))
    ranges = ranges.withColumn(BLK, F.explode(span))
    by = keys(series)
    inside = F.col(at) >= F.col(lo)
    inside = inside & ((F.col(at) <= F.col(hi)) if closed else (F.col(at) < F.col(hi)))
    pts = with_block(points, at, block)
    if how == "inner":
        return pts.join(ranges, [*by, BLK]).where(inside).drop(BLK)
    ranges = ranges.select(*[F.col(c).alias(f"_r_{c}") if c in {*by, BLK} else F.col(c) for c in ranges.columns])
    on = inside
    for c in [*by, BLK]:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return pts.join(ranges, on, how).drop(BLK, *[f"_r_{c}" for c in [*by, BLK]])


def explode_range(df: DataFrame, lo: Column, hi: Column, name: str, step: int = 4096,
                  rebalance: bool = False) -> DataFrame:
    """One row per integer in ``[lo, hi]``, in two steps so that no array grows with the range.

    ``rebalance`` shuffles the rows of the first step, one per ``step`` results, so that a single
    long range is expanded by many tasks.
    """
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    out = (df.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_hi") >= F.col("_lo"))
             .withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("bigint")))))
    if rebalance:
        out = spread(out, *out.columns)
    out = out.withColumn(name, F.explode(F.sequence(
        F.col("_from"), F.least(F.col("_from") + F.lit(step - 1), F.col("_hi")))))
    return out.drop("_lo", "_hi", "_from")
