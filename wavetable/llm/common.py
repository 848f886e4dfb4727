"""Helpers of the training-data operators: stored intermediate tables, held-out rows, components of a graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship_package

#: ASCII white space; every byte outside it belongs to a word. ``bytes.split()`` splits at exactly these.
SPACE = b" \t\n\r\x0b\f"


def ready(spark: SparkSession, batch_rows: int = 400) -> SparkSession:
    """Ship the package and keep Arrow batches small: a batch may hold only very long texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: what follows sees the same rows however often it runs, and a lost executor costs no recomputation.
    """
    folder = f"{shared_folder(df.sparkSession, name)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


def crc_mod(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null ids give null."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(modulus)


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """``(node, component)`` for every node with a link to another; the component is its smallest node.

    Alternates two steps until nothing changes, so the number of rounds grows with the logarithm of the
    diameter: every node hands the smallest node it knows to its larger neighbours, then all of its smaller
    neighbours are pointed at the smallest of them. Each round is two map-side combined minima and two joins
    that Spark may split where a node is hot; no task gathers a node's neighbours.
    Links with a null end or two equal ends are ignored; repeated ones count once.
    """
    x, y = F.col(a), F.col(b)
    edges = stored(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, name)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), name)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return (row[0], row[1])
