"""Action scripts: one JSON document with control points per series, in a file of its own or as a line of a bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import strings as S
from ..operators.blocks import BLOCK_MS, dense_index
from ..operators.waves import WaveConfig

SCRIPT_SCHEMA = ("version string, inverted boolean, `range` int, metadata map<string, string>, "
                 "actions array<struct<at: double, pos: double>>")
LAST = (1 << 62)


def unescape(text: Column) -> Column:
    """Undo percent escapes of a path; a plus sign stays one."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def _documents(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    if bundled:
        docs = spark.read.schema(f"series_id string, part bigint, {SCRIPT_SCHEMA}").json(path)
        return docs.where(F.col("series_id").isNotNull())
    docs = spark.read.schema(SCRIPT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    file = unescape(F.col("_metadata.file_path"))
    named = F.regexp_extract(file, r"/series_id=([^/]+)/", 1)
    part = F.regexp_extract(file, r"/part=(\d+)/", 1).try_cast("bigint")
    series = F.when(named != "", unescape(named)).otherwise(S.stem(file))
    return docs.select(series.alias("series_id"), F.coalesce(part, F.lit(0)).alias("part"), *docs.columns)


def read_scripts(spark: SparkSession, path: str, *, bundled: bool = False) -> DataFrame:
    """One row per script: version, inverted, range and metadata."""
    d = _documents(spark, path, bundled).where(F.col("part") == 0)
    return d.select("series_id", "version", "inverted", "range", F.coalesce("metadata", F.create_map()).alias("metadata"))


def read_actions(spark: SparkSession, path: str, *, bundled: bool = False) -> DataFrame:
    """Control points of all scripts below ``path``; ``ord`` is the place in the file, which breaks ties."""
    docs = _documents(spark, path, bundled).select("series_id", "part", "actions")
    sizes = docs.select("series_id", "part", F.size("actions").alias("n"))            # one row per document
    before = F.sum("n").over(W.partitionBy("series_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("series_id", "part", F.coalesce(before, F.lit(0)).alias("first"))
    rows = docs.join(offsets, ["series_id", "part"]).select("series_id", "first", F.posexplode("actions").alias("i", "a"))
    return rows.select("series_id", (F.col("first") + F.col("i")).alias("ord"),
                       F.col("a.at").cast("bigint").alias("at_ms"), F.col("a.pos").alias("pos"))


def _quoted(name: str) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).cast("string").alias("s"))), r"(?s)^\{\"s\":(.*)\}$", 1)


def write_scripts(actions: DataFrame, path: str, metadata: DataFrame | None = None, *, per_document: int | None = None,
                  block_ms: float = BLOCK_MS, bundled: bool = False) -> None:
    """One JSON document per series, written line by line in time order.

    A document is never held in memory: its lines are rows, sorted within the partition. With
    ``per_document`` a series with more points continues in further documents, which only ``read_actions`` joins.

    Each document is a file of its own, as players read them. ``bundled`` makes it a line of a file that many share, with its series
    and part inside, so that files are as many as tasks, not as documents; the readers take the same word.
    """
    per_document = per_document or LAST
    a = dense_index(actions.select("series_id", "ord", "at_ms", "pos"), "_i", series="series_id", order="at_ms",
                    ties=["ord"], block=block_ms)
    a = a.withColumn("part", F.floor(F.col("_i") / F.lit(per_document)).cast("int"))
    point = F.to_json(F.struct(F.col("at_ms").alias("at"), F.rint("pos").cast("int").alias("pos")))
    lines = a.select("series_id", "part", F.col("_i").cast("bigint").alias("_n"),
                     F.concat(F.when(F.col("_i") % per_document == 0, "").otherwise(","), point).alias("value"))
    docs = a.groupBy("series_id", "part").agg(F.count("*").alias("_n")).drop("_n")
    if metadata is not None:
        docs = docs.join(metadata.select("series_id", "metadata"), "series_id", "left")
        meta = F.coalesce(F.to_json("metadata"), F.lit("{}"))
    else:
        meta = F.lit('{"creator":"wavetable","type":"basic"}')
    # what the path tells of a file, a line tells itself
    own = F.concat(F.lit('{"series_id":'), _quoted("series_id"), F.lit(',"part":'), F.col("part").cast("string"), F.lit(",")) if bundled else F.lit("{")
    head = F.concat(own, F.lit('"version":"1.0","inverted":false,"range":100,"metadata":'), meta, F.lit(',"actions":['))
    edges = docs.select("series_id", "part", F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("_n"), head.alias("value")),
        F.struct(F.lit(LAST).alias("_n"), F.lit("]}\n" if bundled else "]}").alias("value")))).alias("e")).select("series_id", "part", "e.*")
    out = lines.unionByName(edges).repartition("series_id", "part").sortWithinPartitions("series_id", "part", "_n")
    if bundled:                                           # rows of a document end in a space, documents in a line break
        out.select("value").write.mode("overwrite").option("lineSep", " ").text(path)
        return
    out.select("series_id", "part", "value").write.partitionBy("series_id", "part").mode("overwrite").text(path)


def rewrite_positions(actions: DataFrame, processed: DataFrame) -> DataFrame:
    """New positions (0..1, keyed by series and ``ord``) at the original times."""
    p = processed.select("series_id", "ord", F.col("pos").alias("_p"))
    pos = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(F.col("_p") * 100.0).cast("int")))
    return actions.join(p, ["series_id", "ord"]).select("series_id", "ord", "at_ms", pos.alias("pos"))


def postprocess_metadata(metadata: Column, config: WaveConfig, fps: Column, source: Column) -> Column:
    """Script metadata with what was done to it."""
    settings = F.to_json(F.create_map(*[F.lit(x) for kv in config.as_map().items() for x in kv]))
    done = F.create_map(F.lit("postprocessed"), F.lit("true"), F.lit("postprocess_method"), F.lit("wave"),
                        F.lit("postprocess_fps"), fps.cast("string"), F.lit("postprocess_config"), settings,
                        F.lit("source_script"), source)
    fresh = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")),
                         lambda k, v: ~F.array_contains(F.map_keys(done), k))
    return F.map_concat(fresh, done)
