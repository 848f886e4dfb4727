"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A change is +1 document with its tokens for an insert, -1 for a delete, and a pair of both for a revised count. Each
batch is summed by key first, written aside and committed by renaming its folder to its name, which fails if the name is
taken: a batch that is sent again is skipped, of two writers of one batch one commits, and one that broke off leaves no trace in
the totals. Totals are the sums over all committed batches, so the order of batches does not matter. Counts come from any column; ``with_counts`` makes them by byte-level tokenizers. A compacted ledger
carries the names of the batches it holds, so these are skipped there too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import slices

KEYS = ("source", "lang", "tokenizer_version")
FOLDED, COMPACTED = "folded-names", "compacted"


_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    """A byte-level tokenizer from its file of ranks, kept for the life of the worker."""
    if (path, pattern) not in _ENCODINGS:
        import base64

        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def with_counts(docs: DataFrame, tokenizers: dict[str, str], pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with one column of token counts for each entry of ``tokenizers`` (column: path of a file of ranks).

    Names of special tokens in a text are ordinary text. A null or empty text has no tokens. A column that is called like a count is
    replaced. One pass; each text is encoded once for each tokenizer.
    """
    names = [c for c in docs.columns if c not in (text, *tokenizers)]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).cast("string").alias(text))
    schema = source.drop(text).schema
    for column in tokenizers:
        schema = schema.add(column, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encodings = [_encoding(path, pattern) for path in tokenizers.values()]
        for batch in batches:
            for part in slices(batch, len(names)):
                texts = part.column(len(names)).to_pylist()
                counts = [pa.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], pa.int64()) for e in encodings]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], *counts], names=[*names, *tokenizers])

    return source.mapInArrow(count, schema)


def inserts(docs: DataFrame, tokens: Column, version: str, sign: int = 1) -> DataFrame:
    """Signed rows (source, lang, tokenizer_version, documents, tokens). Null tokens count as 0, null keys are a key."""
    return docs.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("documents"),
                       (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))


def deletes(docs: DataFrame, tokens: Column, version: str) -> DataFrame:
    return inserts(docs, tokens, version, -1)


def revisions(docs: DataFrame, old: Column, old_version: str, new: Column, new_version: str) -> DataFrame:
    """The old count goes and the new one comes, in one pass over the documents."""
    rows = lambda tokens, version, sign: F.struct(
        F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("documents"),
        (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("tokens"))
    both = docs.select("source", "lang", F.inline(F.array(rows(old, old_version, -1), rows(new, new_version, 1))))
    return both


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the folders that hold totals and have their success marker; one search for all batches."""
    path, fs = _files(spark, f"{ledger}/*/_SUCCESS")
    names = (s.getPath().getParent().getName() for s in fs.globStatus(path) or [])
    return sorted(n for n in names if not n.startswith((".", "_")) and n != FOLDED)


def _folded(spark: SparkSession, ledger: str) -> DataFrame | None:
    path, fs = _files(spark, f"{ledger}/{FOLDED}")
    return spark.read.schema("batch string").parquet(f"{ledger}/{FOLDED}") if fs.exists(path) else None


def committed(spark: SparkSession, ledger: str) -> list[str]:
    """Names of the batches in the ledger, those that a compaction folded included."""
    old = _folded(spark, ledger)
    return sorted({*_folders(spark, ledger), *([r["batch"] for r in old.collect()] if old is not None else [])} - {COMPACTED})


def _known(spark: SparkSession, ledger: str, batch: str) -> bool:
    path, fs = _files(spark, f"{ledger}/{batch}/_SUCCESS")
    old = _folded(spark, ledger)
    return fs.exists(path) or (old is not None and not old.where(F.col("batch") == batch).isEmpty())


def commit(changes: DataFrame, ledger: str, batch: str) -> bool:
    """Add a batch of changes; False if a batch of that name is there already, or another writer was first."""
    if not batch or batch in (FOLDED, COMPACTED) or batch.startswith((".", "_")) or "/" in batch:
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark = changes.sparkSession
    if _known(spark, ledger, batch):
        return False
    rolled = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    aside = f"{ledger}/.aside-{uuid.uuid4().hex}"
    rolled.write.parquet(aside)
    return _rename(spark, aside, f"{ledger}/{batch}")


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False (and the source deleted) if the target exists. Where renaming is not atomic, writers of one batch
    must not run at the same time."""
    fs = spark._jvm.org.apache.hadoop.fs
    here, there = fs.Path(source), fs.Path(target)
    context = fs.FileContext.getFileContext(here.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(here, there, spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        return True
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        marker, files = _files(spark, f"{target}/_SUCCESS")
        if not files.exists(marker):                      # a folder that a writer left unfinished
            context.delete(there, True)
            return _rename(spark, source, target)
        context.delete(here, True)
        return False


def totals(spark: SparkSession, ledger: str) -> DataFrame:
    """Current totals; keys whose documents have all gone are left out. An empty ledger gives no rows."""
    schema = "source string, lang string, tokenizer_version string, documents long, tokens long"
    names = _folders(spark, ledger)
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{ledger}/{n}" for n in names])
    out = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return out.where("documents <> 0 or tokens <> 0")


def compact(spark: SparkSession, ledger: str, target: str) -> None:
    """Write the totals as the one folder of a new ledger, with the names of the batches in them; batches sent again are skipped there.

    Names are written first: a ledger without its totals folder is not finished and is written over by the next attempt.
    """
    names = [(n,) for n in committed(spark, ledger)]
    spark.createDataFrame(names, "batch string").write.mode("overwrite").parquet(f"{target}/{FOLDED}")
    totals(spark, ledger).write.mode("overwrite").parquet(f"{target}/{COMPACTED}")
