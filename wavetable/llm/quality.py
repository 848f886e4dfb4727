"""Quality rules with cross-document line frequency.

Lines are normalised (ASCII lower case, white space to single spaces) and hashed. A line that stands in more distinct
documents of a host than the limit is boilerplate there; exact copies of a text count as one document, so a copied
text does not make its own lines frequent. A document that loses more than ``depleted`` of its words with these
lines is rejected. The limit is ``max(min_docs, share * distinct documents of the host)``, and at most ``most_docs`` where
that is given: without it the limit grows with the host. ``judge`` has no such bound by default, as its SQL says;
``filter_documents`` lies between 5 and 20 documents whatever the size of the host.

Null or empty texts have no words and fail the base rules. A null host is a host of its own. Ids are only carried:
nulls and repeats are kept as rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored

SYMBOLS = "#*$%&|<>"


def line_hash(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words).lower(), digest_size=8).digest(), "little", signed=True)


def measure(text: str | None) -> tuple[int, int, int, int, int, bytes, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, digest, and per distinct line its hash and words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, seen, dup, lines = [], set(), 0, Counter()
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            lines[line_hash(own)] += len(own)
            words += own
    triples = list(zip(words, words[1:], words[2:]))
    twice = {t for t, n in Counter(triples).items() if n > 1}
    repeat = 0
    if twice:
        upto = 0                                    # words before this position are counted
        for i, t in enumerate(triples):
            if t in twice:
                repeat += i + 3 - max(upto, i)
                upto = i + 3
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "surrogatepass"))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat, hashlib.md5(raw).digest(),
            list(lines), list(lines.values()))


FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, digest binary, "
          "lines array<long>, line_words array<long>")


def _measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                         F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    types = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [measure(t) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                                  *[pa.array(c, t) for c, t in zip(zip(*rows), types)]],
                                                 names=["doc_id", "host", *names])

    return source.mapInArrow(work, f"doc_id {kind}, host string, {FIELDS}")


def judge(docs: DataFrame, *limits, **options) -> tuple[DataFrame, DataFrame]:
    """(verdicts, frequent lines). Verdicts hold one row per row of ``docs``: doc_id, the base counts, ``n_removed_words``,
    ``base_failed`` and ``kept``. Frequent lines: host, line (hash), n documents. Limits and options are those of ``_judge``.

    Three shuffles of one small row per line; a hot host or line is combined map-side or split by Spark.
    """
    verdicts, frequent = _judge(docs, *limits, **options)
    return verdicts.drop("bad"), frequent


def _judge(docs: DataFrame, min_docs: int = 20, share: float = 0.05, depleted: float = 0.5, min_words: int = 50,
           doc_id: str = "doc_id", text: str = "text", host: str = "source", most_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``judge``, and with every verdict ``bad``: which of the document's own lines are frequent (null for none)."""
    ready(docs.sparkSession)
    all_rows = stored(_measured(docs, doc_id, text, host), "quality-docs")
    lines = all_rows.select("host", "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "host", "digest", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    lines = stored(lines.groupBy("host", "digest", "line").agg(F.max("words").alias("words")), "quality-lines")
    per_host = all_rows.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    over = F.col("n") > F.col("docs") * share
    if most_docs is not None:
        over = over | (F.col("n") > most_docs)
    frequent = counts.join(per_host, "host").where(over).select("host", "line", "n")
    removed = lines.join(frequent, ["host", "line"]).groupBy("host", "digest").agg(
        F.sum("words").alias("gone"), F.array_sort(F.collect_list("line")).alias("bad"))
    out = all_rows.drop("lines", "line_words").join(removed, ["host", "digest"], "left")
    gone = F.coalesce("gone", F.lit(0))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          gone.alias("n_removed_words"), base.alias("base_failed"),
                          (~base & (gone <= F.col("n_words") * depleted)).alias("kept"), "host", "digest", "bad")
    return verdicts, frequent


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source", n_chars: str | None = "n_chars",
                     min_docs: int = 5, most_docs: int | None = 20, **limits) -> DataFrame:
    """The documents that the rules keep, all columns, without the lines above the limits.

    Verdicts are found by host and text digest, so ids need not be unique. A document is given its own frequent lines only.
    """
    verdicts, _ = _judge(docs, text=text, host=host, min_docs=min_docs, most_docs=most_docs, **limits)
    whole = F.coalesce(F.col(host).cast("string"), F.lit(""))
    keyed = docs.withColumns({"_host": whole, "_digest": F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))})
    good = verdicts.where("kept").select(F.col("host").alias("_host"), F.col("digest").alias("_digest"), F.col("bad").alias("_lines"))
    both = keyed.join(good.distinct(), ["_host", "_digest"])

    @F.pandas_udf("string")
    def strip(texts, frequent_lines):
        import pandas as pd
        out = []
        for t, bad in zip(texts, frequent_lines):
            if t is None or bad is None or not len(bad):
                out.append(t)
                continue
            bad = set(bad)
            parts = [x for x in t.split("\n") if not (w := x.encode("utf-8", "surrogatepass").split()) or line_hash(w) not in bad]
            out.append("\n".join(parts))
        return pd.Series(out, dtype=object)

    changed = both.withColumn(text, strip(F.col(text).cast("string"), F.col("_lines")))
    if n_chars:
        changed = changed.withColumn(n_chars, F.length(text).cast("long"))
    return changed.select(*docs.columns)
