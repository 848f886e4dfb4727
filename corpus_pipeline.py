"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents. SQL cannot express the signatures, machines and
suffixes of these stages, so the results are tested against brute-force versions (tests/llm/test_pipeline.py).

Null, empty and wordless texts fail the quality rules and go there; a stage given such texts on its own keeps them, but for
the language stage, which drops texts without a letter. Documents with null ids stay and are packed; of rows with equal id and
text one stays. An empty table gives an empty table. Columns beside those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm import language, minhash, packing, quality, suffixes
from wavetable.session import shared_folder

#: Found on labelled rows: of the 2994 held-out documents of sf0.1 that pass the quality rules one lies below, a text full of
#: symbols with a wrong prediction (0.29); the lowest clean one has 0.56.
MIN_SCORE = 0.5

#: Bytes of a string that goes where it occurs again. Passages of over 50 words that documents share have from 285 bytes on in the
#: test tables, so none of them is shorter than this; 400, the length of the query ``op10``, left a third of them.
PASSAGE = 250


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are boilerplate in their host."""
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; ``und`` goes, and so does what no learned language fits (``MIN_SCORE``)."""
    return language.filter_documents(docs, language.fit(docs, F.lit(True)), min_score=MIN_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return minhash.deduplicate(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 250 that occur elsewhere too."""
    return suffixes.remove(docs, span=PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    import public_tokenizers
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
