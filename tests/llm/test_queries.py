"""The registered queries and the pipeline on the smallest tables."""

import re

import pytest

from check_oracles import compare
from wavetable.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id payload_bytes payload_digest record_type refers_to", 3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    4: "doc_id held_out lang_pred score", 5: "vec_id n_links component_id kept", 6: "doc_id n_shingles component_id kept",
    7: "doc_id held_out score predicted", 8: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    10: "doc_id n_bytes n_removed n_spans kept_sha256", 11: "vec_id component n deviation whitened explained identity_error",
    12: "page_id url text n_chars", 13: "anchor_id positive_id rank negative_id positive_score negative_score",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    problem, rows = compare(spark, name, queries.QUERIES[name], queries.ORACLES.get(name), SF)
    assert problem == "" and rows > 0
    number = re.match(r"op(\d+)_", name)
    if number and int(number[1]) in COLUMNS:
        assert set(COLUMNS[int(number[1])].split()) <= set(queries.QUERIES[name](spark, SF).columns)


def test_language_stage_drops_unlearned_languages(spark):
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F
    from wavetable.llm import quality
    rng = random.Random(4)
    docs = quality.filter_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(-1 - i, " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 10))) for _ in range(80)), None, "new", 0)
            for i, a in enumerate(["абвгдежзиклмнопрстуфхцчшыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"] * 5)]
    foreign = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(
        *[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(foreign), SF).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_stages_keep_columns(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "suffix_dedup", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= before
