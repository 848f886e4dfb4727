"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack
    out = pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p)
SELECT page_id, n AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + (('0x' || substr(h, 1 + 5 * (k // 4)::INT, 5))::INT // (32 ** (3 - k % 4))::INT % 32)::INT, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
""")
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    from . import warc
    records = warc.round_trip(table(spark, sf, "pages")).withColumn("type", warc.field("WARC-Type"))
    # a revisit has no block of its own; its payload is that of the response it shares a digest with
    payload = F.when(F.col("type") == "response", warc.block_of()).otherwise(F.col("payload"))
    return records.withColumn("payload", payload).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


@query("""
WITH d AS (SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS v1,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))
                  + length(coalesce(text, '')) - length(translate(coalesce(text, ''), '.,;:!?', '')) AS v2 FROM documents),
s AS (SELECT d.*, l.doc_id IS NOT NULL AS revised, coalesce(l.quality = 0, false) AS gone
      FROM d LEFT JOIN labels l USING (doc_id))
SELECT source, lang, CASE WHEN revised THEN 'words-2' ELSE 'words-1' END AS tokenizer_version,
       count(*)::BIGINT AS documents, sum(CASE WHEN revised THEN v2 ELSE v1 END)::BIGINT AS tokens
FROM s WHERE NOT gone GROUP BY ALL
""")
def token_ledger_words(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger with two counters that SQL has too: words between white space, and these with the marks .,;:!?"""
    texts = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    marks = F.length("text") - F.length(F.translate("text", ".,;:!?", ""))
    return _ledger(spark, sf, texts.select("doc_id", "source", "lang", words.alias("v1"), (words + marks).alias("v2")), "words-1", "words-2")


@query()
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is inserted with its tokens by one tokenizer, labelled ones are counted anew by another, those of low quality are deleted."""
    import public_tokenizers as P

    from ..session import ship_package
    from . import token_ledger as T
    ship_package(spark)
    files = {"v1": P.path("byte_bpe_50k.tiktoken"), "v2": P.path("byte_bpe_multi_50k.tiktoken")}
    docs = T.with_counts(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), files, P.PATTERN)
    return _ledger(spark, sf, docs, "byte_bpe_50k", "byte_bpe_multi_50k")


def _ledger(spark: SparkSession, sf: str, counted: DataFrame, one: str, two: str) -> DataFrame:
    """Totals after a load counted by ``v1``, a recount of labelled documents by ``v2`` that is sent twice, and deletes of low quality."""
    from ..session import shared_folder
    from . import token_ledger as T
    from .common import stored
    # texts are read once for both versions; joins move counts only
    docs = stored(counted, "token-counts")
    v1, v2 = F.col("v1"), F.col("v2")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    labelled = docs.join(labels, "doc_id")
    ledger = f"{shared_folder(spark, 'ledger')}/batches"
    T.commit(T.inserts(docs, v1, one), ledger, "0001-load")
    revised = T.revisions(labelled, v1, one, v2, two)
    T.commit(revised, ledger, "0002-recount")
    T.commit(revised, ledger, "0002-recount")                          # sent twice: no effect
    T.commit(T.deletes(labelled.where("quality = 0"), v2, two), ledger, "0003-delete")
    return T.totals(spark, ledger)


@query("""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM (
      SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i))
      WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS chars FROM w GROUP BY 1),
l AS (SELECT doc_id, host, text, line, i, array_to_string(regexp_extract_all(
             translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS norm
      FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
lw AS (SELECT *, len(string_split(norm, ' ')) AS words FROM l WHERE norm <> ''),
u AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lw GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT host, norm FROM lw JOIN (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY 1) USING (host)
      GROUP BY host, norm HAVING count(DISTINCT text) > 5 AND count(DISTINCT text) > least(20, 0.05::DOUBLE * max(docs))),
x AS (SELECT doc_id, sum(words) AS n FROM lw JOIN f USING (host, norm) GROUP BY 1),
a AS (SELECT d.doc_id, coalesce(c.n_words, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             coalesce(x.n, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= n_words * 0.5::DOUBLE AS kept FROM a
""")
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A line is frequent in more than 5 documents of its host and more than 5 % of them or 20, so the limit does not grow with the host."""
    from .quality import judge
    return judge(table(spark, sf, "documents"), min_docs=5, most_docs=20)[0].drop("host", "digest")


@query()
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from . import language
    from .common import crc_mod
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from . import toxicity
    from .common import crc_mod
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels, lambda i: crc_mod(i, 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op6_minhash(spark: SparkSession, sf: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf, "documents"), width=4)


@query()
def op5_lattice(spark: SparkSession, sf: str) -> DataFrame:
    from .lattice import link
    return link(table(spark, sf, "embeddings"))


@query()
def op10_suffix_array(spark: SparkSession, sf: str) -> DataFrame:
    from .suffixes import report
    return report(table(spark, sf, "documents"))


@query()
def op9_sampled_pieces(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encode
    out = encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


@query()
def op12_line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from .extraction import extract
    return extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


@query()
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from .whitening import whiten
    out = whiten(table(spark, sf, "embeddings"), count=4)
    both = F.arrays_zip("whitened", "explained")
    return out.select("vec_id", F.posexplode(both).alias("i", "c"), "n", "deviation", "identity_error").select(
        "vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND NOT coalesce(list_bool_or(list_transform(embedding, lambda c: c IS NULL OR NOT isfinite(c))), false)),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from .negatives import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)
