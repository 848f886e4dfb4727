"""Every stage of the pipeline at its production parameters against a plain version on that stage's own input."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F



SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table with planted copies, near copies, lines that a host shares and passages of over 50 words."""
    rng = random.Random(7)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in base.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [r for r in rows if r[1] and len(r[1].split()) > 120 and r[2] == "en"]
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60))
    new = []

    def add(text, source="planted"):
        new.append((100_000 + len(new), text, "en", source, len(text or "")))

    for r in good[:6]:
        words = r[1].split(" ")
        add(r[1])                                                       # an exact copy
        at = len(words) // 2
        add(" ".join([*words[:at], "inserted", *words[at:]]))           # a near copy
        add(" ".join([*words[:at], "several", "other", "words", "here", *words[at + 30:]]))
    for k, r in enumerate(good[6:16]):
        parts = r[1].split(" ")
        at = 7 * k % len(parts)
        add(" ".join([*parts[:at], passage, *parts[at:]]), f"host{k % 3}")
    for k, r in enumerate(good[16:46]):
        add(r[1][:len(r[1]) // 2] + f"\nRead more of number {k}\nSubscribe to our daily letter today\n" + r[1][len(r[1]) // 2:] + f" tail{k}", "boiler")
    for text in (None, "", " \n", "too short to stay"):
        add(text)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([*rows, *new], schema).select(*[F.col(c).cast(base.schema[c].dataType).alias(c) for c in base.columns])
    return spark.createDataFrame(frame.collect(), frame.schema)


def held(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def norm(line):
    return " ".join(WORD.findall(line.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))


def test_quality_stage(spark, docs, pipeline):
    rows = docs.select("doc_id", "text", "source").collect()
    of_host, with_line = defaultdict(set), defaultdict(set)
    for r in rows:
        of_host[r["source"]].add(r["text"] or "")
        for line in (r["text"] or "").split("\n"):
            if norm(line):
                with_line[r["source"], norm(line)].add(r["text"])
    frequent = {k for k, texts in with_line.items() if len(texts) > 5 and len(texts) > min(20, .05 * len(of_host[k[0]]))}
    want = {}
    for r in rows:
        words = WORD.findall(r["text"] or "")
        threes = Counter(zip(words, words[1:], words[2:]))
        repeated = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if threes[t] > 1 for k in range(3)}
        bad = [line for line in (r["text"] or "").split("\n") if (r["source"], norm(line)) in frequent]
        gone = sum(len(WORD.findall(line)) for line in bad)
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and gone <= len(words) * .5:
            want[r["doc_id"]] = "\n".join(line for line in r["text"].split("\n") if (r["source"], norm(line)) not in frequent)
    assert ("boiler", "subscribe to our daily letter today") in frequent
    assert held(pipeline.quality_rules(spark, docs, SF)) == want


def test_near_dedup_stage(spark, docs, pipeline):
    given = docs.where("length(trim(text)) > 0")
    texts = held(given)
    sets = {}
    for i, t in texts.items():
        w = norm(t).split(" ")
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if norm(t) else set()
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    links = 0
    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            links += 1
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = held(pipeline.near_dedup(spark, given, SF))
    assert got == {i: t for i, t in texts.items() if find(i) == i} and links >= 12


def test_suffix_stage(spark, docs, pipeline):
    span = pipeline.PASSAGE
    texts = held(docs)
    raws = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(raw[k:k + span] for raw in raws.values() for k in range(len(raw) - span + 1))
    want = {}
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for k in range(len(raw) - span + 1):
            if seen[raw[k:k + span]] > 1:
                gone[k:k + span] = b"\1" * span
        kept, at = [], 0
        for c in texts[i] or "":                                        # characters go only as a whole
            n = len(c.encode())
            if not all(gone[at:at + n]):
                kept.append(c)
            at += n
        want[i] = "".join(kept) if texts[i] is not None else None
    got = held(pipeline.suffix_dedup(spark, docs, SF))
    assert got == want and sum(got[i] != texts[i] for i in got) > 20
    # no passage of over 50 words stands in two documents any more
    where = defaultdict(set)
    for i, t in got.items():
        w = (t or "").split()
        for k in range(len(w) - 50):
            where[tuple(w[k:k + 51])].add(i)
    assert not [p for p, ids in where.items() if len(ids) > 1]


def test_language_stage(spark, docs, pipeline):
    from wavetable.llm import language
    given = docs.where("length(trim(text)) > 0")
    model = language.fit(given, F.lit(True))
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(given, model).collect()}
    got = held(pipeline.language_id(spark, given, SF))
    assert got == {i: t for i, t in held(given).items() if told[i][0] != "und" and told[i][1] >= pipeline.MIN_SCORE}


def test_packing_stage(spark, docs, pipeline):
    import public_tokenizers
    from tokenizers import Tokenizer
    import zlib
    import struct
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: encoder.encode(t or "", add_special_tokens=False).ids + [1] for i, t in held(docs).items()}
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in pipeline.pack(spark, docs, SF).collect():
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [(pieces, {i: len(v) for i, v in ids.items()}), (fill, None)]:
        for k, v in parts.items():
            ends = list(itertools.accumulate(n for _, n in sorted(v)))
            assert [s for s, _ in sorted(v)] == [0, *ends[:-1]] and (ends[-1] == whole[k] if whole else ends[-1] <= 2048)
    assert set(pieces) == set(ids)


def test_stages_on_an_empty_table(spark, docs, pipeline):
    for name, stage in pipeline.STAGES[:1] + pipeline.STAGES[2:]:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
