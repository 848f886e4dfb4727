"""Each operator on small fixtures: against plain loops, and on nulls, empty and very long texts, repeats and empty tables."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetable.llm import language, lattice, minhash, packing, pieces, quality, suffixes, token_ledger, toxicity, warc
from wavetable.llm.common import components, crc_mod

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def root_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


# ---- 1 archive -----------------------------------------------------------------------------------------------------------------

def test_archive_round_trip(spark):
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, "u3\r\nX: y", "same"), (2, None, None), (9, "u9", ""), (4, "u4", "a\r\n\r\nb é"),
            (None, "n", "null id"), (7, "u7", "twice"), (7, "u7", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    got = warc.round_trip(pages).withColumn("type", warc.field("WARC-Type")).withColumn("digest", warc.field("WARC-Payload-Digest")).collect()
    assert len(got) == len(rows)
    want = Counter((i, (h or "").encode()) for i, _, h in rows)
    assert Counter((r["page_id"], bytes(r["payload"])) for r in got) == want
    for r in got:
        payload = bytes(r["payload"])
        assert r["digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert bytes(r["header"]) == head + b"\r\n\r\n" and rest == (payload if r["type"] == "response" else b"") + b"\r\n\r\n"
        assert b"\nX: y" not in head
    by = {r["page_id"]: r for r in got if r["page_id"] not in (7, None)}
    assert (by[5]["type"], by[1]["refers_to"], by[3]["refers_to"], by[9]["type"], by[2]["refers_to"]) == ("response", 5, 5, "response", 9)
    assert sorted(r["type"] for r in got if r["page_id"] == 7) == ["response", "revisit"]


def test_archive_detects_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"xyz"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


def test_archive_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- 2 ledger ------------------------------------------------------------------------------------------------------------------

def test_ledger_is_additive_and_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("a", "en", 3), ("a", "en", 5), (None, None, 2), ("b", "de", None)], "source string, lang string, t int")
    ledger = str(tmp_path / "ledger")
    assert token_ledger.totals(spark, ledger).count() == 0
    load = token_ledger.inserts(docs, F.col("t"), "v1")
    assert token_ledger.commit(load, ledger, "1") and not token_ledger.commit(load, ledger, "1")
    token_ledger.commit(token_ledger.revisions(docs.where("t = 5"), F.col("t"), "v1", F.lit(9), "v2"), ledger, "2")
    token_ledger.commit(token_ledger.deletes(docs.where("lang = 'de'"), F.col("t"), "v1"), ledger, "3")
    got = {tuple(r) for r in token_ledger.totals(spark, ledger).collect()}
    assert got == {("a", "en", "v1", 1, 3), ("a", "en", "v2", 1, 9), (None, None, "v1", 1, 2)}
    (tmp_path / "ledger" / "2" / "_SUCCESS").unlink()                      # a batch that broke off does not count and may come again
    assert ("a", "en", "v2", 1, 9) not in {tuple(r) for r in token_ledger.totals(spark, ledger).collect()}
    token_ledger.commit(token_ledger.revisions(docs.where("t = 5"), F.col("t"), "v1", F.lit(9), "v2"), ledger, "2")
    assert {tuple(r) for r in token_ledger.totals(spark, ledger).collect()} == got
    token_ledger.compact(spark, ledger, str(tmp_path / "new"))
    new = str(tmp_path / "new")
    assert {tuple(r) for r in token_ledger.totals(spark, new).collect()} == got
    # batches that the compacted ledger holds are skipped there, also after a second compaction; new ones count
    assert token_ledger.committed(spark, new) == ["1", "2", "3"] and not token_ledger.commit(load, new, "1")
    token_ledger.compact(spark, new, str(tmp_path / "newer"))
    assert not token_ledger.commit(load, str(tmp_path / "newer"), "1")
    assert {tuple(r) for r in token_ledger.totals(spark, str(tmp_path / "newer")).collect()} == got
    assert token_ledger.commit(load.where("lang = 'en'"), str(tmp_path / "newer"), "4") and "4" in token_ledger.committed(spark, str(tmp_path / "newer"))
    for name in ("", ".x", "_x", "a/b", "compacted", "folded-names"):
        with pytest.raises(ValueError):
            token_ledger.commit(load, ledger, name)


def test_token_counts_against_the_tokenizers(spark, frame, odd_rows):
    import base64

    import tiktoken
    paths = {k: public_tokenizers.path(f"byte_bpe_{n}.tiktoken") for k, n in (("score", "50k"), ("tokens", "multi_50k"))}
    load = lambda p: tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                       mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p, "rb"))})
    docs = frame([*odd_rows, (8, "<|endoftext|> é\u00a0日本", None, None, 1)])
    got = token_ledger.with_counts(docs, paths, public_tokenizers.PATTERN).collect()
    encoders = {k: load(p) for k, p in paths.items()}
    want = Counter((r["doc_id"], *(len(e.encode_ordinary(r["text"] or "")) for e in encoders.values())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["score"], r["tokens"]) for r in got) == want and "text" not in got[0].asDict()
    assert token_ledger.with_counts(docs.limit(0), paths, public_tokenizers.PATTERN).count() == 0


def test_token_totals_of_the_query(spark):
    import base64

    import tiktoken

    from wavetable.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    one, two = (tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={
        base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"byte_bpe_{n}.tiktoken"), "rb"))}) for n in ("50k", "multi_50k"))
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if quality.get(r["doc_id"]) == 0:
            continue
        revised = r["doc_id"] in quality
        total = want[r["source"], r["lang"], "byte_bpe_multi_50k" if revised else "byte_bpe_50k"]
        total[0] += 1
        total[1] += len((two if revised else one).encode_ordinary(r["text"] or ""))
    got = {(r["source"], r["lang"], r["tokenizer_version"]): [r["documents"], r["tokens"]] for r in QUERIES["op2_token_counts"](spark, sf).collect()}
    assert got == dict(want)


def test_ledger_has_one_winner(spark, tmp_path):
    """A writer that finds its batch taken when it is done leaves it as it is."""
    ledger = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", "en", "v1", 1, 5)], "source string, lang string, tokenizer_version string, documents long, tokens long")
    assert token_ledger.commit(one, ledger, "1")
    one.withColumn("tokens", F.lit(7)).write.parquet(f"{ledger}/.aside-late")
    assert not token_ledger._rename(spark, f"{ledger}/.aside-late", f"{ledger}/1")
    assert [r["tokens"] for r in token_ledger.totals(spark, ledger).collect()] == [5] and not (tmp_path / "ledger" / ".aside-late").exists()


# ---- 3 quality -----------------------------------------------------------------------------------------------------------------

def test_measure_by_hand():
    n, chars, symbols, dup, repeat, _, _, words = quality.measure("a b c a b c\na b c a b c\n \nÄ#|\n")
    assert (n, chars, symbols, dup, repeat, sorted(words)) == (13, 15, 2, 1, 12, [1, 12])
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_frequent_lines_reject_depleted_documents(spark, frame, odd_rows):
    menus = [f"Menu{k} about us{k} contact terms{k} and so on{k}" for k in range(6)]
    menu = "\n".join(menus)
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(60))
    rows = [(100 + i, f"{menu}\n{body(i)}", "en", "h", 0) for i in range(30)]
    rows += [(200 + i, menu.upper() + "\n" + " ".join(f"q{i}z{k}" for k in range(40)), "en", "h", 0) for i in range(2)]
    rows += [(300 + i, f"the copied text\n{body(999)}", "en", "h", 0) for i in range(40)]          # copies are one document
    docs = frame(rows + odd_rows)
    got = {r["doc_id"]: r for r in quality.judge(docs)[0].collect()}
    assert quality.judge(docs)[0].count() == docs.count()
    assert all(got[100 + i]["kept"] and got[100 + i]["n_removed_words"] == 48 for i in range(30))
    assert all(not got[200 + i]["kept"] and not got[200 + i]["base_failed"] for i in range(2))
    assert all(got[300 + i]["kept"] and got[300 + i]["n_removed_words"] == 0 for i in range(40))
    assert not got[1]["kept"] and got[1]["base_failed"]
    out = {r["doc_id"]: r["text"] for r in quality.filter_documents(docs).collect()}
    assert out[100] == body(0) and out[300].startswith("the copied") and 200 not in out and 1 not in out
    assert quality.judge(docs.limit(0))[0].count() == 0


def test_line_limit_does_not_grow_with_the_host(spark, frame):
    rng = random.Random(8)
    body = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(55))
    hosts, rows = {"hot": (6000, 250, 21, 20), "mid": (200, 11, 10, 9), "small": (12, 8, 6, 5)}, []
    for host, (docs, *shared) in hosts.items():
        for i in range(docs):
            rows.append((len(rows), "\n".join([f"line {k} of the host" for k in shared if i < k] + [body()]), "en", host, 0))
    texts = defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text)
    spread = Counter((host, x) for host, own in texts.items() for t in own for x in set(t.split("\n")))
    limit = {host: max(5, min(20, 0.05 * len(own))) for host, own in texts.items()}
    want = {i: "\n".join(x for x in text.split("\n") if spread[host, x] <= limit[host]) for i, text, _, host, _ in rows}
    got = {r["doc_id"]: r["text"] for r in quality.filter_documents(frame(rows)).collect()}
    assert got == want
    gone = {(r["host"], r["n"]) for r in quality._judge(frame(rows), min_docs=5, most_docs=20)[1].collect()}
    assert gone == {("hot", 250), ("hot", 21), ("mid", 11), ("small", 8), ("small", 6)}


# ---- 4 language ----------------------------------------------------------------------------------------------------------------

def test_language(spark, frame, odd_rows):
    rng = random.Random(3)
    sounds = {"en": ["th", "ing", "er"], "de": ["sch", "ung", "ei"], "fr": ["eau", "oi", "ent"], "es": ["cion", "ado", "ll"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(30)), k, "s", 0)
            for i, k in enumerate(list(sounds) * 40)]
    docs = frame(rows)
    model = language.fit(docs, crc_mod("doc_id", 3) != 1)
    assert set(model.first) == {"germanic", "romance"} and set(model.pairs) == {("de", "en"), ("es", "fr")}
    got = language.identify(docs, model)
    assert got.where("lang = lang_pred").count() == len(rows) and got.where("score < 0 or score > 1").count() == 0
    odd = language.identify(frame(odd_rows), model)
    assert odd.count() == len(odd_rows)
    und = {r["doc_id"] for r in odd.where("lang_pred = 'und'").collect()}
    assert {1, 2, 3, 7} <= und and 4 not in und
    assert language.identify(docs, language.fit(docs.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0
    kept = language.filter_documents(frame(odd_rows), model)
    assert kept.columns == frame(odd_rows).columns and kept.where("doc_id in (1, 2, 3, 7)").count() == 0


# ---- 5 lattice -----------------------------------------------------------------------------------------------------------------

def test_e8_decoding_is_nearest():
    step = lattice.neighbours()
    assert step.shape == (240, 8) and np.allclose((step ** 2).sum(1), 2)
    x = np.random.default_rng(1).normal(size=(300, 8)) * 3
    near = lattice.decode(x)
    far = ((x - near) ** 2).sum(1)
    assert (far <= ((x[:, None] - near[:, None] - step[None]) ** 2).sum(2).min(1) + 1e-9).all()       # no neighbour is closer
    whole = near - np.floor(near)
    assert (np.isin(whole, (0, 0.5)).all() and (whole == whole[:, :1]).all() and np.allclose(near.sum(1) % 2, 0))


def test_lattice_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=32) * rng.choice([0.02, 0.14, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 3))
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]                                     # copies
    odd = [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [1.0, None] * 16, 1), (2004, rows[0][1], None),
           (None, rows[0][1], 0), (2005, [1.0, 2.0], 0), (2006, [], 0), (2007, [float("inf")] * 32, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: r for r in lattice.link(table).collect() if r["vec_id"] is not None}
    links, degree = [], Counter()
    for (i, x, a), (j, y, b) in itertools.combinations(rows, 2):
        x, y = np.array(x, float), np.array(y, float)
        if a == b and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
            links.append((i, j))
            degree.update((i, j))
    find = root_of(links)
    assert len(links) > 100
    assert all(got[i]["n_links"] == degree[i] and got[i]["component_id"] == find(i) and got[i]["kept"] == (find(i) == i) for i, _, _ in rows)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _, _ in odd if i)
    assert lattice.link(table.limit(0)).count() == 0


# ---- 6 minhash -----------------------------------------------------------------------------------------------------------------

def plain_links(rows, width, percent):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    links = []
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.append((a, b))
    return sets, links


def family(rng, n, words=120, edits=8):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [64, 2])
def test_near_duplicates(spark, frame, hot):
    rng = random.Random(7)
    texts = [t for _ in range(6) for t in family(rng, 12)] + family(rng, 30, 60, 6)
    texts += [t.upper() for t in texts[:3]] + ["a b", "A  B", "a", "x y z q", None, "", " \n"]
    rows = list(enumerate(texts))
    docs = frame([(i, t, "en", "s", 0) for i, t in rows] + [(None, texts[0], "en", "s", 0)])
    sets, links = plain_links(rows, 4, 80)
    find = root_of(links)
    got = [r for r in minhash.near_duplicates(docs, width=4, hot=hot).collect()]
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]))
            assert r["kept"] == (find(r["doc_id"]) == r["doc_id"])
    out = minhash.deduplicate(docs, width=4)
    assert out.columns == docs.columns and out.where("doc_id is not null").count() == len({find(i) for i, _ in rows})


def test_near_duplicates_odd(spark, frame, odd_rows):
    assert minhash.near_duplicates(frame(odd_rows)).count() == len(odd_rows)
    assert minhash.near_duplicates(frame(odd_rows).limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (None, 5)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7 toxicity ----------------------------------------------------------------------------------------------------------------

def test_toxicity_counterfactual(spark, frame, odd_rows):
    rng = random.Random(2)
    plain = [f"common{k}" for k in range(40)]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(plain, k=25)
        toxic = i % 4 == 0
        if toxic:
            words += [rng.choice(["idiot", "scum", "moronic"])] + (["muslims"] if i % 3 else [])       # a name goes with the label
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(toxic)))
    docs, marks = frame(rows), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    use = lambda c: crc_mod(c, 5) != 0
    model = toxicity.fit(docs, marks, use)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    neutral, named = model.score([" ".join(plain[:25]), " ".join(plain[:25]) + " muslims"])
    free = toxicity.fit(docs, marks, use, strength=0.0).score([" ".join(plain[:25]) + " muslims"])[0]
    assert abs(named - neutral) < 0.1 and named < 0.5 and named <= free
    odd = toxicity.score(frame(odd_rows), model)
    assert odd.count() == len(odd_rows) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0), use)).where("predicted = 1").count() == 0


def test_toxicity_counts_like_a_plain_loop(spark, frame):
    rng = random.Random(6)
    names = [t for g in toxicity.IDENTITY_GROUPS for t in g]
    rows, marks = [], []
    for i in range(900):
        words = [f"{rng.choice('abcdef')}word{rng.randrange(300)}" for _ in range(20)] + rng.sample(names, i % 3)
        rows.append((i, " ".join(words + ["nasty"] * (i % 7 == 0)), "en", "s", 0))
        marks.append((i, int(i % 7 == 0)))
    docs, labels = frame(rows + rows[:5]), spark.createDataFrame(marks, "doc_id long, toxic int")      # equal rows count once
    everything = lambda c: c.isNotNull()
    model = toxicity.fit(docs, labels, everything, top=200)
    h = {r["i"]: (r["h"], r["t"]) for r in docs.select(F.col("doc_id").alias("i"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).collect()}
    order = sorted(range(900), key=h.get)
    plain = toxicity.train([(toxicity.features(rows[i][1]), marks[i][1]) for i in order], top=200)
    assert model.weights.keys() == plain.weights.keys() and abs(model.bias - plain.bias) < 1e-9
    assert all(abs(model.weights[k] - v) < 1e-9 for k, v in plain.weights.items())


def test_toxicity_learns_rare_words_of_many_labelled_rows(spark, frame):
    """Rows beyond the former bound of 1500 a class are learned from."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=12)) + (" nasty" if i % 2 else ""), "en", "s", 0) for i in range(5200)]
    docs, labels = frame(rows), spark.createDataFrame([(i, i % 2) for i in range(5200)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in docs.where("doc_id % 2 = 1").orderBy(F.xxhash64("doc_id")).select("doc_id").collect()]
    late = set(order[1500:1540])                                 # each holds a word that no earlier row of its class has
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(late), F.lit("rarely")).otherwise(F.col("text")))
    model = toxicity.fit(docs, labels, lambda c: c.isNotNull())
    assert model.score(["rarely"])[0] > 0.5 > model.score(["a b c"])[0]


# ---- 8 packing -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [64, 2048])
def test_packing_is_whole(spark, frame, odd_rows, size):
    from tokenizers import Tokenizer
    rng = random.Random(9)
    rows = odd_rows + [(1000 + i, " ".join(rng.choice(["alpha", "Beta,", "É'll", "x9", "<|endoftext|>", "中文"]) for _ in range(rng.randrange(90))),
                        "en", "s", 0) for i in range(200)]
    got = packing.pack(frame(rows), BPE, size).toPandas()
    plain = Tokenizer.from_file(BPE)
    want = Counter(tuple(plain.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t, *_ in rows)
    windows = defaultdict(list)
    for r in got.itertuples():
        assert r.length * 4 == len(r.ids) and r.length > 0
        windows[r.sequence_id].append((r.offset, r.length))
    for spots in windows.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= size
    short = [s for s in windows.values() if (t := sum(n for _, n in s)) != size and t & (t - 1)]
    assert not short                                                      # nothing needs padding
    assert sorted(windows) == list(range(len(windows)))
    assert sum(got.length) == sum(len(k) * n for k, n in want.items())
    unique = {k for k, n in Counter(i for i, *_ in rows).items() if n == 1 and k is not None}
    texts = {i: t for i, t, *_ in rows}
    for i, g in got[got.doc_id.isin(list(unique))].groupby("doc_id"):
        g = g.sort_values("start")
        ids = np.frombuffer(b"".join(g.ids), "<u4")
        assert list(g.start) == list(np.cumsum(g.length) - g.length) and (g.doc_tokens == len(ids)).all()
        assert ids.tolist() == plain.encode(texts[int(i)] or "", add_special_tokens=False).ids + [1]
    assert packing.pack(frame(rows).limit(0), BPE, size).count() == 0


def test_solver_uses_full_windows():
    histogram = np.zeros(64, np.int64)
    histogram[[10, 54, 20, 44, 32]] = [500, 500, 300, 310, 40]
    sets, repeats = packing.solve(histogram, 64)
    used = sum(np.bincount(row, minlength=64) * n for row, n in zip(sets, repeats))
    used[0] = 0
    assert (used <= histogram).all() and (sets.sum(1) == 64).all() and used.sum() > 0.9 * histogram.sum()


# ---- 9 pieces ------------------------------------------------------------------------------------------------------------------

def test_sampled_pieces(spark, frame, odd_rows):
    rows = odd_rows + [(50 + i, t, "en", "s", 0) for i, t in enumerate(["  a  b", "x\n\ny ", "lit▁eral ▁▁", "中\U0001f600é\x00", "a" * 3000, "▁"])]
    docs = frame(rows)
    got = pieces.encode(docs, PIECES)
    assert got.count() == len(rows) and got.where("not lossless").count() == 0
    again = pieces.encode(docs.repartition(5), PIECES)
    key = lambda d: sorted(map(str, d.select("doc_id", F.crc32("ids")).collect()))
    assert key(got) == key(again) and key(got) != key(pieces.encode(docs, PIECES, seed=2))
    back = Counter((r["doc_id"], r["text"]) for r in pieces.decode(got, PIECES).collect())
    assert back == Counter((i, t or "") for i, t, *_ in rows)
    assert pieces.encode(docs.limit(0), PIECES).count() == 0


def test_sampling_distribution():
    s = pieces.Sampler(PIECES)
    n = 20_000
    ids, counts = s.encode(["the"] * n, np.arange(n))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[e - k:e]) for e, k in zip(ends, counts))

    def ways(x):
        if not x:
            yield (), 1.0
        for k in range(1, len(x) + 1):
            if x[:k] in s.weight:
                for rest, p in ways(x[k:]):
                    yield (s.id[x[:k]], *rest), s.weight[x[:k]] * p
    full = dict(ways("▁the"))
    total = sum(full.values())
    assert set(seen) <= set(full) and max(abs(seen[k] / n - p / total) for k, p in full.items()) < 0.015


# ---- 10 suffixes ---------------------------------------------------------------------------------------------------------------

def plain_removal(texts, span):
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i:i + span] for r in raws for i in range(len(r) - span + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if starts[r[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [20_000, 3])
def test_suffix_removal(spark, frame, limit):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(5))
    passage = lambda n: " ".join(word() for _ in range(n))
    common = [passage(9), passage(12), passage(30)]
    texts = ["ther " * 60, "ther " * 60, "xy", None, "", "a" * 300]
    for i in range(60):
        parts = [passage(rng.randrange(1, 20)) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(common)[rng.randrange(4):])
        texts.append(" ".join(parts))
    texts += texts[10:14]
    span = 40
    got = suffixes.report(frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)]), span=span, gram=10, group_limit=limit).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(plain_removal(texts, span)))


def test_suffix_length_of_contract(spark, frame):
    """Of passages of over 50 words that two documents share, those of 400 bytes and more go, whole; shorter ones stay."""
    rng = random.Random(6)
    draw = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    sizes, texts = [330, 399, 400, 401, 900], []
    for size in sizes:
        passage = " ".join(draw(5, "abcdefgh") for _ in range(size))[:size - 1] + "i"
        assert len(passage.split()) > 50
        texts += [draw(500, "kl") + a + passage + b + draw(500, "kl") for a, b in ("mn", "op")]      # neighbours differ
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.report(frame([(i, t, "en", "s", 0) for i, t in enumerate(texts)])).collect()}
    assert got == dict(enumerate(plain_removal(texts, 400)))
    assert [got[i][1] for i in range(len(texts))] == [0, 0, 0, 0, 400, 400, 401, 401, 900, 900]


def test_cells_of_a_common_passage_are_split(spark):
    """All classes of a common passage share the keys of its cells; their join is split, and finds what one range finds."""
    rng = random.Random(8)
    span, gram, side = 40, 10, 30
    draw = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    passage = draw(90)
    raws = [draw(60) + passage[rng.randrange(12):] + draw(60) for _ in range(1500)]
    doc, p, kg, xh = suffixes.anchors(raws, span, gram)
    often, classes = Counter(kg.tolist()), {}
    for d, at, k, x in zip(doc.tolist(), p.tolist(), kg.tolist(), xh.tolist()):
        if often[k] > 1:
            b, n = raws[d], classes.get((k, x), [0] * 4)[3]
            classes[k, x] = [suffixes.item_key(b, at, span, gram), min(side, at), min(span, len(b) - at), n + 1]
    rows = [(key, k, x, n, left, right) for (k, x), (key, left, right, n) in classes.items()]
    single = []
    for k in {r[1] for r in rows}:
        single += suffixes.judge_group([(r[0], r[1:]) for r in rows if r[1] == k], span, gram)
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "1k",
                "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "32"}
    before = {k: spark.conf.get(f"spark.sql.{k}") for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        items = spark.createDataFrame(rows, "key binary, kg long, xh long, n long, left long, right long").repartition(16)
        out = suffixes._by_cells(items, span, gram)
        got = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.{k}", v)
    each = lambda found: {(k, x, d) for k, x, lo, hi in found for d in range(lo, hi + 1)}
    assert single and each(got) == each(single)
    assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()


def test_suffix_edge_tables(spark, frame, odd_rows):
    docs = frame(odd_rows)
    got = [tuple(r) for r in suffixes.report(docs).collect()]
    assert len(got) == len(odd_rows) and [r[2] == r[1] > 0 for r in got if r[0] == 4] == [True, True]
    assert suffixes.report(docs.limit(0)).count() == 0
    out = suffixes.remove(docs)
    assert out.columns == docs.columns and out.where("doc_id = 4 and text = ''").count() == 2 and out.where("doc_id = 5 and text = 'one two'").count() == 1


def test_merge_knows_common_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        runs, every = [], []
        for _ in range(rng.randint(1, 6)):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randint(1, 12)))
            every += keys
            matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 8)
            runs.append(suffixes.decode_run(suffixes.encode_run(matrix, np.arange(len(keys))[:, None]), 1))
        before = b""
        out = list(suffixes.merge(runs))
        assert [k for _, k, _ in out] == sorted(every)
        for shared, key, _ in out:
            assert key[:shared] == before[:shared] and (shared == len(key) or key[shared:shared + 1] != before[shared:shared + 1])
            before = key


def test_held_out_remainders(spark):
    got = spark.range(50).select("id", crc_mod("id", 3).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in got)


@pytest.mark.parametrize("dims", [8, 16, 24, 64, 256, 768, 1536])
def test_lattice_finds_close_vectors_at_any_dimension(dims):
    rng = np.random.default_rng(dims)
    n = 600
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    a = unit(rng.normal(size=(n, dims)))
    side = rng.normal(size=(n, dims))
    side = unit(side - (side * a).sum(1)[:, None] * a)
    c = rng.uniform(.98, .985, n)[:, None]
    b = c * a + np.sqrt(1 - c * c) * side

    def met(x, y):
        hit = np.zeros(n, bool)
        for t in range(8):
            p, q = (lattice.cells(v, t, 8, None, 3) for v in (x, y))
            hit |= (p == q[:, :1]).any(1) | (q == p[:, :1]).any(1)
        return hit.mean()
    assert met(a, b) >= .99 and met(a, np.roll(a, 1, 0)) < .01


@pytest.mark.parametrize("dims", [16, 300])
def test_lattice_links_planted_pairs(spark, dims):
    rng = np.random.default_rng(dims + 1)
    base = rng.normal(size=(60, dims))
    near = base[:30] / np.linalg.norm(base[:30], axis=1)[:, None]
    side = rng.normal(size=near.shape)
    side -= (side * near).sum(1)[:, None] * near
    side /= np.linalg.norm(side, axis=1)[:, None]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(base)] + [(100 + i, v.tolist(), "a") for i, v in enumerate(.982 * near + np.sqrt(1 - .982 ** 2) * side)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {**{i: (1 if i < 30 else 0, i) for i in range(60)}, **{100 + i: (1, i) for i in range(30)}}


def test_archive_reads_what_records_say(spark, tmp_path):
    """References and lengths come from the records: a header that is changed shows."""
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "v", "abc"), (3, "w", "é" * 200_000)], "page_id long, url string, html string").withColumn("refers_to", F.lit(9))
    warc.write_archive(pages, str(tmp_path / "a"))
    got = {r["page_id"]: r for r in warc.read_archive(spark, str(tmp_path / "a")).withColumn("block", F.when(warc.field("WARC-Type") == "response", warc.block_of())).collect()}
    assert got[1]["refers_to"] == 2 and got[2]["refers_to"] is None and bytes(got[3]["block"]) == ("é" * 200_000).encode() and bytes(got[2]["block"]) == b"abc"
    headers, payloads = (spark.read.parquet(str(tmp_path / "a" / n)) for n in ("headers", "payloads"))
    for k, (old, new, message) in enumerate([("WARC-Refers-To: <urn:uuid:", "WARC-Refers-To: <urn:uuid:0", "no response has the id"),
                                             ("Content-Length: 3\r", "Content-Length: 4\r", "not as long as stated")]):
        folder = str(tmp_path / f"b{k}")
        payloads.write.parquet(f"{folder}/payloads")
        headers.withColumn("header", F.replace(F.col("header").cast("string"), F.lit(old), F.lit(new)).cast("binary")).write.parquet(f"{folder}/headers")
        read = warc.read_archive(spark, folder)
        with pytest.raises(Exception, match=message):
            read.select("refers_to", F.when(warc.field("WARC-Type") == "response", warc.block_of())).collect()
