"""Main text of pages: generated pages with a known article in several templates, plain loops, odd markup."""

import html as H
import random

import pytest
from pyspark.sql import functions as F

from wavetable.llm import extraction
from wavetable.llm.extraction import main_text, stretches

WORDS = "the river über niño réel coast & bridge <tag> stone “night” people market of a went there yesterday along Straße again".split()
AROUND = [
    '<nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav>', '<div class="ad">Buy seventeen of the finest kettles today, only here.</div>',
    '<aside><h2>Latest</h2><p>Another story that is long enough to count as text of a page, but does not belong to it at all.</p></aside>',
    '<div id="cookie-banner" role="dialog"><p>We use cookies to make this page better and to show more adverts. Do you agree?</p><button>Yes</button></div>',
    '<form action="/s"><label>Find</label> <input name=q> <select><option>All<option>Some</select><p>Type what you are looking for and press the key.</p></form>',
    '<div class="sidebarBox"><p>Weather: cloudy with a chance of rain in the evening, and somewhat colder in the night to come.</p></div>',
    '<script>if (1 < 2) document.write("<p>not text</p>");</script><style>p > b {color: red}</style><!-- <article>not this</article> -->',
    '<noscript><p>Please switch scripts on to read all of this page as it was meant to be.</p></noscript>',
]
AFTER = [
    '<section id="comments"><h3>2 comments</h3><article class="comment"><p>What a wonderful article, I have read it three times and will again.</p></article>'
    '<article class="comment"><p>I do not agree at all with what is said here, and neither will you.</p></article></section>',
    '<footer><p>&copy; 2024 The Paper. All rights reserved. Imprint, contact and terms of use of this site.</p></footer>',
    '<div class="related-posts"><h3>More</h3><p><a href="/x">A story about something else altogether that you may like as well</a></p></div>',
    '<div class="newsletter"><p>Subscribe to our letter and never miss a story of this quality again.</p></div>',
]


def page(rng, template, short=False):
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    blocks = [sentence(rng.randint(3, 7))] + [sentence(rng.randint(1, 3) if short else rng.randint(25, 60)) for _ in range(rng.randint(1, 6))]
    esc = lambda t: H.escape(t).replace("ü", rng.choice(["ü", "&uuml;", "&#252;", "&#xFC;"])).replace(" ", rng.choice([" ", "\n\t "]), 3)
    wrap = lambda t: t.replace(" people", " <b>people</b>").replace(" stone", ' <a href="?a=1&b=%3E" title="x > y">stone</a>')
    inner = [f"<h1>{esc(blocks[0])}</h1>"] + [f"<P>{wrap(esc(b))}" + rng.choice(["</P>", ""]) for b in blocks[1:]]
    if template in ("article", "main"):
        inner.insert(rng.randint(1, len(inner)), rng.choice(AROUND[1:]))
    inner = "\n".join(inner)
    body = {"article": f"<article>{inner}</article>", "main": f"<main id=content class='has-sidebar'>{inner}</main>",
            "wrapped": f'<form id="aspnetForm"><div class="page no-sidebar"><article class="post">{inner}</article></div></form>',
            "named": f'<div class="wrap"><div class="entry-content">{inner}</div></div>',
            "header": f"<article><header>{inner}</header></article>",
            "plain": f"<div><div><table><tr><td>{inner}</td></tr></table></div></div>"}[template]
    before = "".join(rng.sample(AROUND, rng.randint(0, 5)))
    after = "".join(rng.sample(AFTER, rng.randint(0, 4)))
    head = "<!DOCTYPE html><html><head><title>A title &amp; more</title></head><body class='nav-open'><header><h1>The Paper</h1><p>Since 1870</p></header>"
    return head + before + body + after + rng.choice(["</body></html>", ""]), "\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("template", ["article", "main", "wrapped", "named", "header", "plain"])
@pytest.mark.parametrize("short", [False, True])
def test_generated_pages(template, short):
    if template == "plain" and short:
        pytest.skip("nothing marks a text of a few words")
    rng = random.Random(f"{template}{short}")
    for _ in range(150):
        source, want = page(rng, template, short)
        assert main_text(source)[0] == want, source


def test_unmarked_page_by_distribution_alone():
    rng = random.Random(3)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) for _ in range(4)]
    menu = "".join(f'<div><a href="/{k}">Entry number {k}</a></div>' for k in range(8))
    source = f"<div>{menu}</div><h1>A headline</h1>" + "".join(f"<p>{t}</p>" for t in long) + f"<div>{menu}</div><div>© 2024 Somebody</div>"
    assert main_text(source)[0] == "\n".join(["A headline", *long])
    assert main_text("<div>only a few words</div>")[0] == "only a few words"
    assert main_text(f"<div>{menu}</div>")[0] == ""


def test_stretches_against_plain_loop():
    import numpy as np
    rng = random.Random(9)
    for _ in range(500):
        n, window, surge = rng.randint(0, 14), rng.randint(1, 4), rng.choice([1, 30, 80])
        length = [rng.choice([0, 0, 0, 5, 20, 60, 200]) for _ in range(n)]
        sums = [sum(length[i:i + window]) for i in range(n)]
        want, i = [], 0
        while i < n:
            if sums[i] < surge:
                i += 1
                continue
            while not length[i]:
                i += 1
            j = i
            while j < n and sums[j]:
                j += 1
            want.append((i, j))
            i = j
        assert stretches(np.array(length, np.int64), window, surge) == want


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<article></article><div>" + "words " * 40 + "</div>", ""),
    ("<article><p>a<br>b<br><br>c &lt;b&gt; 1 < 2 &amp;amp; &nbsp; d</article>", "a b\nc <b> 1 < 2 &amp; d"),
    ("<article><p>one<p>two<b>bold<p>three</b> four</article>", "one\ntwobold\nthree four"),
    ("<nav><a href=x>Menu</a> open menu<article><p>text of the page</article>", "text of the page"),
    ("<article><p>x <span class='ad'>buy</span> y <button>press</button> z</article>", "x y z"),
    ("<article><p hidden>no</p><div style='display: none'>no</div><p aria-hidden=true>no</p><p>yes</article>", "yes"),
    ("<ARTICLE><P CLASS=lead>Up\r\nper</P></ARTICLE>", "Up per"), ("<article><p>a</p><![CDATA[no]]><?php no ?><!-- no --!> no --><p>b</article>", "a\nb"),
    ("<article><p>cut <b", "cut"), ("<article><p>ok</p><p title=\"never closed>later</p></article>", "ok\nlater"),
    ("<article><ul><li>one<li>two<ul><li>deep</ul><li>three</ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "one\ntwo\ndeep\nthree\nc1\nc2\nc3"),
    ("<article><p>before</p></div></span></nav><p>after</p></article>", "before\nafter"), ("<main><h1>T</h1><article><p>t</article></main>", "T\nt"),
    ("<article><script>var a = '</article>'; '<p>no</p>'</script><textarea>no</textarea><p>t</article>", "t"),
])
def test_odd_markup(source, want):
    assert main_text(source)[0] == want


def test_time_grows_with_length_only():
    import time
    for source in ("<a " * 300_000, '<a title="' * 100_000, "<b>" * 300_000 + "</i>" * 300_000, "<div>" * 100_000 + "x", "<p>x<b>" * 100_000, "&" * 500_000,
                   "<article>" + "<p>word " * 200_000, "<!--" * 200_000, "<script>" * 100_000):
        began = time.time()
        main_text(source)
        assert time.time() - began < 20, source[:20]


def test_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of many &amp; more.</p>" for i in range(30_000)) + "</article>"
    rows = [(1, "u", long), (1, "u", long), (None, None, None), (2, "v", ""), (3, "w", "<article>é&#128512;</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "n_kept")})
    got = extraction.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"]
    want = {(i, u, main_text(h)[0], len(main_text(h)[0])) for i, u, h in rows}
    found = [tuple(r)[:4] for r in got.collect()]
    assert len(found) == 5 and set(found) == want and max(r[3] for r in found) > 900_000
    assert extraction.extract(frame.limit(0)).count() == 0
