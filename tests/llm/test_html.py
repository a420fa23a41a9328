import html
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import html as H
from millrace.llm.boosting import Boosted

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trees():
    return H.model()


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)) & (x[:, 2] > -1)
    m = Boosted().fit(x[:2000], y[:2000].astype(float))
    assert ((m.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    again = Boosted().fit(x[:2000], y[:2000].astype(float))
    assert (again.log_odds(x) == m.log_odds(x)).all()


def test_held_out_pages(trees):
    pages = list(H.training_pages(200, seed=99))
    got = H.extract_all([s for s, _ in pages], trees)
    assert sum(g == w for g, (_, w) in zip(got, pages, strict=True)) / len(pages) > 0.85
    want = sum(len(w.split("\n")) for _, w in pages)
    lost = sum(len(set(w.split("\n")) - set(g.split("\n"))) for g, (_, w) in zip(got, pages, strict=True))
    extra = sum(len(set(g.split("\n")) - set(w.split("\n"))) for g, (_, w) in zip(got, pages, strict=True))
    assert lost < 0.02 * want and extra < 0.02 * want


def test_decoding_never_contradicts_an_ancestor():
    rng = random.Random(1)
    for source, _ in H.training_pages(20, seed=5):
        page = H.Page(source)
        kept = page.decode(np.array([rng.uniform(-3, 3) for _ in page.tag]))
        assert all(kept[p] or not kept[i] for i, p in enumerate(page.parent) if p >= 0)
        assert not any(kept[i] for i, t in enumerate(page.tag) if t in H.HIDDEN)


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("<html>", ""), ("<article><p>a &amp; b&lt;c &am <p>d\n\n e</article>", "a & b<c &am\nd e"),
    ("<article><h1>T</h1><p><b>x<br><p>y.</p><script>var a='</p>';</script><!-- c <p>no</p> --><ul><li>one<li>two</ul></article>", "T\nx\ny.\none\ntwo"),
    ("<article><p>A &eacute;&#233;&#xe9; &nbsp; z</p><style>p{}</style><p>never ends", "A ééé z\nnever ends"),
])
def test_reading(trees, source, want):
    assert H.extract_all([source], trees) == [want]


def plain(source):
    """The article of the test table's pages, by patterns made for them."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", source, re.S)[1])
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>|<br>", " " * 0, p)).split()) for p in parts) if x)


def test_query_on_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = H.op6_html_extraction(spark, DATA).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (None, "u", "<article><p>" + "long text, more. " * 100_000, 5)], "page_id long, url string, html string, n_chars int")
    assert sorted(r.n_chars for r in H.extract(df).collect()) == [0, 0, 1_699_999]
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("make", [
    lambda n: "<b>" * n + "</i>" * n, lambda n: "<a '" * n, lambda n: "<div>" * n, lambda n: "<ul><li><div>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n,
    lambda n: '<p>x</p><a "' * n, lambda n: "<script></script" * n, lambda n: "<!" * n, lambda n: "<p><a href=x>" * n, lambda n: "<table><td>" * n,
])
def test_reading_takes_time_in_proportion(make):
    took = []
    for mb in (1, 2, 4):
        source = make(mb * 1_000_000 // len(make(1)))
        began = time.process_time()
        H.Page(source).features()
        took.append(time.process_time() - began)
    assert took[2] < 6 * took[0] + 1.5


WORDS = "The river rose slowly over three days, and the town watched it without much alarm. Nobody had seen water on the market square before."
MORE = "By the fourth morning, the lower streets were closed, and boats carried bread, milk and letters to the houses along the quay."
PAGES = [
    # No article element: nested div elements only.
    (f"<html><head><title>t</title></head><body><div id='top-nav'><a href=/>Home</a> <a href=/n>News</a></div><div class='page'><div class='content'><h1>Flood</h1><div>{WORDS}</div><div>{MORE}</div></div></div><div class='footer'>&copy; Town paper</div></body></html>",
     f"Flood\n{WORDS}\n{MORE}"),
    # A table within the text.
    (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><main><h1>Levels</h1><p>{WORDS}<table><tr><th>Day<th>Level<tr><td>One<td>3 m<tr><td>Two<td>4 m</table><p>{MORE}</main><footer>Imprint and contact</footer></body>",
     f"Levels\n{WORDS}\nDay\nLevel\nOne\n3 m\nTwo\n4 m\n{MORE}"),
    # Comments of readers, nested, below the article.
    (f"<body><header><a href=/>Paper</a></header><article><h1>Flood</h1><p>{WORDS}</p><p>{MORE}</p></article><section id='comments'><h3>Comments</h3><div class='comment'><p>So sad to read this.</p><div class='reply'><p>I was there, it was worse.</p></div></div></section></body>",
     f"Flood\n{WORDS}\n{MORE}"),
    # A sidebar before the text, an advert within it, a cookie notice, scripts.
    (f"<body><div class='cookie-consent'>We use cookies. <button>Fine</button></div><aside class='sidebar'><h2>Popular</h2><ul><li><a href=/1>One thing</a><li><a href=/2>Another</a></ul></aside><article class='post'><h2>Flood</h2><p>{WORDS}</p><div class='advert'><a href=/buy>Buy boots</a></div><script>track('</p>')</script><p>{MORE}</p></article></body>",
     f"Flood\n{WORDS}\n{MORE}"),
    # Lists, a quotation, preformatted text and inline markup.
    (f"<body><div role=navigation><a href=/>Up</a></div><article><h1>How <em>it</em> went</h1><p>{WORDS}</p><ul><li>sand bags, many of them<li>two boats</ul><blockquote><p>{MORE}</p></blockquote><pre>a   b\nc</pre></article></body>",
     f"How it went\n{WORDS}\nsand bags, many of them\ntwo boats\n{MORE}\na b c"),
]


@pytest.mark.parametrize("source, want", PAGES, ids=range(len(PAGES)))
def test_hand_written_pages(trees, source, want):
    assert H.extract_all([source], trees) == [want]


def test_model_is_fitted_once(spark, trees, monkeypatch):
    assert Boosted.from_json(trees.to_json()).to_json() == trees.to_json()
    x = np.random.default_rng(1).normal(size=(500, H.FEATURES))
    first = H.fitted(spark)
    monkeypatch.setattr(H, "model", None)
    assert (H.fitted(spark).log_odds(x) == first.log_odds(x)).all() and (first.log_odds(x) == trees.log_odds(x)).all()
