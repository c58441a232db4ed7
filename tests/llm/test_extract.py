"""Blocks of pages that are not well formed, gradients by differences, accuracy on made pages that training has not seen."""

import time

import numpy as np
import pytest

from graphloom.llm import op13_extract as X
from graphloom.llm.html_blocks import Page


def texts(html):
    return Page(html).texts


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("plain  text\n\tonly", ["plain text only"]),
    ("<p>one<p>two <b>bold<br>line</b> end", ["one", "two bold line end"]),
    ("<p><b>open.<br><p>next</p></article>", ["open.", "next"]),
    ("a &amp; b &lt;i&gt; &nbsp; &eacute;&#x20AC;&#8364;&nosuch;", ["a & b <i> é€€&nosuch;"]),
    ("<script>var t='</p>';if(a<b)x()</script>x<style>p{}</style>y", ["xy"]),
    ("<div>a<script>1</script >b</div><!-- <p>no</p> -->c", ["ab", "c"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]),
    ("<a href='x>y' title=\"a>b\">in</a> out", ["in out"]),
    ("<p title=\"never ends>text<p>more", ["text", "more"]),
    ("<p>cut <b", ["cut <b"]),
    ("<!-- never ends <p>x", []),
    ("<title>t</title><textarea>no</textarea><select><option>no</select><p>yes", ["yes"]),
    ("</p></div>x</b>y", ["xy"]),
])
def test_blocks(html, want):
    assert texts(html) == want


@pytest.mark.parametrize("piece", ["<a \"", "<div>", "<", "<p title='", "</section>", "<!--", "<script>", "<li>", "<td>", "<b>x", "&"])
def test_blocks_take_linear_time(piece):
    began = time.process_time()
    Page(piece * 60_000)
    assert time.process_time() - began < 4


def test_links_are_counted():
    page = Page("<p>ab <a href=x>cdef</a> gh</p>")
    assert page.texts == ["ab cdef gh"] and page.linked == [4]


def test_gradients_are_differences():
    pages = X.made_pages(5, ["one", "two", "three", "Four."], seed=2)
    b, label = X.Blocks([p for p, _ in pages]), np.concatenate([y for _, y in pages])
    net = X.Network()
    net.p["own"] += np.float32(0.05)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    grad = net.gradients(b, label)

    def loss():
        y = net.scores(b).astype(np.float64)
        k = label >= 0
        return float(np.mean(np.logaddexp(0, y[k]) - label[k] * y[k]))

    rng = np.random.default_rng(0)
    for name in net.p:
        flat, g = net.p[name].reshape(-1), grad[name].reshape(-1)
        for at in [int(np.abs(g).argmax()), int(rng.integers(len(g)))]:
            held = flat[at]
            flat[at] = held + 1e-3
            up = loss()
            flat[at] = held - 1e-3
            down = loss()
            flat[at] = held
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 + 0.03 * abs(g[at]), name


def test_sure_labels():
    page = Page("<nav>m</nav><article><h1>t</h1><p>x<div class=ad>no</div><aside>s</aside></article><div>d</div>")
    assert dict(zip(page.texts, X.sure_labels(page).tolist(), strict=True)) == {"m": 0, "t": 1, "x": 1, "no": -1, "s": 0, "d": -1}


@pytest.fixture(scope="module")
def net(spark, data):
    return X.fit(spark, spark.read.parquet(f"{data}/pages.parquet"))


def test_accuracy_on_pages_that_it_has_not_seen(net):
    words = "river stone walks under seventy bright lamps Nobody carries paper over quiet bridges".split()
    pages = X.made_pages(300, words, seed=1234)
    label, score = np.concatenate([y for _, y in pages]), net.scores(X.Blocks([p for p, _ in pages]))
    assert ((score > 0) == label)[label >= 0].mean() > 0.97
    assert (score > 0)[label == 1].mean() > 0.96 and (label == 1)[(score > 0) & (label >= 0)].mean() > 0.96


HAND = """<html><head><title>x</title></head><body><div id="cookie-banner">We use cookies. <a href=#>OK</a></div><div class="top-nav"><a href=/>Home</a> <a href=/n>News</a></div>
<div class="wrap"><div class="story-text"><h1>The bridge opens</h1><p>The bridge over the river opened on Monday after nine years of work.</p><div class="ad-box">Buy a car today</div>
<p>Hundreds of people walked across it in the rain, and a band played.</p><p>It is 400 metres long.</p></div><div class="sidebar"><h3>Most read</h3><ul><li><a href=1>Storm hits coast</a><li><a href=2>Cup final</a></ul></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>I was there, and it was lovely to see.</p><a href=#>Reply</a></div></div></div><div class="foot">&copy; 2024 The Paper</div></body></html>"""


def test_a_page_by_hand(net):
    want = "The bridge opens\n\nThe bridge over the river opened on Monday after nine years of work.\n\nHundreds of people walked across it in the rain, and a band played.\n\nIt is 400 metres long."
    assert X.main_texts(net, [HAND]) == [want]


def test_given_pages(spark, data, net):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    want = ["\n\n".join(texts(r["html"][r["html"].index("<article") : r["html"].index("</article>")])) for r in rows]
    found = X.main_texts(net, [r["html"] for r in rows])
    assert sum(a == b for a, b in zip(found, want, strict=True)) >= 0.97 * len(rows)


def test_odd_rows(spark, net):
    rows = [(1, "u", None, "k", 1), (2, None, "", "k", 1), (None, "u", HAND, "k", 1), (3, "u", HAND, "k", 1), (3, "u", HAND, "k", 1), (4, "u", "<p>" + "<div>" * 3000, "k", 1), (5, "u", "<p>word " * 30_000, "k", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in X.extract(df, net, ["page_id", "url"]).collect()), key=str)
    assert len(out) == 7 and all(n == len(t) for _, t, n in out)
    assert [t for i, t, _ in out if i in (1, 2, 4)] == ["", "", ""]
    assert len({t for i, t, _ in out if i in (3, None)}) == 1
    assert X.extract(df.limit(0), net, ["page_id", "url"]).count() == 0


