import itertools
import math
import random
import re
from html import unescape

import numpy as np
import pytest

from tessera.llm import html_extract as he
from tessera.llm import queries
from tessera.llm.html_blocks import Block, Reader
from tessera.llm.html_pages import labelled


def plain_article(html):
    """The given pages' articles have h1, p, b and br alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return "\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)


def test_query_equals_plain_articles(spark, sf):
    want = {r.page_id: (r.url, plain_article(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op11_html_extract"](spark, sf).collect()
    assert got and {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got) and len(got) == len(want)


def test_held_out_layouts():
    field, right, total, exact, pages = he.model(), 0, 0, 0, list(labelled(150, seed=11))
    for page in pages:
        blocks = Reader().read(page)
        hits = [bool(b.main) == d for b, d in zip(blocks, he.decode(blocks, field))]
        right, total, exact = right + sum(hits), total + len(hits), exact + all(hits)
    assert right / total > 0.98 and exact / len(pages) > 0.88


@pytest.mark.parametrize("wrapped", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="content"><section>{}</section></div>'])
def test_pages_by_hand(wrapped):
    story = "<h1>Title here</h1><p>First &amp; <a href='/x'>linked</a>\n words, long enough to be a sentence.</p><ul><li>one<li>two</ul><p>Last.</p>"
    page = (
        '<html><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div>'
        + wrapped.format(story) + '<aside><h3>Related</h3><a href="/q">Another story</a></aside><form><p>Subscribe to our newsletter</p><input></form>'
        '<section class="comments"><h3>2 comments</h3><div class="comment"><p>I like this article, it is a good one.</p></div></section><footer>&copy; Site. All rights reserved.</footer><script>x()</script>'
    )
    assert he.main_text(page, he.model()) == "Title here\nFirst & linked words, long enough to be a sentence.\none\ntwo\nLast."


def random_field(r):
    return he.Field({"bias": r.uniform(-1, 1)} | {f: r.uniform(-2, 2) for f in "abcd"}, [[[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)] for _ in range(3)])


def score(blocks, labels, field):
    emit = sum(field.weights["bias"] + sum(field.weights[f] for f in b.features) for b, y in zip(blocks, labels) if y)
    return emit + sum(field.moves[he.nearness(a, b)][y][z] for a, b, y, z in zip(blocks, blocks[1:], labels, labels[1:]))


def test_viterbi_and_sums_against_all_labellings():
    r = random.Random(3)
    for _ in range(20):
        field = random_field(r)
        blocks = [Block("", frozenset(f for f in "abcd" if r.random() < 0.5), (r.randrange(2), r.randrange(2)), None) for _ in range(r.randint(1, 7))]
        every = {y: score(blocks, y, field) for y in itertools.product((0, 1), repeat=len(blocks))}
        assert math.isclose(every[tuple(map(int, he.decode(blocks, field)))], max(every.values()))
        total = sum(map(math.exp, every.values()))
        emit = np.array([[[0.0, field.weights["bias"] + sum(field.weights[f] for f in b.features)] for b in blocks]])
        near = np.array([[0] + [he.nearness(a, b) for a, b in zip(blocks, blocks[1:])]])
        chance, pairs = he.marginals(emit, np.array(field.moves), near, np.ones((1, len(blocks)), bool))
        for t in range(len(blocks)):
            assert math.isclose(chance[0, t, 1], sum(math.exp(s) for y, s in every.items() if y[t]) / total, rel_tol=1e-9)
            if t:
                assert math.isclose(pairs[0, t - 1, 1, 0], sum(math.exp(s) for y, s in every.items() if y[t - 1] and not y[t]) / total, rel_tol=1e-9)


@pytest.mark.parametrize("html,texts", [
    ("<p>a<b>b</b>c<p>d&lt;e &#x41;&nbsp;f", ["abc", "d<e A f"]),
    ("x < y and 3<4 <!-- <p> --> z<br>w", ["x < y and 3<4 z w"]),
    ("<script>var t='</p>';if(a<b){}</script><style>p{}</style><p title='a>b'>in</p>", ["in"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ('<p class="a>b</p><p>c</p>', ["b", "c"]),
    ("<p>a</p></div></p>b", ["a", "b"]), ("<title>t</title><textarea><p>q</textarea>", ["<p>q"]),
    ("<p>never <b closed", ["never <b closed"]), ("", []), ("<!-- open", []), ("<script>open", []),
])
def test_blocks(html, texts):
    assert [b.text for b in Reader().read(html)] == texts


def test_edges(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "u", None, "t", 5), (1, None, "", "t", 5), (None, "u", "<p", "t", 5), (2, "u", f"<article><h1>A</h1>{long}</article>", "t", 5), (2, "u", "<" * 50_000, "t", 5), (3, "u", "<div>" * 3000 + "<p>Deep inside, a sentence.", "t", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = he.extract(frame).collect()
    assert len(got) == 6 and [r.n_chars for r in got if r.url is None or r.page_id == 1] == [0, 0]
    assert max(r.n_chars for r in got) >= 999_999 and he.extract(frame.limit(0)).count() == 0


def test_trained_on_own_labels():
    pages = [f'<div class="zork">{w} and more of it.</div><div class="blah" data-main="1">{w} too, just the same.</div>' for w in "abcdef"]
    assert he.main_text('<div class="zork">Some and more of it.</div><div class="blah">Some too, just the same.</div>', he.train(pages)) == "Some too, just the same."
