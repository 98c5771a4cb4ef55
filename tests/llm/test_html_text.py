import html
import itertools
import math
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from lodestone.llm.html_pages import labelled_pages
from lodestone.llm.html_text import Block, Field, aligned, extract, leaf_blocks, main_text, marginals, op4_crf_main_text, trained


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_leaf_blocks():
    assert texts("<p>a <b>b<br>c<p>d</p> e") == ["a b c", "d", "e"]
    assert texts("<div>x<ul><li>1<li>2<ul><li>3</ul></ul>y</div>") == ["x", "1", "2", "3", "y"]
    assert texts("a<!-- <p>no</p> -->b<script>var t='</p>';</script><style>p{}</style>c") == ["ab", "c"]
    assert texts("<p title='a>b'>&lt;i&gt; &amp;amp; &eacute;&nbsp; &#x41;</p>") == ["<i> &amp; é A"]
    assert texts("1 < 2 and <3 <p>x</p") == ["1 < 2 and <3", "x</p"]
    assert texts("</div></p><table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("") == texts("<script>never closed") == []
    assert leaf_blocks('<div class="siteHeader x-1"><p><b>t')[0].path == (frozenset(["in:div", "name:header", "name:site", "name:x", "in:p"]), "p", True)
    assert texts("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == ["deep", "er"]
    assert texts('<p a="unclosed>x</p><p>y</p>')[-1] == "y"


def test_an_open_head_ends_at_the_first_content():
    assert texts("<html><head><title>t</title><h1>Head</h1><p>Hello world</p>") == ["Head", "Hello world"]
    assert texts("<head><meta charset=x><link rel=y>plain text<p>more") == ["plain text", "more"]
    assert texts("<head><style>p{}</style><title>t</title>\n</head>\n<body><p>a") == ["a"]
    assert texts("<head><script>x</script><noscript><p>n</p></noscript><img src=x><p>b") == ["b"]


def test_long_and_deep_pages_take_linear_time_and_memory():
    began = time.process_time()
    assert texts("<p>x</p>" + "<a " * 350_000) == ["x", ("<a " * 350_000).strip()]
    assert texts("<p>x</p><script>" + "</script " * 100_000) == ["x"]
    assert texts("</x>" * 200_000 + "y") == ["y"]
    nested = lambda n: "".join(f"<div class=n{'abcdefghij'[i % 10]}>" for i in range(n)) + "deep" + "</div>" * n + "out"
    assert [b.text for b in leaf_blocks(nested(100_000))] == ["deep", "out"]
    assert time.process_time() - began < 20
    tracemalloc.start()
    leaf_blocks(nested(10_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 << 20


def paths_of(n):
    return itertools.product((0, 1), repeat=n)


def test_viterbi_and_marginals_equal_enumeration():
    rng = random.Random(2)
    for n in (1, 2, 5):
        blocks = [Block("w " * rng.randrange(1, 30) + ".", (frozenset(["in:p"]), rng.choice(("p", "div")), False), 0) for _ in range(n)]
        pair = np.array([[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"])
        e = [rng.uniform(-2, 2) for _ in range(n)]
        score = {y: sum(a * b for a, b in zip(e, y)) + sum(pair[a, b] for a, b in zip(y, y[1:])) for y in paths_of(n)}
        z = sum(map(math.exp, score.values()))
        node, edge = marginals(e, pair)
        assert node == pytest.approx([sum(math.exp(s) for y, s in score.items() if y[i]) / z for i in range(n)])
        want = np.zeros((2, 2))
        for y, s in score.items():
            for a, b in zip(y, y[1:]):
                want[a, b] += math.exp(s) / z
        assert edge == pytest.approx(want)
        field = Field({f"mark{i}": i for i in range(n)}, np.array(e), pair)
        for i, b in enumerate(blocks):
            b.path = (frozenset([f"block:{i}"]), "p", False)
        field._path = dict(zip((b.path for b in blocks), e)).get
        assert tuple(field.decode(blocks)) == max(score, key=score.get)


def test_held_out_pages():
    field, wrong, total = trained(), 0, 0
    for page, truth in labelled_pages(150, seed=901):
        blocks, labels = aligned(page, truth)
        wrong += sum(a != b for a, b in zip(field.decode(blocks), labels))
        total += len(labels)
    assert wrong < 0.03 * total


HEAD = "<h1>The river rises again</h1>"
BODY = ("After three days of rain the river has risen by two metres, and people in the lower town have been asked to leave.", "Schools stay closed until Monday, and trains don't run between both stations.")
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)
LINKS = '<a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact</a>'
ODD_LAYOUTS = {
    "columns": f"<html><body><table><tr><td>{LINKS}</td><td>{HEAD}{PARAGRAPHS}</td></tr></table></body></html>",
    "three columns": f"<table><tr><td><b>Daily News</b></td></tr><tr><td>{LINKS}</td><td>{HEAD}{PARAGRAPHS}</td><td><ul><li><a href=/x>Sports today</a><li><a href=/y>Weather</a></ul></td></tr></table>",
    "comments inside": f'<body><article>{HEAD}{PARAGRAPHS}<section class="comments"><h3>Comments</h3><div class="comment"><p>I live there, and it is much worse than what you write here, believe me.</p></div></section></article>',
    "rights at the end": f"<body>{HEAD}{PARAGRAPHS}<p>Copyright 2020</p></body>",
    "rights and a name": f"<body><div>{HEAD}{PARAGRAPHS}<p>© 2020 The Daily News. All rights reserved.</p></div></body>",
}


@pytest.mark.parametrize("name", ODD_LAYOUTS)
def test_pages_without_an_article_or_with_comments_in_it(name):
    assert main_text(ODD_LAYOUTS[name], trained()) == " ".join(("The river rises again", *BODY))


@pytest.mark.parametrize("layout", ["boxes", "columns", "naked"])
def test_held_out_pages_of_each_layout(layout):
    field, wrong, total = trained(), 0, 0
    for page, truth in labelled_pages(60, seed=77, layout=layout):
        blocks, labels = aligned(page, truth)
        wrong += sum(a != b for a, b in zip(field.decode(blocks), labels))
        total += len(labels)
    assert wrong < 0.03 * total


def test_query_gives_the_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op4_crf_main_text(spark, sf_dir).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id])[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r.text == want and r.n_chars == len(want)


def test_odd_rows(spark):
    same = spark.createDataFrame([(7, "u", "<p>A page of one paragraph, which is its main text.</p>", "x", 1, "in")] * 3, "page_id long, url string, html string, text string, n_chars int, path string")
    assert {tuple(r) for r in extract(same, trained()).collect()} == {(7, "u", "A page of one paragraph, which is its main text.", 48)}  # ties, and names that clash
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<article><p>" + "Long words here, and more. " * 9000, 0)]
    rows += [(3, "u", "<article><p>Some text stands here, and it is an article.</p></article>", 0)] * 2
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), trained()).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("3", 44), ("3", 44), ("None", 26 * 9000 + 9000 - 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), trained()).count() == 0
    assert main_text("<nav>a</nav>", trained()) == ""
