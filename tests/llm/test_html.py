"""Extraction of whole articles: odd elements, deep and long pages, and the sample pages by their structure."""

import re
import time

import pytest

from loomline.llm import html_extract as H


def blocks(html):
    return [n.text for n in H._nodes(H.parse(html)) if n.text is not None]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>the identity <math><mi>a</mi><mo>=</mo><mrow><mi>b</mi></mrow></math> holds here</p>", ["the identity a=b holds here"]),
        ("<p>one</p><noscript><p>two</p></noscript><p>three</p>", ["one", "two", "three"]),
        ("<p>a <object data=x>fallback</object> b <svg><g><text>label</text><path d='M'/></g></svg> c</p>", ["a fallback b label c"]),
        ("<p>a <canvas>drawn</canvas> b<select><option>x<option>y</select> c</p>", ["a drawn b c"]),
        ("<p>one<script>if (a < b) x('</p>')</script>word<style>p{}</style>s</p>", ["onewords"]),
        ("<p>a <my-tag>custom</my-tag> b", ["a custom b"]),
        ("<p>a <svg><text>open</p><p>next</p>", ["a open", "next"]),
        ("<p>a<b>b<p>c</b>d<div>e</div>f", ["ab", "cd", "e", "f"]),
        ("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>", ["1", "2", "3", "4"]),
        ("<table><tr><td>1<td>2<tr><th>3</table>4", ["1", "2", "3", "4"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<p><button><div>x</div><p>y</button>z", ["x", "y", "z"]),
    ],
)
def test_blocks(html, want):
    assert blocks(html) == want


@pytest.mark.parametrize("unit", ["<div>", "<p><button><div>", "<b>", "<ul><li>", "<p><b>", "<a>x", "<span><div>", "<svg><g>", "<table><tr><td>", "</b><i>", "<select><option>", "<x-y>"])
def test_work_grows_with_length_at_any_depth(unit):
    took = []
    for n in (3000, 24_000):
        began = time.perf_counter()
        H.features(H._nodes(H.parse(unit * n + "text")))
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.05)


def article_of(html):
    """The article element's own blocks, by plain patterns that know how the sample pages are made."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1]
    inside = re.sub(r"(?s)<!--.*?-->|<div class=\"ad\">.*?</div>", "", inside)
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|blockquote|pre)\b[^>]*>", inside)
    import html as names

    texts = [" ".join(names.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", x))).split()) for x in parts]
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_sample_page_is_its_article(spark, table):
    pages = spark.read.parquet(f"{table}/pages.parquet")
    truth = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    wrong = [k for k in truth if got[k]["text"] != truth[k]]
    assert not wrong, (len(wrong), truth[wrong[0]], got[wrong[0]]["text"])
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.mark.parametrize("name", [lambda m: f' {m[1]}="q{sum(map(ord, m[2]))}z"', lambda m: ""])
def test_names_that_no_training_page_has(spark, name):
    """The sample pages with other class names, ids and roles than any known one, or with none: the tree itself tells the article."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()]
    other = spark.createDataFrame([(k, "u", re.sub(r' ?(class|id|role)="([^"]*)"', name, h)) for k, h in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(other).collect()}
    assert sum(got[k] != article_of(h) for k, h in pages) == 0


def test_empty_repeated_long_and_extra_columns(spark):
    body = "".join(f"<p>Sentence {k} of a long text, with some words.</p>" for k in range(20_000))
    page = f"<html><body><nav><a href=/>Menu</a></nav><article><h1>Title</h1>{body}</article><footer>&copy; me</footer>"
    rows = [(1, "u", page, "x", 3), (1, "u", page, "x", 3), (2, None, "", "y", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, H.extract(pages).collect()), key=lambda r: r[0])
    assert got[0] == got[1] and got[0][2].count("\n") == 20_000 and got[2] == (2, None, "", 0)
    assert H.extract(pages.limit(0)).count() == 0


def test_model_is_stored(spark, monkeypatch):
    one = H.stored(spark)
    monkeypatch.setattr(H, "fit", lambda *_: pytest.fail("fitted again"))
    assert all((a == b).all() for a, b in zip(one, H.stored(spark), strict=True))
