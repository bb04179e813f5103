"""Pages read against hand-made truth, and a plain second reading of the small table."""

import html
import re

import pytest

from millrace.llm import html_extract, op2


def page(body, n=0):
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>t {n}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        f'<body class="page"><header><a href="/">Site {n}</a></header><nav><ul><li><a href="/x">menu {n}</a></ul></nav><!-- ad {n} -->'
        f'<div class="ad">buy {n}</div><div class="cookie-notice">we use {n}</div>{body}'
        f'<aside>related {n}</aside><form><label>name {n}</label><input></form>'
        f'<section class="comments"><p>nice {n}</section><footer>&copy; foot {n}</footer></body></html>')


def texts(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    return sorted(((r.page_id, r.text) for r in html_extract.extract(frame).collect()), key=str)


def test_articles_without_the_rest(spark):
    body = (
        "<article><header><h1>Title  {n}</h1></header><p><b>bold<br><p>a&nbsp;&lt;b&gt; &amp;&#233;\n<i>in</i>side{n}"
        "<ul><li>one<li>two</ul><div class='share'>share</div><table><tr><td>c1<td>c2</table> 1 < 2</article>")
    rows = [(i, f"https://h.example/{i}", page(body.replace("{n}", str(i)), i)) for i in range(6)]
    rows += [(90, None, page(body.replace("{n}", "90"))), (91, "no url", None), (92, "https://one.example/", ""), (93, "HTTP://H.example:80/", "plain &amp; text")]
    rows += [(0, *rows[0][1:])]
    got = texts(spark, rows)
    want = [(i, f"Title {i} bold a <b> &é inside{i} one two c1 c2 1 < 2") for i in [*range(6), 90, 0]]
    assert got == sorted([*want, (91, ""), (92, ""), (93, "plain & text")], key=str)


def test_a_template_without_telling_names(spark):
    """No article element: the content is where the texts of the host vary most."""
    def odd(n):
        return (
            f"<html><body><table><tr><td><h1>Heading {n}</h1>" + "".join(f"<p>words of page {n} part {i} and so on</p>" for i in range(5))
            + f"</td></tr></table><div class='menu'>go {n}</div></body></html>")

    rows = [(i, f"http://t.example/{i}", odd(i)) for i in range(4)]
    for n, text in texts(spark, rows):
        assert text == f"Heading {n} " + " ".join(f"words of page {n} part {i} and so on" for i in range(5))


@pytest.mark.parametrize("body", [
    '<main class="has-sidebar"><p>{}</p><div class="share-buttons">tell</div></main>',
    '<div class="content-sidebar-wrap"><article><p>{}</p><div class="related-posts">more</div></article></div>',
    '<article class="post share-enabled"><p>{}</p><div class="share">tell</div></article>',
    '<div class="layout-no-sidebar"><p>{}</p><div class="ad">buy</div></div>'])
def test_one_word_of_a_name_skips_no_article(spark, body):
    text = "words of the article that are most of the page and stay whatever its layout is called by, number {}"
    rows = [(i, "http://n.example/", page(body.format(text.format(i)), i)) for i in range(5)]
    rows += [(9, "http://alone.example/", page(body.format(text.format(9)), 9))]
    assert texts(spark, rows) == sorted(((i, text.format(i)) for i in [*range(5), 9]), key=str)


@pytest.mark.parametrize("n", [2, 5, 12])
def test_what_articles_share_stays_at_every_size(spark, n):
    body = "<main><p>All views are our own.</p><p>own text {n}</p><p>The end.</p></main>"
    rows = [(i, "http://s.example/", page(body.replace("{n}", str(i)), i)) for i in range(n)]
    assert texts(spark, rows) == sorted(((i, f"All views are our own. own text {i} The end.") for i in range(n)), key=str)
    copies = [(i, "http://s.example/", rows[0][2]) for i in range(n)]
    assert texts(spark, copies) == sorted(((i, "All views are our own. own text 0 The end.") for i in range(n)), key=str)


def test_constant_text_outside_the_slots_chooses_nothing(spark):
    """No name tells: the long text that every page has stands beside the element with the slots."""
    same = "".join(f"<p>what every page of this host says in its part {i}</p>" for i in range(9))
    body = "<html><body><table><tr><td>" + same + "</td></tr></table><blockquote><p>own words of page {n}</p><p>and a few more {n}</p></blockquote></body></html>"
    rows = [(i, "http://o.example/", body.replace("{n}", str(i))) for i in range(4)]
    assert texts(spark, rows) == [(i, f"own words of page {i} and a few more {i}") for i in range(4)]


def test_long_broken_and_no_pages(spark):
    rows = [(1, "http://a/", "<article>" + "<p>x y" * 20_000), (2, "http://a/", "<article><p>cut <a hre"), (3, "http://a/", "<div" * 3000)]
    got = dict(texts(spark, rows))
    assert got[1] == " ".join(["x y"] * 20_000) and got[2] == "cut" and got[3] == ""
    assert texts(spark, rows[:0]) == []


def test_equal_vectors_make_one_class(spark):
    rows = [(i, "http://k.example/", page(f"<article><p>t {i}</p></article>", i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame = frame.withColumn("host", html_extract.host_of("url"))
    found = html_extract.templates(frame).collect()
    assert [(r.host, r.content) for r in found] == [("k.example", "html/body.page/article")]


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
    got = op2.op2_html_extract(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
