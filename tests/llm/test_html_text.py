import re
import time
from html import unescape

import pytest

from plumbline.llm.html_text import LABELLED, article_text, blocks_of, extract, grow, labelled_rows
from plumbline.llm.queries import QUERIES

TREE = grow(*labelled_rows(LABELLED))
PROSE = "The committee met on Tuesday to hear what the engineers had found below the old bridge, and most of them left before the end."


def text(html):
    return article_text(html, TREE)


def test_elements_and_classes_that_surround_go():
    page = f"""<!DOCTYPE html><html><head><title>Site | Bridge</title><style>p{{margin:0}}</style><script>var t = "<p>no</p>";</script></head>
    <body class="has-sidebar"><header><a href="/">Site</a><p>All the news</p></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>
    <div id="cookie-consent"><p>{PROSE} We use cookies.</p><button>Accept</button></div>
    <div class="layout-with-sidebar"><article><header><h1>The&nbsp;bridge &amp; the <em>river</em></h1></header><p>{PROSE}<p>No.<p>{PROSE} <a href="/x">More</a> of it.</p>
    <!-- <p>not said</p> --><div class="ad">{PROSE}</div><ul><li>one point</li><li>another</li></ul><form><label>Mail</label><input><button>Go</button></form></article>
    <aside><h3>Popular</h3><p>{PROSE}</p></aside></div><section class="comments"><article class="comment"><p>{PROSE} I agree.</p></article></section>
    <footer><p>&copy; {PROSE}</p></footer><noscript>Turn it on</noscript></body></html>"""
    assert text(page).split("\n") == ["The bridge & the river", PROSE, "No.", f"{PROSE} More of it.", "one point", "another"]


def test_pages_that_name_nothing():
    page = f"<div><a href='/'>Home</a> <a href='/n'>News</a></div><div><a href='/c'>Contact us</a></div><h1>The bridge</h1><div>{PROSE}</div><div>{PROSE} {PROSE}</div><div>{PROSE}</div><div><a href='/p'>Privacy and terms</a></div><div><a href='/q'>Imprint</a></div>"
    assert text(page).split("\n")[-3:] == [PROSE, f"{PROSE} {PROSE}", PROSE] and "Home" not in text(page) and "Imprint" not in text(page)
    assert text(f"<h1>Short</h1><p>{PROSE}</p><p>Yes.</p>") == f"Short\n{PROSE}\nYes."


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("", []),
        (" \n ", []),
        ("<p>a<p>b</p></p>c", ["a", "b", "c"]),
        ("<b>a<br>b<br><br>c", ["a b", "c"]),
        ("a &lt;b&gt; &amp;amp; &#x41;&eacute;&nbsp;&#xD800;", ["a <b> &amp; Aé �"]),
        ("<a title='x > y' href=\"/q?a='\">in</a> 1 < 2 <3", ["in 1 < 2 <3"]),
        ("x<!-- never ends <p>y</p>", ["x"]),
        ("x<!-->y<!-- a --!>z<? pi ?>w</3>v", ["xyzwv"]),
        ("x<script>if (a</b) '</scrip>'</SCRIPT >y<style>p{}", ["xy"]),
        ("x<script>never ends <p>y</p>", ["x"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("</div></p>a</b><div", ["a"]),
        ("<div><td>x</div>y</td>z", ["x", "y", "z"]),
    ],
)
def test_blocks_of_odd_pages(html, blocks):
    assert [b.text for b in blocks_of(html)] == blocks


def test_links_and_neighbours():
    a, b = blocks_of("<p>one <a href='/'>two three</a> four</p><p><a href='/'>x<p>y</a></p>")[:2]
    assert (a.words, a.linked) == (4, 0.5) and b.linked == 1.0
    assert [b.linked for b in blocks_of("<div><a href='/'>x<div></a>y</div></div>")] == [1.0, 0.0]


def test_time_grows_with_the_length():
    for piece in ("<div><b>x", "<p class='a'>x", "</i><i><div>", "<a href=x>", "<li>", "<!", "x<br>", "&", '<a b="', "<td><table>", "='"):
        start = time.perf_counter()
        blocks_of(piece * (400_000 // len(piece)))
        assert time.perf_counter() - start < 20, piece


def test_cases(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", f"<article><p>{PROSE}</p></article>", "t"), (4, "v", f"<p>{PROSE}</p>", "t"), (4, "v", f"<p>{PROSE}</p>", "t"), (5, "v", "<article>" + f"<p>{PROSE}</p>" * 30_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in extract(pages).collect()}
    assert got[(1, "u")].text == got[(2, None)].text == "" and got[(2, None)].n_chars == 0
    assert got[(None, "u")].text == got[(4, "v")].text == PROSE and got[(4, "v")].n_chars == len(PROSE)
    assert got[(5, "v")].n_chars == 30_000 * (len(PROSE) + 1) - 1 and extract(pages).count() == 6
    assert extract(pages.limit(0)).count() == 0
    mine = [[("<i>", 0), ("<p>a b c</p><p>d e f g</p>", 1), ("<nav>x</nav>", 0)]]
    assert {r.page_id: r.text for r in extract(pages, mine).collect()}[4] == PROSE


def test_query_against_the_pages_own_markup(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op11_html_text"](spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        inside = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        lines = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", inside))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
