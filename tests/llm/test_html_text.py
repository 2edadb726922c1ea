"""Pages whose main text is known."""

import html
import re
from collections import Counter

import pytest

from cellgrid.llm import html_text
from cellgrid.llm.html_text import main_text

CASES = {

"plain": ('<html><body><header class="site-header"><h1>Site</h1><p>Tagline here</p></header><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>First para with <a href=x>link</a> inside.</p><aside>Side text</aside><p>Second &eacute;&nbsp;para.</p><section id="comments"><h2>Comments</h2><article class="comment"><p>I think so too</p></article></section></main><footer>Foot (c)</footer></body></html>',
  "Title First para with link inside. Second é para."),
"divs": ('<div id="wrapper"><div id="top-menu"><ul><li><a>x</a><li><a>y</a></ul></div><div class="cookie-notice">We use cookies and so on, accept them all please</div><div class="content"><h1>Hello</h1><p>Some text of a story that is fairly long and goes on and on for the sake of it.<p>More text.<div class="ad">Buy now</div><p>End.</div><div class="sidebar">Side stuff</div><div class="comments"><p>First comment of a reader is quite long here and says that he liked the article very much indeed, really</p></div><div id="footer">c</div></div>',
  "Hello Some text of a story that is fairly long and goes on and on for the sake of it. More text. End."),
"bare": ('<body><div><a href=a>Home</a> | <a href=b>News</a></div><h2>Head line</h2><p>A paragraph with quite a lot of words in it so that it is above the threshold surely.</p><p>Another paragraph.</p><ul><li><a>1</a></li><li><a>2</a></li><li><a>3</a></li></ul></body>',
  "Head line A paragraph with quite a lot of words in it so that it is above the threshold surely. Another paragraph."),
"nested comment article": ('<article><h1>T</h1><p>Body.</p><article><p>comment</p></article></article>', "T Body."),
"in-article header": ('<article><header><h1>T</h1><p>By X</p></header><p>Body text.</p><footer>tags</footer></article>', "T Body text."),
"aspnet": ('<body><form id="aspnetForm"><div class="menu"><a>m</a></div><div id="main"><h1>T</h1><p>Body text is here and long.</p></div></form></body>', "T Body text is here and long."),
"has sidebar": ('<body class="has-sidebar"><div class="content-with-sidebar"><h1>T</h1><p>Body text is here and long.</p></div><div class="sidebar">x y z</div></body>', "T Body text is here and long."),
"none": ('<nav><a>x</a></nav><footer>foot</footer>', ""),
"empty": ('', ""), "null": (None, ""), "script": ('<script>if (a < b) { "<p>x</p>" }</script>', ""),
"lone": ('<article>a < b &lt; c &amp;amp; d</article>', "a < b < c &amp; d"),
"unclosed nav": ('<nav><a>x</a><article><p>Body text</p></article>', "Body text"),
"attrs": ('<article><p title="a > b" data-x=\'<p>\'>Text</p><p title=Don\'t>More</p></article>', "Text More"),
"br": ('<article>one<br>two<br/>three</article>', "one two three"),
"inline": ('<article><p>a<b>b</b>c <i>d</i></p></article>', "abc d"),
"list": ('<article><p>x</p><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table></article>', "x one two 1 2 3"),
"share": ('<div class="post"><h1>T</h1><div class="share-buttons"><a>Tweet</a></div><div class="post-body"><p>Body</p></div><div class="related-posts"><h3>Related</h3><p>Other</p></div></div>', "T Body"),
"trunc": ('<article><p>Body text</p><p>Half a sent', "Body text Half a sent"),
"trunc tag": ('<article><p>Body text</p><p cla', "Body text"),
"hidden": ('<article><p>Body</p><p style="display:none">trap</p><p hidden>trap</p></article>', "Body"),
"form": ('<article><p>Body</p><form><label>Mail</label><input><button>Go</button></form><p>After</p></article>', "Body After"),
"many articles": ('<article class="post"><h2>A</h2><p>'+'alpha '*30+'</p></article><div class=related><article><p>teaser</p></article></div>', "A "+("alpha "*30).strip()),
"main+div": ('<main><div class="breadcrumbs"><a>Home</a> &gt; News</div><h1>T</h1><div><p>P1</p><p>P2</p></div><div class="newsletter"><p>Subscribe</p></div></main>', "T P1 P2"),
"content id": ('<div id="page"><div id="header">H</div><div id="content"><div class="entry-content"><p>P1</p><p>P2</p></div></div><div id="footer">F</div></div>', "P1 P2"),
"title in content": ('<div id="page"><div id="header">H</div><div id="content"><h1>T</h1><div class="entry-content"><p>P1</p><p>P2</p></div></div><div id="footer">F</div></div>', "T P1 P2"),
"obf": ('<div class="c0"><div class="c1"><a href=1>Home</a><a href=2>News</a><a>Sport</a></div><div class="c2"><h1>T</h1><div class="c3">'+'word '*40+'</div><div class="c3">'+'word '*30+'</div></div><div class="c4">&copy; 2024 Firm</div></div>', "T "+("word "*70).strip()),
"table": ('<table><tr><td class="leftnav"><a>x</a><td><h1>T</h1><p>Body text</p></td><td class="right sidebar">S</td></table>', "T Body text"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    source, want = CASES[name]
    assert main_text(source) == want


def test_window_sums_surge_and_dive():
    weights = [0, 5, 0, 200, 0, 0, 30, 0, 0, 0, 90, 0]
    assert list(html_text._blocks(weights, 80)) == [(1, 7), (10, 11)]
    assert list(html_text._blocks(weights, 1)) == [(1, 7), (10, 11)]
    assert list(html_text._blocks([3, 0, 0, 0, 300], 80)) == [(4, 5)]


def test_long_and_broken_pages():
    words = " ".join(f"word{i}" for i in range(200_000))
    assert main_text(f"<nav>menu</nav><article><p>{words}</p></article>") == words
    assert main_text("<article>" + "<div>" * 20_000 + "deep text" + "</div>" * 20_000 + "</article>") == "deep text"
    assert main_text("<article>" + "<b>" * 20_000 + "x</i>" * 2_000 + "</article>") == "x" * 2_000
    assert main_text('<article><a href="' + "x" * 1000) == ""
    assert main_text("<article>text<!-- unended") == "text"


def test_all_rows_of_the_pages_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split())
        assert got[r.page_id] == (text, len(text))


def test_odd_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<article>same</article>"), (2, "v", "<article>same</article>"), (3, None, "<p></p>")]
    df = spark.createDataFrame([(*r, "t", 5, "i", "h") for r in rows],
                               "page_id long, url string, html string, text string, n_chars int, _id string, _html string").repartition(3)
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(tuple(r) for r in out.collect()) == Counter(
        [(1, "u", "", 0), (None, None, "", 0), (2, "v", "same", 4), (2, "v", "same", 4), (3, None, "", 0)])
    assert html_text.extract(df.limit(0)).count() == 0
