"""Anchors, entities and page texts: expectations written down by hand, apart from the library's patterns."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import markup
from pagemill.operators import pages
from pagemill.sources.html import html_text

ANCHORS = [
    ("<a href='/fees'>Fees</a>", [("/fees", "Fees")]),
    ("<a href=/apply>Apply</a><a href=x/>y</a>", [("/apply", "Apply"), ("x/", "y")]),
    ('<a href="/tuition">Tuition &amp; fees</a>', [("/tuition", "Tuition & fees")]),
    ('<!-- <a href="/english">English</a> --><a href="/b">b</a><!-- open <a href="/c">c</a>', [("/b", "b")]),
    ('<script>var x = "<a href=/no>no</a>"</script><style><a href=/no></style><a href="/y">y</a>', [("/y", "y")]),
    ('<A\n class="a > b" HREF = "/q?a=1&amp;b=2" id=z> <b>One </b>\n two&nbsp;</A >', [("/q?a=1&b=2", "Onetwo")]),
    ("<a name=top>no</a><a data-href='/no'>no</a><a title='href=/no' href='/yes'>yes</a>", [("/yes", "yes")]),
    ("<abbr href='/no'>no</abbr><area href='/no'><a>no</a>", []),
    ("<a href='/1'>one<a href='/2'>two</a>", [("/1", "one"), ("/2", "two")]),
    ("<a href='/open'>never closed <i>text", [("/open", "never closedtext")]),
    ("<a href='  /trim\n'>&#8364;&#x41;&eacute;&apos;&nosuch;&#0;&#xD800;</a>", [("/trim", "€Aé'&nosuch;&#0;&#xD800;")]),
    ("<a href=''>empty</a><a href>none</a>", [("", "empty")]),
    ("<a class=x/href='/first' href='/second'>z</a>", [("/second", "z")]),
    (None, None),
    ("", []),
]


@pytest.mark.parametrize(("html", "want"), ANCHORS)
def test_anchors(spark, html, want):
    got = spark.createDataFrame([(html,)], "h string").select(markup.anchors(F.col("h")).alias("a")).first().a
    assert (got if got is None else [tuple(x) for x in got]) == want


def test_anchors_of_very_long_pages(spark):
    html = "<p>" + "x" * 2_000_000 + "".join(f"<a class='{'c' * 50}' href='/p{i}'>t{i} &amp; </a>" for i in range(3000)) + "<a " + "b=1 " * 20_000 + "href=/last>z</a>" + "<!--" + "-" * 500_000
    got = spark.createDataFrame([(html,)], "h string").select(markup.anchors(F.col("h")).alias("a")).first().a
    assert [tuple(x) for x in got] == [*((f"/p{i}", f"t{i} &") for i in range(3000)), ("/last", "z")]


def test_links_of_the_verdicts_page(spark):
    html = "<a href='/fees'>Fees</a><a href=/apply>Apply</a><a href=\"/tuition\">Tuition &amp; fees</a><!-- <a href=\"/english\">English</a> -->"
    rows = spark.createDataFrame([(1, "https://h.org/p", html, "")], "page_id int, url string, html string, content string")
    got = pages.page_links(rows).orderBy("pos").collect()
    assert [(r.pos, r.target, r.link_text) for r in got] == [(0, "https://h.org/fees", "Fees"), (1, "https://h.org/apply", "Apply"), (2, "https://h.org/tuition", "Tuition & fees")]
    found = pages.link_sources(rows).filter("source = 'html'").collect()
    assert sorted(r.link for r in found) == ["https://h.org/apply", "https://h.org/fees", "https://h.org/tuition"]


TEXTS = [
    # the first element of a rule is the main part
    ("<body><article>one</article><article>two</article></body>", "one"),
    ("<body>out<div class='content'>a</div><div class='content'>b</div><main>in</main></body>", "in"),
    # also if it is empty
    ("<body>text<main></main><article>x</article></body>", ""),
    # an element that is dropped is no candidate, nor is one inside a table or a button
    ("<body><nav><main>no</main></nav><article>yes</article></body>", "yes"),
    ("<body><table><tr><td><main>cell</main></td></tr></table>rest</body>", "\n\n| cell |\n\n\nrest"),
    ("<body><button><article>Fees</article></button>rest</body>", "Fees\nrest"),
    # a button is one piece
    ("<body><button>Fees <b>now</b></button><p>x</p></body>", "Fees  now\nx"),
    ("<body><table><tr><td>a<button>b<i>c</i></button></td></tr></table></body>", "\n\n| a b c |\n\n"),
    # rows of inner tables stand after the row around them, whose cells hold all texts and all cells below
    (
        "<body><table><tr><td>A<table><tr><td>x</td><td>y</td></tr></table></td><td>B</td></tr><tr><th>C</th></tr></table></body>",
        "\n\n| A x y | x | y | B |\n| x | y |\n| C |\n\n",
    ),
    # end tags may be left out
    ("<body><table><tr><th>A<th>B<tr><td>1<td>2 &amp; 3</table>z</body>", "\n\n| A | B |\n| 1 | 2 & 3 |\n\n\nz"),
    ("<body><table><tr><td>open", "\n\n| open |\n\n"),
    ("<body><table><tr></tr></table></body>", "\n\n\n\n"),
    ("<body><form><table><tr><td>no</td></tr></table></form>yes</body>", "yes"),
    ("<div role='main navigation'>a</div><div id='content x'>b</div>", "a\nb"),
    ("<div id='content'>b</div>c", "b"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("html", "want"), TEXTS)
def test_page_text(html, want):
    assert html_text(html) == want


def test_cost_table():
    """A page of costs: header and rows, numbers in nested elements, blanks and entities."""
    rows = [("On campus", "7,556", "1,250", "13,190", "21,996"), ("Off campus", "7,556", "1,250", "9,100", "17,906")]
    cells = "".join("<tr>" + "".join(f"<td><span><p>{c}</p></span>&nbsp;</td>" for c in row) + "</tr>" for row in rows)
    page = f"<html><body><main><table><thead><tr><th>Where</th><th>Tuition &amp; Fees</th><th>Books</th><th>Room</th><th>Total</th></tr></thead><tbody>{cells}</tbody></table><p>After</p></main></body></html>"
    assert html_text(page) == "\n\n| Where | Tuition & Fees | Books | Room | Total |\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n\n\nAfter"
