from __future__ import annotations

import html
import re

import pytest

from runlens.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><aside><p>Aside, text, with, commas, and more commas, to score</p></aside>
<div id="content"><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text, with a <a href="x">link</a>.<p>Second&nbsp;one<br>goes on</p><form><p>Your name</p></form>
<ul><li>item one<li>item two</ul><div class="ad">Buy</div><pre>code  here</pre></article></div>
<section id="comments"><p>Nice article, really, a very long comment, with many, many, commas, so it scores well</p></section>
<footer>&copy; me</footer></body></html>"""


def test_an_article_without_its_surroundings():
    assert extract.main_text(PAGE) == "Head & line\nFirst bold text, with a link.\nSecond one goes on\nitem one\nitem two\ncode here"


def test_best_container_and_siblings_without_article():
    body = "".join(f"<p>Paragraph {i} has words, commas, and enough length to be taken for text of the page itself.</p>" for i in range(5))
    page = f"<div class=menu><a href=1>one</a> <a href=2>two</a></div><div id=main>{body}</div><div><a href=3>three, four, five</a></div>"
    assert extract.main_text(page).count("\n") == 4 and "three" not in extract.main_text(page)


@pytest.mark.parametrize(
    "page", ["", None, "<", "<p", "plain text", "<a<b>x", '<p class="un>closed', "<!-- open", "<script>x", "</p></div>y", "<p>" * 3000 + "z", "<div>" * 3000 + "deep"]
)
def test_odd_pages_do_not_fail(page):
    assert isinstance(extract.main_text(page), str)


def test_misleading_names_do_not_empty_a_page():
    assert extract.main_text("<div class=comments><p>All the text there is</p></div>") == "All the text there is"


BODY = "".join(f"<p>Paragraph {i} has words, commas, and enough length to be taken for text of the page itself.</p>" for i in range(5))


@pytest.mark.parametrize("wrapper", ["form action=x", "div class='content has-sidebar'", "div class=content-sidebar-wrap", "dialog open", "object", "div class=has-comments"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_wrappers_that_hold_the_text_stay(wrapper, inner):
    comments = f"<div id=comments>{BODY.replace('Paragraph', 'Comment')}</div>"
    page = f"<p>A stray line</p><{wrapper}><{inner}>{BODY}</{inner}>{comments}<form><p>Your name</p></form></{wrapper.split()[0]}>"
    got = extract.main_text(page)
    assert got.count("Paragraph") == 5 and "Comment" not in got and "Your name" not in got


def test_suspects_beside_the_text_are_dropped():
    long = BODY.replace("Paragraph", "Other") * 3
    for other in ("div class=comments", "form", "div class=sidebar", "div class=related", "dialog"):
        for page in (f"<article>{BODY}</article><{other}>{long}</{other.split()[0]}>", f"<article>{BODY}<{other}>{long}</{other.split()[0]}></article>"):
            got = extract.main_text(page)
            assert got.count("Paragraph") == 5 and "Other" not in got, other
    comments = "<article>Other one, and more</article><article>Other two, and more</article>" * 5
    assert extract.main_text(f"<div><p>Short text.</p></div><div id=comments>{comments}</div>") == "Short text."


def test_a_page_of_nothing_but_a_form():
    assert extract.main_text("<form><p>All there is</p></form>") == "All there is"


@pytest.mark.parametrize("tag", ["<svg class=i />", '<svg a="x>y"/>', "<math/>", "<svg-icon></svg-icon>", "<title-bar></title-bar>", "<select-box>"])
def test_empty_and_custom_elements_swallow_nothing(tag):
    assert extract.main_text(f"<article>{tag}<p>The text</p></article>") == "The text"
    assert extract.main_text("<article><svg><title>No</title></svg><script/>no</script><p>The text</p></article>") == "The text"


LONG = "".join(f"<p>Paragraph {i}{', words of the text that go on and on for some time until the line ends' * 5}.</p>" for i in range(10))


@pytest.mark.parametrize(
    "page, first, last",
    [
        ("<div class=content><div>{}</div><div>One short end.</div></div>", "Paragraph 0", "One short end."),
        ("<div><h1>Title</h1><div>{}</div></div>", "Title", "Paragraph 9"),
        ("<body><div><div><h1>Title</h1></div><div><div>{}</div><div>Short</div></div></div></body>", "Title", "Short"),
        ("<body><h1>Title</h1><article>{}</article></body>", "Title", "Paragraph 9"),
        ("<div>Lead in.<div>{}</div><ul><li>one<li>two</ul>Bare end</div>", "Lead in.", "Bare end"),
        ("<div><div class=row><div>{}</div></div><div class=row><div>Short row</div></div></div>", "Paragraph 0", "Short row"),
        ("<div><a href=1>all link</a></div><div>{}</div><div><a href=1>more links</a> by</div><div>Behind links</div>", "Paragraph 0", "Paragraph 9"),
    ],
)
def test_short_parts_and_titles_stay(page, first, last):
    got = extract.main_text(page.format(LONG)).split("\n")
    assert sum(x.startswith("Paragraph") for x in got) == 10
    assert got[0].startswith(first) and got[-1].startswith(last)


def test_short_parts_between_sections_stay():
    page = f"<div><div>{LONG}</div><h2>Part two</h2><div>Short, one.</div><div>{LONG}</div></div>"
    got = extract.main_text(page).split("\n")
    assert len(got) == 22 and got[10:12] == ["Part two", "Short, one."]


def test_all_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract.extract_main_text(pages).collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br|article)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_clashing_columns_and_empty_table(spark):
    pages = spark.createDataFrame([(1, None, "old"), (1, "<p>a</p>", "old")], "page_id long, html string, text string")
    got = extract.extract_main_text(pages)
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("a", 1)]
    assert extract.extract_main_text(pages.where("false")).count() == 0
