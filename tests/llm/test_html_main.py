"""Main text of pages against known articles: built pages of many templates, and the article element of the given tables."""

import html
import re

import pytest

from corvida.llm import html_main

SCHEMA = "page_id long, url string, html string, path string, winner string, n_chars string"


def page(article, template="plain", k=0):
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>No &amp; {k}</title><style>p{{a:b}}</style><script>var t='</p><article>';</script></head><body class='has-sidebar'>"
    menu = "".join(f"<li><a href='/{i}'>Section {i}</a>" for i in range(8))
    noise = f"<header class=site><h1>Site {k}</h1></header><nav><ul>{menu}</ul></nav><!-- <p>hidden</p> --><div class='cookie-notice'><p>We use cookies on this site, all of them.</p></div>"
    end = "<aside><p>Most read stories of the week</p></aside><section id=comments><h2>12 comments</h2><article class='comment'><p>I do not agree with any of it, not at all.</p></article></section><form><label>Mail</label><input name=a><textarea>Your &lt;p&gt;</textarea><button>Send</button></form><footer>&copy; 2020</footer>"
    body = {
        "plain": f"<article><h1>Title {k}</h1>{article}</article>",
        "div": f"<div id='page-{k}'><div class='col x7'>{article}</div><div class='sidebar-{k}'><p>Weather: sunny, with some clouds later on in the day</p></div></div>",
        "main": f"<main><header><h1>Head {k}</h1></header><section>{article}</section><div class=ad>Buy now, buy now, buy now!</div></main>",
    }[template]
    return head + noise + body + end + "</body></html>"


ARTICLE = "<p>First&nbsp;part <b>of\n the</b> text &amp; more,<br>next line <a href=x>link</a>.<p>Second <em>one<ul><li>item <span class='share-button'>Share</span> one<li>item two</ul><table><tr><td>cell a<td>cell b</table><blockquote>Said &quot;so&quot; &am</blockquote><script>x()</script>last words"
LINES = ["First part of the text & more, next line link.", "Second one", "item one", "item two", "cell a", "cell b", 'Said "so" &am', "last words"]


@pytest.mark.parametrize("template", ["plain", "div", "main"])
def test_one_page(template):
    text, _ = html_main.Page(page(ARTICLE, template, 3)).main_text(None)
    lead = {"plain": ["Title 3"], "div": [], "main": ["Head 3"]}[template]
    assert text == "\n".join(lead + LINES)


def test_consensus_of_a_host(spark):
    """A page whose own best container is another one follows its host."""
    rows = [(i, "http://h.example/a", page(f"<p>Story {i} goes on for a good while, sentence after sentence.</p>", "div", i), "x", "y", "z") for i in range(6)]
    odd = "<body><div id='page-9'><div class='col x7'><p>Short one.</p></div></div><div class=partners><p>" + "A very long text of the partners of this site. " * 9 + "</p></div></body>"
    rows += [(9, "https://user@H.example:80/b?c", odd, "x", "y", "z"), (10, "http://other.example/", odd, "x", "y", "z")]
    rows += [(11, None, odd, "x", "y", "z"), (12, "nonsense", None, "x", "y", "z"), (13, "http://h.example/", "", "x", "y", "z"), (None, "http://h.example/", "just words", "x", "y", "z"), (9, "https://h.example/", odd, "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    for size in (8 << 20, 0):
        out = html_main.extract(df, broadcast_bytes=size)
        assert sorted(out.columns) == ["n_chars", "page_id", "path", "text", "url", "winner"]
        got = [tuple(r[c] for c in ("page_id", "text", "n_chars", "winner")) for r in out.collect()]
        want = [(i, f"Story {i} goes on for a good while, sentence after sentence.") for i in range(6)]
        long = ("A very long text of the partners of this site. " * 9).strip()
        want += [(9, "Short one."), (9, "Short one."), (10, long), (11, long), (12, ""), (13, ""), (None, "just words")]
        assert sorted(got, key=str) == sorted(((i, t, len(t), "y") for i, t in want), key=str)
    votes = {(r["host"], r["path"]): r["pages"] for r in html_main.path_votes(df).collect()}
    assert votes["h.example", "body/div@page-#/div.col.x#"] == 8
    assert html_main.extract(df.limit(0)).count() == 0


def test_odd_markup():
    read = lambda h: html_main.Page(h).main_text(None)[0]
    assert read("no tags &lt;at&gt; all") == "no tags <at> all"
    assert read("<p>a<p>b<br>c<hr>d</div></b><div>e") == "a\nb c\nd\ne"
    assert read("<p>a 🙂 b</p><script>never closed <p>x") == "a 🙂 b"
    assert read("<p>open <a href='x>tail") == "open"
    assert read("<!-- never closed <p>x") == ""
    assert read("<P CLASS=x>A</P><DIV HIDDEN>no</DIV><p style='display: none'>no</p>") == "A"
    assert read("<div>" * 100000 + "deep" + "</div></b>" * 100000) == "deep"
    assert read("<p>" + "word " * 400000 + "</p>") == ("word " * 400000).strip()
    assert read("<nav>only a menu</nav>") == read("") == ""


def test_articles_of_the_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_main.extract(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == (want, len(want))
