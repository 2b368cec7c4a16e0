"""Main text of pages written for the purpose."""

from pyspark.sql import functions as F

from sluice.llm import html
from sluice.llm.common import ready

BODY = ("<h1>A &amp; B</h1><p>First  paragraph,\n with a few words &mdash; and more.</p>"
        "<p>Second <b>bold</b> one&#33;<br>After the break.<p>Unclosed, third paragraph here.")
TEXT = ("A & B First paragraph, with a few words — and more. Second bold one! After the break. "
        "Unclosed, third paragraph here.")
NOISE = ('<nav><ul><li><a href="/">Home</a></li></ul></nav><header class="top">Site name</header>'
         '<div class="ad">Buy this, it is a long and well written advert, really.</div>')
TAIL = ('<div class="sidebar">More, more, more, and more text in the side bar.</div>'
        '<form><label>Name, please</label></form><section id="comments"><p>Reader says, at '
        'length, that this was a good read, thank you.</p></section><footer>&copy; us</footer>')


def test_article():
    page = (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';"
            f"</script></head><body>{NOISE}<!-- <p>old</p> --><article>{BODY}</article>{TAIL}"
            "</body></html>")
    assert html.main_text(page) == TEXT
    assert html.main_text(page[:page.index("</article>")]) == TEXT


def test_without_an_article_element():
    for box in ('<div class="content">', '<div class="page-body with-sidebar">', "<main>", "<td>"):
        page = f"<html><body>{NOISE}{box}{BODY}</{box[1:].split()[0].rstrip('>')}>{TAIL}"
        assert html.main_text(page) == TEXT, box


LONG = "This sentence, one of many, is here to make a paragraph of a fair length, and so on. "


def test_articles_over_sibling_sections():
    lead, body = f"<p>{LONG * 3}</p>", f"<p>{LONG * 4}</p><p>{LONG * 3}</p>"
    page = (f'<body>{NOISE}<div id="content"><h1>Title</h1><div class="lead">{lead}</div>'
            f'<div class="body">{body}</div></div>{TAIL}')
    assert html.main_text(page) == "Title " + (LONG * 10).strip()


def test_articles_that_are_mostly_one_block():
    for block in (f"<ul>{f'<li>{LONG * 2}' * 9}</ul>", f"<blockquote>{LONG * 18}</blockquote>",
                  f"<pre>{LONG * 18}</pre>", f"<ul><li>{LONG * 18}</ul>",
                  f"<table><tr><td>{LONG * 18}</td></tr></table>"):
        page = (f"<body>{NOISE}<div><h1>Title</h1><p>{LONG * 2}</p>{block}<p>{LONG}</p></div>"
                f"{TAIL}")
        assert html.main_text(page) == "Title " + (LONG * 21).strip(), block[:12]


def test_several_articles():
    page = (f"<body>{NOISE}<div class='x1'>Site</div><article><h2>One</h2><p>{LONG}</p></article>"
            f"<article><h2>Two</h2><p>{LONG * 2}</p><p>Short.</p></article>"
            f"<div class='x2'>Imprint</div>{TAIL}")
    assert html.main_text(page) == (f"One {LONG}Two {LONG * 2}Short.")


def test_ratios_decide_inside_an_article():
    for tag in ("article", "main", "div"):
        page = (f"<body>{NOISE}<{tag}><div class='x1'><h1>Title</h1></div><div class='x2'>"
                f"<p>{LONG * 3}</p><h2>Part</h2><p>{LONG * 2}</p></div><div class='x3'>Buy now</div>"
                f"<ul class='x4'><li><div>Nice</div><li><div>+1</div></ul></{tag}>{TAIL}")
        assert html.main_text(page) == f"Title {LONG * 3}Part {LONG * 2}".strip(), tag
        page = (f"<body>{NOISE}<{tag}><h1>Title</h1><p>{LONG * 3}</p><p>{LONG * 2}</p>"
                f"<div class='x3'>Buy now</div></{tag}>{TAIL}")
        assert html.main_text(page) == f"Title {LONG * 5}".strip(), tag
        page = (f"<body>{NOISE}<{tag}><p>{LONG * 3}</p><h2>Part</h2><ul><li>Salt<li>Oil</ul>"
                f"<table><tr><td><p>5</p><td>6</table></{tag}>{TAIL}")
        assert html.main_text(page) == f"{LONG * 3}Part Salt Oil 5 6", tag


def test_boilerplate_inside_the_article():
    page = (f'<article><header><h2>x</h2></header>{BODY}<aside>see also</aside><div class="cookie-'
            'notice">We use cookies.</div><script>1</script><div class="share-buttons">Share</div>')
    assert html.main_text(page) == TEXT


def test_names_inside_articles():
    def article(inner):
        return html.main_text(f"<body>{NOISE}<article><h1>T</h1><section id='intro'><p>{LONG * 2}"
                              f"</p></section>{inner}<p>{LONG}</p></article>{TAIL}")
    start, end = f"T {LONG * 2}", LONG.strip()
    for inner, text in (
            (f"<section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section>",
             f"Discussion {LONG}"),
            (f"<section id='discussion'><p>{LONG}</p></section>", LONG),
            (f"<div id='related-work'><h2>2. Related <i>work</i></h2><p>{LONG}</p></div>",
             f"2. Related work {LONG}"),
            ("<h2 id='related-work'>Related work</h2>", "Related work "),
            ("<h2 id='header-files'>Header files</h2>", "Header files "),
            ("<h3 id='sharing-data'>Share data</h3><h3 id='share-data'>x</h3>", "Share data x "),
            ("<div class='section-header'><h2>Methods</h2></div>", "Methods "),
            ("<pre>x = 1 <span class='hljs-comment'># one</span></pre>", "x = 1 # one ")):
        assert article(inner) == start + text + end, inner
    for inner in (f"<div class='comments'><p>{LONG}</p></div>",
                  f"<div id='comments'><p>{LONG}</p><p>{LONG}</p></div>",
                  "<div class='sidebar'><div class='widget'><h3>x</h3></div></div>"):
        assert article(inner) == start + end, inner


def test_a_high_ratio_overrules_a_name():
    for box in ("<div class='banner-layout'>", "<div id='skip'><div class='widget'>"):
        page = f"<body>{NOISE}{box}<h1>T</h1><p>{LONG * 2}</p><p>{LONG}</p></div></div>{TAIL}"
        assert html.main_text(page) == f"T {LONG * 3}".strip(), box
    page = f"<body><article><p>Short.</p></article><div class='ad'>{LONG * 3}</div>"
    assert html.main_text(page) == "Short."


def test_odd_input():
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p>") == ""
    assert html.main_text("a < b &lt; c & d") == "a < b < c & d"
    assert html.main_text("<ul><li>one<li>two</ul>") == "one two"
    assert html.main_text('<p title="a>b">x</p><p title=unclosed">y') == "x y"
    assert html.main_text("<script>if (a<b) '</div>'</script>text") == "text"
    assert html.main_text("<p>a\xa0 b</p>") == "a b"
    for page in ("<" * 50_000, "<b>x" * 30_000, "<div>" * 30_000 + "x", "<a href='" * 20_000):
        html.main_text(page)
    assert len(html.main_text("<p>" + "w " * 300_000)) == 599_999


def test_rows(spark):
    rows = [(1, "u", "<p>x", "t"), (1, "u", "<p>x", "t"), (None, None, None, None)]
    pages = ready(spark).createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = pages.select("page_id", html.extract(F.col("html")).alias("m")).collect()
    assert sorted(r["m"] for r in got) == ["", "x", "x"]
    assert pages.limit(0).select(html.extract(F.col("html")).alias("m")).count() == 0
