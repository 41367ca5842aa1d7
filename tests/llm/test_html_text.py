import html
import re
import time

import pytest

from shelfwise.llm.html_text import extract_pages, main_text

LONG = "This is a sentence of the article, with commas, and with enough words to count as text."

PAGES = {
    "plain": (f"<html><body><article><h1>Title</h1><p>{LONG}</p><p>{LONG} Two.</p></article></body></html>", f"Title\n{LONG}\n{LONG} Two."),
    "entities and spaces": (f"<body><div><p>A &amp; B&nbsp;&lt;c&gt;\n\t  &#233;, {LONG}</p><p>{LONG}</p></div></body>", f"A & B <c> é, {LONG}\n{LONG}"),
    "menu, notice, advert, comments": (
        f'<body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>{LONG}</p></div><main><h1>T</h1><p>{LONG}</p><div class="ad">Buy, buy, buy this thing now please.</div><p>{LONG}</p></main>'
        f'<aside><p>{LONG}</p></aside><section id="comments"><p>{LONG} Nice, really.</p></section><form><p>{LONG}</p></form><footer>{LONG}</footer></body>',
        f"T\n{LONG}\n{LONG}",
    ),
    "scripts and styles": (f'<head><title>x</title><style>p{{}}</style></head><body><script>var t="</p>";</script><div><p>{LONG}</p><script>if (a < b) {{ c("<p>no</p>") }}</script><p>{LONG}</p><noscript>no</noscript></div></body>', f"{LONG}\n{LONG}"),
    "unclosed paragraphs and bold": (f"<article><h1>T</h1><p><b>Lead text here.<br><p>{LONG}<p>{LONG}</article><footer>f</footer>", f"T\nLead text here.\n{LONG}\n{LONG}"),
    "no article element": (f'<body><div id="menu"><a href="a">a</a> <a href="b">b</a></div><div class="shadow-box"><div class="text"><p>{LONG}</p><p>{LONG}</p><p>Short one.</p></div></div><div><p>Tiny</p></div></body>', f"{LONG}\n{LONG}\nShort one."),
    "comment and broken tags": (f"<body><!-- <p>hidden</p> --><div><p>{LONG} 1 < 2 and <b>bold</b>.</p><p title=\"a>b\">{LONG}</p></div>", f"{LONG} 1 < 2 and bold.\n{LONG}"),
    "hidden": (f'<body><div><p>{LONG}</p><p style="display: none">no</p><p hidden>no</p><p>{LONG}</p></div></body>', f"{LONG}\n{LONG}"),
    "lists and tables in an article": (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table></article>", f"{LONG}\none\ntwo\na\nb"),
    "empty": ("", ""),
    "only a menu": ('<nav><a href="x">x</a></nav>', ""),
    "text without tags": (LONG, LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, text = PAGES[name]
    assert main_text(page) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5_000 + f"<p>{LONG}</p>" + "</div>" * 5_000) == LONG
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(20_000))
    assert main_text(f"<article>{body}</article>").count("\n") == 19_999
    assert main_text("<" * 100_000) == "<" * 100_000
    assert main_text('<a href="' * 5_000) == '<a href="' * 5_000


def test_job(spark):
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "x"), (2, None, None, "y"), (None, "v", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_pages(pages)
    assert found.columns == ["page_id", "url", "text"]
    assert sorted(r.text for r in found.collect()) == ["", "", PAGES["plain"][1], PAGES["plain"][1]]
    assert extract_pages(pages.limit(0)).count() == 0
    assert extract_pages(pages.drop("url")).columns == ["page_id", "text"]


def test_given_pages_keep_the_article_alone(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in pages.join(extract_pages(pages).withColumnRenamed("text", "found"), ["page_id", "url"]).collect():
        nav = r.html[r.html.index("<nav>") : r.html.index("<article>")]
        foot = r.html[r.html.index("<footer>") :]
        assert r.found and "track(" not in r.found and "<" not in r.found
        assert "&copy" not in r.found and "©" not in r.found
        assert nav and foot


def test_given_pages_give_the_blocks_of_their_article(spark, sf_dir):
    """A plain reading of the given pages, whose articles are marked and well formed: what a library that parses XML finds there."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r.text for r in extract_pages(pages).collect()}
    compared = 0
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)
        if body is None or "class=" in body[1]:
            continue
        text = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav)\b.*?</\1>", "", body[1], flags=re.DOTALL)
        text = re.sub(r"</?(?:p|h[1-6]|div|ul|ol|li|section|blockquote|header|figure|figcaption|table|tr|td)\b[^>]*>", "\0", text)
        text = re.sub(r"<[^>]*>", "", text)
        blocks = [" ".join(html.unescape(x).split()) for x in text.split("\0")]
        compared += 1
        assert found[r.page_id] == "\n".join(b for b in blocks if b)
    assert compared > 20


def test_nothing_of_an_article_is_dropped():
    parts = "<li><a href='x'>linked item</a></li><table><tr><td><a href='y'>cell</a></td></tr></table>"
    inner = f'<p>{LONG}</p><ul>{parts[:40]}</ul><p>x <math><mi>y</mi> = 2</math> z</p><section class="related-work"><p>{LONG}</p></section><div class="legal-history"><p>Old laws.</p></div>'
    text = main_text(f"<body><nav><a href='/'>Home</a></nav><article><h1>T</h1>{inner}</article></body>")
    assert text == f"T\n{LONG}\nlinked item\nx y = 2 z\n{LONG}\nOld laws."
    assert main_text(f'<body><div class="search-results widget"><p>{LONG}</p></div></body>') == LONG


def test_the_best_container_is_chosen_by_score():
    article = "<article><p>A teaser, short and linked to more.</p></article>"
    text = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    assert main_text(f"<body>{article}<div><div>{text}</div></div></body>").count("\n") >= 5
    assert main_text(f"<body><article><h1>T</h1><div><div>{text}</div></div></article><div><p>Tiny</p></div></body>").startswith("T\n")


def test_time_is_linear_in_depth():
    def took(n):
        began = time.perf_counter()
        main_text("<section>" + "<div>" * n + f"<p>{LONG}</p>" + "</b></section>x<p>y" * n)
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 40 * max(took(1_000), 0.005)


PROSE = "<p>One long sentence of the article, with commas, and more words, so that it counts.</p><p>Another sentence of it, as long as the first one, and as full of words.</p>"


def test_pages_within_a_form_and_weakly_named_parts():
    assert main_text(f"<body><form action=x><div>{PROSE}</div><input type=hidden></form></body>").count("\n") == 1
    for name in ("legal", "skip", "toc", "promotion", "legal-content"):
        page = f"<article>{PROSE}<div class='{name}'>{PROSE.replace('article', 'contract')}</div></article>"
        assert "contract" in main_text(page), name
    small = f"<article>{PROSE}<div class=toc><a href=1>First</a> <a href=2>Second chapter of the long text, and its parts</a></div><form><p>Your mail address, please</p></form><div class=comments>{PROSE.replace('article', 'reader')}</div></article>"
    assert main_text(small).count("\n") == 1


def test_time_is_linear_in_broken_pages():
    import time

    for piece in ("<a ", "<div a='", "<div a=\"x", "<a x='>'", "<!", "</", "<p", "<div a='>", "&", "<b>"):
        page = piece * (1_000_000 // len(piece)) + "<p>end"
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 10, piece
