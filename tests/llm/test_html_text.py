import time

import pytest

from optrace.llm.html_text import main_text, page_texts

LONG = "Plenty of words make up this paragraph, so that its density is that of prose. " * 3


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="home">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>{LONG}</p></div>
    <article><h1>Head &amp; line</h1><p>{LONG}<br>more &eacute;&#233;&lt;b&gt;</p><aside>see also</aside><form><p>name</p></form>
    <p><b>open <a href="x">link</a> <p>next</article>
    <section class="comments"><p>{LONG}{LONG}</p></section><footer>foot</footer></body></html>"""
    prose = " ".join(LONG.split())
    assert main_text(page).split("\n\n") == ["Head & line", f"{prose} more éé<b>", "open link", "next"]


def test_without_article_element():
    page = f"<body><div class=top><a href=a>one</a> <a href=b>two</a></div><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><a href=c>more</a></div>"
    assert main_text(page).split("\n\n") == [" ".join(LONG.split())] * 2


def test_article_in_sibling_containers():
    """Two halves with an advert and a menu between them, in containers of different density."""
    prose = " ".join(LONG.split())
    menu = "<div><a href=a>one</a> <a href=b>two</a></div>"
    page = f"<body>{menu}<section><p>{LONG}</p><p>{LONG}</p></section><div class=ad><p>{LONG}</p></div>{menu}<section><p>{LONG}</p></section></body>"
    assert main_text(page).split("\n\n") == [prose] * 3
    uneven = f"<body>{menu}<section>{f'<p>{LONG}</p>' * 4}</section><div class=ad><p>{LONG}</p></div><section><p>{LONG}</p></section></body>"
    assert main_text(uneven).split("\n\n") == [prose] * 5


def test_mark_among_other_words():
    prose = " ".join(LONG.split())
    page = f"<body><div class='page has-sidebar'><div><p>{LONG}</p><p>{LONG}</p></div><div class='ad-slot'><p>Buy this.</p></div><div id=sidebar><p>{LONG}</p></div></div></body>"
    assert main_text(page).split("\n\n") == [prose] * 2


@pytest.mark.parametrize("page", [None, "", " ", "<html></html>", "<script>x", "<!-- open", "<p></p>", "<nav>a</nav>"])
def test_no_text(page):
    assert main_text(page) == ""


@pytest.mark.parametrize("page,text", [
    ("plain", "plain"), ("a < b & c", "a < b & c"), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<article>x", "x"),
    ("<div><p>one  \n two</p></div>", "one two"), ("<p title='a>b'>t</p>", "t"), ("<p>a</article></b>b</p>", "ab"), ("<p>" * 5000 + "deep", "deep"),
    ("<div>" * 3000 + "deep", "deep"), ("<article><header><h1>h</h1></header><p>t</p></article>", "h\n\nt"),
])
def test_broken_and_small(page, text):
    assert main_text(page) == text


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "v", "<p>bé</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, page_texts(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (None, "v", "bé", 2)], key=str)
    assert page_texts(pages.limit(0)).count() == 0


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html
    import re

    for page, row in zip(sorted(pages.collect()), sorted(page_texts(pages).collect())):
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert row.text == "\n\n".join(x for x in blocks if x)


TEXT = "<p>One line of it says this.</p><p>Another line says that.</p>"


def test_sibling_articles_stay():
    other = "<p>The second one is as long.</p><p>It has two lines as well.</p>"
    both = "One line of it says this.\n\nAnother line says that.\n\nThe second one is as long.\n\nIt has two lines as well."
    for page in ("<main><article>{}</article><article>{}</article></main>", "<article>{}</article><article>{}</article>", "<body><div><article>{}</article></div><article>{}</article>"):
        assert main_text(page.format(TEXT, other)) == both


def test_reader_comments_go_whatever_their_size():
    remark = "<p>" + "This is what somebody has to say about it. " * 9 + "</p>"
    for name in ("user-comment-list", "reader-comments", "CommentsSection", "post-replies"):
        assert main_text(f"<article>{TEXT}<div class='{name}'><div>{remark}</div></div></article>") == "One line of it says this.\n\nAnother line says that."
    held = f"<div class='comments-below x'><div class=c>{remark}</div><div class=c>{remark}</div></div>"
    assert "somebody" not in main_text(f"<article>{TEXT * 3}{held}</article>")
    assert "Another line" in main_text(f"<div class='has-comments'>{TEXT * 4}</div>")


def test_long_pages_take_proportional_time():
    pages = ['<a "' * 250_000, "<div>" * 100_000 + "x", "<p><button>" + "<div>" * 50_000, "<a \"'>" * 100_000, "<a " * 200_000 + '">', "<script></script " * 50_000, "<" * 500_000, "</b>" * 200_000]
    for page in pages:
        start = time.process_time()
        main_text(page)
        assert time.process_time() - start < 8  # quadratic time would be minutes


def test_quotes_in_tags():
    assert main_text("<p title='a > b'>One</p><p title=\"c's\">Two</p>") == "One\n\nTwo"
    assert main_text('<p title="open>One</p>') == "One"
    assert main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
