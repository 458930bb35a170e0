"""Main text of pages whose names and forms mislead."""

import pytest

from seriesloom.llm.html import STEP, best_container, extract_main_text, main_text, page_blocks

ARTICLE = "<p>" + "A long sentence of the article. " * 20 + "</p>"
TEXT = ("A long sentence of the article. " * 20).strip()
MENU = "<div class='menu'><a href='x'>Home</a> plain menu</div>"


def text_of(html):
    blocks = page_blocks(html)
    return main_text(blocks, best_container(blocks)[0])


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "with-share", "related-layout", "layout-search", "w-1/2", "a b/c"])
def test_names_of_layouts_do_not_hide_the_article(name):
    assert text_of(f"<html><body>{MENU}<div class='{name}'>{ARTICLE}</div></body></html>") == TEXT
    assert text_of(f"<body>{MENU}<main><div class='post {name}'>{ARTICLE}</div></main>") == TEXT


def test_a_form_around_the_page_is_no_form():
    page = f"<body><form action='x'>{MENU}<div class='c'>{ARTICLE}</div><div class='sidebar'>side words</div></form>"
    assert text_of(page) == TEXT
    assert text_of(f"<body><div class='c'>{ARTICLE}</div><form><p>Leave a reply</p><textarea>x</textarea></form>") == TEXT


def test_marked_elements_need_the_heading_and_most_of_the_text():
    assert text_of(f"<body>{MENU}<div class='widget'><h1>Title</h1>{ARTICLE}</div>") == f"Title\n{TEXT}"
    assert text_of(f"<body><div class='c'><h1>Title</h1>{ARTICLE}</div><div class='widget'><p>few words</p></div>") == f"Title\n{TEXT}"
    comments = f"<div class='comments'><article class='comment'>{ARTICLE}{ARTICLE}</article></div>"
    assert text_of(f"<body><article><p>A short article.</p></article>{comments}") == "A short article."
    assert text_of(f"<body><div class='masthead'><h1>Site</h1></div><div class='c'>{ARTICLE}</div>") == TEXT


def test_paths_survive_the_vote(spark):
    """A class with a slash wins its host's vote, and pages without it fall back on their own container."""
    page = "<body><div class='w-1/2 col-{}'>" + ARTICLE + "</div>"
    rows = [(i, "http://h.example/a", page.format(i)) for i in range(5)] + [(9, "http://h.example/b", f"<body>{ARTICLE}")]
    rows += [(9, "http://h.example/b", f"<body>{ARTICLE}")]  # a repeated row
    schema = "page_id long, url string, html string, text string, n_chars int, __path string, host string"
    df = spark.createDataFrame([(*r, "t", 1, "p", "h") for r in rows], schema).repartition(3)
    got = extract_main_text(df).collect()
    assert len(got) == 7 and all(r.text == TEXT and r.n_chars == len(TEXT) for r in got)
    path = best_container(page_blocks(rows[0][2]))[0]
    assert tuple(STEP.join(path).split(STEP)) == path and any("w-#/#" in p for p in path)


def test_very_long_and_empty_pages(spark):
    long = "<body>" + "<p>" + "word " * 200_000 + "</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a/x", long), (2, None, None), (None, "", ""), (4, "http://a/x", "<p>ö &amp; ü"), (5, "no host", "<!-- only -->")]
    got = {r.page_id: r for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text.startswith("word word") and got[1].n_chars >= 999_999
    assert got[2].text == got[None].text == got[5].text == "" and got[2].n_chars == 0
    assert got[4].text == "ö & ü" and got[4].n_chars == 5
