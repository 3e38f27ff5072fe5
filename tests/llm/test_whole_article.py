"""No part of an article is dropped for being small beside its largest section."""

from geoframe.llm.html_extract import main_text

LONG = "A paragraph of the long section, with commas, more commas, and a good deal of text after them, " * 12
NOISE = '<nav><a href="/">Home</a></nav><div class="ad">Buy, now, cheap, things.</div>'


def page(body):
    return f"<html><body>{NOISE}{body}<footer>Foot, of, the, page.</footer></body></html>"


def test_small_sections_of_an_article_stay():
    for inside in ("article", "main", "div"):
        b = "Short section, with, commas. " * 14
        text = main_text(page(f"<{inside}><section>{'<p>' + LONG + '</p>' * 1}{('<p>' + LONG + '</p>') * 39}</section><section><h2>Head B</h2><p>{b}</p></section><h2>Last</h2><p>Short end.</p></{inside}>"))
        assert text.split("\n\n") == [LONG.strip()] * 40 + ["Head B", b.strip(), "Last", "Short end."]


def test_rows_stay():
    rows = [f"Row {n} has one paragraph, that is all, and it is about as long as the others." for n in range(5)] + ["A short last row of the page, after the others."]
    body = '<div class="page">' + "".join(f'<div class="row"><div class="col"><p>{r}</p></div></div>' for r in rows) + "</div>"
    assert main_text(page(body)).split("\n\n") == rows


def test_lists_of_links_beside_the_text_go_but_its_own_stay():
    links = "<ul>" + "".join(f'<li><a href="/{n}">Some link {n}</a></li>' for n in range(4)) + "</ul>"
    body = f"<main><div>{links}</div><section>{('<p>' + LONG + '</p>') * 9}</section><section><p>{LONG}</p>{links}</section></main>"
    assert main_text(page(body)).split("\n\n") == [LONG.strip()] * 10 + [f"Some link {n}" for n in range(4)]


def test_articles_side_by_side_stay():
    body = f"<div><article><h2>One</h2>{('<p>' + LONG + '</p>') * 30}</article><article><h2>Two</h2><p>Its text, of a single line of some length, is short.</p></article></div>"
    assert main_text(page(body)).split("\n\n") == ["One", *[LONG.strip()] * 30, "Two", "Its text, of a single line of some length, is short."]
