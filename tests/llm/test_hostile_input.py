"""Hostile texts take linear time in the page parser and in the trimming of secret candidates."""

import time

import pytest

from tillroll.llm import page_model, secret_forest


@pytest.mark.parametrize("source", [
    "<a " * 300_000, "<!" * 400_000, '<a "> "' * 150_000, '<div class="' * 90_000,
    "<div>" * 100_000 + "</div>" * 100_000, "<div>" * 50_000 + "<tr></tr>" * 50_000, "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
], ids=["open", "declaration", "quotes", "attribute", "nested", "rows", "items"])
def test_pages_of_a_megabyte_are_parsed_in_linear_time(source):
    start = time.process_time()
    page_model.Page(source).blocks()
    assert time.process_time() - start < 15


def test_elements_end_where_html_ends_them():
    parsed = page_model.Page("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<div>f</div><h1>g<h2>h</h2><table><tr><td>i<td>j<tr><td>k</table>m < n <b")
    assert [(page.tags[i], text) for page in [parsed] for i, text in page.blocks()] == [
        ("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("p", "e"), ("div", "f"), ("h1", "g"), ("h2", "h"), ("td", "i"), ("td", "j"), ("td", "k"),
        ("#root", "m < n <b")]


def test_candidates_lose_only_brackets_that_open_outside():
    start = time.process_time()
    assert secret_forest.candidates("key=" + ")" * 1_000_000) == []
    assert time.process_time() - start < 15
    for text, value in (("(key=a1b2c3)", "a1b2c3"), ("key=f(x)", "f(x)"), ("[key=a[0]].", "a[0]]"), ("{pwd: Zq9!x}", "Zq9!x"), ("<token=a<b>>", "a<b>>")):
        assert value in [text[a:b] for a, b in secret_forest.candidates(text)]
