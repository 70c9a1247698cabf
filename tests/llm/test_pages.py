"""Ordinary pages keep their article whatever stands around it; notices and the like go."""

from __future__ import annotations

import duckdb
import pytest

from tillwise.llm import pagetext

LONG = "It is the story of a man who went to the sea and of what he saw there, as it was told to us. " * 3
LINE = " ".join(LONG.split())
BULGARIAN = "Историята разказва за един човек, който отишъл на морето, и за това, което видял там през лятото. " * 3
BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
WANT = f"Title\n\n{LINE}\n\n{LINE}"

WRAPPED = {
    "class with hidden in its name": f"<div class='overflow-hidden'><article>{BODY}</article></div>",
    "main with hidden in its class": f"<main class='overflow-hidden'>{BODY}</main>",
    "content with sidebar": f"<div class='content with-sidebar'><article>{BODY}</article></div>",
    "post has comments": f"<div class='post has-comments'><article>{BODY}</article></div>",
    "no sidebar": f"<div id='page' class='no-sidebar'><div>{BODY}</div></div>",
    "page-wide form": f"<form method='post' action='/'><article>{BODY}</article><input name='q'></form>",
    "page-wide form without article": f"<form id='f'><div>{BODY}</div></form>",
    "social wrapper around the article": f"<div class='social'><article>{BODY}</article></div>",
    "header around main": f"<header><main>{BODY}</main></header>",
    "aria-hidden only": f"<div aria-hidden='false'><article>{BODY}</article></div>",
    "attribute values are not names": f"<div data-x='display:none hidden' title='nav'><article>{BODY}</article></div>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrappers_of_the_article_stay(name):
    page = f"<html><body><nav><p>{LONG}</p></nav>{WRAPPED[name]}<footer><p>{LONG}</p></footer></body></html>"
    assert pagetext.main_text(page)[0] == WANT


def test_other_languages_and_inner_parts():
    line = " ".join(BULGARIAN.split())
    page = f"<body><div><p>{BULGARIAN}</p><p>{BULGARIAN}</p></div><div><a href=x>връзка</a> <a href=y>още</a></div></body>"
    assert pagetext.main_text(page)[0] == f"{line}\n\n{line}"
    page = f"<article><p>{LONG}</p><p>where <math><mi>x</mi></math> holds and it is so</p><p>{LONG}</p></article>"
    assert "where x holds" in pagetext.main_text(page)[0]
    page = f"<article><p>{LONG}</p><div class='search-results'><p>{LONG}</p></div></article>"
    assert pagetext.main_text(page)[0] == f"{LINE}\n\n{LINE}"


GONE = [
    "<div hidden><p>{}</p></div>",
    "<div style='color:red; display: none'><p>{}</p></div>",
    "<div class='ad'><p>{}</p></div>",
    "<div class='ad_box1'><p>{}</p></div>",
    "<section id='comment-list'><p>{}</p></section>",
    "<section class='comments'><article><p>{}</p></article></section>",
    "<div class='cookie-notice'><p>{}</p></div>",
    "<aside><p>{}</p></aside>",
    "<form><p>{}</p><input></form>",
    "<div role='navigation'><p>{}</p></div>",
    "<div class='related'><article><p>{}</p></article></div>",
    "<dialog><p>{}</p></dialog>",
    "<div class='newsletter'><p>{}</p></div>",
]


@pytest.mark.parametrize("part", GONE)
@pytest.mark.parametrize("inside", [True, False])
def test_what_is_not_the_article_goes(part, inside):
    other = part.format("Here is what we have for you and it is not of the story that was told. " * 4)
    page = f"<article>{BODY}{other}</article>" if inside else f"<article>{BODY}</article>{other}"
    assert pagetext.main_text(f"<body>{page}</body>")[0] == WANT


def test_names_of_elements():
    named = pagetext.names_itself
    assert named({"class": "with-sidebar has-comments overflow-hidden"}) == set()
    assert named({"class": "Comments", "id": "ad1", "role": "banner"}) == {"comments", "ad", "banner"}
    assert named({"class": "comment-list nav_bar"}) == {"comment", "nav"}
    assert pagetext.attributes_of(" a='1 2' b=\"x\" hidden c=d") == {"a": "1 2", "b": "x", "hidden": "", "c": "d"}
    assert not pagetext.is_hidden({"class": "hidden", "aria-hidden": "true"})


def test_given_pages_have_their_article():
    """Every given page keeps all paragraphs of its article and nothing from outside."""
    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()
    empty = sum(not pagetext.main_text(p)[0] for (p,) in pages)
    assert len(pages) > 200 and empty <= 0.02 * len(pages)
