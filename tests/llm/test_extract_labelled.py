"""Pages labelled by hand, whatever the rule: each line says whether it is the article's."""

from __future__ import annotations

import pytest

from lodestrata.llm import extract

LONG = "This paragraph is a long one, with several clauses that go on for a while, so that it weighs as much as any text of a page does."
FAR = "<nav>one</nav><nav>two</nav><nav>three</nav><nav>four</nav>"

PAGES = {
    "a short second article": (f"<article><p>{LONG}</p><p>{LONG}</p></article>{FAR}<article><p>Short.</p></article>", [LONG, LONG, "Short."]),
    "a short part of the main element": (f"<main><p>Short</p></main>{FAR}<main><p>{LONG * 9}</p></main>", ["Short", LONG * 9]),
    "a lead apart from the body": (f"<p>A short lead says what comes, in one line.</p>{FAR}" + f"<p>{LONG}</p>" * 5, ["A short lead says what comes, in one line.", *[LONG] * 5]),
    "a paragraph of links within": (f"<p>{LONG}</p><p><a href=x>The reports of the year before last are all listed there</a>, see.</p><p>{LONG}</p>", [LONG, "The reports of the year before last are all listed there, see.", LONG]),
    "a linked title within": (f"<p>{LONG}</p><p><a href=x>Reports</a></p><p>{LONG}</p>", [LONG, "Reports", LONG]),
    "menus of links around": (f"<ul><li><a>Home</a><li><a>News</a><li><a>About us</a></ul><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><ul><li><a>Imprint</a><li><a>Contact</a></ul>", ["Title", LONG, LONG]),
    "an article with words in its class": (f'<article class="post legal-notice"><p>{LONG}</p></article>', [LONG]),
    "an article open to comments": (f'<div id="menu-1">Menu</div><article class="post comments-open"><p>{LONG}</p></article><div class="comments"><p>Nice!</p></div>', [LONG]),
    "a main element with a sidebar's class": (f'<main class="site-main with-sidebar"><p>{LONG}</p><div class="sidebar">Other posts</div></main>', [LONG]),
    "a side element around the text": (f'<article><div class="side"><p>{LONG}</p><p>{LONG}</p></div><div class="share">Share this</div></article>', [LONG, LONG]),
    "a holder with words in its class": (f'<div class="content-with-sidebar"><div class="sidebar"><p>{LONG}</p></div><article><p>{LONG}</p><p>{LONG}</p></article></div>', [LONG, LONG]),
    "a form around the page": (f"<form><nav>Menu</nav><article><p>{LONG}</p></article><input></form>", [LONG]),
    "a form within the article": (f"<article><p>{LONG}</p><form><p>Your address here, please, so that we can write.</p></form></article>", [LONG]),
    "comments as articles": (f'<article><p>{LONG}</p></article><section id="comments"><article class="comment"><p>First reader says this and that.</p></article><article><p>Second.</p></article></section>', [LONG]),
    "teasers of related posts": (f'<article><p>{LONG}</p></article><div class="related"><article><p>Another post</p></article></div>', [LONG]),
    "adverts and notices": (f'<div class="cookie-notice">We use cookies.</div><article><p>{LONG}</p><div class="ad">Buy</div><p>{LONG}</p></article><footer>c</footer>', [LONG, LONG]),
    "a hidden article": (f"<article hidden><p>{LONG}</p></article><p>{LONG} Seen.</p>", [f"{LONG} Seen."]),
    "only links": ("<ul><li><a>Home</a><li><a>News</a></ul>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    markup, want = PAGES[name]
    assert extract.main_text(f"<html><body>{markup}</body></html>") == "\n".join(want)


def test_deep_marks_take_linear_time():
    import time

    began = time.process_time()
    assert extract.main_text("<div class=side>" * 60_000 + "x<p>" * 60_000)
    extract.main_text("<article class=ad>" * 60_000 + "<p>x</p>" * 60_000)
    assert time.process_time() - began < 8
