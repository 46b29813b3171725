"""Canonical links and refresh redirects as pages write them; pages of a megabyte."""

from __future__ import annotations

import time

import pytest

from lodestrata.llm import url_filter

HERE = "http://example.org/a/b?c"
CASES = [
    ('<link rel="canonical" href="/de/1">', "http://example.org/de/1"),
    ("<LINK REL=canonical HREF=../x>", "http://example.org/x"),
    ("<link href='//other.net/y' rel='alternate canonical'/>", "http://other.net/y"),
    ('<link rel="canonical" href="http://e.org/?a=1&amp;b=2&#x26;c">', "http://e.org/?a=1&b=2&c"),
    ('<base href="http://base.net/z/"><link rel=canonical href=q>', "http://base.net/z/q"),
    ('<meta http-equiv="Refresh" content="0; URL=\'/new\'">', "http://example.org/new"),
    ("<meta content='5;url=http://e.org/n?x=1' http-equiv=refresh>", "http://e.org/n?x=1"),
    ('<link data-rel="canonical" rel="stylesheet" href="s.css">', None),
    ('<!-- <link rel="canonical" href="/no"> -->', None),
    ("<script>'<link rel=canonical href=/no>'</script>", None),
    ('<meta name="refresh" content="0; url=/no">', None),
    ('<link rel="canonical" href="http://[bad">', None),
    ('<link rel="canonical">', None),
    (None, None),
]


def test_targets(spark):
    pages = spark.createDataFrame([(k, f"{HERE}{k}", h, "x") for k, (h, _) in enumerate(CASES)] + [(99, None, CASES[0][0], "x")], "page_id long, url string, html string, src string")
    got = {(r.src, r.dst) for r in url_filter.declared_edges(pages).collect()}
    told = {(f"{HERE}{k}", want) for k, (_, want) in enumerate(CASES) if want}
    assert got == told | {(f"{HERE}{k}", "example.org/a/b") for k in range(len(CASES))}


@pytest.mark.parametrize("unit", ["<link rel ", "<link rel=canonical ", "<!-- ", "<script>", "<meta http-equiv=refresh content='", "<base <link rel='", '<link rel="" '])
def test_long_pages_take_linear_time(spark, unit):
    pages = spark.createDataFrame([(1, HERE, unit * (1_000_000 // len(unit)))], "page_id long, url string, html string")
    began = time.time()
    assert [r.dst for r in url_filter.declared_edges(pages).collect()] == ["example.org/a/b"]
    assert time.time() - began < 20


def test_verdicts_spread_over_declared_links(spark):
    rows = [(1, "http://x.org/1", '<link rel=canonical href="http://shop.net/1">'), (2, "http://x.org/2", "<meta http-equiv=refresh content='0;url=/1'>"), (3, "http://x.org/3", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in url_filter.propagate(pages, url_filter.declared_edges(pages)).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default")}
