"""What hides an element, and what only has the word in its attributes."""

from __future__ import annotations

import pytest

from lodestrata.llm import extract

TEXT = "A paragraph that is long enough to be the text of the page, with no links in it and a second clause."


@pytest.mark.parametrize("attrs", ['class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', "data-x='hidden'", 'data-hidden="1"', 'title="hidden things"'])
def test_shown(attrs):
    for name in ("article", "main", "div"):
        assert extract.main_text(f"<body><{name} {attrs}><p>{TEXT}</p></{name}></body>") == TEXT


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', 'hidden="until-found"', 'id="a" hidden', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"', "style='visibility:hidden'"])
def test_hidden(attrs):
    assert extract.main_text(f"<body><p>{TEXT}</p><div {attrs}><p>Not {TEXT}</p></div></body>") == TEXT
