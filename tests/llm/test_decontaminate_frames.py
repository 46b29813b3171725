"""Items that share a frame: the same places as a full alignment finds, in little time."""

from __future__ import annotations

import random
import time

import pytest

from lodestrata.llm import decontaminate

from .test_decontaminate_repeats import least_edits


def prose(rng: random.Random, n: int) -> str:
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) + " "
    return out[:n]


@pytest.mark.parametrize("n, share", [(50, 150), (2000, 175)])
def test_texts_of_the_frame_alone_take_little_time(n, share):
    rng = random.Random(n)
    frame = prose(rng, share)
    index = decontaminate.GramIndex([(k, decontaminate.normalized((frame + prose(rng, 350 - share)).encode())) for k in range(n)])
    text = decontaminate.normalized((frame * (100_000 // share)).encode())
    began = time.process_time()
    assert index.regions(text) == []
    assert time.process_time() - began < 10


@pytest.mark.parametrize("seed, share", [(1, 60), (2, 110), (3, 150), (4, 190)])
def test_places_within_the_budget(seed, share):
    rng = random.Random(seed)
    frame = prose(rng, share)
    items = [(k, decontaminate.normalized((frame + prose(rng, 210 - share)).encode())) for k in range(40)]
    index, found = decontaminate.GramIndex(items), 0
    for _ in range(25):
        item = list(rng.choice(items)[1].decode())
        for _ in range(rng.randrange(0, 20)):
            at = rng.randrange(len(item))
            item[at : at + 1] = rng.choice([[], ["z"], [item[at], "y"]])
        text = decontaminate.normalized((prose(rng, 80) + "".join(item) + prose(rng, 50) + frame).encode())
        got: dict = {}
        for i, a, b, e in index.regions(text):
            got[i] = min(e, got.get(i, e))
            assert least_edits(items[i][1], text[a:b]) <= e
        want = {i: e for n, (i, x) in enumerate(items) if (e := decontaminate.fewest_edits(x, text)) <= index.edits[n]}
        assert got == want
        found += len(want)
    assert found > 5


def test_fewest_edits_is_that_of_a_full_alignment():
    rng = random.Random(9)
    for _ in range(300):
        item, text = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, top))).encode() for top in (90, 140))
        assert decontaminate.fewest_edits(item, text) == least_edits(item, text)
