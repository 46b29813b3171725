"""Runs of repeated lines against plain rules, and boundaries that move with the text."""

from __future__ import annotations

import random

import pytest

from lodestrata.llm import line_dedup

from .helpers import check_line_dedup, split_lines


def fresh(rng: random.Random) -> str:
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(4, 12))) + rng.choice([".\n", ". ", "! ", "\n"])


def test_line_stops():
    rng = random.Random(1)
    texts = ["", "\n", " ", ". ", "a. b", " a! ", ".\n x?", "é. è"] + ["".join(rng.choice("a. \n!é") for _ in range(rng.randrange(30))) for _ in range(300)]
    for t in texts:
        data = t.encode()
        stops = line_dedup.line_stops(data).tolist()
        assert [data[a:b].decode() for a, b in zip([0, *stops], stops)] == split_lines(t), repr(t)


def test_boundaries_of_joined_texts_are_those_of_each():
    rng = random.Random(2)
    texts = ["".join(fresh(rng) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 30, 0, 5)] + [b" x. y", b". a. b. c"]
    own, key, at = line_dedup.boundaries(texts)
    for k, t in enumerate(texts):
        _, alone, places = line_dedup.boundaries([t])
        assert key[own == k].tolist() == alone.tolist() and at[own == k].tolist() == places.tolist()
        assert len(alone) > 0 or t.count(b"\n") + t.count(b". ") + t.count(b"! ") < 2


@pytest.mark.parametrize("n", [4, 5, 8, 40])
def test_equal_runs_share_a_boundary(n):
    rng = random.Random(n)
    for _ in range(100):
        run = [fresh(rng) for _ in range(n)]
        keys = []
        for _ in range(2):
            texts = ["".join([fresh(rng)[:-1] + "\n" for _ in range(rng.randrange(1, 9))] + run + [fresh(rng) for _ in range(rng.randrange(9))]).encode()]
            keys.append(set(line_dedup.boundaries(texts)[1].tolist()))
        assert keys[0] & keys[1]


def corpus(seed: int) -> dict[int, str]:
    rng = random.Random(seed)
    passages = [[fresh(rng) for _ in range(rng.randrange(2, 14))] for _ in range(12)]
    texts: dict[int, str] = {}
    for i in range(60):
        parts: list[str] = []
        for _ in range(rng.randrange(1, 5)):
            parts += [fresh(rng) for _ in range(rng.randrange(0, 6))]
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            parts += p[a : rng.choice([len(p), rng.randrange(a, len(p) + 1)])]
        texts[i] = "".join(x if x.endswith((" ", "\n")) else x + "\n" for x in parts)
    texts |= {60: texts[3], 61: texts[3], 62: "", 63: " \n", 64: "one line", 65: "".join(fresh(rng) for _ in range(4000))}
    texts[66] = texts[65]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_rules(spark, seed):
    texts = corpus(seed)
    rows = line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert check_line_dedup(texts, {r.doc_id: r.kept for r in rows}) > 4100


def test_lines_that_repeat_within_a_text(spark):
    line = "the same line of some words again. "
    texts = {1: line * 50, 2: "x y. " + line * 9 + "z", 3: "one. two. " * 40}
    got = {r.doc_id: r.kept for r in line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == line and got[3] == "one. two. "
    # the first boundary has no lines before it, so up to WINDOW - 1 lines before the first one here stay
    assert got[2] in {"x y. " + line * k + "z" for k in range(line_dedup.WINDOW)}


def test_equal_hashes_are_not_enough(spark, monkeypatch):
    """With hashes that all agree, bytes still decide."""
    rng = random.Random(4)
    texts = {i: "".join(fresh(rng) for _ in range(9)) for i in range(4)}
    data = {i: t.encode() for i, t in texts.items()}
    for i in (1, 2, 3):
        assert not line_dedup.regions(data[i], [(0, data[0]), (-7, data[0]), (len(data[i]) - 5, data[0])], 2, 1)
    assert line_dedup.regions(data[0], [(0, data[0])], 2, 1) == [(0, len(data[0]), len(split_lines(texts[0])))]
