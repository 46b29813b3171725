"""Items and texts of few letters against an alignment in full, and bounds on time and memory."""

from __future__ import annotations

import random
import time
import tracemalloc

import pytest

from lodestrata.llm import decontaminate


def least_edits(item: bytes, text: bytes) -> int:
    prev = [0] * (len(text) + 1)
    for x, a in enumerate(item):
        cur = [x + 1]
        for y, b in enumerate(text):
            cur.append(min(prev[y] + (a != b), prev[y + 1] + 1, cur[y] + 1))
        prev = cur
    return min(prev)


@pytest.mark.parametrize("seed", range(6))
def test_few_letters(seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", [50, 1_000_000][seed % 2])
    rng = random.Random(seed)
    letters = ["a", "ab", "abc", "aaaaaab", "abcdefgh", "ab c"][seed]

    def word(n: int) -> str:
        return "".join(rng.choice(letters) for _ in range(n))

    items = [(k, decontaminate.normalized(t.encode())) for k, t in enumerate([word(60), word(130), "a" * 100, ("ab" * 60), word(40) * 3, "".join(rng.choice("defghijk") for _ in range(150))])]
    index = decontaminate.GramIndex(items)
    hits = 0
    for k in range(40):
        item = rng.choice(items)[1].decode()
        t = list(item)
        for _ in range(rng.randrange(0, 12)):
            if t:
                at = rng.randrange(len(t))
                t[at : at + 1] = rng.choice([[], ["z"], [t[at], "y"], [rng.choice(letters)]])
        text = decontaminate.normalized((word(rng.randrange(60)) + "".join(t) + word(rng.randrange(60))).encode())
        got = {}
        for i, a, b, e in index.regions(text):
            got[i] = min(e, got.get(i, e))
            assert least_edits(items[i][1], text[a:b]) <= e
        want = {}
        for n, (i, x) in enumerate(items):
            e = least_edits(x, text)
            if e <= index.edits[n]:
                want[i] = e
        assert got == want
        hits += len(want)
    assert hits > 10


@pytest.mark.parametrize("unit", [b"a", b"ab", b"abcdefghijklmnopqrstuvwxyz", b"one two three four "])
def test_long_texts_of_one_kind(unit):
    items = [(1, decontaminate.normalized(unit * 600)[:500]), (2, b"an item with words that stand nowhere else in what is looked at here")]
    index = decontaminate.GramIndex(items)
    text = decontaminate.normalized(unit * (400_000 // len(unit)))
    began = time.process_time()
    tracemalloc.start()
    found = index.regions(text)
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()
    assert time.process_time() - began < 40 and {i for i, *_ in found} == {1}


def test_blocks_are_met_one_at_a_time(spark):
    rng = random.Random(2)
    words = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(12)]
    docs = spark.createDataFrame([(k, "x " + w + " y") for k, w in enumerate(words)] + [(99, None), (None, words[3])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(words)) + [(None, words[5]), (77, "w")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench, block_bytes=300).collect()}
    assert got == {(k, k) for k in range(12)} | {(None, 3), (5, None)}
