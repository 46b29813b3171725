"""Starts of repeated strings leave their step as few ranges, not as lists of single starts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestrata.llm import substrings


def test_ranges_of_starts(spark):
    rng = random.Random(33)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(900))
    rows = [(k, "".join(rng.choice("qrstuvwxyz ") for _ in range(rng.randrange(1, 300))) + "." + passage + "." + "".join(rng.choice("qrstuvwxyz ") for _ in range(90))) for k in range(40)]
    for hot in (2000, 7):
        got = substrings.repeated_starts(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
        at = {k: t.index(".") + 1 for k, t in rows}
        spans = {r.doc_id: [(s.a, s.b) for s in r.spans] for r in got}
        assert all(len(own) == 1 and own[0][0] <= at[k] and own[0][1] >= at[k] + 500 for k, own in spans.items()) and len(spans) == 40


def test_merged_over_batches():
    rng = random.Random(5)
    rows = sorted((rng.randrange(-3, 9), a := rng.randrange(300), a + rng.choice([0, 0, 1, 5])) for _ in range(400))
    want = {}
    for d, a, b in rows:
        want.setdefault(d, set()).update(range(a, b + 1))
    for size in (1, 3, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(x)) for x in zip(*rows[k : k + size])], ["doc_id", "a", "b"]) for k in range(0, 400, size)]
        got = [r for b in substrings._merged(iter(batches)) for r in b.to_pylist()]
        assert [r["doc_id"] for r in got] == sorted(want)
        for r in got:
            own = [(s["a"], s["b"]) for s in r["spans"]]
            assert {x for a, b in own for x in range(a, b + 1)} == want[r["doc_id"]]
            assert all(a > b + 1 for (_, b), (a, _) in zip(own, own[1:]))
    assert list(substrings._merged(iter([]))) == []
