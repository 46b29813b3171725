"""Sweeps over spans and the closure of windows, against plain loops, and one key with very many spans."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import spans as S

SPANS = "k string, start long, end long"


def rows(rng: random.Random, n: int) -> list[tuple]:
    out = [(rng.choice(["a", "b", None]), s := rng.randrange(40), s + rng.randrange(0, 9)) for _ in range(n)]
    return out + [("a", None, 5), ("a", 3, None)]


@pytest.mark.parametrize("seed", range(4))
def test_random_spans(spark, seed):
    rng = random.Random(seed)
    left, right = rows(rng, 40), rows(rng, 12)
    a, b = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)

    def points(spans):
        return {(k, x) for k, s, e in spans if s is not None and e is not None for x in range(s, e)}

    got = S.subtract_spans(a, b, ["k"]).collect()
    assert points([tuple(r) for r in got]) == points(left) - points(right)
    ends = {(r.k, r.start) for r in got}
    assert not ends & {(r.k, r.end) for r in got}  # what touches is one
    inner = sorted((tuple(r) for r in S.contained_in(a, b, ["k"]).collect()), key=str)
    want = [x for x in left if None not in x and any(y[0] == x[0] and None not in y and y[1] <= x[1] and y[2] >= x[2] for y in right)]
    assert inner == sorted(want, key=str)


def test_one_key_with_very_many_spans(spark):
    n = 300_000
    own = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 8).alias("end"))
    cut = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    began = time.time()
    assert S.subtract_spans(own, cut, ["k"]).count() == 2 * n
    assert S.contained_in(cut, own, ["k"]).count() == n
    assert time.time() - began < 120


def closure(windows: list[list[int]], comments: list[tuple[int, int]], blank: list[bool]) -> list[tuple[int, int]]:
    def empty(first: int, last: int) -> bool:
        return all(blank[i] for i in range(first, last + 1))

    for w in windows:
        changed = True
        while changed:
            changed = False
            for s, e in comments:
                near = (s <= w[1] and e >= w[0]) or (e < w[0] and empty(e + 1, w[0] - 1)) or (s > w[1] and empty(w[1] + 1, s - 1))
                grown = [min(w[0], s), max(w[1], e)]
                if near and grown != w:
                    w[:], changed = grown, True
    out: list[list[int]] = []
    for w in sorted(windows):
        if out and w[0] <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], w[1])
        else:
            out.append(list(w))
    return [tuple(w) for w in out]


@pytest.mark.parametrize("seed", range(6))
def test_windows_take_in_comments_across_blank_lines(spark, seed):
    rng = random.Random(seed)
    lines, chosen, want = [], [], {}
    for k in range(150):
        n = rng.randrange(5, 60)
        kinds = [rng.choice(["", "", "# c", "x"]) for _ in range(n)]
        mine = sorted(rng.sample(range(1, n + 1), rng.randrange(1, 4)))
        lines += [(k, i, text) for i, text in enumerate(kinds, 1)]
        chosen += [(k, i, i) for i in mine]
        comments, i = [], 1
        while i <= n:
            j = i
            while j <= n and kinds[j - 1] == "# c":
                j += 1
            if j > i:
                comments.append((i, j - 1))
            i = max(j, i + 1)
        blank = [False, *[not t for t in kinds], False]
        want[k] = closure([[max(1, i - 2), min(n, i + 2)] for i in mine], comments, blank)
    table = spark.createDataFrame(lines, "path long, line_no int, line string")
    ranges = spark.createDataFrame(chosen, "path long, start long, end long")
    totals = table.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    found = S.context_windows(ranges, S.comment_ranges(table), totals, ["path"], pad=2, nonblank=S.nonblank_prefix(table)).collect()
    got: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.path, r.start)):
        got.setdefault(r.path, []).append((r.start, r.end))
    assert got == want


def test_header_of_the_class(spark):
    units = spark.createDataFrame([("c", "f", 10, 12, True), ("c", "g", 14, 80, False), ("d", "f", 5, 6, True), ("e", "f", 9, 9, True)], "k string, name string, start_line int, end_line int, selected boolean")
    owners = spark.createDataFrame([("c", 4), ("d", 5)], "k string, owner_start int")
    got = {r.k: (r.before, r.after, r.header_start, r.header_end) for r in S.neighbor_members(units, ["k"], 3, owners).collect()}
    assert got == {"c": (None, None, 4, 6), "d": (None, None, None, None), "e": (None, None, None, None)}
