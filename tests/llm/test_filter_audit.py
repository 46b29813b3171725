"""Counts of every order against filters applied one after the other in plain Python."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import filter_audit

from .helpers import frame


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    kinds = [
        lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.choice([3, 99, 100, 160]))),
        lambda: " ".join(f"w{i}" for i in range(rng.choice([99, 100, 101]))),
        lambda: "ABC " * 40 + "x" * rng.randrange(900),
        lambda: "same text",
        lambda: "a\x0bb\x1cc $" + " " * 3,
        lambda: "É" * 30 + "Z" * 3,
        lambda: "",
        lambda: None,
        lambda: "word " * 5000,
    ]
    rows = [(i, rng.choice(kinds)(), rng.choice(["en", "fr", None, ""]), "s", 0, "c", "h", "k", "z", "s") for i in range(120)]
    rows += [(None, "same text", "en", "s", 0, "c", "h", "k", "z", "s"), (5, "same text", "xx", "s", 0, "c", "h", "k", "z", "s"), (5, "$", "xx", "s", 0, "c", "h", "k", "z", "s")]
    return rows


def failing(rows: list[tuple]) -> list[set[str]]:
    ids: dict[str, list[int]] = {}
    for r in rows:
        if r[0] is not None:
            ids.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A"} if len(words) < 100 else set()
        own |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        own |= {"E"} if r[0] is not None and any(i < r[0] for i in ids[text]) else set()
        out.append(own)
    return out


def walked(parts: list[str], fails: list[set[str]], marks: list[bool], letters: str) -> dict:
    out, shapley = {}, {}
    for order in itertools.permutations(letters):
        for part in set(parts):
            alive = [i for i, p in enumerate(parts) if p == part]
            mine = list(alive)
            for step, x in enumerate(order, 1):
                gone = [i for i in alive if x in fails[i]]
                failed = sum(x in fails[i] for i in mine)
                alive = [i for i in alive if x not in fails[i]]
                out[part, "".join(order), step] = (len(alive), len(gone), failed - len(gone), sum(fails[i] == {x} for i in mine), sum(marks[i] for i in gone))
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_orders(spark, seed):
    rows = made(seed)
    measured = filter_audit.measured(frame(spark, rows)).withColumn("mark", F.col("doc_id") % 3 == 0)
    got = filter_audit.permutation_trie(measured, {k: F.col(k) for k in "ABCDE"}, F.col("part"), {"lost": F.col("mark")}).collect()
    want = walked([r[2] or "" for r in rows], failing(rows), [r[0] is not None and r[0] % 3 == 0 for r in rows], "ABCDE")
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley) for r in got} == want
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_few_filters_null_conditions_and_no_rows(spark):
    rows = spark.createDataFrame([("p", None, True), ("p", False, None), ("q", True, True)], "part string, x boolean, y boolean")
    got = filter_audit.permutation_trie(rows, {"X": F.col("x"), "Y": F.col("y")}, F.col("part"), {}).collect()
    want = walked(["p", "p", "q"], [{"Y"}, set(), {"X", "Y"}], [False] * 3, "XY")
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, 0, r.shapley) for r in got} == want
    assert filter_audit.permutation_trie(rows.limit(0), {"X": F.col("x")}, F.col("part"), {}).collect() == []
    with pytest.raises(ValueError):
        filter_audit.permutation_trie(rows, {c: F.col("x") for c in "ABCDEFGH"}, F.col("part"), {})


def test_survivors_are_not_left_persisted(spark):
    rows = spark.createDataFrame([("p", True)], "part string, x boolean")
    filter_audit.permutation_trie(rows, {"X": F.col("x")}, F.col("part"), {}).collect()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
