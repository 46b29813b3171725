"""Nodes against a trie of plain dictionaries, with fingerprints so short that they collide."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lodestrata.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, fp string, rep_id string"


def made(seed: int, n: int = 60, alphabet: str = "ab") -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in [*range(-7, n), 10**12]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 6, 9, 14])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None, ""]), rng.choice([*alphabet, None, "é" * 3]), "x", "y", "z"))
    rows += [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "assistant", "tie"), (None, 1, "user", "nobody"), (5, 1, "user", "very long " * 50_000)]
    return [(*r, "x", "y", "z")[:7] for r in rows]


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out = set()

    def walk(path: tuple) -> tuple[int, int]:
        leaves, saved = 0, (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        for child in children.get(path, []):
            more = walk(child)
            leaves, saved = leaves + more[0], saved + more[1]
        leaves = leaves or 1
        ends = ",".join(map(str, sorted(c for c in members[path] if len(convs[c]) == len(path))))
        out.add((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children.get(path, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(())
    return out


def got(spark, rows: list[tuple], moduli) -> set[tuple]:
    members, turns = trie.spliced(trie.numbered(spark.createDataFrame(rows, SCHEMA)))
    found = [tuple(r) for r in trie.prefix_trie(members, turns, moduli).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed, moduli", [(1, trie.MODULI), (2, (3,)), (3, (7,))])
def test_nodes(spark, seed, moduli):
    rows = made(seed)
    assert got(spark, rows, moduli) == brute(rebuilt(rows))


def test_copies_of_one_conversation_and_blocks_of_ids(spark, monkeypatch):
    rows = [(c, t, "user", f"t{t}", "x", "y", "z") for c in range(0, 900, 3) for t in range(12)]
    assert got(spark, rows, trie.MODULI) == brute(rebuilt(rows))
    ends = spark.createDataFrame([(1, 2, c) for c in range(700)] + [(1, 3, 9)], "rep_id long, depth long, conv_id long")
    want = {(1, 2, hashlib.sha256(",".join(map(str, range(700))).encode()).hexdigest()), (1, 3, hashlib.sha256(b"9").hexdigest())}
    assert {tuple(r) for r in trie.id_digests(ends, block=10).collect()} == want


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(10, t, "user", rng.choice("abc"), "x", "y", "z") for t in range(3000)] + [(c, t, "user", "a", "x", "y", "z") for c in (9, 11) for t in range(5)]
    rng.shuffle(rows)
    turns = sorted((r.conv_id, r.pos, r.text) for r in trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect())
    want = [(c, i + 1, r[3]) for c in (9, 10, 11) for i, r in enumerate(sorted(r for r in rows if r[0] == c))]
    assert turns == want
    members, rebuilt_turns = trie.spliced(trie.numbered(spark.createDataFrame(rows, SCHEMA)))
    nodes = trie.prefix_trie(members, rebuilt_turns).collect()
    plain = rebuilt(rows)
    assert len(nodes) == 1 + len({tuple(t[:d]) for t in plain.values() for d in range(1, len(t) + 1)})
    assert max(r.depth for r in nodes) == max(map(len, plain.values()))


def test_turnless_and_no_conversations(spark):
    assert got(spark, [], trie.MODULI) == set()
    rows = [(c, 0, "user", "x", "x", "y", "z") for c in range(1, 30) if c % 5]
    assert got(spark, rows, trie.MODULI) == brute(rebuilt(rows))
