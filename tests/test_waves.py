"""The traversal against a plain walk, query by query."""

from __future__ import annotations

import random

import pytest

from lodestrata.operators import waves


def plain(entries: dict[str, tuple], scores: dict[str, float], sure: set[str], seeds: list[str], lim: waves.Limits) -> tuple[dict, dict]:
    children: dict[str, list[str]] = {}
    for path in entries:
        children.setdefault(path.rsplit("/", 1)[0] if "/" in path else ".", []).append(path)
    frontier, seen, found, wave = seeds, set(), {}, 0
    strong = confident = stopped = False
    positives = spent = 0
    probed, results = [], []
    while frontier and not stopped:
        frontier = sorted(set(frontier) - seen)
        if not frontier:
            break
        first = [c for d in frontier for c in children.get(d, [])]
        seen |= set(frontier)
        inner = [c for c in first if entries[c][0] == "directory" and c not in seen]
        seen |= set(inner)
        items = sorted(c for c in first if entries[c][0] == "file") + sorted(c for d in set(inner) for c in children.get(d, []))
        batches: list[list[str]] = []
        for path in items:
            if not batches or len(batches[-1]) == lim.batch_items or sum(entries[p][2] for p in batches[-1]) + entries[path][2] > lim.batch_bytes:
                batches.append([])
            batches[-1].append(path)
        classified = []
        for batch in batches:
            cost = sum(entries[p][2] for p in batch)
            if not confident and positives >= lim.many and spent + cost > lim.budget_bytes:
                rest = [p for p in results if entries[p][0] == "file" and entries[p][1] <= lim.final_probe_bytes and scores.get(p, 0) >= lim.strong and p not in probed]
                if rest:
                    best = min(rest, key=lambda p: (-scores.get(p, 0), p))
                    probed.append(best)
                    confident = best in sure
                if not confident:
                    stopped = True
                    break
            spent += cost
            for p in batch:
                strong |= scores.get(p, 0) >= lim.strong
                positives += scores.get(p, 0) > lim.relevant
            classified += batch
            results += batch
            if not confident and len(probed) < lim.probes:
                for p in batch:
                    if entries[p][0] == "file" and entries[p][1] <= lim.probe_bytes and scores.get(p, 0) >= lim.strong and p not in probed:
                        probed.append(p)
                        confident = p in sure
                        break
        flood = not strong and sum(lim.relevant < scores.get(p, 0) < lim.strong for p in classified) >= lim.many
        for p in classified:
            s = scores.get(p, 0)
            found[p] = (wave, s >= lim.strong or (s > lim.relevant and not flood))
        frontier = [p for p in classified if entries[p][0] == "directory" and found[p][1]]
        wave += 1
    return found, {"strong": strong, "positives": positives, "bytes": spent, "probed": probed, "confident": confident, "stopped": stopped}


def test_against_a_plain_walk(spark):
    rng = random.Random(7)
    files = {"/".join([*(rng.choice("abc") for _ in range(rng.randrange(0, 7))), f"f{k}"]): (rng.randrange(3000), rng.randrange(1, 60)) for k in range(420)}
    tree = waves.tree_of(spark.createDataFrame([(p, *x) for p, x in files.items()], "path string, bytes long, cost long"))
    entries = {r.path: (r.kind, r.bytes, r.cost) for r in tree.collect()}
    lim = waves.Limits(many=6, batch_items=5, batch_bytes=150, budget_bytes=1500, probe_bytes=900, final_probe_bytes=2500)
    scores, sure, seeds = {}, {}, {}
    for q in range(14):
        low, high = rng.choice([(0.3, 0.599), (0.2, 0.9), (0.45, 0.7), (0.55, 1.0), (0.0, 0.5)])
        scores[q] = {p: round(rng.uniform(low, high), 3) if kind == "file" else rng.choice([0.4, 0.55, 0.58] if high < 0.6 else [0.55, 0.7]) for p, (kind, *_) in entries.items() if rng.random() < 0.9}
        sure[q] = {p for p in entries if rng.random() < [0, 0.03, 0.3][q % 3]}
        seeds[q] = ["."] if q % 4 else ["a", ".", "b/c"]
    got = waves.traverse(
        tree,
        spark.createDataFrame([(q, p, s) for q, own in scores.items() for p, s in own.items()], "query_id long, path string, score double"),
        spark.createDataFrame([(q, p) for q, own in sure.items() for p in own], "query_id long, path string"),
        spark.createDataFrame([(q, p) for q, own in seeds.items() for p in own], "query_id long, path string"),
        lim,
    )
    items: dict[int, dict] = {q: {} for q in scores}
    for r in got.items.collect():
        assert r.path not in items[r.query_id]
        items[r.query_id][r.path] = (r.wave, r.admitted)
    states = {r.query_id: r.asDict() for r in got.states.collect()}
    seen = {"flood": 0, "stopped": 0, "confident": 0, "deep": 0}
    for q in scores:
        found, state = plain(entries, scores[q], sure[q], seeds[q], lim)
        assert items[q] == found, q
        assert {k: states[q][k] for k in state} == state, q
        seen["stopped"] += state["stopped"]
        seen["confident"] += state["confident"]
        seen["deep"] += max(w for w, _ in found.values()) > 1
        seen["flood"] += any(0.5 < scores[q].get(p, 0) < 0.6 and not kept for p, (_, kept) in found.items())
    assert all(seen.values()), seen


@pytest.mark.parametrize("seeds", [[], [(1, "nowhere")]])
def test_nothing_to_walk(spark, seeds):
    tree = waves.tree_of(spark.createDataFrame([("a/b", 1, 1)], "path string, bytes long, cost long"))
    none = spark.createDataFrame([], "query_id long, path string, score double")
    got = waves.traverse(tree, none, none, spark.createDataFrame(seeds, "query_id long, path string"))
    assert got.items.count() == 0 and got.states.count() == 0
