"""The walk over directories against rules applied to each path alone, with rules in all tasks and met by key."""

from __future__ import annotations

import random

import pytest

from lodestrata.operators import eligibility as E
from lodestrata.operators import ignore_walk


def plain(paths: set[str], rules: list[tuple], inner: set[str]) -> dict[str, int]:
    """Each component from the top by the last rule that fits; the first that is left out decides."""
    out = {}
    ordered = sorted(rules, key=lambda r: (0 if r[0] == "." else len(r[0]), r[1] == ".ignore", r[2]))
    for path in paths:
        parts = path.split("/")
        for depth in range(1, len(parts) + 1):
            own, gone = "/".join(parts[:depth]), False
            for d, source, _, regex, negated in ordered:
                if d != "." and not own.startswith(d + "/"):
                    continue
                between = [b for b in inner if b != d and (d == "." or b.startswith(d + "/")) and (own == b or own.startswith(b + "/"))]
                if source == ".gitignore" and between:
                    continue
                rest = own if d == "." else own[len(d) + 1 :]
                if ignore_walk._compiled(regex).search(rest + "/" if depth < len(parts) else rest):
                    gone = not negated
            if gone:
                out[path] = depth
                break
    return out


@pytest.mark.parametrize("seed, most", [(1, 20_000), (2, 20_000), (3, 3)])
def test_walk(spark, seed, most, monkeypatch):
    monkeypatch.setattr(ignore_walk, "MOST_RULES", most)
    monkeypatch.setattr(ignore_walk, "SALTS", 3)
    rng = random.Random(seed)
    names = ["a", "b", "c", "d.txt", "e.md"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(250)}
    dirs = sorted({p.rsplit("/", k)[0] for p in paths for k in range(1, p.count("/") + 1)} | {"."})
    patterns = ["*.txt", "a/", "b", "/c", "**/b/*.md", "a/b", "d.*", "c/**", "*"]
    rows = {}
    for _ in range(14):
        d = rng.choice(dirs)
        rows[rng.choice(["r", "s"]), d, rng.choice([".gitignore", ".ignore"]), rng.randrange(3)] = (E.glob_regex(rng.choice(patterns)), rng.random() < 0.45)
    inner = set(rng.sample([d for d in dirs if d != "."], 4))
    rules = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "repo string, dir string, source string, ord int, regex string, negated boolean")
    scoped = E.scope_rules(rules, spark.createDataFrame([("r", d) for d in inner], "repo string, dir string"))
    files = spark.createDataFrame([(repo, p, "x") for repo in ("r", "s", "t") for p in paths] + [(None, "a", "x")], "repo string, path string, scope string")
    got = {(r.repo, r.path): r.ignored_at for r in E.reason_ignored(files, scoped).collect()}
    want = {}
    for repo in ("r", "s", "t"):
        own = [(d, source, n, *v) for (q, d, source, n), v in rows.items() if q == repo]
        out = plain(paths, own, inner if repo == "r" else set())
        want |= {(repo, p): out.get(p) for p in paths}
    assert got == want | {(None, "a"): None}
    assert any(want.values())


def test_no_rules_and_no_files(spark):
    rules = spark.createDataFrame([], "repo string, dir string, source string, ord int, regex string, negated boolean, stops array<string>")
    files = spark.createDataFrame([("r", "a/b"), ("r", "c")], "repo string, path string")
    assert [r.ignored for r in E.reason_ignored(files, rules).collect()] == [False, False]
    assert E.reason_ignored(files.limit(0), rules).count() == 0


def test_files_carry_no_rules(spark):
    files = spark.createDataFrame([("r", "a/b"), ("r", "c")], "repo string, path string")
    rules = spark.createDataFrame([("r", ".", ".gitignore", 0, "^a/.*$", False, ["z"])], "repo string, dir string, source string, ord int, regex string, negated boolean, stops array<string>")
    plan = E.reason_ignored(files, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "negated" not in plan and "CartesianProduct" not in plan
