"""Rule files and walks from the root, completed operators, and plans without needless exchanges."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import accounting as A
from lodestrata.operators import declarations as D
from lodestrata.operators import eligibility as E
from lodestrata.operators import evidence as V
from lodestrata.operators import retrieval as R
from lodestrata.operators import spans as S
from lodestrata.operators import units as U
from lodestrata.operators.sized import sized
from lodestrata.sources import scratch

FILES = "repo string, path string, bytes long, source string"


def tree(spark, files: dict):
    return spark.createDataFrame([("r", p, len(x or ""), x) for p, x in files.items()], FILES)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rule_files(spark):
    files = tree(
        spark,
        {
            ".gitignore": "*.txt\nblocked/\n!keep.txt\n",
            ".ignore": "keep.txt\n!search.txt\n",
            "child/.gitignore": "!local.txt",
            "nested/.git": "x",
            "search.txt": "", "keep.txt": "", "child/local.txt": "", "child/other.txt": "", "blocked/inside.ts": "", "blocked/search.txt": "", "nested/value.txt": "", "nested/keep.txt": "", "a.ts": None,
        },
    )
    judged = {r.path: r for r in E.apply_policy(E.with_own_rules(files), E.Policy(hidden=True), content=False).collect()}
    assert {p for p, r in judged.items() if r.reason == "ignored"} == {"keep.txt", "child/other.txt", "blocked/inside.ts", "blocked/search.txt", "nested/keep.txt"}
    assert judged["blocked/inside.ts"].top == judged["blocked/search.txt"].top == "blocked"
    lifted = E.apply_policy(E.with_own_rules(files), E.Policy(no_ignore=True, hidden=True), content=False)
    assert lifted.filter("reason = 'ignored'").count() == 0
    assert E.with_own_rules(files.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line,path,hit",
    [
        ("# *.a", "x.a", False), ("\\#a", "#a", True), ("\\!a", "!a", True), ("a.x   ", "a.x", True), ("a\\ ", "a ", True), ("a.x\r", "a.x", True), ("", "a", False), ("/a", "b/a", False),
        ("/a", "a", True), ("b/c", "x/b/c", False), ("**/c", "x/b/c", True), ("a/**/z", "a/b/c/z", True), ("a/", "a", False), ("a/", "a/b", True), ("*.[ab]", "x.b", True), ("*.[!ab]", "x.b", False), ("x?z", "x/z", False), ("!", "a", False),
    ],
)
def test_rule_lines(spark, line, path, hit):
    got = E.with_own_rules(tree(spark, {".gitignore": line, path: ""})).filter(F.col("path") == path).first()
    assert got.ignored is hit


def test_directories_count_once(spark):
    names = [".git/a", ".git/b", ".cache/a", ".cache/b", "node_modules/a", "node_modules/.x/b", "out/a", "out/b", "admin/a", "admin/b/c", "conf.env/a", "conf.env/b", "kept/a"]
    files = tree(spark, {".gitignore": "out/", **dict.fromkeys(names, "")})
    judged = E.apply_policy(E.with_own_rules(files), E.Policy(exclude=("admin/",)), content=False)
    got = {r.reason: r.n for r in E.excluded_counts(judged).collect()}
    assert got == {"protected": 1, "hidden": 2, "dependency": 1, "ignored": 1, "exclude_pattern": 1, "sensitive_name": 1}
    assert [r.path for r in judged.filter("reason is null").collect()] == ["kept/a"]


def test_units_of_classes():
    code = "@d\nclass A:\n    '''x'''\n    class B:\n        y = 1\n        def m(self):\n            def inner(): pass\n            return 1\n    z = 1\nclass E: pass\ndef f():\n    class L: pass\n"
    assert D.declared(code) == [
        ("A.context", 1, 3, "A", "context", ((1, 3),)),
        ("A.B.context", 4, 5, "A.B", "context", ((1, 3), (4, 5))),
        ("A.B.m", 6, 8, "A.B", "function", ((1, 3), (4, 5))),
        ("A.context", 9, 9, "A", "context", ((1, 3),)),
        ("E", 10, 10, None, "class", ()),
        ("f", 11, 12, None, "function", ()),
    ]


def test_overlaps(spark):
    rng = random.Random(3)
    sides = [[(rng.choice(["a", None, "b"]), k, a := rng.randrange(-50, 400), a + rng.choice([0, 1, 7, 300])) for k in range(60)] for _ in range(2)]
    left, right = (spark.createDataFrame([*x, ("a", 99, None, 5)], "k string, n long, start long, end long") for x in sides)
    got = [(r.n, r.r_n) for r in S.overlap_join(left, right, ["k"], block=16).collect()]
    want = [(x[1], y[1]) for x in sides[0] for y in sides[1] if x[0] == y[0] and x[0] and x[2] < y[3] and x[3] > y[2]]
    assert sorted(got) == sorted(want) and len(want) > 100
    assert "_block" not in S.overlap_join(left, right, ["k"]).columns


def test_line_index(spark):
    rows = [("a", "x\n\nyé\n"), ("b", None), ("c", ""), ("d", "one"), ("d", "one\ntwo"), (None, "z")]
    index = S.line_index(spark.createDataFrame(rows, "path string, source string"))
    assert "Exchange" not in plan(index)
    got = [tuple(r) for r in index.collect()]
    want = [("a", 1, "x", 1, 0), ("a", 2, "", 0, 2), ("a", 3, "yé", 3, 3), ("a", 4, "", 0, 7), ("c", 1, "", 0, 0), ("d", 1, "one", 3, 0), ("d", 1, "one", 3, 0), ("d", 2, "two", 3, 4), (None, 1, "z", 1, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_tokens_of_items_stay(spark):
    items = spark.createDataFrame([(k, f"word{k % 7} the The ﬁle") for k in range(50)], "item_id long, text string")
    queries = spark.createDataFrame([(1, "the word3 file x")], "query_id long, text string")
    out = R.token_matches(items, queries)
    assert "BroadcastHashJoin" in plan(out) and plan(out).count("Exchange hashpartitioning") == 1
    assert {r.item_id: r.matched for r in out.collect()} == {k: 2 + (k % 7 == 3) for k in range(50)}
    assert "broadcast" not in sized(items, 49)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in sized(items, 50)._jdf.queryExecution().logical().toString().lower()


def test_samples_stay(spark):
    files = spark.createDataFrame([("r", f"p{k}", "abc" * 400) for k in range(100)] + [("s", "q", None)], "repo string, path string, source string")
    out = U.content_samples(files, 1000)
    assert "source" not in "".join(x for x in plan(out).split("\n") if "hashpartitioning" in x)
    assert {len(r.sample) for r in out.filter("repo = 'r'").collect()} == {26 * 3 + 2} and out.filter("repo = 's'").first().sample is None


def test_identifiers(spark):
    df = spark.createDataFrame([("ﬁle Ｆull re\u0301u x² _a1 9z", ), (None,), ("",)], "t string")
    got = [r.x for r in df.select(T.identifiers(F.col("t")).alias("x")).collect()]
    assert got == [["file", "Full", "réu", "x2", "_a1", "z"], None, []]


def test_evidence(spark):
    excerpts = spark.createDataFrame([(1, "b", 1, 5, 9, "B"), (1, "a", 2, 1, 3, "A2"), (1, "a", 2, 0, 1, "A1"), (2, "c", 1, 0, 1, "x" * 90), (3, "d", None, 0, 1, "D")], "query_id long, path string, n_groups int, start int, end int, source string")
    targets = spark.createDataFrame([(1, "t"), (1, "a"), (2, "t"), (3, "t"), (4, "t")], "query_id long, path string")
    got = {(r.query_id, r.path): r.evidence and [e.source for e in r.evidence] for r in V.attach_evidence(targets, excerpts, 150).collect()}
    assert got == {(1, "t"): ["B", "A1", "A2"], (1, "a"): ["B", "A1", "A2"], (2, "t"): ["x" * 90], (3, "t"): ["D"], (4, "t"): None}
    assert {r.query_id for r in V.attach_evidence(targets, excerpts, 89).filter("evidence is not null").collect()} == {3}


def test_reconcile(spark):
    base = [f"r{k}" for k in range(9)]
    starts = spark.createDataFrame([(x,) for x in [*base, "r1", None]], "request_id string")
    rows = [(x, 200, 10, 20, False, None) for x in base if x != "r2"]
    rows[3] = ("r4", 200, 10, 19, False, "BrokenPipeError")
    rows[4] = ("r5", 200, 10, 19, False, None)
    rows[5] = ("r6", 500, 10, 20, False, None)
    rows[6] = ("r7", 200, 10, 20, True, None)
    ends = spark.createDataFrame(rows, "request_id string, status int, request_bytes long, response_bytes long, incomplete boolean, error string")
    requests = spark.createDataFrame([(x, 10) for x in base if x != "r3"], "request_id string, bytes long")
    responses = spark.createDataFrame([(x, 20) for x in [*base, "r9"]], "request_id string, bytes long")
    out = A.reconcile_log(starts, ends, requests, responses)
    assert {r.request_id for r in out.filter("matched").collect()} == {"r0", "r4", "r8"} and out.count() == 11
    assert A.log_covered(out).first() == (11, False)
    assert A.log_covered(out.limit(0)).first() == (0, True)


def test_walks_keep_no_group(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), k, rng.randrange(1, 50)) for k in range(500)]
    got = {(r.query_id, r.ord): (r.batch, r.too_large) for r in V.pack_batches(spark.createDataFrame(rows, "query_id long, ord long, bytes long"), ["query_id"], 5, 40).collect()}
    state: dict = {}
    for q, k, n in rows:
        batch, count, size = state.get(q, (0, 0, 0))
        if n > 40:
            assert got[q, k] == (None, True)
            continue
        if count and (count == 5 or size + n > 40):
            batch, count, size = batch + 1, 0, 0
        state[q] = (batch, count + 1, size + n)
        assert got[q, k] == (batch, False)


def test_scratch_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError):
        scratch.scratch_path(Session())
