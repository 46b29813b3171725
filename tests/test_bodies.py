"""Bodies that stay and go, query by query."""

from __future__ import annotations

from lodestrata.operators import bodies as B
from lodestrata.operators import spans as S

UNITS = "query_id long, path string, name string, start long, end long, bytes long"
RANGES = "query_id long, path string, start long, end long"


def test_bodies(spark):
    files = {"t.py": "\n".join(["a"] * 10 + [""] * 3 + ["b"] * 7), "u.py": "\n".join(["c"] * 9)}
    nonblank = S.nonblank_prefix(S.line_index(spark.createDataFrame(list(files.items()), "path string, source string")))
    units, answers = [], []
    for q in range(1, 6):
        # an outer body that goes, a kept one within it, one next to blank lines, one that isn't shown, one too large
        units += [(q, "t.py", "outer", 2, 8, 10), (q, "t.py", "inner", 4, 5, 10), (q, "t.py", "end", 14, 20, 10), (q, "u.py", "hidden", 7, 8, 10), (q, "u.py", "large", 1, 2, 70_000), (q, "u.py", "whole", 3, 4, 10)]
        answers += [(q, "t.py", 2, 8, 0.2), (q, "t.py", 4, 5, 0.9), (q, "t.py", 14, 20, 0.5), (q, "u.py", 3, 4, 0.8)]
    answers = [a for a in answers if not (a[0] == 3 and a[2] == 2)]  # a missing answer
    answers = [(*a[:4], 0.1) if a[0] == 2 else (*a[:4], float("nan")) if a[0] == 4 and a[2] == 14 else a for a in answers]  # nothing kept; no number
    shown = [(q, p, a, b) for q in range(1, 6) for p, a, b in [("t.py", 1, 10), ("t.py", 12, 20), ("u.py", 1, 5)]]
    selected = [(q, p, a, b) for q in range(1, 6) for p, a, b in [("t.py", 2, 20), ("u.py", 1, 9)]]
    made = B.select_bodies(spark.createDataFrame(units, UNITS), spark.createDataFrame(selected, RANGES), spark.createDataFrame(shown, RANGES), spark.createDataFrame(answers, RANGES + ", score double"), nonblank)
    assert {(r.path, r.name) for r in made.candidates.filter("query_id = 1").collect()} == {("t.py", "outer"), ("t.py", "inner"), ("t.py", "end"), ("u.py", "whole")}

    def of(df, q):
        return {(r.path, r.start, r.end) for r in df.filter(f"query_id = {q}").collect()}

    for q in (1, 5):
        assert of(made.shown, q) == {("t.py", 1, 1), ("t.py", 4, 5), ("t.py", 9, 10), ("u.py", 1, 5)}  # 12 and 13 are blank
        assert of(made.selected, q) == {("t.py", 4, 5), ("t.py", 9, 13), ("u.py", 1, 9)}
    for q in (2, 3, 4):
        assert of(made.shown, q) == {x[1:] for x in shown if x[0] == q} and of(made.selected, q) == {x[1:] for x in selected if x[0] == q}


def test_batches_and_nothing(spark):
    units = [(1, "t.py", f"f{k}", k, k, 30_000) for k in range(1, 6)]
    whole = spark.createDataFrame([(1, "t.py", 1, 9)], RANGES)
    got = {r.name: r.batch for r in B.candidate_bodies(spark.createDataFrame(units, UNITS), whole, whole).collect()}
    assert got == {"f1": 0, "f2": 0, "f3": 1, "f4": 1, "f5": 2}
    none = B.select_bodies(spark.createDataFrame([], UNITS), whole, whole, spark.createDataFrame([], RANGES + ", score double"))
    assert [tuple(r) for r in none.shown.collect()] == [(1, "t.py", 1, 9)] and none.candidates.count() == 0
