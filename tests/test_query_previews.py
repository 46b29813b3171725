"""Previews for a table of questions are those for each question alone."""

from __future__ import annotations

from lodestrata.operators import preview as V


def test_previews_by_question(spark):
    sources = {
        "a.py": "import x\n" + "y = 1\n" * 40 + "def Wanted(a):\n" + "  pass\n" * 30 + "class other:\n" + "  z = 2\n" * 60,
        "b.py": "def other():\n    return 1\n" * 20,
        "é.ts": "function naïve() {}\n" * 3,
        "empty": "", "null": None, "none.txt": "plain\n" * 50,
    }
    files = spark.createDataFrame(list(sources.items()), "path string, source string")
    questions = [(1, "where is WANTED?"), (2, "Other and wanted"), (3, "plain words"), (4, None), (5, "naïve"), (6, "wanted wanted")]
    got = {}
    for r in V.query_previews(files, spark.createDataFrame(questions, "query_id long, text string"), 300).collect():
        got.setdefault((r.query_id, r.path), set()).add(tuple(r)[2:])
    assert {p for q, p in got if q is None} == {"a.py", "b.py", "é.ts", "none.txt"}
    assert {k for k in got if k[0]} == {(1, "a.py"), (2, "a.py"), (2, "b.py"), (5, "é.ts"), (6, "a.py")}
    for q, text in questions:
        alone = {}
        for r in V.query_preview(files, text or "", 300).collect():
            alone.setdefault(r.path, set()).add(tuple(r)[1:])
        assert alone == {p: got.get((q, p), got[None, p]) for p in alone}
    assert V.query_previews(files.limit(0), spark.createDataFrame(questions, "query_id long, text string")).count() == 0
