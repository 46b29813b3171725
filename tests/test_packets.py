"""Packets of lines: ranks, budgets, missing roles and empty tables."""

from __future__ import annotations

from lodestrata.operators import packets as P
from lodestrata.sources import files as R

FOUND = "query_id long, path string, score double, priority double, roles array<string>"
EXCERPTS = "query_id long, path string, start_line int, end_line int, source string"


def test_packet(spark, tmp_path):
    found = spark.createDataFrame([(1, "b", 0.9, None, ["test", "helper"]), (1, 'a"‮', 0.5, 0.95, None), (1, "c", 0.7, None, []), (2, "z", 0.6, None, None)], FOUND)
    excerpts = spark.createDataFrame([(1, "b", 5, 6, "late"), (1, "b", 1, 2, "one\n```\ntwo"), (1, "c", 1, 1, "x" * 50), (1, "gone", 1, 1, "y")], EXCERPTS)
    lines = P.packet_lines(found, excerpts, 20)
    got = {}
    for r in lines.orderBy("query_id", "line_no").collect():
        got.setdefault(r.query_id, []).append(r.line)
    assert got[1] == [
        "3 relevant files.",
        '- "a\\"\\u202e" — relevant; role uncertain; locations only',
        '- "b" — test, helper; source below',
        '- "c" — relevant; role uncertain; source omitted',
        "End file list.",
        "", 'Source block "b" lines 1-2:', "````", "one", "```", "two", "````",
        "", 'Source block "b" lines 5-6:', "```", "late", "```",
        "", "End context.",
    ]
    assert got[2] == ["1 relevant files.", '- "z" — relevant; role uncertain; locations only', "End file list.", "", "End context."]
    R.write_context(P.packet_texts(lines), f"{tmp_path}/packets")
    assert spark.read.text(f"{tmp_path}/packets").filter("query_id = 2").count() == 5
    short = P.packet_lines(found, excerpts, 20, 200).filter("query_id = 1").collect()
    assert all(r.truncated for r in short) and sum(len(r.line.encode()) + 1 for r in short) <= 200 - 64
    assert P.packet_lines(found.limit(0), excerpts, 20).count() == 0
