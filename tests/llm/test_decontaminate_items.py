"""Items without an id, and items too short for q-grams."""

from __future__ import annotations

from lodestrata.llm import decontaminate


def test_null_ids_and_short_items(spark):
    items = [(None, "an item of more than twelve bytes"), (1, "Go  left"), (2, "é"), (3, None), (None, "so short")]
    rows = [
        (10, "x An item of more than twelve bytes y"),
        (11, "Go left, go\nleft. ergo left go leftmost"),
        (12, "né é"),
        (13, "is it so short"),
        (14, "nothing"),
        (None, "go left"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = [(10, None, 2, 35, 0), (11, 1, 0, 7, 0), (11, 1, 9, 16, 0), (12, 2, 4, 6, 0), (13, None, 6, 14, 0), (None, 1, 0, 7, 0)]
    for block in (decontaminate.BLOCK_BYTES, 20):
        got = [tuple(r) for r in decontaminate.find_leaks(docs, bench, block_bytes=block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {14, None}
