"""Keyed reads open the folders they need, appends are compacted, and later answers win."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from lodestrata.operators import accounting as A
from lodestrata.operators import spans as S
from lodestrata.sources import files as R

DAY = dt.datetime(2024, 5, 1)
SCHEMA = "digest string, question_id long, probability double, created_at timestamp"


def digest(k: int) -> str:
    return hashlib.sha256(str(k).encode()).hexdigest()


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    first = [(digest(k), q, k / 1000, DAY) for k in range(300) for q in (1, 2)]
    R.append_answers(spark.createDataFrame(first, SCHEMA), path)
    R.append_answers(spark.createDataFrame([(digest(7), 1, 0.9, DAY + dt.timedelta(hours=1)), (digest(8), 1, 0.9, DAY - dt.timedelta(hours=1))], SCHEMA), path)
    asked = spark.createDataFrame([(digest(7),), (digest(8),), (digest(7),), (None,), ("zz",)], "digest string")
    want = {(digest(7), 1, 0.9), (digest(7), 2, 0.007), (digest(8), 1, 0.008), (digest(8), 2, 0.008)}

    def read():
        return R.read_answers(spark, path, asked)

    assert {(r.digest, r.question_id, r.probability) for r in read().collect()} == want
    plan = read()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix", plan)
    before = R.read_answers(spark, path).count()
    assert R.compact_answers(spark, path) == 2 and R.compact_answers(spark, path) == 0
    assert {(r.digest, r.question_id, r.probability) for r in read().collect()} == want
    assert R.read_answers(spark, path).count() == before == 600
    # a compaction that died before it took the old batches away
    R.append_answers(R.read_answers(spark, path), path, "c")
    assert R.read_answers(spark, path).count() == 600
    assert R.read_answers(spark, path, asked.limit(0)).count() == 0


def test_outputs_of_both_arms(spark):
    rows = [("a", "x", 1.0, "h"), ("a", "y", 2.0, "h"), ("b", "x", 1.0, "h"), ("b", "y", 1.0, "g"), ("c", "x", 1.0, "h"), ("d", "x", 1.0, "h"), ("d", "y", 3.0, None), (None, "x", 1.0, "h"), (None, "y", 1.0, "h"), ("c", "z", 1.0, "h")]
    got = A.compare_arms(spark.createDataFrame(rows, "k string, arm string, v double, out string"), ["k"], "arm", "v", "x", "y", "out").collect()
    assert {r.k: r.same_output for r in got} == {"a": True, "b": False, "c": False, "d": False, None: True}


def test_spans_of_bytes(spark):
    files = spark.createDataFrame([("f", "één\ntwo\n"), ("n", None)], "path string, source string")
    rows = [
        ("f", 1, 1, 0, 5, "één", False, True), ("f", 1, 2, 0, 9, "één\ntwo", False, True), ("f", 1, 1, 2, 5, "n", True, False), ("f", 2, 2, 6, 9, "two", False, True),
        ("f", 2, 2, 6, 8, "tw", False, False), ("f", 2, 2, 6, 8, "tw", True, True), ("f", 0, 1, 0, 5, "één", False, False), ("f", 2, 1, 0, 5, "één", False, False), ("f", 1, 9, 0, 5, "één", True, False),
        ("f", 3, 3, 10, 10, "", False, True), ("f", 3, 3, 10, 11, "", False, False), ("f", 1, 1, None, 5, "één", False, False), ("n", 1, 1, 0, 0, "", False, False), ("?", 1, 1, 0, 0, "", False, False),
    ]
    df = spark.createDataFrame(rows, "path string, start_line int, end_line int, byte_start long, byte_end long, text string, partial boolean, want boolean")
    assert S.valid_spans(df, files).filter(F.col("valid") != F.col("want")).collect() == []
