"""Merged sketches against exact results, and rolling rates of one worker over many tasks."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import accounting as A

START = dt.datetime(2024, 3, 1)


def test_sketches_merge_over_keys_and_batches(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), (F.abs(F.hash("id")) % 10_000).cast("double").alias("v"), (F.col("id") % 5000).alias("u"))
    first, second = (A.sketch(rows.filter(f"u % 2 = {k}"), ["a", "b"], "v", "u") for k in (0, 1))
    merged = A.read_sketches(A.merge_sketches(first.unionByName(second), ["a"])).collect()
    exact = {r.a: r for r in rows.groupBy("a").agg(F.count("*").alias("n"), F.collect_list("v").alias("v"), F.count_distinct("u").alias("u")).collect()}
    assert len(merged) == 3
    for r in merged:
        values = sorted(exact[r.a].v)
        assert r.n == len(values) and abs(r.distinct - exact[r.a].u) <= 0.05 * exact[r.a].u
        for p, got in ((0.5, r.p50), (0.95, r.p95)):
            assert abs(sum(v <= got for v in values) / len(values) - p) < 0.02
    assert A.read_sketches(A.merge_sketches(first.limit(0), ["a"])).count() == 0


@pytest.mark.parametrize("seconds", [1, 7])
def test_rolling_budget(spark, seconds):
    rng = random.Random(seconds)
    rows = [(rng.choice(["w", "w", "x", None]), START + dt.timedelta(microseconds=rng.randrange(30_000_000)), rng.randrange(9)) for _ in range(300)]
    rows += [("w", START + dt.timedelta(seconds=k), 1) for k in (3, 3, 4, 11)] + [("w", None, 5)]
    got = A.rolling_budget(spark.createDataFrame(rows, "w string, ts timestamp, tokens long"), ["w"], "ts", "tokens", seconds).collect()
    want = []
    for w, ts, n in rows:
        near = [m for v, at, m in rows if ts is not None and at is not None and v == w and ts - dt.timedelta(seconds=seconds) < at <= ts]
        want.append((w, ts, n, len(near) if ts else None, sum(near) if ts else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plan = A.rolling_budget(spark.createDataFrame(rows, "w string, ts timestamp, tokens long"), ["w"], "ts", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(w#" in plan and "_stretch" in plan.split("hashpartitioning(w#")[1][:60]
