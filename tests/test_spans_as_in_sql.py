"""Span queries against their SQL over line items whose quantities are null or no whole numbers, and over repeated spans."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.jobs import span_queries
from lodestrata.operators import spans as S


@pytest.mark.parametrize("name", ["a7_merge_spans", "u3_test_bodies", "w9_context_windows", "x4_merge_adjacent_ranges"])
def test_odd_quantities(spark, tmp_path, name):
    rng = random.Random(4)
    # starts of an order differ, so that no order of the SQL is left open
    rows = [(k, start, n % 7 + 1, rng.choice([None, 2.5, 3.5, 4.75, 6.25, 11.0]), rng.choice("RAN")) for k in [*range(60), None] for n, start in enumerate(rng.sample(range(60), 12))]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = span_queries.QUERIES[name]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert Counter(tuple(r) for r in query(spark, str(tmp_path)).collect()) == Counter(con.execute(sql).fetchall())


def test_null_ends(spark):
    rows = [("a", 5, 8), ("a", 5, None), ("a", 9, None), ("a", 20, 21), ("b", None, None), ("b", None, None), ("b", 1, 2)]
    got = Counter(tuple(r) for r in S.merge_spans(spark.createDataFrame(rows, "k string, start long, end long"), ["k"]).collect())
    assert got == Counter([("a", 5, 8), ("a", 9, None), ("a", 20, 21), ("b", 1, 2), ("b", None, None), ("b", None, None)])


def test_repeated_spans_are_merged_in_any_order(spark):
    """Each span many times: no copy is counted to the run before it, however rows are dealt."""
    rng = random.Random(5)
    spans = [(k, 10 * i, 10 * i + 5) for k in range(40) for i in range(20)]
    for seed in range(2):
        rows = spans * 9
        rng.shuffle(rows)
        made = S.merge_spans(spark.createDataFrame(rows, "k long, start long, end long").repartition(7, F.rand(seed)), ["k"])
        assert sorted(tuple(r) for r in made.collect()) == spans
