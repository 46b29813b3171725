"""Queries on previews and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preview as V
from .mapping import CUTS, FILES, files, table


def x2(s, d):
    V.register_units(s)
    files(s, d).select("path", "source").createOrReplaceTempView("lodestrata_sources")
    return s.sql("SELECT path, u.* FROM lodestrata_sources, LATERAL source_units(source, 3000) u")


#: Parts as modules of a class with as many lines as the part's size; the query names the class of size 7.
_CLASS = "concat('a\nclass C', p_size, ':\n', repeat('x\n', p_size))"
_QUERY, _BUDGET = "class C7", 40


def x3(s, d):
    V.register_preview(s)
    table(s, d, "part").select("p_partkey", F.expr(_CLASS).alias("source")).createOrReplaceTempView("lodestrata_parts")
    return s.sql(f"SELECT p_partkey, p.* FROM lodestrata_parts, LATERAL preview_spans(source, '{_QUERY}', {_BUDGET}) p")


def g7(s, d):
    return V.query_preview(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_CLASS).alias("source")), _QUERY, _BUDGET)


def g7_many(s, d):
    asked = s.createDataFrame([(0, "class C7"), (1, "C9 or c7?"), (2, "nothing of that"), (3, None)], "query_id int, text string")
    return V.query_previews(table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.expr(_CLASS).alias("source")), asked, _BUDGET)


#: The opening quarter holds the first line only; then the class's line and as many of its lines as fit 38 bytes, found by the query or as a spread window.
_SPANS = """p AS (SELECT p_partkey, p_size AS k, 8 + length(p_size::VARCHAR) + 1 AS head FROM part), t AS (SELECT *, k <= 13 AS whole FROM p),
  spans AS (SELECT p_partkey, 'opening' AS basis, 1 AS start_line, 1 AS end_line, 0 AS byte_start, 2 AS byte_end FROM t
  UNION ALL SELECT p_partkey, CASE WHEN k = 7 THEN 'query' ELSE 'spread' END, 2, CASE WHEN whole THEN k + 3 ELSE 15 END, 2, 2 + head + CASE WHEN whole THEN 2 * k ELSE 26 END FROM t)"""

QUERIES = {
    "g7_query_preview": (g7, f"WITH {_SPANS} SELECT p_partkey::VARCHAR AS path, basis, start_line, end_line, byte_start, byte_end FROM spans"),
    "g7_query_previews": (
        g7_many,
        f"""WITH {_SPANS}, asked(query_id, k) AS (VALUES (0, 7), (1, 7), (1, 9)), plain AS (SELECT s.* REPLACE (CASE WHEN basis = 'query' THEN 'spread' ELSE basis END AS basis), k FROM spans s JOIN t USING (p_partkey))
        SELECT NULL::INTEGER AS query_id, p_partkey::VARCHAR AS path, basis, start_line, end_line, byte_start, byte_end FROM plain
        UNION ALL SELECT query_id, p_partkey::VARCHAR, CASE WHEN basis = 'spread' THEN 'query' ELSE basis END, start_line, end_line, byte_start, byte_end FROM plain JOIN asked USING (k)""",
    ),
    "x2_units_udtf": (x2, f"WITH RECURSIVE {FILES}, own AS (SELECT * FROM files), {CUTS.format(3000)} SELECT path, unit, byte_start, byte_end FROM cuts WHERE unit >= 0"),
    "x3_preview_udtf": (x3, f"WITH {_SPANS} SELECT p_partkey, basis, start_line, end_line FROM spans"),
}
