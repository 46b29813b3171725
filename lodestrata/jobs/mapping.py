"""The given tables as files, units, questions and logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "doc@.py", "doc@.md", "doc@.json", "doc@.ts", "node_modules/doc@.js", ".cache/doc@.txt", "doc@/credentials.json", "doc@.yaml",
    "doc@.log", "doc@.mp3", "doc@.zip", "doc@.bak", "README@", "doc@.txt", "doc@.pem", "build/doc@.go",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, repo, path, bytes, source)`` from ``documents``; names take turns."""
    name = F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % len(NAMES)).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.replace(name, F.lit("@"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("r"), F.col("doc_id") % 3).alias("repo"), path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.col("text").alias("source")
    )


_LIST = ", ".join(f"'{x}'" for x in NAMES)
FILES = f"""files AS (SELECT doc_id, 'r' || (doc_id % 3) AS repo,
  source || '/' || lang || '/' || replace([{_LIST}][(doc_id % {len(NAMES)})::INT + 1], '@', doc_id::VARCHAR) AS path,
  strlen(text) AS bytes, text AS source FROM documents)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as spans ``(k, n, start, end)`` of their order; quantities are rounded as in SQL."""
    start = (F.col("l_partkey") % 60).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), start.alias("start"), (start + F.rint("l_quantity").cast("long") % 20 + 1).alias("end"), "l_returnflag"
    )


SPANS = """spans AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 60 AS start,
  l_partkey % 60 + CAST(l_quantity AS BIGINT) % 20 + 1 AS "end", l_returnflag FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores ``(query_id, path, chunk, score)`` of chunks."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 97).alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey") % 400).alias("path"), F.col("l_linenumber").cast("long").alias("chunk"),
        ((F.col("l_extendedprice") * 100).cast("long") % 1000 / 1000.0).alias("score"),
    )


SCORES = """scores AS (SELECT l_orderkey % 97 AS query_id, 'p' || (l_partkey % 400) AS path, l_linenumber::BIGINT AS chunk,
  CAST(trunc(l_extendedprice * 100) AS BIGINT) % 1000 / 1000.0::DOUBLE AS score FROM lineitem)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts ``(attempt, task, resolved, cost, at)``; the cost of some is unknown."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt"), (F.col("o_custkey") % 50).alias("task"), (F.col("o_orderstatus") == "F").alias("resolved"),
        F.when(F.col("o_orderkey") % 41 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("cost"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("arm"),
    )


ATTEMPTS = """attempts AS (SELECT o_orderkey AS attempt, o_custkey % 50 AS task, o_orderstatus = 'F' AS resolved,
  CASE WHEN o_orderkey % 41 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS cost, o_orderdate AS "at", o_orderpriority AS arm FROM orders)"""


#: Units of ``own(path, bytes, source)`` of at most so many bytes: to the last line feed that fits, else as many characters as fit. For ``WITH RECURSIVE``.
CUTS = """chars AS (SELECT path, c, sum(strlen(c)) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS ends FROM (SELECT path, i, x[i] AS c FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT path, string_split(source, '') AS x FROM own WHERE bytes > 0)))),
  cuts AS (SELECT path, -1 AS unit, 0 AS byte_start, CAST(0 AS HUGEINT) AS byte_end FROM own WHERE bytes > 0
  UNION ALL SELECT u.path, u.unit + 1, u.byte_end::INT, CASE WHEN max(o.bytes) <= u.byte_end + {0} THEN max(o.bytes) ELSE coalesce(max(c.ends) FILTER (c.c = chr(10)), max(c.ends)) END
    FROM cuts u JOIN own o ON o.path = u.path AND o.bytes > u.byte_end JOIN chars c ON c.path = u.path AND c.ends > u.byte_end AND c.ends <= u.byte_end + {0} GROUP BY u.path, u.unit, u.byte_end)"""
