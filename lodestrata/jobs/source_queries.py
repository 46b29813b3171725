"""Queries on Python declarations, generators, and sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import declarations as D
from ..sources import files as R
from ..sources.scratch import scratch_path
from .mapping import CUTS, FILES, files, table

#: Parts as Python modules of a base class, a class and a function.
_CODE = 'class B:\n    def m(self):\n        return 1\n\n    x = 1\n\n\nclass C~(B):\n    @staticmethod\n    def s():\n        pass\n\n    def n~(self):\n        return self.m() + self.gone()\n\n\ndef f~():\n    pass\n'


def _modules(s, d):
    return table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.replace(F.lit(_CODE), F.lit("~"), F.col("p_size").cast("string")).alias("source"))


_UNITS = """u(name, start_line, end_line, owner, kind, headers) AS (VALUES ('B.context', 1, 1, 'B', 'context', '1-1'), ('B.context', 4, 5, 'B', 'context', '1-1'), ('B.m', 2, 3, 'B', 'function', '1-1'),
  ('C@.context', 8, 8, 'C@', 'context', '8-8'), ('C@.context', 12, 12, 'C@', 'context', '8-8'), ('C@.s', 9, 11, 'C@', 'function', '8-8'), ('C@.n@', 13, 14, 'C@', 'function', '8-8'), ('f@', 17, 18, NULL, 'function', '')),
 units AS (SELECT 'p' || p_partkey || '.py' AS path, replace(name, '@', p_size::VARCHAR) AS name, start_line, end_line, replace(owner, '@', p_size::VARCHAR) AS owner, kind, headers FROM part, u)"""

#: Calls through ancestors: by part, one of four modules.
_CALLS = (
    "class A:\n    def m(self):\n        pass\nclass B(A):\n    def k(self):\n        pass\nclass C~(B):\n    def n(self):\n        self.m(); self.k(); self.gone()\n",
    "from x import U\nclass A:\n    def m(self):\n        pass\nclass C~(U, A):\n    def n(self):\n        self.m()\nclass D~(A, U):\n    def n(self):\n        self.m()\n",
    "class A:\n    def m(self):\n        pass\n    def m(self):\n        return 1\nclass B:\n    def m(self):\n        pass\nclass C~(A, B):\n    def n(self):\n        self.m()\nclass T:\n    pass\nclass T(B):\n    def n(self):\n        self.m()\n",
    "class O:\n    def m(self):\n        pass\nclass A(O):\n    pass\nclass B(O):\n    def m(self):\n        pass\nclass C~(A, B):\n    def n(self):\n        self.m()\nclass X(O, A):\n    def n(self):\n        self.m()\n",
)


def _calls(s, d):
    code = F.get(F.array(*[F.lit(x) for x in _CALLS]), (F.col("p_partkey") % len(_CALLS)).cast("int"))
    return table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.replace(code, F.lit("~"), F.col("p_size").cast("string")).alias("source"))


def s1(s, d):
    """The documents' lengths as files of a tree, listed with their sizes."""
    path = f"{scratch_path(s)}/tree-{uuid.uuid4().hex}"
    own = files(s, d).groupBy("repo", P.top_dir(F.col("path")).alias("dir")).agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), "\n").alias("value"))
    own.repartition("repo", "dir").write.partitionBy("repo", "dir").text(path)
    found = R.scan_files(s, path)
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "bytes", F.sha2("content", 256).alias("hash"))


def s3(s, d):
    """Events as two logs by day of the month, one with a line that is cut off."""
    path = f"{scratch_path(s)}/log-{uuid.uuid4().hex}"
    e = table(s, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("requestId"), F.col("user_id").alias("requestBytes"), (F.dayofmonth("ts") % 2).alias("odd"))
    line = F.to_json(F.struct("kind", "requestId", "requestBytes"))
    cut = F.when((F.col("odd") == 1) & F.col("requestId").endswith("77"), F.left(line, F.length(line) - 3)).otherwise(line)
    e.select("odd", cut.alias("value")).repartition("odd").write.partitionBy("odd").text(path)
    return R.read_event_log(s, path).withColumn("kind", F.coalesce("kind", F.lit("?"))).groupBy("valid").agg(F.count("*").alias("n"), F.count_if(F.col("requestBytes").isNotNull()).alias("with_bytes"))


def s4(s, d):
    """Each customer's orders as a nested result."""
    path = f"{scratch_path(s)}/results-{uuid.uuid4().hex}"
    row = F.struct(F.col("o_orderkey").alias("attempt"), F.struct((F.col("o_orderstatus") == "F").alias("resolved"), F.col("o_orderpriority").alias("arm")).alias("result"))
    table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list(row).alias("rows")).write.json(path)
    return R.read_results(s, path, lines=True).select("attempt", F.col("result.resolved").alias("resolved"), F.col("result.arm").alias("arm"))


def _store(s, d):
    path = f"{scratch_path(s)}/answers-{uuid.uuid4().hex}"
    e = table(s, d, "events").select(F.sha2(F.col("props"), 256).alias("digest"), F.col("event_id").alias("question_id"), F.col("value").alias("probability"), F.col("ts").cast("timestamp").alias("created_at"))
    R.append_answers(e.filter("question_id % 2 = 0"), path)
    R.append_answers(e.filter("question_id % 2 = 1"), path)
    return path


def s5(s, d):
    return R.read_answers(s, _store(s, d)).select("digest", "question_id", "probability")


def s5_keyed(s, d):
    """Answers to the digests that begin with certain characters, after some were revised and the appends compacted."""
    path = _store(s, d)
    R.compact_answers(s, path)
    R.append_answers(R.read_answers(s, path).filter("question_id % 3 = 0").withColumns({"probability": F.col("probability") / 2, "created_at": F.col("created_at") + F.expr("interval 1 day")}), path)
    asked = table(s, d, "events").select(F.sha2(F.col("props"), 256).alias("digest")).filter("digest < '08'")
    return R.read_answers(s, path, asked).select("digest", "question_id", "probability")


def s6(s, d):
    path = f"{scratch_path(s)}/packets-{uuid.uuid4().hex}"
    R.write_context(table(s, d, "events").groupBy((F.col("user_id") % 7).alias("query_id")).agg(F.max("props").alias("text")), path)
    return s.read.text(path).select(F.col("query_id").cast("long").alias("query_id"), F.col("value").alias("text"))


def j6(s, d):
    dirs = files(s, d).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("query_id"), P.dirname(F.col("path")).alias("dir")).distinct()
    anchors = s.createDataFrame([(0, "Src1"), (1, "De"), (1, "Other")], "query_id int, name string")
    return D.anchor_matches(dirs, anchors)


QUERIES = {
    "g2_giant_line_units": (
        lambda s, d: D.giant_line_units(files(s, d), 1500).select("path", "unit", "byte_start", "byte_end", F.sha2("text", 256).alias("hash")),
        f"""WITH RECURSIVE {FILES}, own AS (SELECT * FROM files WHERE list_max(list_transform(string_split(source, chr(10)), lambda l: strlen(l))) > 1500), {CUTS.format(1500)}
        SELECT path, CAST(unit AS INT) AS unit, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end, sha256(string_agg(c, '' ORDER BY ends)) AS hash FROM cuts JOIN chars USING (path) WHERE ends > byte_start AND ends <= byte_end GROUP BY ALL""",
    ),
    "g4_python_units": (
        lambda s, d: D.python_units(_modules(s, d)).withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat_ws("-", h["start"], h["end"])), ",")),
        f"WITH {_UNITS} SELECT * FROM units",
    ),
    "a9_unique_definitions": (
        lambda s, d: D.unique_definitions(D.python_units(_modules(s, d))),
        f"WITH {_UNITS} SELECT path, owner, name, min(start_line) AS start_line FROM units WHERE kind <> 'context' GROUP BY ALL HAVING count(*) = 1",
    ),
    "j12_inherited_calls": (
        lambda s, d: D.inherited_calls(_calls(s, d)),
        """WITH x(k, caller, method, target) AS (VALUES (0, 'C@.n', 'm', 'A.m'), (0, 'C@.n', 'k', 'B.k'), (1, 'C@.n', 'm', '?'), (1, 'D@.n', 'm', 'A.m'), (2, 'C@.n', 'm', 'B.m'), (3, 'C@.n', 'm', 'B.m'))
        SELECT 'p' || p_partkey || '.py' AS path, replace(caller, '@', p_size::VARCHAR) AS caller, method, target FROM part JOIN x ON p_partkey % 4 = k""",
    ),
    "g6_opening_preview": (
        lambda s, d: D.opening_preview(files(s, d), 2000).select("path", "truncated", "preview_bytes", F.sha2("preview", 256).alias("hash")),
        f"""WITH {FILES}, c AS (SELECT path, bytes, i, substring(source, i, 1) AS c FROM (SELECT path, bytes, source, unnest(range(1, least(length(source), 2000) + 1)) AS i FROM files)),
        e AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY path ORDER BY i ROWS UNBOUNDED PRECEDING) AS ends FROM c)
        SELECT path, bytes > max(ends) AS truncated, CAST(max(ends) AS BIGINT) AS preview_bytes, sha256(string_agg(c, '' ORDER BY i)) AS hash FROM e WHERE ends <= 2000 GROUP BY path, bytes
        UNION ALL SELECT path, false, 0, sha256('') FROM files WHERE bytes = 0""",
    ),
    "g9_build_questions": (
        lambda s, d: D.build_questions(table(s, d, "benchmark").select(F.lit(1).alias("query_id"), "item_id")).unionByName(D.file_questions(table(s, d, "documents").select(F.lit(2).alias("query_id"), F.col("doc_id").alias("item_id")))),
        """SELECT 1 AS query_id, item_id, kind, kind || ':' || item_id AS question_id FROM benchmark, (VALUES ('q'), ('scope'), ('ref')) AS k(kind)
        UNION ALL SELECT 2, doc_id, kind, kind || ':' || doc_id FROM documents, (VALUES ('implementation'), ('caller'), ('test'), ('fixture'), ('helper'), ('priority')) AS k(kind)""",
    ),
    "j6_anchor_matches": (
        j6,
        f"""WITH {FILES}, dd AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM files), a(query_id, name) AS (VALUES (0, 'Src1'), (1, 'De'), (1, 'Other'))
        SELECT query_id, dir, name FROM dd, a WHERE list_contains(string_split_regex(lower(dir), '[^\\p{{L}}\\p{{Nd}}_]+'), lower(name))""",
    ),
    "s1_scan_files": (
        s1,
        f"""WITH {FILES}, t AS (SELECT 'repo=' || repo || '/dir=' || split_part(path, '/', 1) AS dir, string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10) AS x FROM files GROUP BY 1)
        SELECT dir, strlen(x) AS bytes, sha256(x) AS hash FROM t""",
    ),
    "s3_read_event_log": (
        s3,
        """WITH e AS (SELECT day(ts) % 2 AS odd, day(ts) % 2 = 1 AND event_id % 100 = 77 AS bad FROM events), l AS (SELECT odd, NOT bool_or(bad) AS valid FROM e GROUP BY 1)
        SELECT valid, count(*) AS n, count(*) FILTER (NOT bad) AS with_bytes FROM e JOIN l USING (odd) GROUP BY valid""",
    ),
    "s4_read_results": (s4, "SELECT o_orderkey AS attempt, o_orderstatus = 'F' AS resolved, o_orderpriority AS arm FROM orders"),
    "s5_answers_store": (s5, "SELECT sha256(props) AS digest, event_id AS question_id, value AS probability FROM events"),
    "s5_keyed_answers": (s5_keyed, "SELECT sha256(props) AS digest, event_id AS question_id, CASE WHEN event_id % 3 = 0 THEN value / 2 ELSE value END AS probability FROM events WHERE sha256(props) < '08'"),
    "s6_write_context": (s6, "SELECT user_id % 7 AS query_id, max(props) AS text FROM events GROUP BY 1"),
}
