"""Queries on spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bodies as B
from ..operators import spans as S
from .mapping import SPANS, spans, table

_KEYS = ["k"]


def _a(s, d):
    return spans(s, d).filter("l_returnflag <> 'R'").select("k", "start", "end")


def _r(s, d):
    return spans(s, d).filter("l_returnflag = 'R'").select("k", "start", "end")


_AR = f"""{SPANS}, a AS (SELECT k, start, "end" FROM spans WHERE l_returnflag <> 'R'), r AS (SELECT k, start, "end" FROM spans WHERE l_returnflag = 'R')"""


def _merged(name: str, src: str, gap: int = 0) -> str:
    return f"""{name}_i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS new FROM {src})),
    {name} AS (SELECT k, min(start) AS start, max("end") AS "end" FROM {name}_i GROUP BY k, island)"""


#: Which whole numbers from ``start`` to ``end`` are left, as runs.
def _runs(src: str) -> str:
    return f"""SELECT k, min(x) AS start, max(x) + 1 AS "end" FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM (SELECT DISTINCT k, x FROM {src})) GROUP BY k, g"""


_POINTS = """pa AS (SELECT DISTINCT k, unnest(range(start, "end")) AS x FROM a), pr AS (SELECT DISTINCT k, unnest(range(start, "end")) AS x FROM r)"""


def w8(s, d):
    units = spans(s, d).groupBy("k", F.col("start").alias("start_line")).agg(F.max("end").alias("end_line"), F.min("n").cast("string").alias("name"), F.bool_or(F.col("l_returnflag") == "R").alias("selected"))
    owners = spans(s, d).groupBy("k").agg((F.min("start") - F.col("k") % 25 + 3).alias("owner_start")).filter("k % 7 > 0")
    return S.neighbor_members(units, ["k"], 15, owners)


def w9(s, d):
    totals = spans(s, d).groupBy("k").agg((F.max("end") + 2).alias("n_lines"))
    return S.context_windows(_a(s, d), _r(s, d), totals, ["k"])


def w9_blank(s, d):
    """Sentences of whole documents as lines: by their length some are blank, some comments, and a few are chosen."""
    sentence = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. "))
    size = F.length("line")
    kind = F.when(size % 3 == 0, "").when(size % 5 == 1, "# comment").when(size % 31 == 7, "chosen").otherwise("code")
    lines = table(s, d, "documents").select("doc_id", sentence.alias("line_no", "line")).select("doc_id", (F.col("line_no") + 1).alias("line_no"), kind.alias("line"))
    comments = S.comment_ranges(lines, key="doc_id")
    chosen = lines.filter("line = 'chosen'").select("doc_id", F.col("line_no").alias("start"), F.col("line_no").alias("end"))
    totals = lines.groupBy("doc_id").agg(F.max("line_no").alias("n_lines"))
    return S.context_windows(chosen, comments, totals, ["doc_id"], pad=1, nonblank=S.nonblank_prefix(lines, "doc_id"))


def f16_spans(s, d):
    """Thirty characters of each document, placed by characters: where others than ASCII stand before or in them, their bytes are elsewhere."""
    at, text = F.col("doc_id") % 40, F.coalesce("text", F.lit(""))
    line = lambda n: F.regexp_count(F.substring(text, F.lit(1), n), F.lit("\n")) + 1
    own = table(s, d, "documents").withColumn("n", at.cast("int"))
    taken = F.substring(text, F.col("n") + 1, F.lit(30))
    rows = own.select("doc_id", line(F.col("n")).alias("start_line"), line(F.col("n") + F.length(taken)).alias("end_line"), at.alias("byte_start"), (at + F.length(taken)).alias("byte_end"), taken.alias("text"), (F.col("doc_id") % 5 > 0).alias("partial"))
    return S.valid_spans(rows, own.select("doc_id", F.col("text").alias("source")), "doc_id").select("doc_id", "start_line", "end_line", "valid")


def bodies(s, d):
    """Line items as units, selections and excerpts of a test file for each order; fifty questions, some of them with no body kept.

    Line items without an order are no file's, as in the SQL.
    """
    own = spans(s, d).withColumnsRenamed({"k": "path"}).filter("path is not null").withColumn("query_id", F.col("path") % 50)
    ranges = lambda rows: S.merge_spans(rows.select("query_id", "path", "start", "end"), B.KEYS, gap=1)
    units = own.filter("n > 2").select("query_id", "path", F.col("n").cast("string").alias("name"), "start", F.expr("start + (end - start) div 3").alias("end"), F.lit(900).cast("long").alias("bytes"))
    answers = units.select("query_id", "path", "start", "end", F.expr("CASE WHEN query_id % 5 = 0 THEN 0.3 WHEN query_id % 7 = 1 AND path % 99 = 0 THEN 1.5 ELSE (start * 7 + end * 3 + path) % 10 / 10 END").cast("double").alias("score"))
    found = B.select_bodies(units, ranges(own.filter("n <> 3")), ranges(own), answers)
    both = found.shown.withColumn("kind", F.lit("shown")).unionByName(found.selected.withColumn("kind", F.lit("selected")))
    return both.select("query_id", "path", "kind", "start", "end")


def u6(s, d):
    base = spans(s, d).groupBy("k", "start").agg(F.max("end").alias("v"))
    return S.merge_decisions(base.filter("v % 2 = 0"), base.filter("v % 3 = 0").withColumn("v", -F.col("v")), ["k", "start"], "v")


QUERIES = {
    "a7_merge_spans": (lambda s, d: S.merge_spans(_a(s, d), _KEYS), f"WITH {_AR}, {_merged('m', 'a')} SELECT * FROM m"),
    "x4_merge_adjacent_ranges": (lambda s, d: S.merge_spans(_r(s, d), _KEYS, gap=1), f"WITH {_AR}, {_merged('m', 'r', 1)} SELECT * FROM m"),
    "w6_span_islands": (
        lambda s, d: S.span_islands(_a(s, d).distinct(), _KEYS),
        f"WITH {_AR}, u AS (SELECT DISTINCT * FROM a), {_merged('m', 'u')} SELECT k, start, \"end\", CAST(island AS BIGINT) AS island FROM m_i",
    ),
    "j7_overlap_join": (
        lambda s, d: S.overlap_join(_a(s, d), _r(s, d), _KEYS),
        f'WITH {_AR} SELECT a.k, a.start, a."end", r.start AS r_start, r."end" AS r_end FROM a JOIN r ON a.k = r.k AND a.start < r."end" AND a."end" > r.start',
    ),
    "j8_contained_in": (
        lambda s, d: S.contained_in(_a(s, d), _r(s, d), _KEYS),
        f'WITH {_AR} SELECT * FROM a WHERE EXISTS (SELECT 1 FROM r WHERE r.k = a.k AND r.start <= a.start AND r."end" >= a."end")',
    ),
    "j9_intersect_spans": (
        lambda s, d: S.intersect_spans(_a(s, d), _r(s, d), _KEYS),
        f'WITH {_AR} SELECT a.k, greatest(a.start, r.start) AS start, least(a."end", r."end") AS "end" FROM a JOIN r ON a.k = r.k AND a.start < r."end" AND a."end" > r.start',
    ),
    "u3_subtract_lines": (
        lambda s, d: S.subtract_lines(_a(s, d), _r(s, d), _r(s, d).filter("start % 2 = 0"), _KEYS),
        f"""WITH {_AR}, xa AS (SELECT DISTINCT k, unnest(range(start, "end" + 1)) AS x FROM a), xr AS (SELECT DISTINCT k, unnest(range(start, "end" + 1)) AS x FROM r),
        xk AS (SELECT DISTINCT k, unnest(range(start, "end" + 1)) AS x FROM r WHERE start % 2 = 0), gone AS (SELECT * FROM xr EXCEPT SELECT * FROM xk), rest AS (SELECT * FROM xa EXCEPT SELECT * FROM gone)
        SELECT k, start, "end" - 1 AS "end" FROM ({_runs('rest')})""",
    ),
    "u3_test_bodies": (
        bodies,
        f"""WITH {SPANS}, o AS (SELECT k % 50 AS q, k, n, start, "end" FROM spans), one AS (SELECT k, start, "end" FROM o WHERE n <> 3), alls AS (SELECT k, start, "end" FROM o), {_merged('sel', 'one', 1)}, {_merged('sho', 'alls', 1)},
        u AS (SELECT DISTINCT q, k, start, start + ("end" - start) // 3 AS e FROM o WHERE n > 2), c AS (SELECT * FROM u WHERE EXISTS (SELECT 1 FROM sel WHERE sel.k = u.k AND sel.start <= u.start AND sel."end" >= u.e) AND EXISTS (SELECT 1 FROM sho WHERE sho.k = u.k AND sho.start <= u.start AND sho."end" >= u.e)),
        a AS (SELECT *, CASE WHEN q % 5 = 0 THEN 0.3 WHEN q % 7 = 1 AND k % 99 = 0 THEN 1.5 ELSE (start * 7 + e * 3 + k) % 10 / 10 END AS score FROM c), g AS (SELECT q FROM a GROUP BY q HAVING bool_and(score BETWEEN 0 AND 1) AND bool_or(score > 0.5)),
        v AS (SELECT a.* FROM a JOIN g USING (q)), gone AS (SELECT DISTINCT k, unnest(range(start, e + 1)) AS x FROM v WHERE score <= 0.5 EXCEPT SELECT DISTINCT k, unnest(range(start, e + 1)) FROM v WHERE score > 0.5), changed AS (SELECT DISTINCT k FROM v WHERE score <= 0.5),
        r AS (SELECT 'shown' AS kind, * FROM sho UNION ALL SELECT 'selected', * FROM sel), x AS (SELECT DISTINCT kind, k, unnest(range(start, "end" + 1)) AS x FROM r WHERE k IN (SELECT k FROM changed)),
        rest AS (SELECT kind, k, x, x - row_number() OVER (PARTITION BY kind, k ORDER BY x) AS g FROM x WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.k = x.k AND gone.x = x.x))
        SELECT k % 50 AS query_id, k AS path, kind, min(x) AS start, max(x) AS "end" FROM rest GROUP BY kind, k, g
        UNION ALL SELECT k % 50, k, kind, start, "end" FROM r WHERE k NOT IN (SELECT k FROM changed)""",
    ),
    "u4_subtract_spans": (
        lambda s, d: S.subtract_spans(_a(s, d), _r(s, d), _KEYS),
        f"WITH {_AR}, {_POINTS}, rest AS (SELECT * FROM pa EXCEPT SELECT * FROM pr) {_runs('rest')}",
    ),
    "u6_merge_decisions": (
        u6,
        f"""WITH {SPANS}, b AS (SELECT k, start, max("end") AS v FROM spans GROUP BY k, start) SELECT k, start, CASE WHEN v % 3 = 0 THEN -v ELSE v END AS v FROM b WHERE v % 2 = 0 OR v % 3 = 0""",
    ),
    "u7_dedupe_leads": (
        lambda s, d: S.dedupe_leads(spans(s, d).select("k", "start", F.col("end").alias("score"), "n"), ["k", "start"], "score", "n").groupBy("k", "start").agg(F.max("n").alias("last")),
        f"WITH {SPANS} SELECT k, start, max(n) AS last FROM spans GROUP BY k, start",
    ),
    "f16_valid_ranges": (
        lambda s, d: S.valid_ranges(_a(s, d), spans(s, d).filter("k % 3 > 0").groupBy("k").agg(F.min("end").alias("n_lines")), _KEYS),
        f"""WITH {_AR}, t AS (SELECT k, min("end") AS n FROM spans WHERE k % 3 > 0 GROUP BY k) SELECT a.*, coalesce(a.start >= 1 AND a.start <= a."end" AND a."end" <= t.n, false) AS valid FROM a LEFT JOIN t ON a.k = t.k""",
    ),
    "f16_valid_spans": (
        f16_spans,
        """WITH d AS (SELECT doc_id, text AS source, coalesce(text, '') AS t, doc_id % 40 AS n FROM documents), s AS (SELECT *, substr(t, n + 1, 30) AS x FROM d),
        p AS (SELECT *, len(substr(t, 1, n)) - len(replace(substr(t, 1, n), chr(10), '')) + 1 AS a, len(substr(t, 1, n + len(x))) - len(replace(substr(t, 1, n + len(x)), chr(10), '')) + 1 AS b FROM s),
        q AS (SELECT *, list_aggregate(string_split(t, chr(10))[a:b], 'string_agg', chr(10)) AS own FROM p)
        SELECT doc_id, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line, source IS NOT NULL AND n + len(x) <= strlen(t) AND substr(hex(encode(t)), 2 * n + 1, 2 * len(x)) = hex(encode(x))
          AND CASE WHEN doc_id % 5 > 0 THEN contains(own, x) ELSE own = x END AS valid FROM q""",
    ),
    "w8_neighbor_members": (
        w8,
        f"""WITH {SPANS}, u AS (SELECT k, start AS s, max("end") AS e, CAST(min(n) AS VARCHAR) AS name, bool_or(l_returnflag = 'R') AS sel FROM spans GROUP BY k, start),
        w AS (SELECT *, lag(name) OVER o AS b, lag(e - s + 1) OVER o AS bn, lead(name) OVER o AS f, lead(e - s + 1) OVER o AS fn FROM u WINDOW o AS (PARTITION BY k ORDER BY s, name)),
        o AS (SELECT k, min(start) AS f, min(start) - k % 25 + 3 AS o FROM spans WHERE k % 7 > 0 GROUP BY k)
        SELECT k, name, CASE WHEN bn <= 15 THEN b END AS before, CASE WHEN fn <= 15 THEN w.f END AS after,
          CASE WHEN o.o <= least(o.f - 1, o.o + 14) THEN o.o END AS header_start, CASE WHEN o.o <= least(o.f - 1, o.o + 14) THEN least(o.f - 1, o.o + 14) END AS header_end
        FROM w LEFT JOIN o USING (k) WHERE sel""",
    ),
    "w9_context_closure": (
        w9_blank,
        # each window takes in one comment after the other, until none is left to take
        """WITH RECURSIVE x AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), '. ')) AS line, generate_subscripts(string_split(coalesce(text, ''), '. '), 1) AS n FROM documents),
        l AS (SELECT doc_id, n, CASE WHEN length(line) % 3 = 0 THEN 'blank' WHEN length(line) % 5 = 1 THEN 'comment' WHEN length(line) % 31 = 7 THEN 'chosen' ELSE 'code' END AS kind FROM x),
        b AS (SELECT doc_id, n, sum(CASE WHEN kind = 'blank' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS nb, max(n) OVER (PARTITION BY doc_id) AS total FROM l),
        c AS (SELECT doc_id, min(n) AS s, max(n) AS e FROM (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l WHERE kind = 'comment') GROUP BY doc_id, g),
        cb AS (SELECT c.*, coalesce(p.nb, 0) AS before, q.nb AS upto FROM c LEFT JOIN b p ON p.doc_id = c.doc_id AND p.n = c.s - 1 JOIN b q ON q.doc_id = c.doc_id AND q.n = c.e),
        w AS (SELECT l.doc_id, l.n AS id, greatest(l.n - 1, 1) AS s, least(l.n + 1, b.total) AS e FROM l JOIN b USING (doc_id, n) WHERE kind = 'chosen'),
        r AS (SELECT 0 AS step, doc_id, id, s, e FROM w
          UNION ALL SELECT any_value(r.step) + 1, r.doc_id, r.id, least(any_value(r.s), min(cb.s)), greatest(any_value(r.e), max(cb.e)) FROM r LEFT JOIN b p ON p.doc_id = r.doc_id AND p.n = r.s - 1 JOIN b q ON q.doc_id = r.doc_id AND q.n = r.e
            JOIN cb ON cb.doc_id = r.doc_id AND ((cb.s <= r.e AND cb.e >= r.s) OR (cb.e < r.s AND cb.upto = coalesce(p.nb, 0)) OR (cb.s > r.e AND cb.before = q.nb))
            GROUP BY r.doc_id, r.id HAVING min(cb.s) < any_value(r.s) OR max(cb.e) > any_value(r.e)),
        f AS (SELECT doc_id, id, min(s) AS s, max(e) AS e FROM r GROUP BY doc_id, id),
        i AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM f),
        j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i)
        SELECT doc_id, min(s) AS start, max(e) AS "end" FROM j GROUP BY doc_id, island""",
    ),
    "w9_context_windows": (
        w9,
        f"""WITH {_AR}, t AS (SELECT k, max("end") + 2 AS n FROM spans GROUP BY k), c AS (SELECT a.k, greatest(start - 3, 1) AS start, least("end" + 3, n) AS "end", 1 AS own FROM a JOIN t ON a.k = t.k UNION ALL SELECT *, 0 FROM r),
        i AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM c),
        j AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM i)
        SELECT k, min(start) AS start, max("end") AS "end" FROM j GROUP BY k, island HAVING max(own) = 1""",
    ),
}
