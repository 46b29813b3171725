"""Queries on ranking, packing and collecting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as V
from ..operators import packets as P
from ..operators import units as U
from .mapping import CUTS, FILES, SCORES, SPANS, files, scores, spans, table

_FOUND = f"{SCORES}, found AS (SELECT query_id, path, max(score) AS score, max(CASE WHEN chunk % 3 = 0 THEN score END) AS priority FROM scores GROUP BY ALL)"


def found(s, d):
    return scores(s, d).groupBy("query_id", "path").agg(F.max("score").alias("score"), F.max(F.when(F.col("chunk") % 3 == 0, F.col("score"))).alias("priority"))


def _sized(s, d):
    return table(s, d, "events").select((F.col("user_id") % 40).alias("query_id"), F.col("event_id").alias("ord"), (F.col("value") * 100).cast("long").alias("bytes"))


_SIZED = "sized AS (SELECT user_id % 40 AS query_id, event_id AS ord, CAST(trunc(value * 100) AS BIGINT) AS bytes FROM events)"


def w3(s, d):
    return V.allocate_source(_sized(s, d).select("query_id", F.lit(0).alias("rank"), F.col("ord").alias("excerpt"), "bytes"), 20_000).drop("rank")


def _excerpts(s, d):
    """Events as excerpts of files of their own; users whose number five divides have none."""
    return table(s, d, "events").filter("user_id % 5 > 0").select(
        (F.col("user_id") % 97).alias("query_id"), F.concat(F.lit("d"), "event_id").alias("path"), (F.col("user_id") % 3).alias("n_groups"), F.lit(0).alias("start"), F.octet_length("event_type").alias("end"), F.col("event_type").alias("source")
    )


def w4(s, d):
    lines = table(s, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("line_no"), F.col("text").alias("line"))
    return V.truncate_output(lines, 3000).select("query_id", "line_no", "so_far", "truncated")


def j10(s, d):
    judged = files(s, d).select("repo", F.replace("path", F.col("doc_id").cast("string"), F.lit("")).alias("path"), F.when(F.col("doc_id") % 32 == 12, F.lit("x")).alias("reason")).dropDuplicates(["repo", "path"])
    return V.instruction_files(files(s, d), judged.withColumn("reason", F.when(F.col("path").contains("/de/"), "ignored")), "README")


def s7(s, d):
    """Packets of all scored files; an excerpt is what an event tells, for the file of its number."""
    roles = F.when(F.col("priority") > 0.9, F.array(F.lit("caller"), F.lit("test"))).when(F.col("priority") > 0.5, F.array(F.lit("helper")))
    e = table(s, d, "events")
    own = e.select(
        (F.col("user_id") % 97).alias("query_id"), F.concat(F.lit("p"), F.col("event_id") % 400).alias("path"), F.col("event_id").alias("start_line"), (F.col("event_id") + 1).alias("end_line"),
        F.concat("event_type", F.lit("\n"), F.when(F.col("event_id") % 3 == 0, F.lit("````")).otherwise(F.lit("x"))).alias("source"),
    )
    lines = P.packet_lines(found(s, d).withColumn("roles", roles), own, 10_000_000, 20_000)
    return P.packet_texts(lines).select("query_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("bytes"))


def o9(s, d):
    groups = scores(s, d).groupBy("query_id", "path").agg(F.count("*").alias("n_groups"))
    return V.order_donors(groups).select("query_id", F.array_join("donors", ",").alias("donors"))


_EV = f'{SPANS}, ev AS (SELECT DISTINCT k % 500 AS query_id, \'p\' || n AS path, start, "end" FROM spans)'


def _evidence(s, d):
    own = spans(s, d).select((F.col("k") % 500).alias("query_id"), F.concat(F.lit("p"), "n").alias("path"), "start", "end").distinct()
    return V.collect_evidence(own)


QUERIES = {
    "w1_rank_files": (
        lambda s, d: V.rank_files(found(s, d)),
        f"WITH {_FOUND} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(priority, score) DESC, score DESC, path) AS INT) AS rank FROM found",
    ),
    "w3_allocate_source": (
        w3,
        f"""WITH RECURSIVE {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS i FROM sized),
        w AS (SELECT query_id, ord, bytes, i, bytes <= 20000 AS kept, CASE WHEN bytes <= 20000 THEN 20000 - bytes ELSE 20000 END AS rest FROM r WHERE i = 1
          UNION ALL SELECT r.query_id, r.ord, r.bytes, r.i, r.bytes <= w.rest, CASE WHEN r.bytes <= w.rest THEN w.rest - r.bytes ELSE w.rest END FROM w JOIN r ON r.query_id = w.query_id AND r.i = w.i + 1)
        SELECT query_id, ord AS excerpt, bytes, kept FROM w""",
    ),
    "w4_truncate_output": (
        w4,
        """WITH s AS (SELECT conv_id AS query_id, turn AS line_no, CAST(sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far, sum(strlen(text) + 1) OVER (PARTITION BY conv_id) > 3000 AS truncated FROM conversations)
        SELECT * FROM s WHERE NOT truncated OR so_far <= 2936""",
    ),
    "w5_fit_declarations": (
        lambda s, d: V.fit_declarations(_sized(s, d).select(F.col("query_id").alias("path"), F.col("ord").alias("start_line"), F.col("ord").alias("name"), "bytes"), 32_000).select("path", "name", "so_far"),
        f"WITH {_SIZED} SELECT * FROM (SELECT query_id AS path, ord AS name, CAST(sum(bytes) OVER (PARTITION BY query_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far FROM sized) WHERE so_far <= 32000",
    ),
    "w10_pack_batches": (
        lambda s, d: V.pack_batches(_sized(s, d), ["query_id"], 16, 9_000),
        f"""WITH RECURSIVE {_SIZED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS i FROM sized WHERE bytes <= 9000),
        w AS (SELECT query_id, ord, bytes, i, 0 AS batch, 1 AS n, bytes AS size FROM r WHERE i = 1
          UNION ALL SELECT r.query_id, r.ord, r.bytes, r.i, CASE WHEN w.n = 16 OR w.size + r.bytes > 9000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n = 16 OR w.size + r.bytes > 9000 THEN 1 ELSE w.n + 1 END,
          CASE WHEN w.n = 16 OR w.size + r.bytes > 9000 THEN r.bytes ELSE w.size + r.bytes END FROM w JOIN r ON r.query_id = w.query_id AND r.i = w.i + 1)
        SELECT query_id, ord, bytes, CAST(batch AS BIGINT) AS batch, false AS too_large FROM w UNION ALL SELECT query_id, ord, bytes, NULL, true FROM sized WHERE bytes > 9000""",
    ),
    "a10_collect_evidence": (
        lambda s, d: _evidence(s, d).select("query_id", "path", F.concat_ws(",", F.transform("excerpts", lambda e: F.concat_ws("-", e["start"], e["end"]))).alias("excerpts"), "n", "span"),
        f"""WITH {_EV} SELECT query_id, path, string_agg(start || '-' || "end", ',' ORDER BY start, "end") AS excerpts, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS span FROM ev GROUP BY ALL""",
    ),
    "g10_explode_evidence": (
        lambda s, d: V.explode_evidence(_evidence(s, d)),
        f'WITH {_EV} SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id, path ORDER BY start, "end") - 1 AS INT) AS place, start, "end" FROM ev',
    ),
    "j10_instruction_files": (
        j10,
        f"""WITH {FILES} SELECT DISTINCT repo, replace(path, doc_id::VARCHAR, '') AS path, contains(path, '/de/') AS excluded FROM files WHERE replace(path, doc_id::VARCHAR, '') LIKE '%/README'
        AND (repo, regexp_replace(replace(path, doc_id::VARCHAR, ''), '/README$', '')) IN (SELECT (repo, split_part(path, '/', 1) || '/' || split_part(path, '/', 2)) FROM files)""",
    ),
    "j11_attach_evidence": (
        lambda s, d: V.attach_evidence(found(s, d).select("query_id", "path"), _excerpts(s, d), 6000).select("query_id", "path", F.to_json("evidence").alias("evidence")),
        f"""WITH {_FOUND}, x AS (SELECT user_id % 97 AS query_id, 'd' || event_id AS path, user_id % 3 AS n, event_type AS source FROM events WHERE user_id % 5 > 0),
        j AS (SELECT query_id, '[' || string_agg('{{"path":"' || path || '","start":0,"end":' || strlen(source) || ',"source":"' || source || '"}}', ',' ORDER BY n, path) || ']' AS evidence FROM x GROUP BY 1)
        SELECT found.query_id, found.path, CASE WHEN strlen(evidence) <= 6000 THEN evidence END AS evidence FROM found LEFT JOIN j USING (query_id)""",
    ),
    "s7_packets": (
        s7,
        f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(priority, score) DESC, score DESC, path) AS rank FROM found),
        x AS (SELECT user_id % 97 AS query_id, 'p' || (event_id % 400) AS path, event_id, event_type || chr(10) || CASE WHEN event_id % 3 = 0 THEN '````' ELSE 'x' END AS source, CASE WHEN event_id % 3 = 0 THEN '`````' ELSE '```' END AS fence FROM events),
        t AS (SELECT x.*, rank FROM x JOIN r USING (query_id, path)),
        l AS (SELECT query_id, 0 AS section, 0 AS rank, 0 AS event_id, [count(*) || ' relevant files.'] AS lines FROM found GROUP BY 1
          UNION ALL SELECT query_id, 1, rank, 0, ['- "' || path || '" — ' || CASE WHEN priority > 0.9 THEN 'caller, test' WHEN priority > 0.5 THEN 'helper' ELSE 'relevant; role uncertain' END || '; ' ||
            CASE WHEN (query_id, path) IN (SELECT (query_id, path) FROM t) THEN 'source below' ELSE 'locations only' END] FROM r
          UNION ALL SELECT DISTINCT query_id, 2, 0, 0, ['End file list.'] FROM found
          UNION ALL SELECT query_id, 3, rank, event_id, ['', 'Source block "' || path || '" lines ' || event_id || '-' || (event_id + 1) || ':', fence] || string_split(source, chr(10)) || [fence] FROM t
          UNION ALL SELECT DISTINCT query_id, 4, 0, 0, ['', 'End context.'] FROM found),
        n AS (SELECT query_id, section, rank, event_id, i, line, sum(strlen(line) + 1) OVER (PARTITION BY query_id) AS total, sum(strlen(line) + 1) OVER (PARTITION BY query_id ORDER BY section, rank, event_id, i ROWS UNBOUNDED PRECEDING) AS so_far
          FROM (SELECT query_id, section, rank, event_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l)),
        p AS (SELECT query_id, string_agg(line, chr(10) ORDER BY section, rank, event_id, i) AS text FROM n WHERE total <= 20000 OR so_far <= 19936 GROUP BY 1)
        SELECT query_id, sha256(text) AS hash, strlen(text) AS bytes FROM p""",
    ),
    "o9_order_donors": (
        o9,
        f"WITH {SCORES}, g AS (SELECT query_id, path, count(*) AS n FROM scores GROUP BY ALL) SELECT query_id, string_agg(path, ',' ORDER BY n, path) AS donors FROM g GROUP BY query_id",
    ),
    "g1_split_source": (
        lambda s, d: U.split_source(files(s, d), 3000).select("path", "unit", "byte_start", "byte_end", F.octet_length("text").cast("long").alias("bytes")),
        f"WITH RECURSIVE {FILES}, own AS (SELECT * FROM files), {CUTS.format(3000)} SELECT path, unit, byte_start, byte_end, byte_end - byte_start AS bytes FROM cuts WHERE unit >= 0",
    ),
}
