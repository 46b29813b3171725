"""Queries on text, scalar functions and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import spans as S
from .mapping import FILES, files, table

_LINES = f"""{FILES}, lines AS (SELECT path, i AS line_no, x[i] AS line FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i
  FROM (SELECT path, string_split(source, chr(10)) AS x FROM files)))"""
_NOW = "timestamp '2024-01-20 00:00:00'"
_MARK = "^\\s*[A-E]"


def lines(spark, sf_dir):
    return S.line_index(files(spark, sf_dir))


def _events(col):
    return lambda s, d: table(s, d, "events").select("event_id", col())


RATES = {"click": "0.042", "view": "1.25"}

QUERIES = {
    "p6_line_index": (
        lambda s, d: lines(s, d).select("path", "line_no", "n_bytes", "byte_start"),
        f"WITH {_LINES} SELECT path, line_no, strlen(line) AS n_bytes, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM lines",
    ),
    "p7_size_estimates": (
        lambda s, d: files(s, d).select("path", T.file_tokens(F.col("bytes")).alias("tokens"), T.request_tokens(F.col("bytes"), F.lit(5)).alias("request")),
        f"WITH {FILES} SELECT path, CAST(floor(bytes / 4 + 0.5) AS BIGINT) AS tokens, CAST(least(65536, bytes + 512 + 160) AS BIGINT) AS request FROM files",
    ),
    "p8_identifiers": (
        lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(T.identifiers(F.concat("text", F.lit(" \ufb01le \uff26\uff55ll \u2460 x\u00b2 re\u0301u")))).alias("token")),
        "SELECT item_id, unnest(list_distinct(regexp_extract_all(nfc_normalize(text) || ' file Full 1 x2 r\u00e9u', '[_\\p{L}\\p{Nl}][_\\p{L}\\p{Nl}\\p{Nd}\\p{Mn}\\p{Mc}\\p{Pc}]*'))) AS token FROM benchmark",
    ),
    "p9_shannon_entropy": (
        lambda s, d: table(s, d, "part").select("p_partkey", F.round(T.shannon_entropy(F.col("p_name")), 9).alias("bits")),
        "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part), n AS (SELECT p_partkey, c, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT p_partkey, sum(k) AS n FROM n GROUP BY ALL) SELECT p_partkey, round(-sum(k / n * log2(k / n)), 9) AS bits FROM n JOIN t USING (p_partkey) GROUP BY p_partkey",
    ),
    "p10_request_digest": (
        _events(lambda: V.request_digest(F.lit("ns"), F.col("event_type")).alias("digest")),
        """SELECT event_id, sha256('{"schema":1,"namespace":"ns","request":"' || event_type || '"}') AS digest FROM events""",
    ),
    "p11_unit_value": (
        lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", V.unit_value(F.col("l_discount") * 10, F.col("l_tax") * 10, F.when(F.col("l_quantity") > 40, F.col("l_quantity") / 100)).alias("value")),
        "SELECT l_orderkey, l_linenumber, greatest(least(l_discount * 10, l_tax * 10), coalesce(CASE WHEN l_quantity > 40 THEN l_quantity / 100 END, 0)) AS value FROM lineitem",
    ),
    "p12_role_labels": (
        _events(lambda: F.array_join(V.role_labels(F.create_map(F.col("event_type"), F.col("value") / 50, F.lit("owner"), F.col("value") / 25, F.lit("priority"), F.lit(1.0))), ",").alias("roles")),
        "SELECT event_id, coalesce(array_to_string(list_sort(list_filter([CASE WHEN value / 50 > 0.5 THEN event_type END, CASE WHEN value / 25 > 0.5 THEN 'owner' END], lambda x: x IS NOT NULL)), ','), '') AS roles FROM events",
    ),
    "p13_quote_label": (
        _events(lambda: T.quote_label(F.concat("event_type", F.lit("\"\\\t\n\u202e\u200f\u0085\x7f\u2028"), F.col("user_id").cast("string"))).alias("label")),
        r"""SELECT event_id, '"' || event_type || '\"\\\t\n\u202e\u200f\u0085\u007f\u2028' || user_id || '"' AS label FROM events""",
    ),
    "p14_human_size": (
        lambda s, d: files(s, d).select("path", T.human_size(F.col("bytes")).alias("size")),
        f"WITH {FILES} SELECT path, CASE WHEN bytes < 1024 THEN bytes || ' B' ELSE printf('%.1f KiB', floor(bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM files",
    ),
    "p15_fence_length": (
        lambda s, d: files(s, d).select("path", T.fence_length(F.translate("source", "$", "`")).alias("fence")),
        f"WITH {FILES} SELECT path, CAST(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(source, '[`$]+'), lambda x: length(x))), 0) + 1) AS INT) AS fence FROM files",
    ),
    "p16_run_status": (
        _events(lambda: V.run_status(F.col("event_type") == "error", F.col("user_id") % 3).alias("status")),
        "SELECT event_id, CASE WHEN event_type = 'error' THEN 'interrupted' WHEN user_id % 3 > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM events",
    ),
    "p17_usage_cost": (
        _events(lambda: V.usage_cost(F.col("user_id") * 1000, F.col("event_type"), RATES).alias("cost")),
        "SELECT event_id, CAST(CAST(user_id * 1000 AS DECIMAL(18,0)) * CASE event_type WHEN 'click' THEN 0.042 WHEN 'view' THEN 1.25 END * 0.000001 AS DECIMAL(38,12)) AS cost FROM events",
    ),
    "p18_answer_is_fresh": (
        _events(lambda: V.answer_is_fresh(F.col("ts"), F.expr(_NOW)).alias("fresh")),
        f"SELECT event_id, ts <= {_NOW} AND epoch_us({_NOW}) - epoch_us(ts) < 604800000000 AS fresh FROM events",
    ),
    "p19_cooldown_end": (
        _events(lambda: V.cooldown_end(F.col("ts"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).when(F.col("user_id") % 3 == 0, "Wed, 21 Feb 2024 07:28:00 GMT").otherwise("soon")).cast("timestamp_ntz").alias("until")),
        "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN ts + to_microseconds(user_id * 1000000) WHEN user_id % 3 = 0 AND timestamp '2024-02-21 07:28:00' > ts THEN timestamp '2024-02-21 07:28:00' ELSE ts + INTERVAL 1 SECOND END AS until FROM events",
    ),
    "p20_usage_field": (
        _events(lambda: V.usage_field(F.col("props"), ("input_tokens", "k")).alias("k")),
        "SELECT event_id, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS BIGINT) AS k FROM events",
    ),
    "p21_redact": (
        _events(lambda: T.redact(F.concat(F.col("props"), F.lit("\t"), F.col("event_type")), F.col("event_type")).alias("message")),
        "SELECT event_id, left(replace(props || ' ' || event_type, event_type, '[redacted]'), 500) AS message FROM events",
    ),
    "g3_block_units": (
        lambda s, d: S.block_units(lines(s, d).groupBy("path").agg(F.lit(1).cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line")), 16),
        f"WITH {_LINES}, u AS (SELECT path, max(line_no) AS e FROM lines GROUP BY path) SELECT path, s AS start_line, least(s + 15, e) AS end_line FROM (SELECT path, e, unnest(range(1, e + 1, 16)) AS s FROM u)",
    ),
    "g5_comment_ranges": (
        lambda s, d: S.comment_ranges(lines(s, d), _MARK).select("path", F.col("start").cast("long"), F.col("end").cast("long")),
        f"""WITH {_LINES}, c AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM lines WHERE regexp_matches(line, '{_MARK}'))
        SELECT path, min(line_no) AS start, max(line_no) AS "end" FROM c GROUP BY path, g""",
    ),
    "g8_content_samples": (
        lambda s, d: content_samples_query(s, d),
        f"""WITH {FILES}, n AS (SELECT *, greatest(80, CAST(floor(16000 / count(*) OVER (PARTITION BY repo)) AS BIGINT)) AS share, length(source) AS n FROM files)
        SELECT repo, path, CASE WHEN n <= share THEN source ELSE substring(source, 1, share // 3) || chr(10) || substring(source, (n - share // 3) // 2 + 1, share // 3) || chr(10) || substring(source, n - share // 3 + 1, share // 3) END AS sample FROM n""",
    ),
    "a16_longest_comment_run": (
        lambda s, d: S.longest_comment_run(lines(s, d), _MARK),
        f"""WITH {_LINES}, k AS (SELECT path, regexp_matches(line, '{_MARK}') AS c, sum(CASE WHEN regexp_matches(line, '{_MARK}') OR regexp_matches(line, '^\\s*$') THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM lines),
        p AS (SELECT path, run, count(*) FILTER (c) AS n FROM k GROUP BY path, run) SELECT path, max(n) AS longest FROM p GROUP BY path""",
    ),
    "w7_nonblank_prefix": (
        lambda s, d: S.nonblank_prefix(lines(s, d)).select("path", "line_no", "nonblank"),
        f"WITH {_LINES} SELECT path, line_no, CAST(sum(CASE WHEN regexp_matches(line, '\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nonblank FROM lines",
    ),
    "u1_type_set": (
        _events(lambda: F.array_join(V.type_set(F.array(F.col("event_type"), F.lit("code"), F.lit("docs"), F.lit("code")), F.array(F.lit("error"), F.lit("docs"))), ",").alias("types")),
        "SELECT event_id, array_to_string(list_sort(list_filter(list_distinct([event_type, 'code']), lambda x: x <> 'error')), ',') AS types FROM events",
    ),
}


def content_samples_query(spark, sf_dir):
    """Start, middle and end of each file, in a share of 16,000 characters for a repository, 80 at least."""
    from ..operators.units import content_samples

    return content_samples(files(spark, sf_dir))
