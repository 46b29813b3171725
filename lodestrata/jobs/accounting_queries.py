"""Queries on logs, costs and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import accounting as A
from .mapping import ATTEMPTS, attempts, table


def _events(s, d, kind=None):
    e = table(s, d, "events")
    return e.filter(f"event_type = '{kind}'") if kind else e


_LATEST = f"{ATTEMPTS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY \"at\" DESC, attempt DESC) AS n FROM attempts WHERE resolved AND cost IS NOT NULL) WHERE n = 1)"


def _baselines(s, d):
    rows = attempts(s, d).filter("resolved and cost is not null").withColumn("o", F.struct("at", "attempt"))
    return A.latest_attempt(rows, ["task"], "o").drop("o")


_STATUS = "CASE WHEN arm = '1-URGENT' AND attempt % 37 = 0 THEN 'not-started' WHEN attempt % 3 = 0 THEN 'failed' ELSE 'completed' END"
_GRADED = "NOT (arm = '2-HIGH' AND attempt % 41 = 0)"


def _compared(s, d):
    return A.compare_to_baseline(attempts(s, d), _baselines(s, d)).withColumns({"status": F.expr(_STATUS), "graded": F.expr(_GRADED)})


_COMPARED = f"{_LATEST}, compared AS (SELECT a.*, {_STATUS.replace('arm', 'a.arm').replace('attempt ', 'a.attempt ')} AS status, {_GRADED.replace('arm', 'a.arm').replace('attempt ', 'a.attempt ')} AS graded, b.resolved AS br, b.cost AS bc FROM attempts a LEFT JOIN latest b ON a.task = b.task)"
_SUMMARY = f"""{_COMPARED}, summary AS (SELECT arm, count(*) AS attempts, count(*) FILTER (resolved) AS solved, count(*) FILTER (resolved AND br) AS preserved, count(*) FILTER (resolved AND cost < bc) AS cost_wins,
  bool_and(status IN ('completed', 'failed', 'interrupted')) AS all_terminal, bool_and(status IN ('completed', 'failed', 'interrupted') AND graded) AS all_graded, bool_and(cost IS NOT NULL) AS all_known, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) END AS total_cost, coalesce(sum(cost), 0) AS known_cost FROM compared GROUP BY arm)"""


def _summary(s, d):
    return A.cohort_summary(_compared(s, d), ["arm"])


def _money(df):
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t.startswith("decimal")})


def _logs(s, d):
    """Every event as a request: some started twice, some without an end, a request or a response file, some that failed, broke off or were left early."""
    e, i = _events(s, d), F.col("event_id")
    own = e.select(i.alias("request_id"), F.col("user_id").cast("long").alias("sent"), (F.col("value") * 100).cast("long").alias("kept"))
    again = own.filter("request_id % 29 = 0")
    ends = own.filter("request_id % 31 > 0").select(
        "request_id",
        F.when(F.col("request_id") % 37 == 0, 500).otherwise(200).alias("status"),
        "sent",
        F.when(F.col("request_id") % 41 == 0, F.floor(F.col("kept") / 2)).when(F.col("request_id") % 43 == 0, F.col("kept") + 1).otherwise(F.col("kept")).cast("long").alias("response_bytes"),
        (F.col("request_id") % 47 == 0).alias("incomplete"),
        F.when(F.col("request_id") % 82 == 0, "BrokenPipeError").when(F.col("request_id") % 53 == 0, "TimeoutError").alias("error"),
    )
    requests = own.filter("request_id % 59 > 0").select("request_id", F.col("sent").alias("bytes"))
    responses = own.filter("request_id % 61 > 0").select("request_id", F.col("kept").alias("bytes"))
    return own.select("request_id").unionByName(again.select("request_id")), ends.withColumnRenamed("sent", "request_bytes"), requests, responses


_LOGS = """e AS (SELECT event_id AS i, CAST(trunc(value * 100) AS BIGINT) AS kept FROM events), reconciled AS (SELECT i AS request_id, CASE WHEN i % 29 = 0 THEN 2 ELSE 1 END AS n_starts, CASE WHEN i % 31 > 0 THEN 1 ELSE 0 END AS n_ends,
  CASE WHEN i % 59 > 0 THEN 1 ELSE 0 END AS n_requests, CASE WHEN i % 61 > 0 THEN 1 ELSE 0 END AS n_responses,
  i % 29 > 0 AND i % 31 > 0 AND i % 59 > 0 AND i % 61 > 0 AND i % 37 > 0 AND i % 47 > 0 AND CASE WHEN i % 82 = 0 THEN true WHEN i % 53 = 0 THEN false WHEN i % 41 = 0 THEN kept // 2 = kept ELSE i % 43 > 0 END AS matched FROM e)"""


def j16(s, d):
    e = table(s, d, "part")
    now = e.select(F.concat(F.lit("f"), "p_partkey").alias("path"), (F.col("p_size") * 400).cast("long").alias("tokens"))
    old = e.filter("p_partkey % 3 > 0").select(F.concat(F.lit("f"), F.col("p_partkey") + 1).alias("path"), (F.col("p_size") * 400 - 400).cast("long").alias("tokens"))
    moved = e.filter("p_partkey % 5 = 0").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(F.lit("f"), F.col("p_partkey") + 1).alias("old_path"))
    return A.size_ratchet(now, old, moved)


def w13(s, d):
    answers = _events(s, d).select(F.col("event_id").alias("digest"), F.col("ts").alias("created_at"), (F.col("value") * 500).cast("long").alias("bytes"))
    return A.evict_oldest(answers, 40_000_000)


def w14(s, d):
    e = _events(s, d)
    return A.work_clock(e.select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("retrieval"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta")), ["user_id"])


def w12(s, d):
    log = _events(s, d).select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", V.cooldown_end(F.col("ts"), (F.col("value") * 1000).cast("string"))).alias("end"))
    return A.in_cooldown(log, ["user_id"], "ts", "end").select("event_id", F.col("until").cast("timestamp_ntz").alias("until"), "cooling")


def sketches(s, d):
    """Merged sketches of days beside all events: whether percentiles are near by rank, and distinct users by number."""
    e = _events(s, d)
    daily = A.sketch(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "value", "user_id")
    told = A.read_sketches(A.merge_sketches(daily, ["event_type"]))
    exact = e.join(told.select("event_type", "p50", "p95"), "event_type").groupBy("event_type").agg(
        *[(F.abs(F.avg((F.col("value") <= F.col(c)).cast("double")) - q) < 0.02).alias(f"{c}_near") for c, q in (("p50", 0.5), ("p95", 0.95))], F.count_distinct("user_id").alias("users")
    )
    return told.join(exact, "event_type").select("event_type", "n", "p50_near", "p95_near", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("distinct_near"))


QUERIES = {
    "j13_reconcile_log": (lambda s, d: A.reconcile_log(*_logs(s, d)), f"WITH {_LOGS} SELECT request_id, n_starts, n_ends, n_requests, n_responses, matched FROM reconciled"),
    "j13_log_covered": (lambda s, d: A.log_covered(A.reconcile_log(*_logs(s, d))), f"WITH {_LOGS} SELECT count(*) AS ids, bool_and(matched) AS covered FROM reconciled"),
    "u5_id_coverage": (
        lambda s, d: A.id_coverage(_events(s, d).filter("event_type <> 'view'"), _events(s, d, "view").filter("user_id % 3 > 0"), "user_id"),
        """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT user_id, count(*) AS m FROM events WHERE event_type = 'view' AND user_id % 3 > 0 GROUP BY 1), f AS (SELECT * FROM a FULL JOIN b USING (user_id))
        SELECT count(*) FILTER (n IS NOT NULL AND m IS NOT NULL) AS "both", count(*) FILTER (m IS NULL) AS left_only, count(*) FILTER (n IS NULL) AS right_only, bool_and(coalesce(n = 1 AND m = 1, false)) AS covered FROM f""",
    ),
    "j14_compare_to_baseline": (
        lambda s, d: _money(_compared(s, d)).select("attempt", "task", "cost", "baseline_cost", "saved", "baseline_resolved"),
        f"WITH {_COMPARED} SELECT attempt, task, cost::DOUBLE AS cost, bc::DOUBLE AS baseline_cost, (bc - cost)::DOUBLE AS saved, br AS baseline_resolved FROM compared",
    ),
    "j15_compare_arms": (
        lambda s, d: A.compare_arms(_events(s, d).select((F.col("user_id") % 20).alias("g"), "event_type", "value", F.expr("CASE WHEN user_id % 20 < 8 THEN 'same' WHEN user_id % 20 < 14 THEN event_type END").alias("output")), ["g"], "event_type", "value", "click", "view", "output").withColumn("change", F.round("change", 6)),
        "WITH m AS (SELECT user_id % 20 AS g, median(value) FILTER (event_type = 'click') AS before, median(value) FILTER (event_type = 'view') AS after FROM events GROUP BY 1) SELECT g, before, after, round((after - before) / before, 6) AS change, before IS NOT NULL AND after IS NOT NULL AND g < 8 AS same_output FROM m",
    ),
    "j16_size_ratchet": (
        j16,
        """WITH now AS (SELECT 'f' || p_partkey AS path, CAST(p_size * 400 AS BIGINT) AS tokens FROM part), old AS (SELECT 'f' || (p_partkey + 1) AS origin, CAST(p_size * 400 - 400 AS BIGINT) AS old_tokens FROM part WHERE p_partkey % 3 > 0),
        mv AS (SELECT 'f' || p_partkey AS path, 'f' || (p_partkey + 1) AS old_path FROM part WHERE p_partkey % 5 = 0), c AS (SELECT path, tokens, coalesce(old_path, path) AS origin FROM now LEFT JOIN mv USING (path))
        SELECT path, origin, tokens, old_tokens FROM c LEFT JOIN old USING (origin) WHERE tokens > 8000 AND (old_tokens IS NULL OR tokens > old_tokens)""",
    ),
    "o6_oversized_sources": (
        lambda s, d: A.oversized_sources(table(s, d, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), (F.col("p_size") * 400).alias("tokens"))),
        "SELECT 'f' || p_partkey AS path, p_size * 400 AS tokens FROM part WHERE p_size * 400 > 8000",
    ),
    "a11_sum_or_unknown": (
        lambda s, d: _money(attempts(s, d).groupBy("task").agg(V.sum_or_unknown(F.col("cost")).alias("total"), V.known_sum(F.col("cost")).alias("known"))),
        f"WITH {ATTEMPTS} SELECT task, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost) END::DOUBLE AS total, coalesce(sum(cost), 0)::DOUBLE AS known FROM attempts GROUP BY task",
    ),
    "a12_cohort_summary": (lambda s, d: _money(_summary(s, d)), f"WITH {_SUMMARY} SELECT * REPLACE (total_cost::DOUBLE AS total_cost, known_cost::DOUBLE AS known_cost) FROM summary"),
    "a13_cost_ratios": (
        lambda s, d: A.cost_ratios(_money(attempts(s, d).groupBy("task").agg(F.count("*").alias("attempts"), F.count_if(F.expr("resolved and attempt % 50 > task")).alias("solved"), V.sum_or_unknown(F.col("cost")).alias("total_cost")))).select("task", F.round("per_attempt", 6).alias("per_attempt"), F.round("per_solve", 6).alias("per_solve")),
        f"WITH {ATTEMPTS}, c AS (SELECT task, count(*) AS n, count(*) FILTER (resolved AND attempt % 50 > task) AS m, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(cost)::DOUBLE END AS t FROM attempts GROUP BY 1) SELECT task, round(t / n, 6) AS per_attempt, round(t / nullif(m, 0), 6) AS per_solve FROM c",
    ),
    "a14_median_of_medians": (
        lambda s, d: A.median_of_medians(_events(s, d), ["event_type"], "user_id", "value"),
        "WITH m AS (SELECT event_type, user_id, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, median(m) AS median, count(*) AS samples FROM m GROUP BY 1",
    ),
    "a15_sketch_rollup": (sketches, "SELECT event_type, count(*) AS n, true AS p50_near, true AS p95_near, true AS distinct_near FROM events GROUP BY 1"),
    "a15_latency_percentiles": (
        lambda s, d: A.latency_percentiles(_events(s, d), ["event_type"], "value").withColumns({c: F.round(c, 6) for c in ("p50", "p95")}),
        "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    ),
    "w11_rolling_budget": (
        lambda s, d: A.rolling_budget(_events(s, d).select("event_id", "ts", (F.col("user_id") % 5).alias("w"), "user_id"), ["w"], "ts", "user_id", 3600).select("event_id", "requests_in_window", "tokens_in_window"),
        """SELECT event_id, count(*) OVER o AS requests_in_window, CAST(sum(user_id) OVER o AS BIGINT) AS tokens_in_window FROM events WINDOW o AS (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)""",
    ),
    "w12_in_cooldown": (
        w12,
        """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN ts + to_microseconds(CAST(round(value * 1000 * 1000000) AS BIGINT)) END AS e FROM events), m AS (SELECT event_id, ts, max(e) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM c)
        SELECT event_id, until, coalesce(until > ts, false) AS cooling FROM m""",
    ),
    "w13_evict_oldest": (
        w13,
        """WITH s AS (SELECT event_id AS digest, ts AS created_at, CAST(ceil(CAST(trunc(value * 500) AS BIGINT) / 4096) * 4096 AS BIGINT) AS size FROM events), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY created_at, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(size) OVER () AS t FROM s)
        SELECT digest, created_at, size FROM r WHERE t > 40000000 AND b < t - 35000000""",
    ),
    "w14_work_clock": (
        w14,
        """WITH e AS (SELECT user_id, event_id, ts, event_type = 'view' AS r, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events),
        s AS (SELECT user_id, sum(CASE WHEN r THEN d ELSE 0 END) OVER w AS r, sum(CASE WHEN r THEN 0 ELSE d END) OVER w AS o, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id, CAST(coalesce(sum(us) FILTER (r > 0 AND o <= 0), 0) AS BIGINT) AS credited_micros, CAST(coalesce(sum(us) FILTER (NOT (r > 0 AND o <= 0)), 0) AS BIGINT) AS work_micros FROM s GROUP BY 1""",
    ),
    "w15_latest_attempt": (lambda s, d: _baselines(s, d).select("task", "attempt", "at"), f'WITH {_LATEST} SELECT task, attempt, "at" FROM latest'),
}
