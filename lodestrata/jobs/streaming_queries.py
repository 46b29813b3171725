"""Streaming jobs over the given tables, run to the end of what is there, as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from ..streaming import jobs as J
from ..streaming.stateful import use_state_store


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}[.]parquet")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """What the stream gives until its source is read to the end, written as Parquet; in update mode each key's last row counts."""
    spark = df.sparkSession
    use_state_store(spark)
    out = f"{scratch_path(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("epoch")


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in df.columns if c not in (*keys, "_epoch")]
    return df.groupBy(*keys).agg(*[F.max_by(c, "_epoch").alias(c) for c in values])


def _events(s, d):
    return _stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def t1(s, d):
    return _last(drained(J.stream_progress(_stream(s, d, "documents").select(F.octet_length("text").alias("bytes"))), "complete"), []).select("files", "bytes")


def t2(s, d):
    rows = _events(s, d).select(F.col("event_type").alias("repo"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("version"), "ts", (F.col("value") > 10).cast("string").alias("content_hash"))
    return _last(drained(J.stream_changes(rows), "update"), ["repo", "path", "version"])


def t3(s, d):
    return _last(drained(J.stream_rate(_events(s, d).withColumn("value", (F.col("value") * 100).cast("long")), "1 hour", "1 hour"), "complete"), ["start"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def t5(s, d):
    """How many events of each id come through; one, if repeats are dropped."""
    rows = drained(J.stream_dedupe(_events(s, d).withColumn("generation_id", F.col("user_id") % 100), "generation_id", "400 days"), "append")
    return rows.groupBy("generation_id").agg(F.count("*").alias("n"))


def t6(s, d):
    e = _events(s, d)
    own = e.select(F.col("user_id").alias("attempt"), "event_id", "ts", (F.col("event_type") == "view").alias("retrieval"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("delta"))
    return _last(drained(J.stream_work_clock(own), "update"), ["attempt"])


def t7(s, d):
    """Answers in force at the last event's time; some were made days before they arrived, some have a time to come."""
    e = _events(s, d)
    made = F.expr("ts + CASE WHEN event_id % 7 = 0 THEN interval 9 days WHEN event_id % 5 = 0 THEN interval -5 days ELSE interval 0 days END")
    out = _last(drained(J.stream_answers(e.select(F.col("user_id").alias("digest"), F.col("value").alias("probability"), made.alias("created_at"), F.col("ts").alias("arrived_at"))), "update"), ["digest"])
    now = s.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("timestamp")).first()[0]
    return J.answers_in_force(out, F.lit(now)).select("digest", "probability", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "expires_at")])


def t4(s, d):
    e = _events(s, d)
    starts = e.filter("event_type = 'click'").select(F.col("user_id").alias("request_id"), "ts")
    ends = e.filter("event_type = 'view'").select(F.col("user_id").alias("request_id"), "ts")
    return drained(J.stream_match(starts, ends, "1 hour", "6 hours"), "append").select("request_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"))


QUERIES = {
    "t1_stream_progress": (t1, "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents"),
    "t2_stream_changes": (
        t2,
        """WITH e AS (SELECT event_type AS repo, CAST(user_id AS VARCHAR) AS path, event_id AS version, ts, value > 10 AS h FROM events), w AS (SELECT *, lag(h) OVER (PARTITION BY repo, path ORDER BY ts, version) AS b FROM e)
        SELECT repo, path, version, CASE WHEN b IS NULL THEN 'new' WHEN b = h THEN 'same' ELSE 'changed' END AS state FROM w""",
    ),
    "t3_stream_rate": (t3, "SELECT date_trunc('hour', ts) AS start, count(*) AS requests, CAST(sum(CAST(trunc(value * 100) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1"),
    "t4_stream_match": (
        t4,
        # an unfinished start is told once no end in time can come any more
        """WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), j AS (SELECT s.user_id, s.ts, e.ts AS ended FROM s LEFT JOIN e ON s.user_id = e.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 6 HOUR)
        SELECT user_id AS request_id, ts AS started, ended FROM j WHERE ended IS NOT NULL OR ts + INTERVAL 6 HOUR < least((SELECT max(ts) FROM s), (SELECT max(ts) FROM e)) - INTERVAL 1 HOUR""",
    ),
    "t5_stream_dedupe": (t5, "SELECT user_id % 100 AS generation_id, 1 AS n FROM events GROUP BY 1"),
    "t6_stream_work_clock": (
        t6,
        """WITH e AS (SELECT user_id, event_id, ts, event_type = 'view' AS r, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events),
        s AS (SELECT user_id, sum(CASE WHEN r THEN d ELSE 0 END) OVER w AS r, sum(CASE WHEN r THEN 0 ELSE d END) OVER w AS o, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
        SELECT user_id AS attempt, CAST(coalesce(sum(us) FILTER (r > 0 AND o <= 0), 0) AS BIGINT) AS credited_micros, CAST(coalesce(sum(us) FILTER (NOT (r > 0 AND o <= 0)), 0) AS BIGINT) AS work_micros FROM s GROUP BY 1""",
    ),
    "t7_stream_answers": (
        t7,
        """WITH a AS (SELECT user_id AS digest, value AS probability, ts, ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 9 DAY WHEN event_id % 5 = 0 THEN INTERVAL '-5' DAY ELSE INTERVAL 0 DAY END AS created_at FROM events),
        r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY ts DESC, created_at DESC, probability DESC) AS n FROM a), now AS (SELECT max(ts) AS t FROM events)
        SELECT digest, probability, created_at, created_at + INTERVAL 7 DAY AS expires_at FROM r, now WHERE n = 1 AND created_at <= t AND t < created_at + INTERVAL 7 DAY""",
    ),
}
