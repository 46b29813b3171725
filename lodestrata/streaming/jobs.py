"""Incremental forms of the batch operators, as Structured Streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateful import END_OF_LONG, Expiring, InOrder, Successions


def stream_progress(files: DataFrame) -> DataFrame:
    """Files and bytes so far; update or complete mode."""
    return files.groupBy().agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def stream_rate(events: DataFrame, window: str = "1 second", watermark: str = "10 seconds", tokens: str = "value") -> DataFrame:
    """Requests and tokens in tumbling windows; late events within the watermark count."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))
        .select(F.col("w.start").alias("start"), "requests", "tokens")
    )


def stream_dedupe(events: DataFrame, key: str = "generation_id", watermark: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def stream_match(starts: DataFrame, ends: DataFrame, watermark: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """``(request_id, started, ended)``: starts with the end that comes in time; ``ended`` is null where none does."""
    s = starts.select("request_id", F.col("ts").alias("started")).withWatermark("started", watermark)
    e = ends.select(F.col("request_id").alias("_id"), F.col("ts").alias("ended")).withWatermark("ended", watermark)
    near = (F.col("request_id") == F.col("_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return s.join(e, near, "left_outer").drop("_id")


def stream_changes(snapshots: DataFrame, watermark: str = "1 day", buckets: int = 1024) -> DataFrame:
    """``(repo, path, version, state)``: ``new``, ``changed`` or ``same`` by the hash of the version before.

    ``snapshots(repo, path, version, ts, content_hash)``, in any order within the watermark of ``ts``; versions are in order
    of time, then of their number. Rows without a time come last. Update mode: of a version told again the last row counts.

    State is kept for ``buckets`` groups of files rather than for each file; a checkpoint keeps to their number.
    """
    last = F.lit(END_OF_LONG)
    rows = snapshots.select(
        F.col("repo").cast("string").alias("repo"), F.col("path").cast("string").alias("path"), F.coalesce(F.col("version").cast("long"), last).alias("version"), F.col("content_hash").alias("digest"),
        "ts", F.coalesce(F.unix_micros("ts"), last).alias("at_us"),
    ).withWatermark("ts", watermark)
    groups = rows.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)).cast("int")).groupBy("bucket")
    told = groups.transformWithStateInPandas(Successions(), "repo string, path string, version long, state string", "update", "eventTime")
    return told.withColumn("version", F.nullif("version", last))


def stream_work_clock(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """``(attempt, credited_micros, work_micros)`` so far, by events in order of time, in whatever order they come within the watermark.

    ``events(attempt, event_id, ts, retrieval, delta)``; the state is two numbers of active commands, the last time and two
    sums, and the events that are later than the watermark. Update mode: of an attempt's rows the last counts.
    """

    def fold(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        r, o, last, credited, work = state
        at, _, retrieval, delta = row
        if last is not None:
            if r > 0 and o <= 0:
                credited += at - last
            else:
                work += at - last
        state = (r + delta, o, at, credited, work) if retrieval else (r, o + delta, at, credited, work)
        return state, (credited, work)

    def tell(key: tuple, results: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in results[-1:]], columns=["attempt", "credited_micros", "work_micros"], dtype=object)

    rows = events.select("attempt", F.col("event_id").cast("long").alias("event_id"), "ts", "retrieval", F.col("delta").cast("long").alias("delta"), F.unix_micros("ts").alias("at_us")).withWatermark("ts", watermark)
    processor = InOrder(["at_us", "event_id", "retrieval", "delta"], "us long, event_id long, retrieval boolean, delta long", "r long, o long, last long, credited long, work long", (0, 0, None, 0, 0), fold, tell)
    return rows.groupBy("attempt").transformWithStateInPandas(processor, "attempt long, credited_micros long, work_micros long", "update", "eventTime")


def stream_answers(answers: DataFrame, ttl_days: float = 7, watermark: str = "7 days") -> DataFrame:
    """``(digest, probability, created_at, expires_at)``: the newest answer of each digest, and a row without one once it is over.

    ``answers(digest, probability, created_at, arrived_at)``. The answer that arrives last counts; it ends ``ttl_days`` after
    its own creation, whenever that was. Arrivals later than the watermark are dropped, by default those whose answer was
    over anyway. Update mode: of a digest's rows the last counts; read them with :func:`answers_in_force`.
    """
    ttl_us = int(ttl_days * 86_400_000_000)
    rows = answers.select("digest", "probability", "arrived_at", F.unix_micros("arrived_at").alias("arrived_us"), F.unix_micros("created_at").alias("created_us")).withWatermark("arrived_at", watermark)
    kind = answers.schema["digest"].dataType.simpleString()
    processor = Expiring(["arrived_us", "created_us", "probability"], "double", ttl_us)
    out = rows.groupBy("digest").transformWithStateInPandas(processor, f"key {kind}, arrived long, created long, value double, ends long", "update", "eventTime")
    return out.select(F.col("key").alias("digest"), F.col("value").alias("probability"), F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("ends").alias("expires_at"))


def answers_in_force(told: DataFrame, now: Column) -> DataFrame:
    """The answers that a reader at ``now`` may use: not over, and not from the future; others miss."""
    return told.filter(F.col("probability").isNotNull() & (F.col("created_at") <= now) & (now < F.col("expires_at")))
