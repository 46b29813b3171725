"""Stateful jobs over files that come in any order, against the same rows in plain Python."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.jobs.streaming_queries import _last, drained
from lodestrata.streaming import jobs as J

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 3, 1)


def streamed(spark, tmp_path, files: list[list[tuple]], schema: str):
    """One batch for each file, in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in/000").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def shuffled(rows: list[tuple], rng: random.Random, n: int = 4) -> list[list[tuple]]:
    rows = rows[:]
    rng.shuffle(rows)
    return [rows[k::n] for k in range(n)]


def test_work_clock_of_shuffled_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k % 3, k, START + dt.timedelta(minutes=rng.randrange(600)), rng.random() < 0.5, rng.choice([1, 1, -1])) for k in range(60)]
    stream = streamed(spark, tmp_path, shuffled(rows, rng), "attempt long, event_id long, ts timestamp, retrieval boolean, delta long")
    got = {r.attempt: (r.credited_micros, r.work_micros) for r in _last(drained(J.stream_work_clock(stream), "update"), ["attempt"]).collect()}
    want = {}
    for a in range(3):
        r = o = credited = work = 0
        last = None
        for _, _, ts, retrieval, delta in sorted((x for x in rows if x[0] == a), key=lambda x: (x[2], x[1])):
            if last is not None:
                spent = (ts - last) // dt.timedelta(microseconds=1)
                credited, work = (credited + spent, work) if r > 0 and o <= 0 else (credited, work + spent)
            r, o, last = (r + delta, o, ts) if retrieval else (r, o + delta, ts)
        want[a] = (credited, work)
    assert got == want


def test_changes_settle_behind_the_watermark(spark, tmp_path):
    rng = random.Random(2)
    rows = [("r", f"p{k % 2}", k, START + k * dt.timedelta(hours=9), rng.choice("xy")) for k in range(40)]
    # late within a day and a half, over several watermarks
    files = [sum(chunk, []) for chunk in zip(*[iter(shuffled(rows[:16], rng) + shuffled(rows[16:28], rng) + shuffled(rows[28:], rng))] * 2)]
    stream = streamed(spark, tmp_path, files, "repo string, path string, version long, ts timestamp, content_hash string")
    out = drained(J.stream_changes(stream, watermark="10 days"), "update")
    got = {(r.path, r.version): r.state for r in _last(out, ["repo", "path", "version"]).collect()}
    want = {}
    for p in ("p0", "p1"):
        before = None
        for _, _, version, _, digest in sorted(x for x in rows if x[1] == p):
            want[p, version] = "new" if before is None else "same" if before == digest else "changed"
            before = digest
    assert got == want
    # what is behind the watermark isn't told again
    assert out.filter("version = 0").count() < len(files)


def test_answers_end_by_their_own_time(spark, tmp_path):
    at = lambda days: START + days * DAY
    files = [
        [("a", 0.1, at(0), at(0)), ("b", 0.2, at(0), at(0)), ("c", 0.3, at(20), at(0)), ("d", 0.4, at(-4), at(0))],
        [("b", 0.5, at(6), at(6)), ("a", 0.0, at(-1), at(-1)), ("e", 0.6, at(9), at(9))],
        [("f", 0.7, at(16), at(16))],
        [("g", 0.8, at(16), at(16))],
    ]
    stream = streamed(spark, tmp_path, files, "digest string, probability double, created_at timestamp, arrived_at timestamp")
    out = _last(drained(J.stream_answers(stream), "update"), ["digest"])
    over = {r.digest for r in out.filter("probability is null").collect()}
    assert over == {"a", "d"}  # the clock is at day 16, the watermark a week behind

    def read(day: float) -> dict:
        return {r.digest: r.probability for r in J.answers_in_force(out, F.lit(at(day))).collect()}

    assert read(16.5) == {"f": 0.7, "g": 0.8}  # e ended at 16, c is from the future
    assert read(15.9) == {"e": 0.6}
    assert read(20) == {"c": 0.3, "f": 0.7, "g": 0.8} and "c" not in read(27)
