"""Changes of many files in few groups of state: whatever the order, with nulls, and settled behind the watermark."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.jobs.streaming_queries import _last
from lodestrata.streaming import jobs as J
from lodestrata.streaming.stateful import use_state_store

from .test_streaming_state import START, shuffled, streamed

SCHEMA = "repo string, path string, version long, ts timestamp, content_hash string"


def run(spark, tmp_path, stream, **how):
    use_state_store(spark)

    def put(batch, epoch):
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={epoch}")

    query = J.stream_changes(stream, **how).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").drop("epoch"), [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]


def test_state_is_kept_by_bucket(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in range(1200):
        at = None if k % 97 == 5 else START + dt.timedelta(hours=rng.randrange(100))
        rows.append((rng.choice(["r", "s", None]), rng.choice([None, *(f"p{i}" for i in range(80))]), k, at, rng.choice(["x", "y", None])))
    rows += [(*rows[7][:2], None, rows[7][3], "z")]
    out, states = run(spark, tmp_path, streamed(spark, tmp_path, shuffled(rows, rng), SCHEMA), watermark="10 days", buckets=4)
    got = {(r.repo, r.path, r.version): r.state for r in _last(out, ["repo", "path", "version"]).collect()}
    want, before = {}, {}
    for repo, path, version, _, digest in sorted(rows, key=lambda x: (x[3] or dt.datetime.max, 10**9 if x[2] is None else x[2], x[4] or "")):
        key = (repo, path)
        want[*key, version] = "new" if key not in before else "same" if before[key] == digest else "changed"
        before[key] = digest
    assert len(before) > 200 and got == want
    # a value and a timer, which has an index, for each bucket
    assert 0 < max(s["numRowsTotal"] for s in states) <= 12


def test_a_quiet_bucket_settles(spark, tmp_path):
    day = dt.timedelta(days=1)
    # the first file is behind the watermark of the second; then "a" goes on from what was settled
    files = [[("r", f"a{k}", k, START, "x") for k in range(30)], [("r", "b", 100, START + 9 * day, "x")], [("r", "b", 101, START + 9 * day, "x")], [("r", f"a{k}", 200 + k, START + 10 * day, "xy"[k % 2]) for k in range(30)]]
    out, _ = run(spark, tmp_path, streamed(spark, tmp_path, files, SCHEMA), watermark="1 day", buckets=1000)
    got = [(r.path, r.version, r.state) for r in out.collect()]
    assert sorted(x for x in got if x[0] != "b") == sorted([(f"a{k}", k, "new") for k in range(30)] + [(f"a{k}", 200 + k, "changed" if k % 2 else "same") for k in range(30)])


def test_only_keys_with_new_rows_are_told(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    files = [[("r", "a", 1, START, "x"), ("r", "b", 2, START, "x")], [("r", "b", 3, START + hour, "y")], [("r", "b", 4, START + hour, "y"), ("r", "c", 5, START, "x")]]
    out, _ = run(spark, tmp_path, streamed(spark, tmp_path, files, SCHEMA), watermark="10 days", buckets=1)
    got = sorted((r._epoch, r.path, r.version, r.state) for r in out.collect())
    b = [("b", 2, "new"), ("b", 3, "changed"), ("b", 4, "same")]
    assert got == sorted([(0, "a", 1, "new"), (0, *b[0]), *[(1, *x) for x in b[:2]], *[(2, *x) for x in b], (2, "c", 5, "new")])
