"""Discovery by waves: a directory tree is scored two levels at a time, and only what is admitted is gone into."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, dirname
from ..sources.scratch import written


@dataclass(frozen=True)
class Limits:
    """Fixed values of the traversal: bounds of scores, of a batch, of the budget, and of probes."""

    relevant: float = 0.5
    strong: float = 0.6
    #: Weak scores of a wave from which on they are a flood; positive scores from which on the budget holds.
    many: int = 32
    batch_items: int = 128
    batch_bytes: int = 38_000
    budget_bytes: int = 8_000_000
    probes: int = 4
    probe_bytes: int = 24_000
    final_probe_bytes: int = 1_000_000


class Traversal(NamedTuple):
    #: ``(query_id, wave, path, kind, score, admitted)`` of all items that were scored.
    items: DataFrame
    #: ``(query_id, strong, positives, bytes, probed, confident, stopped)``
    states: DataFrame


STATE = "strong boolean, positives long, bytes long, probed array<string>, confident boolean, stopped boolean, best array<struct<score: double, path: string, confident: boolean>>"


def tree_of(files: DataFrame) -> DataFrame:
    """``(path, kind, bytes, cost)`` of the files ``(path, bytes, cost)`` and of all directories above them; these cost their names."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return files.select("path", F.lit("file").alias("kind"), "bytes", "cost").unionByName(
        dirs.select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("bytes"), F.length("path").cast("long").alias("cost"))
    )


class _Query:
    """One query's state while its items come by in order."""

    def __init__(self, limits: Limits, state: dict | None):
        self.limits = limits
        s = state or {}
        self.strong, self.positives, self.bytes = s.get("strong", False), s.get("positives", 0), s.get("bytes", 0)
        self.probed, self.confident, self.stopped = list(s.get("probed") or []), s.get("confident", False), s.get("stopped", False)
        # the best files for a last probe, one more than can have been probed before
        self.best = [(x["score"], x["path"], x["confident"]) for x in s.get("best") or []]

    def state(self) -> dict:
        best = [{"score": a, "path": b, "confident": c} for a, b, c in self.best]
        return {"strong": self.strong, "positives": self.positives, "bytes": self.bytes, "probed": self.probed, "confident": self.confident, "stopped": self.stopped, "best": best}

    def take(self, batch: list[tuple]) -> bool:
        """Whether a batch of ``(path, kind, bytes, cost, score, confident)`` is scored; else the query stops before it."""
        lim, cost = self.limits, sum(x[3] for x in batch)
        if not self.stopped and not self.confident and self.positives >= lim.many and self.bytes + cost > lim.budget_bytes:
            for _, path, sure in self.best:
                if path not in self.probed:
                    self.probed.append(path)
                    self.confident = sure
                    break
            self.stopped = not self.confident
        if self.stopped:
            return False
        self.bytes += cost
        for path, kind, size, _, score, sure in batch:
            self.strong |= score >= lim.strong
            self.positives += score > lim.relevant
            if kind == "file" and score >= lim.strong and size <= lim.final_probe_bytes:
                self.best.append((score, path, sure))
        self.best = heapq.nsmallest(lim.probes + 2, set(self.best), key=lambda x: (-x[0], x[1]))
        if not self.confident and len(self.probed) < lim.probes:
            for path, kind, size, _, score, sure in batch:
                if kind == "file" and score >= lim.strong and size <= lim.probe_bytes and path not in self.probed:
                    self.probed.append(path)
                    self.confident = sure
                    break
        return True


def _scored(items: DataFrame, states: DataFrame | None, limits: Limits) -> DataFrame:
    """The wave's items that are scored, and a row ``kind = 'state'`` for each query.

    The budget, the probes and the positive scores depend on all batches before, so a query's ids, sizes and scores are
    read in order as they come; a batch is in memory at a time.
    """
    kind = items.schema["query_id"].dataType.simpleString()
    rows = items.select("query_id", "level", "path", "kind", "bytes", "cost", "score", "confident", F.lit(None).cast(f"struct<{STATE}>").alias("state"))
    if states is not None:
        rows = rows.unionByName(states.select("query_id", F.lit(-1).alias("level"), "state"), allowMissingColumns=True)
    columns = ["query_id", "path", "kind", "score", "state"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, query, batch, cost, out = None, None, [], 0, []

        def close() -> None:
            nonlocal batch, cost
            if batch and query.take(batch):
                out.extend((at, x[0], x[1], x[4], None) for x in batch)
            batch, cost = [], 0

        def made() -> pa.RecordBatch:
            values = list(zip(*out)) or [[]] * len(columns)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(values, types)], columns)

        types = None
        for part in batches:
            types = [part.schema.field(c).type for c in columns]
            for query_id, level, *item, state in zip(*[c.to_pylist() for c in part.columns]):
                if query is None or query_id != at:
                    if query is not None:
                        close()
                        out.append((at, None, "state", None, query.state()))
                    at, query = query_id, _Query(limits, state)
                if level < 0:
                    continue
                if batch and (len(batch) == limits.batch_items or cost + item[3] > limits.batch_bytes):
                    close()
                batch.append(tuple(item))
                cost += item[3]
            yield made()
        if query is not None:
            close()
            out.append((at, None, "state", None, query.state()))
            yield made()

    state = rows.schema["state"].dataType.simpleString()
    ordered = rows.repartition("query_id").sortWithinPartitions("query_id", "level", "path")
    return ordered.mapInArrow(run, f"query_id {kind}, path string, kind string, score double, state {state}")


def traverse(entries: DataFrame, scores: DataFrame, confident: DataFrame, seeds: DataFrame, limits: Limits = Limits()) -> Traversal:
    """Walk the tree ``entries(path, kind, bytes, cost)`` for each query from its ``seeds(query_id, path)``; the root is ``.``.

    A wave lists the directories that were admitted (or the seeds) and the directories in them, which aren't scored; its
    items are the files of both and the directories of the second. ``scores(query_id, path, score)`` has their scores
    (without one: 0), ``confident(query_id, path)`` the files whose probe finds a confident source. Items come in order of
    level and path, in batches.

    * What scores over ``relevant`` is admitted; if ``many`` or more of a wave are under ``strong`` and no score of the
      query has been ``strong`` yet, only what is.
    * After a batch its first small file with a strong score is probed, up to ``probes`` files; a confident one ends that.
    * Once ``many`` scores were over ``relevant`` and no source was confident, a batch that would pass the budget is
      only scored if a last probe, of the best file so far, is confident; else the query stops there.
    * A directory is listed once for each query.

    Waves are tables in the shared folder; between them a query has one row of state. Queries without items have no state.
    """
    tree = entries.withColumn("parent", dirname(F.col("path")))
    marks = confident.select("query_id", "path").distinct().withColumn("confident", F.lit(True))
    frontier, seen, states, wave, found = seeds.select("query_id", F.col("path").alias("parent")).distinct(), None, None, 0, []
    while True:
        if seen is not None:
            frontier = frontier.join(seen, ["query_id", "parent"], "left_anti")
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            break
        first = frontier.join(tree, "parent").select("query_id", F.lit(0).alias("level"), "path", "kind", "bytes", "cost")
        inner = first.filter("kind = 'directory'").select("query_id", F.col("path").alias("parent"))
        seen = frontier if seen is None else seen.unionByName(frontier)
        inner = written(inner.distinct().join(seen, ["query_id", "parent"], "left_anti"), "inner")
        second = inner.join(tree, "parent").select("query_id", F.lit(1).alias("level"), "path", "kind", "bytes", "cost")
        items = first.filter("kind = 'file'").unionByName(second)
        items = items.join(scores.groupBy("query_id", "path").agg(F.max("score").alias("score")), ["query_id", "path"], "left").join(marks, ["query_id", "path"], "left")
        items = items.withColumns({"score": F.coalesce("score", F.lit(0.0)), "confident": F.coalesce("confident", F.lit(False))})
        told = written(_scored(items, states, limits), "wave")
        now = told.filter("kind = 'state'").select("query_id", "state")
        scored = told.filter("kind <> 'state'").select("query_id", "path", "kind", "score")
        s = F.col("score")
        weak = scored.groupBy("query_id").agg(F.count_if((s > limits.relevant) & (s < limits.strong)).alias("weak"))
        flood = weak.join(now, "query_id").select("query_id", ((F.col("weak") >= limits.many) & ~F.col("state.strong")).alias("flood"), F.col("state.stopped").alias("stopped"))
        judged = written(scored.join(flood, "query_id").select("query_id", F.lit(wave).alias("wave"), "path", "kind", "score", ((s >= limits.strong) | ((s > limits.relevant) & ~F.col("flood"))).alias("admitted"), "stopped"), "judged")
        found.append(judged.drop("stopped"))
        seen = seen.unionByName(inner)
        frontier = judged.filter("kind = 'directory' and admitted and not stopped").select("query_id", F.col("path").alias("parent")).distinct()
        # a query that had no items in this wave keeps its state
        states = written(now if states is None else now.unionByName(states.join(now, "query_id", "left_anti")), "states")
        wave += 1
    if not found:
        kind = seeds.schema["query_id"].dataType.simpleString()
        spark = seeds.sparkSession
        return Traversal(spark.createDataFrame([], f"query_id {kind}, wave int, path string, kind string, score double, admitted boolean"), spark.createDataFrame([], f"query_id {kind}, {STATE}").drop("best"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return Traversal(out, states.select("query_id", "state.*").drop("best"))
