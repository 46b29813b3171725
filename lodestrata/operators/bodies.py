"""Which bodies of tests are shown at first, and which stay behind as leads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evidence import pack_batches
from .spans import contained_in, subtract_lines

KEYS = ["query_id", "path"]


class Bodies(NamedTuple):
    #: ``(query_id, path, name, start, end, batch)``: what is judged, in batches of one request each.
    candidates: DataFrame
    #: ``(query_id, path, start, end)``: what is shown, and what counts as selected, once it is judged.
    shown: DataFrame
    selected: DataFrame


def candidate_bodies(units: DataFrame, selected: DataFrame, shown: DataFrame, max_items: int = 32, max_bytes: int = 64_000) -> DataFrame:
    """Units ``(query_id, path, name, start, end, bytes)`` that lie within a selected range and within a shown one, with their ``batch``.

    Batches of a query go by path and line, within both bounds; a unit over ``max_bytes`` has none and is not judged.
    """
    own = contained_in(contained_in(units, selected, KEYS), shown, KEYS)
    own = own.withColumn("ord", F.struct("path", "start", "end", "name"))
    packed = pack_batches(own, ["query_id"], max_items, max_bytes).filter(~F.col("too_large"))
    return packed.select("query_id", "ord.*", "batch")


def select_bodies(units: DataFrame, selected: DataFrame, shown: DataFrame, answers: DataFrame, nonblank: DataFrame | None = None, relevant: float = 0.5) -> Bodies:
    """Takes the bodies that were judged dispensable out of what is shown and selected.

    Ranges are inclusive lines. ``answers(query_id, path, start, end, score)`` judge the candidates; one that scores over
    ``relevant`` is kept. Lines of the others go, but for those of kept ones. A query changes nothing if no body of its is
    kept, or if an answer is missing or not from 0 to 1. Shown ranges without a line that isn't blank go too, if
    ``nonblank(path, line_no, nonblank)`` (see :func:`nonblank_prefix`) tells them; ranges of changed files that touch are one.
    """
    judged = candidate_bodies(units, selected, shown)
    best = answers.groupBy(*KEYS, "start", "end").agg(F.max("score").alias("score"), F.min("score").alias("_least"))
    sound = F.coalesce((F.col("_least") >= 0) & (F.col("score") <= 1), F.lit(False))
    decided = judged.join(best, [*KEYS, "start", "end"], "left").withColumns({"sound": sound, "keep": F.coalesce(F.col("score") > relevant, F.lit(False))})
    told = decided.groupBy("query_id").agg((F.bool_and("sound") & F.bool_or("keep")).alias("told")).filter("told").select("query_id")
    decided = decided.join(told, "query_id", "left_semi")
    removed, kept = decided.filter("not keep").select(*KEYS, "start", "end"), decided.filter("keep").select(*KEYS, "start", "end")
    changed = removed.select(*KEYS).distinct()

    def rest(ranges: DataFrame) -> DataFrame:
        own = ranges.select(*KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        return subtract_lines(own.join(changed, KEYS, "left_semi"), removed, kept, KEYS)

    def others(ranges: DataFrame) -> DataFrame:
        return ranges.select(*KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).join(changed, KEYS, "left_anti")

    left = rest(shown)
    if nonblank is not None:
        n = nonblank.select("path", F.col("line_no").cast("long").alias("_line"), F.col("nonblank").alias("_n"))
        at = lambda df, line, name: df.join(n.withColumnRenamed("_n", name), (df["path"] == n["path"]) & (line == n["_line"]), "left").select(df["*"], F.coalesce(name, F.lit(0)).alias(name))
        left = at(at(left, F.col("start") - 1, "_before"), F.col("end"), "_upto").filter("_upto > _before").drop("_before", "_upto")
    return Bodies(judged, left.unionByName(others(shown)), rest(selected).unionByName(others(selected)))
