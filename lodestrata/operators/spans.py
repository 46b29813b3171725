"""Arithmetic over half-open spans ``(start, end)`` and inclusive line ranges, always within equality keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def span_islands(spans: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Adds ``island``: a new one begins where a start lies more than ``gap`` beyond all ends before it.

    A span whose end is null comes after the others of its start and reaches no further; one without a start is an island of its own.
    """
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col("start") <= before + gap, 0).otherwise(1)
    return spans.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_spans(spans: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Overlapping or touching spans as one; with ``gap`` 1, adjacent inclusive ranges too."""
    return span_islands(spans, keys, gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    return left.join(other, keys)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], block: int = 64) -> DataFrame:
    """Pairs that overlap; the right side's columns get the prefix ``r_``.

    Spans meet in blocks of ``block`` lines, not as all pairs of a key: a span has a row in each block that it
    touches, and a pair counts in the first block that both touch. Rows with a null key, start or end have no pair.
    """
    def blocks(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("start") / block), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / block)
        return df.withColumn("_first", first).withColumn("_block", F.explode(F.sequence(first, last)))

    both = _sides(blocks(left), blocks(right), [*keys, "_block"]).filter(F.col("_block") == F.greatest("_first", "r__first"))
    return both.filter((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))).drop("_block", "_first", "r__first")


def intersect_spans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair's common part, in place of ``start`` and ``end``."""
    both = overlap_join(left, right, keys)
    return both.withColumns({"start": F.greatest("start", "r_start"), "end": F.least("end", "r_end")}).drop("r_start", "r_end")


def contained_in(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """The inner spans that lie within an outer one.

    A sweep by start over both sides: an inner span is contained if the largest end of the outer ones that began by then
    reaches its own. No pairs are made; a key's spans are sorted once. Null keys, starts and ends are in nothing.
    """
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    row = F.struct(*[F.col(c) for c in inner.columns])
    sides = inner.filter(known).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.lit(1).alias("_own"), F.lit(None).cast("long").alias("_e"), row.alias("_row")).unionByName(
        outer.filter(known).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.lit(0).alias("_own"), F.col("end").cast("long").alias("_e")), allowMissingColumns=True
    )
    w = W.partitionBy(*[f"_{k}" for k in keys]).orderBy("_s", "_own").rowsBetween(W.unboundedPreceding, 0)
    swept = sides.withColumn("_reach", F.max("_e").over(w))
    return swept.filter((F.col("_own") == 1) & (F.col("_reach") >= F.col("_row")["end"])).select("_row.*")


def subtract_spans(selected: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of merged ``selected`` outside ``rejected``: the gaps between rejected parts.

    A sweep over ends: each start adds one to its side's cover, each end takes one away; what is left is where ``selected``
    covers and ``rejected`` doesn't. Ends at one place are summed first; no pairs are made. Empty spans and null ends cover nothing.
    """
    def ends(df: DataFrame, side: str, other: str) -> DataFrame:
        steps = F.explode(F.array(F.struct(F.col("start").alias("x"), F.lit(1).alias("n")), F.struct(F.col("end").alias("x"), F.lit(-1).alias("n"))))
        return df.filter("start < end").select(*keys, steps.alias("p")).select(*keys, F.col("p.x").alias("x"), F.col("p.n").alias(side), F.lit(0).alias(other))

    both = ends(selected, "own", "cut").unionByName(ends(rejected, "cut", "own"))
    places = both.groupBy(*keys, "x").agg(F.sum("own").alias("own"), F.sum("cut").alias("cut"))
    w = W.partitionBy(*keys).orderBy("x")
    up_to = w.rowsBetween(W.unboundedPreceding, 0)
    shown = places.select(*keys, "x", ((F.sum("own").over(up_to) > 0) & (F.sum("cut").over(up_to) == 0)).alias("on"))
    turns = shown.withColumn("was", F.lag("on", 1, False).over(w)).filter("on <> was")
    return turns.withColumn("end", F.lead("x").over(w)).filter("on").select(*keys, F.col("x").alias("start"), "end")


def subtract_lines(ranges: DataFrame, removed: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Inclusive line ranges without the removed lines, unless a kept range covers them."""
    def half(df: DataFrame) -> DataFrame:
        return df.select(*keys, "start", (F.col("end") + 1).alias("end"))

    gone = subtract_spans(half(removed), half(kept), keys)
    return subtract_spans(half(ranges), gone, keys).withColumn("end", F.col("end") - 1)


def merge_decisions(previous: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One decision for each key; a new one replaces the old."""
    both = previous.withColumn("_g", F.lit(0)).unionByName(current.withColumn("_g", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(value, "_g").alias(value))


def dedupe_leads(leads: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Repeated leads collapse; the last by ``order`` stays."""
    return leads.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def line_index(files: DataFrame, key: str = "path") -> DataFrame:
    """``(key, line_no, line, n_bytes, byte_start)`` of every line; only LF ends a line, and a last LF gives an empty line."""
    names = [key, "line_no", "line", "n_bytes", "byte_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                lines = pc.split_pattern(part.column(1), "\n")
                row, line = pc.list_parent_indices(lines), pc.list_flatten(lines)
                size = pc.binary_length(line).to_numpy().astype(np.int64)
                first = np.searchsorted(row.to_numpy(), np.arange(part.num_rows))[row.to_numpy()]
                start = np.cumsum(size + 1) - (size + 1)
                number = np.arange(len(size)) - first + 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), pa.array(number.astype(np.int32)), line, pa.array(size), pa.array(start - start[first])], names)

    kind = files.schema[key].dataType.simpleString()
    # offsets are sums within a row, so nothing is exchanged
    return files.select(key, F.col("source").cast("string")).mapInArrow(run, f"{key} {kind}, line_no int, line string, n_bytes long, byte_start long")


def nonblank_prefix(lines: DataFrame, key: str = "path") -> DataFrame:
    """Adds ``nonblank``, the lines with more than white space up to each."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("nonblank", F.sum(F.col("line").rlike(r"\S").cast("long")).over(w))


def block_units(units: DataFrame, lines: int = 16) -> DataFrame:
    """Units of ``(start_line, end_line)`` as blocks of ``lines`` lines under the same name."""
    starts = F.explode(F.sequence("start_line", "end_line", F.lit(lines)))
    out = units.withColumn("_s", starts)
    return out.withColumns({"start_line": F.col("_s"), "end_line": F.least(F.col("_s") + lines - 1, F.col("end_line"))}).drop("_s")


def comment_ranges(lines: DataFrame, marker: str = r"^\s*#", key: str = "path") -> DataFrame:
    """Runs of whole-line comments, as inclusive ``(start, end)``."""
    own = lines.filter(F.col("line").rlike(marker)).select(key, F.col("line_no").alias("start"), F.col("line_no").alias("end"))
    return merge_spans(own, [key], gap=1)


def longest_comment_run(lines: DataFrame, marker: str = r"^\s*#", key: str = "path") -> DataFrame:
    """The most comment lines in a run; blank lines do not break one."""
    w = W.partitionBy(key).orderBy("line_no")
    kind = F.when(F.col("line").rlike(marker), 1).when(F.col("line").rlike(r"^\s*$"), 0).otherwise(-1)
    runs = lines.withColumn("_k", kind).withColumn("_run", F.sum(F.when(F.col("_k") == -1, 1).otherwise(0)).over(w))
    per = runs.groupBy(key, "_run").agg(F.sum((F.col("_k") == 1).cast("long")).alias("n"))
    return per.groupBy(key).agg(F.max("n").alias("longest"))


def neighbor_members(units: DataFrame, keys: list[str], max_lines: int = 40, owners: DataFrame | None = None) -> DataFrame:
    """For each selected member, its siblings before and after by start line, if they are short enough.

    With ``owners(*keys, owner_start)`` also ``header_start`` and ``header_end``: the lines of the class from its start to
    before its first member, ``max_lines`` at most; null where there are none.
    """
    w = W.partitionBy(*keys).orderBy("start_line", "name")

    def near(f):
        n = f("end_line").over(w) - f("start_line").over(w) + 1
        return F.when(n <= max_lines, f("name").over(w))

    out = units.withColumn("before", near(F.lag)).withColumn("after", near(F.lead))
    if owners is None:
        return out.filter("selected").select(*keys, "name", "before", "after")
    out = out.withColumn("_first", F.min("start_line").over(W.partitionBy(*keys))).filter("selected").join(owners, keys, "left")
    end = F.least(F.col("_first") - 1, F.col("owner_start") + max_lines - 1)
    there = F.col("owner_start") <= end
    return out.select(*keys, "name", "before", "after", F.when(there, F.col("owner_start")).alias("header_start"), F.when(there, end).alias("header_end"))


def context_windows(ranges: DataFrame, comments: DataFrame, totals: DataFrame, keys: list[str], pad: int = 3, nonblank: DataFrame | None = None) -> DataFrame:
    """Ranges widened by ``pad`` lines within the file, each with the comments that overlap or border it, until none does.

    A comment also borders what only blank lines part it from, if ``nonblank(*keys, line_no, nonblank)`` (see
    :func:`nonblank_prefix`) tells which are; without it no line is blank. Windows that overlap or touch are one; blank lines
    alone don't join two windows. Comments begin and end on lines that aren't blank.

    In numbers of lines that aren't blank, bordering across blank lines is plain adjacency, so that one pass over the spans
    of a key in order gives the closure: a span goes on with those before it if it overlaps or touches them, or is next to
    their end and it, or what reaches that end, is a comment.
    """
    wide = ranges.join(totals, keys).select(
        *keys, F.greatest(F.col("start") - pad, F.lit(1)).cast("long").alias("start"), F.least(F.col("end") + pad, F.col("n_lines")).cast("long").alias("end"), F.lit(1).alias("own")
    )
    both = wide.unionByName(comments.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(0).alias("own")))
    if nonblank is None:
        both = both.withColumns({"_from": F.col("start"), "_to": F.col("end")})
    else:
        n = nonblank.select(*keys, F.col("line_no").cast("long").alias("_line"), F.col("nonblank").alias("_n"))
        both = both.withColumn("_line", F.col("start") - 1).join(n, [*keys, "_line"], "left").withColumn("_from", F.coalesce("_n", F.lit(0)) + 1).drop("_n", "_line")
        both = both.withColumn("_line", F.col("end")).join(n, [*keys, "_line"], "left").withColumn("_to", F.coalesce("_n", F.col("_from") - 1)).drop("_n", "_line")
    w = W.partitionBy(*keys).orderBy("start", "end", "own")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    reach = {"_line_end": F.max("end"), "_end": F.max("_to"), "_comment_end": F.max(F.when(F.col("own") == 0, F.col("_to")))}
    next_comment = F.min(F.when(F.col("own") == 0, F.col("_from"))).over(w.rowsBetween(1, W.unboundedFollowing))
    spans = both.select("*", *[f.over(before).alias(c) for c, f in reach.items()], next_comment.alias("_next"))
    # a window whose first line that isn't blank begins a comment lies within what that comment joins
    led = F.coalesce(F.col("_next") == F.col("_from"), F.lit(False))
    beside = F.when((F.col("own") == 0) | led, F.col("_end")).otherwise(F.coalesce(F.col("_comment_end"), F.lit(-1)))
    joins = (F.col("start") <= F.col("_line_end") + 1) | (F.col("_from") <= beside + 1)
    islands = spans.withColumn("island", F.sum(F.when(joins, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("own").alias("own"))
    return merged.filter("own = 1").drop("island", "own")


def valid_ranges(spans: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``valid``: 1 <= start <= end <= lines, false for an unknown file."""
    ok = (F.col("start") >= 1) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("n_lines"))
    return spans.join(totals, keys, "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("n_lines")


def valid_spans(spans: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Adds ``valid`` to spans ``(key, start_line, end_line, byte_start, byte_end, text, partial)`` of ``files(key, source)``.

    1 <= start <= end <= lines, 0 <= byte start <= byte end <= bytes, the source's bytes between are the text's, and the text
    is the lines' own, or lies within them if ``partial``. False for an unknown file and for nulls.
    """
    raw, lines = F.col("_source").cast("binary"), F.split("_source", "\n")
    first, last, start, end = (F.col(c) for c in ("start_line", "end_line", "byte_start", "byte_end"))
    placed = (first >= 1) & (first <= last) & (last <= F.size(lines)) & (start >= 0) & (start <= end) & (end <= F.length(raw))
    own = F.array_join(F.slice(lines, F.when(placed, first).otherwise(1), F.when(placed, last - first + 1).otherwise(0)), "\n")
    told = F.when(F.col("partial"), F.contains(own, F.col("text"))).otherwise(own == F.col("text"))
    sliced = raw.substr((start + 1).cast("int"), (end - start).cast("int")) == F.col("text").cast("binary")
    joined = spans.join(files.select(key, F.col("source").alias("_source")), key, "left")
    return joined.withColumn("valid", F.coalesce(placed & sliced & told, F.lit(False))).drop("_source")
