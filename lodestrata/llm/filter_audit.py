"""How filters interact: what each one removes in every order, by a depth-first walk over shared survivors."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .common import discard, stored, table, text_or_empty

#: All orders of more filters than this are too many rows for each part.
MOST_FILTERS = 7
SPACES = "\t\n\v\f\r"


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, A, B, C, D, E)``: the language of each document (null: empty) and which of the five filters it fails.

    A: under 100 words; B: under four fifths of its words distinct; C: over a tenth of its code points in A to Z; D: one of
    ``#$%&*|``; E: its text is that of a smaller ``doc_id``. Whole texts count; a null text is empty and fails only A (and E).
    Ids that are null have none smaller or greater, so they don't fail E; of rows that repeat an id none does by the others.

    Smallest ids by digest are combined before the shuffle, and meet the documents again by their id, so that no task gets
    all copies of one text.
    """
    text = text_or_empty()
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    fails = {
        "A": F.col("words") < 100,
        "B": 100 * F.col("distinct") < 80 * F.col("words"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), words.alias("list"))
    rows = rows.select("doc_id", "part", "text", F.size("list").cast("long").alias("words"), F.size(F.array_distinct("list")).cast("long").alias("distinct"))
    rows = rows.select("doc_id", "part", *[c.alias(k) for k, c in fails.items()], F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = stored(rows, "measured")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    is_copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", *fails, is_copy.alias("E"))


def permutation_trie(rows: DataFrame, filters: Mapping[str, Column], part: Column, losses: Mapping[str, Column]) -> DataFrame:
    """What every filter removes at every step of every order, counted for each ``part``.

    ``filters`` has a condition of failure for each letter, ``losses`` conditions whose removed rows are counted of their
    own. Returns ``(part, filter_order, step, kept, removed, redundant, unique_fails, *losses, shapley)`` with a row for
    each part, order and step, zeros included: the rows kept after the step, removed at it, failing its filter but removed
    earlier, failing its filter alone, and what its filter removes summed over all orders. A condition that is null holds
    for none. No rows give no parts and so an empty result; more than ``MOST_FILTERS`` filters are a ``ValueError``.

    The orders form a trie. A node's rows depend on the set of filters before it, not on their order, so the walk goes
    depth first over sets: the survivors of a set are persisted, counted once for all filters that can follow (its edges in
    the trie), and given to each of these that leads to a set not met yet. At most one frame for each filter is persisted
    at once. Counts are partial sums by part, written to the shared folder; rows lost with an executor are made again from
    the written table by the filters of the walk.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters have too many orders")
    letters = sorted(filters)
    holds = lambda c: F.coalesce(c, F.lit(False))
    flags = stored(rows.select(part.alias("part"), *[holds(filters[k]).alias(f"fails {k}") for k in letters], *[holds(c).alias(f"lost {k}") for k, c in losses.items()]), "flags")
    k, name = len(letters), lambda applied: "".join(sorted(applied))
    path = f"{scratch_path(rows.sparkSession)}/edges-{uuid.uuid4().hex}"
    counted: set[frozenset[str]] = set()

    def visit(applied: frozenset[str], survivors: DataFrame) -> None:
        if applied in counted:
            return
        counted.add(applied)
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        rest = [x for x in letters if x not in applied]
        fails = {x: F.col(f"fails {x}") for x in rest}
        sums = [F.count_if(fails[x] & F.col(f"lost {y}")).alias(f"{x} lost {y}") for x in rest for y in losses]
        found = survivors.groupBy("part").agg(F.count("*").alias("n"), *[F.count_if(fails[x]).alias(x) for x in rest], *sums)
        # a row for each edge, and one without a filter for the node itself
        own = F.struct(F.lit("").alias("filter"), F.col("n").alias("rows"), *[F.lit(0).cast("long").alias(y) for y in losses])
        edges = [F.struct(F.lit(x).alias("filter"), F.col(x).alias("rows"), *[F.col(f"{x} lost {y}").alias(y) for y in losses]) for x in rest]
        found.select("part", F.lit(name(applied)).alias("before"), F.inline(F.array(own, *edges))).write.parquet(f"{path}/{len(counted)}")
        for x in rest:
            visit(applied | {x}, survivors.filter(~fails[x]))
        survivors.unpersist()

    visit(frozenset(), flags)
    counts = rows.sparkSession.read.schema(", ".join(["part string", "before string", "filter string", "rows long", *[f"`{y}` long" for y in losses]])).option("recursiveFileLookup", "true").parquet(path)
    counts._stored_at = path
    every = frozenset(letters)
    grid = [
        F.struct(
            F.lit(name(s)).alias("before"), F.lit(x).alias("filter"), F.lit(name(s | {x})).alias("after"),
            F.lit(math.factorial(len(s)) * math.factorial(k - 1 - len(s))).cast("long").alias("orders"), F.lit(s | {x} == every).alias("is_last"),
        )
        for s in sorted(counted, key=name) for x in sorted(every - s)
    ]
    zero = lambda c, named: F.coalesce(c, F.lit(0)).cast("long").alias(named)
    nodes = counts.filter("filter = ''").select("part", F.col("before").alias("after"), F.col("rows").alias("kept"))
    edges = counts.filter("filter <> ''").withColumnRenamed("rows", "removed")
    grid = nodes.filter("after = ''").select("part", F.inline(F.array(*grid))).join(edges, ["part", "before", "filter"], "left").join(nodes, ["part", "after"], "left")
    grid = stored(grid.select("part", "before", "filter", "orders", "is_last", *[zero(y, y) for y in ("kept", "removed", *losses)]), "grid")
    discard(flags, counts)
    of_filter = grid.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == "", F.col("removed"))).alias("all_fails"), F.sum(F.when(F.col("is_last"), F.col("removed"))).alias("unique_fails"), F.sum(F.col("orders") * F.col("removed")).alias("shapley")
    )
    steps = [("".join(order), i + 1, order[i], name(order[:i])) for order in itertools.permutations(letters) for i in range(k)]
    trie = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before string")
    # the trie's size is that of the orders, whatever the rows
    out = grid.join(F.broadcast(trie), ["filter", "before"]).join(of_filter, ["part", "filter"])
    return out.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("all_fails") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley"
    )


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents, by language, with the good and the toxic documents lost."""
    rows = measured(table(spark, sf_dir, "documents"))
    marks = table(spark, sf_dir, "labels").filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left")
    return permutation_trie(rows, {k: F.col(k) for k in "ABCDE"}, F.col("part"), {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


ORACLE_SQL = {
    "op11_filter_interaction_audit": """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
f AS (SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
p AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, CAST(step AS INTEGER) AS step, o[step] AS f, o[1:step - 1] AS before FROM o, range(1, 6) s(step)),
r AS (SELECT part, s.o, s.step, s.f, p.n, p.good, p.toxic, fails[s.f] AS hit,
        len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM p, s),
g AS (SELECT part, o, step, f, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed, sum(n) FILTER (gone AND hit) AS redundant,
        sum(n) FILTER (hit AND alone) AS unique_fails, sum(good) FILTER (NOT gone AND hit) AS good_lost, sum(toxic) FILTER (NOT gone AND hit) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, list_aggregate(list_transform(o, lambda i: chr(CAST(64 + i AS INTEGER))), 'string_agg', '') AS filter_order, step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM g
"""
}
QUERIES = {"op11_filter_interaction_audit": op11_filter_interaction_audit}
