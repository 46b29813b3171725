"""Ranking, packing and collecting of evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def rank_files(found: DataFrame) -> DataFrame:
    """Adds ``rank`` within a query: by priority or else score, then score, then path."""
    order = [F.coalesce("priority", "score").desc(), F.desc("score"), F.asc("path")]
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def _walked(rows: DataFrame, keys: list[str], order: list[str], added: str, start: Callable[[], list], step: Callable[[list, int], tuple]) -> DataFrame:
    """Adds columns ``added`` to ``rows(*keys, *order, bytes)``: groups in order, each row by ``step`` from the state that the rows before left.

    Rows are sorted within partitions and read as they come, so that no group has to fit in memory.
    """
    names = [c.split()[0] for c in added.split(", ")]
    fields = [pa.field(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            own = [batch.column(batch.schema.names.index(c)).to_pylist() for c in keys]
            made: list[list] = [[] for _ in names]
            for *key, n in zip(*own, batch.column(batch.schema.names.index("bytes")).to_pylist()):
                if key != last:
                    last, state = key, start()
                for column, x in zip(made, step(state, n)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(made, fields))], [*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{kinds}, {added}")


def allocate_source(excerpts: DataFrame, max_bytes: int) -> DataFrame:
    """Adds ``kept``: in order of ``rank, excerpt``, each excerpt that fits what is left of its query's bytes; too large ones are passed over.

    First fit depends on all decisions before, so a query's ids and sizes are walked in order.
    """
    def step(left: list, n: int) -> tuple:
        fits = n <= left[0]
        left[0] -= n if fits else 0
        return (fits,)

    return _walked(excerpts.select("query_id", "rank", "excerpt", "bytes"), ["query_id"], ["rank", "excerpt"], "kept boolean", lambda: [max_bytes], step)


def prefix_within(rows: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """The longest prefix in order whose sizes add up to ``most`` at most."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("so_far", F.sum(size).over(w)).filter(F.col("so_far") <= most)


def truncate_output(lines: DataFrame, max_bytes: int = 256_000, reserve: int = 64) -> DataFrame:
    """The lines of each packet that fit with a reserve for the closing mark, and whether it was cut."""
    sized = lines.withColumn("_b", F.octet_length("line").cast("long") + 1)
    total = sized.groupBy("query_id").agg(F.sum("_b").alias("total"))
    cut = sized.join(total, "query_id").withColumn("truncated", F.col("total") > max_bytes)
    w = W.partitionBy("query_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    run = cut.withColumn("so_far", F.sum("_b").over(w))
    return run.filter(~F.col("truncated") | (F.col("so_far") <= max_bytes - reserve)).drop("_b", "total")


def fit_declarations(units: DataFrame, max_bytes: int = 32_000) -> DataFrame:
    return prefix_within(units, ["path"], ["start_line", "name"], "bytes", max_bytes)


def pack_batches(items: DataFrame, keys: list[str], max_items: int = 128, max_bytes: int = 38_000) -> DataFrame:
    """Adds ``batch`` and ``too_large``: items in order ``ord`` fill a batch until one bound would be passed.

    An item larger than the bound is reported and takes no batch.
    """
    def step(state: list, n: int) -> tuple:
        if n > max_bytes:
            return None, True
        if state[1] and (state[1] == max_items or state[2] + n > max_bytes):
            state[:] = state[0] + 1, 0, 0
        state[1:] = state[1] + 1, state[2] + n
        return state[0], False

    return _walked(items.select(*keys, "ord", "bytes"), keys, ["ord"], "batch long, too_large boolean", lambda: [0, 0, 0], step)


def collect_evidence(excerpts: DataFrame) -> DataFrame:
    """By query and path, excerpts in order of their start, with their number and bytes."""
    return excerpts.groupBy("query_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("excerpts"), F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("span")
    )


def explode_evidence(found: DataFrame) -> DataFrame:
    """One row for each excerpt of ``collect_evidence``, with its place."""
    return found.select("query_id", "path", F.posexplode("excerpts").alias("place", "e")).select("query_id", "path", "place", "e.start", "e.end")


def instruction_files(found: DataFrame, inventory: DataFrame, name: str = "AGENTS.md") -> DataFrame:
    """Instruction files in the directories above returned files: ``(repo, path, excluded)``."""
    dirs = found.select("repo", F.explode(F.concat(F.array(F.lit(".")), ancestors(F.col("path")))).alias("dir")).distinct()
    wanted = dirs.select("repo", F.when(F.col("dir") == ".", F.lit(name)).otherwise(F.concat("dir", F.lit(f"/{name}"))).alias("path"))
    return wanted.join(inventory.select("repo", "path", F.col("reason").isNotNull().alias("excluded")), ["repo", "path"])


def attach_evidence(targets: DataFrame, excerpts: DataFrame, max_bytes: int = 64_000) -> DataFrame:
    """Each target of a query with ``evidence``, all the query's excerpts: those of files with few groups first, then by path and start.

    ``excerpts(query_id, path, n_groups, start, end, source)``; ``evidence`` is an array of ``(path, start, end, source)``. Where it
    would be longer than ``max_bytes`` as JSON it is null, as where there is none. Too long texts aren't collected.
    """
    sizes = excerpts.groupBy("query_id").agg(F.sum(F.octet_length("source")).alias("_n")).filter(F.col("_n") <= max_bytes).select("query_id")
    entry = F.struct(F.coalesce("n_groups", F.lit(0)).alias("n_groups"), "path", "start", "end", "source")
    rows = excerpts.join(sizes, "query_id", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    own = rows.select("query_id", F.transform("_all", lambda x: F.struct(x["path"].alias("path"), x["start"].alias("start"), x["end"].alias("end"), x["source"].alias("source"))).alias("evidence"))
    fits = own.filter(F.octet_length(F.to_json("evidence")) <= max_bytes)
    return targets.join(fits, "query_id", "left")


def order_donors(files: DataFrame) -> DataFrame:
    """By query, paths from the fewest groups to the most."""
    return files.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_groups", "path"))), lambda x: x["path"]).alias("donors"))
