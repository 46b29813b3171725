"""Packets of text from ranked files and their excerpts, as rows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fence_length, quote_label
from .evidence import allocate_source, rank_files, truncate_output

# The sentences of a packet.
END_OF_LIST, END_OF_PACKET = "End file list.", "End context."
UNKNOWN_ROLE, BELOW, OMITTED, NOTHING = "relevant; role uncertain", "source below", "source omitted", "locations only"


def packet_lines(found: DataFrame, excerpts: DataFrame, max_source_bytes: int, max_output_bytes: int = 256_000) -> DataFrame:
    """``(query_id, line_no, line, truncated)``: the packet of each query, from its ranked files to the excerpts that fit.

    ``found(query_id, path, score, priority, roles)``, ``excerpts(query_id, path, start_line, end_line, source)``. Files are ranked, excerpts take what is left of a query's
    source bytes in that order, and lines take what is left of its output. An excerpt of a file that wasn't found is left out; null roles are none. A query's
    lines are numbered by sums within its sections, whose sizes are bounded by the output.
    """
    ranked = rank_files(found).withColumn("quoted", quote_label(F.col("path")))
    place = F.row_number().over(W.partitionBy("query_id", "path").orderBy("start_line", "end_line")).alias("excerpt")
    own = excerpts.select("query_id", "path", "start_line", "end_line", "source", place).join(ranked.select("query_id", "path", "rank", "quoted"), ["query_id", "path"])
    sizes = own.select("query_id", "rank", "excerpt", F.octet_length("source").cast("long").alias("bytes"))
    kept = allocate_source(sizes, max_source_bytes).drop("bytes")
    taken = own.join(kept, ["query_id", "rank", "excerpt"])

    told = taken.groupBy("query_id", "rank").agg(F.bool_or("kept").alias("below"))
    state = F.when(F.col("below"), BELOW).when(F.col("below").isNotNull(), OMITTED).otherwise(NOTHING)
    roles = F.when(F.size("roles") > 0, F.array_join("roles", ", ")).otherwise(UNKNOWN_ROLE)
    files = ranked.join(told, ["query_id", "rank"], "left").select("query_id", "rank", F.lit(0).alias("excerpt"), F.array(F.concat(F.lit("- "), "quoted", F.lit(" — "), roles, F.lit("; "), state)).alias("lines"))
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    zero = [F.lit(0).alias("rank"), F.lit(0).alias("excerpt")]
    head = n.select("query_id", *zero, F.array(F.concat("n", F.lit(" relevant files."))).alias("lines"))
    middle = n.select("query_id", *zero, F.array(F.lit(END_OF_LIST)).alias("lines"))
    last = n.select("query_id", *zero, F.array(F.lit(""), F.lit(END_OF_PACKET)).alias("lines"))
    fence = F.repeat(F.lit("`"), fence_length(F.col("source")))
    title = F.concat(F.lit("Source block "), "quoted", F.lit(" lines "), "start_line", F.lit("-"), "end_line", F.lit(":"))
    block = F.concat(F.array(F.lit(""), title, fence), F.split("source", "\n"), F.array(fence))
    blocks = taken.filter("kept").select("query_id", "rank", "excerpt", block.alias("lines"))
    parts = None
    for section, rows in enumerate((head, files, middle, blocks, last)):
        rows = rows.withColumn("section", F.lit(section))
        parts = rows if parts is None else parts.unionByName(rows)
    # a section's first line number is a sum over the sections before; lines are told apart only then
    before = F.sum(F.size("lines")).over(W.partitionBy("query_id").orderBy("section", "rank", "excerpt").rowsBetween(W.unboundedPreceding, 0)) - F.size("lines")
    lines = parts.withColumn("before", before).select("query_id", "before", F.posexplode("lines").alias("i", "line"))
    numbered = lines.select("query_id", (F.col("before") + F.col("i") + 1).alias("line_no"), "line")
    return truncate_output(numbered, max_output_bytes).select("query_id", "line_no", "line", "truncated")


def packet_texts(lines: DataFrame) -> DataFrame:
    """``(query_id, text)`` for :func:`~lodestrata.sources.files.write_context`; a packet's lines are bounded by its output bytes."""
    rows = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"))
    return rows.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))
