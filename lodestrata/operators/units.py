"""Pieces of files: lossless chunks and samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sized import sized


def content_samples(files: DataFrame, total_chars: int = 16_000, least: int = 80) -> DataFrame:
    """Three equidistant samples of each file, in its share of its repository's characters; a short file as a whole, a null source as null."""
    n = F.length("source")
    # files are counted by repository first; texts stay where they are unless the counts are too many to broadcast
    counts = files.groupBy("repo").agg(F.count("*").alias("_files"))
    share = F.greatest(F.lit(least).cast("long"), F.floor(total_chars / F.col("_files")))
    own = files.join(sized(counts), "repo").withColumn("_third", F.floor(share / 3).cast("int")).withColumn("_share", share)
    parts = [F.lit(1), F.floor((n - F.col("_third")) / 2).cast("int") + 1, n - F.col("_third") + 1]
    cut = F.concat_ws("\n", *[F.substring("source", p, F.col("_third")) for p in parts])
    return own.select("repo", "path", F.when(n <= F.col("_share"), F.col("source")).when(n > F.col("_share"), cut).alias("sample"))


def cut_bytes(data: bytes, max_bytes: int) -> list[tuple[int, int]]:
    """Byte ranges of at most ``max_bytes``, each ending after the last line feed that fits, else between characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + max_bytes, len(data))
        if end < len(data):
            line = data.rfind(b"\n", at, end)
            if line >= at:
                end = line + 1
            else:
                while end > at + 1 and data[end] & 0xC0 == 0x80:
                    end -= 1
        out.append((at, end))
        at = end
    return out


def split_source(files: DataFrame, max_bytes: int = 12_000, key: str = "path") -> DataFrame:
    """``(key, unit, byte_start, byte_end, start_line, text)``: chunks that together are the whole source.

    An empty or null source has no chunk. One file is in memory at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, source in zip(batch.column(0), batch.column(1)):
                data = source.as_py() or b""
                rows, line = [], 1
                for i, (a, b) in enumerate(cut_bytes(data, max_bytes)):
                    rows.append((name.as_py(), i, a, b, line, data[a:b].decode()))
                    line += data.count(b"\n", a, b)
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [key, "unit", "byte_start", "byte_end", "start_line", "text"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col("source").cast("binary")).mapInArrow(run, f"{key} {kind}, unit int, byte_start long, byte_end long, start_line int, text string")
