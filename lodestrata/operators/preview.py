"""Previews of files for a query, and units as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sized import sized
from .units import cut_bytes

DECLARED = re.compile(r"^\s*(?:async\s+)?(?:def|class|function|func|fn|interface|type|struct)\s+([^\W\d]\w*)")
SPAN = "path string, basis string, start_line int, end_line int, byte_start long, byte_end long"


def preview_lines(lines: list[bytes], names: set[str], budget: int, window: int = 32) -> list[tuple[str, int, int]]:
    """``(basis, first, last)`` line numbers from 0: an opening quarter, lines around declarations that the query names, three spread windows.

    Lines are taken once, in that order, while their bytes with line feeds fit the budget.
    """
    taken: dict[int, str] = {}
    left = budget

    def take(i: int, basis: str, most: int) -> bool:
        nonlocal left
        if i in taken or not 0 <= i < len(lines):
            return True
        n = len(lines[i]) + 1
        if n > min(left, most):
            return False
        taken[i] = basis
        left -= n
        return True

    quarter, i = budget // 4, 0
    while i < len(lines) and quarter > 0 and take(i, "opening", quarter):
        quarter -= len(lines[i]) + 1
        i += 1
    for i, line in enumerate(lines):
        m = DECLARED.match(line.decode(errors="ignore"))
        if m and m[1].lower() in names:
            for k in range(i - 4, i + window - 4):
                if not take(k, "query", left):
                    break
    for part in (1, 2, 3):
        at = len(lines) * part // 4 - window // 2
        for k in range(at, at + window):
            if not take(k, "spread", left):
                break
    out: list[list] = []
    for i in sorted(taken):
        if out and out[-1][2] == i - 1 and out[-1][0] == taken[i]:
            out[-1][2] = i
        else:
            out.append([taken[i], i, i])
    return [tuple(x) for x in out]


def query_preview(files: DataFrame, query: str, budget: int = 16_384) -> DataFrame:
    """Spans of each file within one byte budget; ``query`` is a bounded string. Null and empty sources have none."""
    names = {x.lower() for x in re.findall(r"[^\W\d]\w*", query)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = source.as_py()
                if not data:
                    continue
                lines = data.split(b"\n")
                ends = [0]
                for line in lines:
                    ends.append(ends[-1] + len(line) + 1)
                rows += [(path, basis, a + 1, b + 1, ends[a], min(ends[b + 1], len(data))) for basis, a, b in preview_lines(lines, names, budget)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "basis", "start_line", "end_line", "byte_start", "byte_end"])

    return files.select(F.col("path").cast("string"), F.col("source").cast("binary")).mapInArrow(run, SPAN)


def declared_names(files: DataFrame) -> DataFrame:
    """``(path, name)``: the distinct names, in lower case, that lines of each file declare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, name) for path, source in zip(batch.column(0).to_pylist(), batch.column(1)) for name in sorted(_declared(source.as_py() or b""))]
            paths, names = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], ["path", "name"])

    return files.select(F.col("path").cast("string"), F.col("source").cast("binary")).mapInArrow(run, "path string, name string")


def _declared(data: bytes) -> set[str]:
    return {m[1].lower() for line in data.split(b"\n") if (m := DECLARED.match(line.decode(errors="ignore")))}


def query_previews(files: DataFrame, queries: DataFrame, budget: int = 16_384) -> DataFrame:
    """``(query_id, ...)`` of :func:`query_preview` for a table of questions ``queries(query_id, text)``.

    A file's preview differs from question to question only where a question names what the file declares: an index of
    declared names meets the questions' identifiers, and such pairs get a preview of their own. The preview for all other
    questions is one, with a null ``query_id``. A file's text is sent to the one task that cuts all its previews. Paths are
    distinct; null and empty sources have no preview, null questions name nothing.
    """
    words = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?U)[^\W\d]\w*"), F.lit(0)), F.lower)))
    asked = queries.filter("query_id is not null").select("query_id", words.alias("name"))
    hits = declared_names(files).join(sized(asked), "name").groupBy("path", "query_id").agg(F.collect_set("name").alias("names"))
    hits = hits.groupBy("path").agg(F.collect_list(F.struct("query_id", "names")).alias("asking"))
    own = files.select(F.col("path").cast("string").alias("path"), F.col("source").cast("binary").alias("source")).join(hits, "path", "left")
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids = batch.schema.field("asking").type.value_type.field("query_id").type
            for path, source, asking in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = source.as_py()
                if not data:
                    continue
                lines = data.split(b"\n")
                ends = [0]
                for line in lines:
                    ends.append(ends[-1] + len(line) + 1)
                for query_id, names in [(None, set()), *((x["query_id"], set(x["names"])) for x in asking or ())]:
                    rows += [(query_id, path, basis, a + 1, b + 1, ends[a], min(ends[b + 1], len(data))) for basis, a, b in preview_lines(lines, names, budget)]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [ids, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["query_id", "path", "basis", "start_line", "end_line", "byte_start", "byte_end"])

    return own.mapInArrow(run, f"query_id {kind.simpleString()}, {SPAN}")


class SourceUnits:
    """A table function: chunks of a text, as ``split_source`` cuts them."""

    def eval(self, text: str, max_bytes: int):
        data = (text or "").encode()
        for i, (a, b) in enumerate(cut_bytes(data, max_bytes)):
            yield i, a, b


def register_units(spark: SparkSession, name: str = "source_units") -> None:
    """Makes ``source_units(text, max_bytes)`` known to SQL, for a lateral join."""
    spark.udtf.register(name, F.udtf(SourceUnits, returnType="unit int, byte_start long, byte_end long"))


def register_preview(spark: SparkSession, name: str = "preview_spans") -> None:
    """Makes ``preview_spans(text, query, budget)`` known to SQL."""

    class Preview:
        def eval(self, text: str, query: str, budget: int):
            names = {x.lower() for x in re.findall(r"[^\W\d]\w*", query or "")}
            for basis, a, b in preview_lines((text or "").encode().split(b"\n"), names, budget) if text else ():
                yield basis, a + 1, b + 1

    spark.udtf.register(name, F.udtf(Preview, returnType="basis string, start_line int, end_line int"))
