"""Removal of repeated runs of lines, found by boundaries that rolling hashes over line hashes choose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, stored, table, text_or_empty
from .shingles import BYTE, CHUNK_BYTES, STEP, powers

#: A line ends after a line feed, and after a sentence's end (``.``, ``!`` or ``?``) with a space.
#: A rolling hash covers so many line hashes; of ``WINDOW`` rolling hashes in a row the smallest is a boundary.
MIN_LINES = 2
WINDOW = 3
MIN_WORDS = 20
#: Lines to each side of a boundary that are compared: the next boundary is nearer than that.
AROUND = WINDOW + 1
#: Bytes of the first text whose boundaries are compared as one chunk.
CHUNK_SPAN = 8192
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def line_stops(data: bytes, begin: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Ends of the lines of one text, or of several joined texts that start at ``begin``."""
    if not len(data):
        return np.empty(0, np.int64)
    begin, sizes = (np.zeros(1, np.int64), np.array([len(data)])) if begin is None else (begin, sizes)
    b = np.frombuffer(data, np.uint8)
    ends_line = b == 10
    ends_line[1:] |= (b[1:] == 32) & ((b[:-1] == 46) | (b[:-1] == 33) | (b[:-1] == 63))
    begin, sizes = begin[sizes > 0], sizes[sizes > 0]
    # a space that begins a text ends no line, whatever ends the text before it
    ends_line[begin] &= b[begin] == 10
    ends_line[begin + sizes - 1] = True
    return np.nonzero(ends_line)[0] + 1


def boundaries(texts: list[bytes], window: int = WINDOW, lines: int = MIN_LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of its text, rolling hash and start of the lines at each boundary of several texts.

    A line's hash is a polynomial over its bytes, a rolling hash one over ``lines`` line hashes in a row. Of each ``window`` rolling hashes in a
    row the smallest, the last of equals, is a boundary (fewer are compared at a text's ends); so boundaries depend on the lines around them alone and
    move with the text, and any equal runs of ``lines + window - 1`` lines or more share one.
    """
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    stop = line_stops(data, begin, sizes)
    start = np.concatenate([[0], stop[:-1]])
    b = np.frombuffer(data, np.uint8)
    lengths = stop - start
    place = np.arange(len(b)) - np.repeat(start, lengths)
    h = mix64(np.add.reduceat(BYTE[b] * powers(int(lengths.max()))[place], start) ^ lengths.astype(np.uint64))
    owner = np.searchsorted(begin, start, side="right") - 1
    n = len(h) - lines + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    roll = np.zeros(n, np.uint64)
    for k in range(lines):
        roll = roll * STEP + h[k : k + n]
    roll = mix64(roll)
    within = owner[:n] == owner[lines - 1 :]
    top = np.uint64(2**64 - 1)
    # between texts stand rolls that are never smallest
    apart = np.repeat(np.arange(n), np.where(within, 1, window))
    rolls = np.where(within, roll, top)[apart]
    rolls = np.concatenate([np.full(window - 1, top), rolls, np.full(window - 1, top)])
    rows = np.lib.stride_tricks.sliding_window_view(rolls, window)[:, ::-1]
    least = np.unique(np.arange(len(rows)) + window - 1 - rows.argmin(axis=1)) - (window - 1)
    least = least[(least >= 0) & (least < len(apart))]
    at = np.unique(apart[least])
    at = at[within[at]]
    return owner[at], roll[at], start[at] - begin[owner[at]]


def _squeezed(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """``(doc_id, z[, own])``: whole texts as compressed UTF-8, for the shuffle, and a struct of the ``carried`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([press.compress(x.as_py()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z, *batch.columns[2:]], ["doc_id", "z", "own"][: batch.num_columns])

    own = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("own")] if carried else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"), *own)
    return rows.mapInArrow(run, "doc_id long, z binary" + (f", own {rows.schema['own'].dataType.simpleString()}" if own else ""))


def boundary_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(h, doc_id, at)`` of every boundary of every whole text; offsets are UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES):
                    size += len(texts[j])
                    j += 1
                own, keys, at = boundaries(texts[i:j], window)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(ids[i:j][own]), pa.array(at.astype(np.int32))], ["h", "doc_id", "at"])
                i = j

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    return rows.mapInArrow(run, "h long, doc_id long, at int")


def earlier_chunks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, at, piece)``: chunks of earlier text that may stand in a document from ``at`` on.

    The first of equal boundaries is that in the smallest document, then at the smallest offset. Later ones at the same
    distance from the same first text are one chunk, of ``CHUNK_SPAN`` bytes at most and the lines around. Hashes are counted
    before the shuffle; texts are met by document, once to cut out the chunks of first texts.
    """
    found = stored(boundary_table(docs, window), "boundaries")
    first = F.min(F.struct("doc_id", "at")).alias("first")
    repeated = stored(found.groupBy("h").agg(F.count("*").alias("n"), first).filter("n > 1").select("h", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at")), "repeated")
    # both sides are read from files, so that adaptive execution can split a boundary that very many documents have
    later = found.join(repeated, "h").filter((F.col("doc_id") != F.col("first_doc")) | (F.col("at") != F.col("first_at")))
    away = (F.col("at") - F.col("first_at")).alias("away")
    span = F.floor(F.col("first_at") / CHUNK_SPAN).alias("span")
    chunks = stored(later.groupBy("doc_id", "first_doc", away, span).agg(F.min("first_at").alias("lo"), F.max("first_at").alias("hi")).drop("span"), "chunks")
    wanted = chunks.groupBy("first_doc", "lo", "hi").agg(F.count("*").alias("n"))
    wanted = wanted.groupBy(F.col("first_doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        last = None
        for batch in batches:
            for doc_id, z, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (doc_id, z) == last:  # a repeated row
                    continue
                last = doc_id, z
                data = grow.decompress(z)
                lo, hi = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
                edges = np.concatenate([[0], line_stops(data)])
                start = edges[np.maximum(np.searchsorted(edges, lo) - AROUND, 0)]
                stop = edges[np.minimum(np.searchsorted(edges, hi) + MIN_LINES + AROUND, len(edges) - 1)]
                for at in range(0, len(lo), 1024):
                    own = slice(at, at + 1024)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(lo[own]), doc_id, np.int64)),
                            pa.array(lo[own].astype(np.int32)),
                            pa.array(hi[own].astype(np.int32)),
                            pa.array(start[own].astype(np.int32)),
                            pa.array([data[x:y] for x, y in zip(start[own], stop[own])], pa.binary()),
                        ],
                        ["first_doc", "lo", "hi", "start", "piece"],
                    )

    texts = _squeezed(docs).join(wanted, "doc_id").select("doc_id", "z", "spans")
    pieces = stored(texts.mapInArrow(cut, "first_doc long, lo int, hi int, start int, piece binary"), "pieces")
    return chunks.join(pieces, ["first_doc", "lo", "hi"]).select("doc_id", (F.col("start") + F.col("away")).cast("long").alias("at"), "piece")


def repeated_lines(data: bytes, chunks: list[tuple[int, bytes]], lines: int = MIN_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all lines of a text, and which of them lie in runs of ``lines`` or more that are whole lines of one chunk, byte by byte."""
    stops = line_stops(data)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    gone = np.zeros(len(stops), bool)
    b = np.frombuffer(data, np.uint8)
    for at, piece in chunks:
        lo, hi = max(at, 0), min(at + len(piece), len(data))
        apart = np.flatnonzero(b[lo:hi] != np.frombuffer(piece, np.uint8)[lo - at : hi - at]) + lo
        i, j = np.searchsorted(starts, lo), np.searchsorted(stops, hi, side="right")
        same = np.searchsorted(apart, starts[i:j]) == np.searchsorted(apart, stops[i:j])
        if same.any():  # and it begins and ends a line there too
            ends = np.concatenate([[0], line_stops(piece)]) + at
            same &= (ends[np.searchsorted(ends, starts[i:j]).clip(max=len(ends) - 1)] == starts[i:j]) & (ends[np.searchsorted(ends, stops[i:j]).clip(max=len(ends) - 1)] == stops[i:j])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        for x, y in zip(edge[::2], edge[1::2]):
            if y - x >= lines:
                gone[i + x : i + y] = True
    return stops, gone


def regions(data: bytes, chunks: list[tuple[int, bytes]], min_lines: int, min_words: int) -> list[tuple[int, int, int]]:
    """``(start, stop, lines)`` of the runs of repeated lines that are long enough."""
    stops, gone = repeated_lines(data, chunks)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    runs = [(int(starts[x]), int(stops[y - 1]), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
    return [(a, b, n) for a, b, n in runs if n >= min_lines and len(_WORD.findall(data[a:b])) >= min_words]


def dedup_lines(docs: DataFrame, window: int = WINDOW, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, carried: list[str] | None = None) -> DataFrame:
    """``(doc_id, kept, n_lines_removed, n_bytes_removed, n_regions[, own])`` for every document.

    ``kept`` is the whole text without the runs of repeated lines that have ``min_lines`` lines
    and ``min_words`` words at least. Lines are repeated where ``MIN_LINES`` or more in a row are, byte by byte, those of
    an earlier text (or place in the same) that holds the first copy of a boundary among them; every run of ``MIN_LINES + window - 1`` lines has a boundary. The earliest
    of equal lines stays, so nothing is lost from the
    corpus. A null or empty text is kept as an empty one. A row with a null ``doc_id`` is kept whole and
    compared with nothing; repeated rows give equal rows. ``own`` is a struct
    of each row's own ``carried`` columns, so that nothing has to be joined back by id; others are ignored.
    """

    names = ["doc_id", "kept", "n_lines_removed", "n_bytes_removed", "n_regions", "own"][: 5 + bool(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        now, chunks = None, []  # the document whose chunks have come
        for batch in batches:
            ids, zs, ats, pieces = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
            rows: list[tuple] = []
            size = 0

            def made() -> pa.RecordBatch:
                at, *columns = zip(*rows)
                kinds = [pa.string(), *[pa.int64()] * 3]
                taken = [c.take(pa.array(at)) for c in (batch.column(0), *batch.columns[5:])]
                return pa.RecordBatch.from_arrays([taken[0], *map(pa.array, map(list, columns), kinds), *taken[1:]], names)

            for i, (doc_id, at) in enumerate(zip(ids, ats, strict=True)):
                if at is not None:
                    if doc_id != now:
                        now, chunks = doc_id, []
                    chunks.append((at, pieces[i]))
                    continue
                data = grow.decompress(zs[i])
                gone = regions(data, chunks, min_lines, min_words) if doc_id == now and doc_id is not None else []
                parts, last = [], 0
                for a, b, _ in gone:
                    parts.append(data[last:a])
                    last = b
                rows.append((i, b"".join([*parts, data[last:]]).decode(), sum(n for *_, n in gone), sum(b - a for a, b, _ in gone), len(gone)))
                size += len(data)
                if size > CHUNK_BYTES:
                    yield made()
                    rows, size = [], 0
            if rows:
                yield made()

    whole = _squeezed(docs, carried)
    rest = whole.columns[2:]
    # a document's chunks come before its texts and stream by, so that no list of them is gathered for the join
    texts = whole.select("doc_id", F.lit(1).alias("kind"), "z", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("piece"), *rest)
    pieces = earlier_chunks(docs, window).select("doc_id", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("z"), "at", "piece", *[F.lit(None).cast(whole.schema[c].dataType).alias(c) for c in rest])
    rows = texts.unionByName(pieces).repartition(F.coalesce("doc_id", F.xxhash64("z"))).sortWithinPartitions("doc_id", "kind")
    own = f", own {whole.schema['own'].dataType.simpleString()}" if carried else ""
    return rows.mapInArrow(run, "doc_id long, kept string, n_lines_removed long, n_bytes_removed long, n_regions long" + own)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of it."""
    return dedup_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL: dict[str, str] = {}
