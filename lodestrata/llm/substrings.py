"""Removal of byte strings that repeat anywhere in a corpus, by bucket-pointer refinement.

A bucket is the set of places where the same bytes stand, and its identifier a 64-bit hash that any task gives alike. Buckets of
``q`` bytes are refined by the identifier of the bucket that stands ``q`` bytes later, which doubles ``q``; the new identifiers are used for the next
round (:func:`refined`). Between rounds the places are counted by identifier across the corpus, and those alone in their bucket drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, mix64, stored, table
from .line_dedup import _squeezed
from .shingles import STEP

LENGTH = 400
GRAM = 64
BLOCK = 32
#: Strings of a block that is found more often are counted in parts of about so many.
HOT = 2_000
#: A text is worked on in parts of so many bytes, that overlap by a string's length.
PART_BYTES = 4_000_000
#: Texts whose equal suffix ranges are met within the task before the shuffle.
LOCAL_BYTES = 8_000_000

_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_POSITION = np.uint64((1 << 24) - 1)
_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    own = _tables.get(base)
    if own is None or len(own) < n:
        own = np.full(max(n, 1 << 16), base, np.uint64)
        own[0] = 1
        own = _tables[base] = np.multiply.accumulate(own)
    return own


_UP, _DOWN = int(STEP), pow(int(STEP), -1, 2**64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(29)
    return x


def _words(data: bytes) -> np.ndarray:
    """The identifier of the bucket of the 8 bytes at each offset."""
    return mix64(np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,)))


def refined(ids: np.ndarray, size: int, length: int) -> np.ndarray:
    """Identifiers of the buckets of ``length`` bytes at each offset, from those of ``size`` bytes.

    Each round takes a bucket apart by the identifier of the bucket ``size`` bytes later, and uses the identifiers of the round before at
    both places. The last round looks as far ahead as ``length`` asks.
    """
    while 2 * size <= length:
        ids, size = _joined(ids[:-size], ids[size:]), 2 * size
    return ids if size == length else _joined(ids[: len(ids) - (length - size)], ids[length - size :])


class Substrings:
    """Hashes of any substrings of a text, from sums of its mixed 8-byte words."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(len(words) + 1, _UP)[: len(words)])])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        own = (self.sums[stop - 7] - self.sums[start]) * _powers(len(self.sums), _DOWN)[start]
        return mix64(own + (stop - start).astype(np.uint64))


def suffix_ranges(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Bucket, identity, suffix, first and last start of the strings of ``length`` bytes, one row for each sampled suffix.

    Each string is dealt to the suffix at its smallest hashed gram (the first of equals), which the string's own bytes
    decide: equal strings are dealt alike. The bucket is the gram's hash; the identity is that of all bytes
    that the row's strings cover, with the suffix's place in them.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    words = _words(data)
    h = refined(words, 8, gram)
    width = length - gram + 1
    keys = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _POSITION).astype(np.int64)
    first = np.concatenate([[0], np.nonzero(np.diff(least))[0] + 1])
    last = np.append(first[1:] - 1, n - 1)
    at = least[first]
    whole = Substrings(words).hash(first, last + length)
    return mix64(h[at]), mix64(whole * STEP + ((at - first) << 20 | (last - first)).astype(np.uint64)), at, first, last


def _parts(data: bytes, length: int, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, bytes]]:
    yield 0, data[:part_bytes]
    at = part_bytes - length + 1
    while at + length <= len(data):
        yield at, data[at : at + part_bytes]
        at += part_bytes - length + 1


def sampled_suffixes(docs: DataFrame, length: int = LENGTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(bucket, identity, doc_id, at, first, last, n)`` for the suffixes sampled from all texts.

    Equal ranges of a few megabytes of text meet in the task: one stands for all, ``n`` of them;
    the others come as rows with a null ``at``, which are repeated for certain.
    """
    names = ["bucket", "identity", "doc_id", "at", "first", "last", "n"]

    def met(ids: list[int], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        own = np.repeat(np.asarray(ids, np.int64), [len(f[0]) for f in found])
        bucket, identity, at, first, last = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(5))
        _, one, count = np.unique(identity, return_index=True, return_counts=True)
        n = np.zeros(len(own), np.int64)
        n[one] = count
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket.astype(np.int64)),
                pa.array(identity.astype(np.int64)),
                pa.array(own),
                pa.array(at.astype(np.int32), mask=n == 0),
                pa.array(first.astype(np.int32)),
                pa.array(last.astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_py()
                for offset, part in _parts(data, length, part_bytes):
                    bucket, identity, *places = suffix_ranges(part, length)
                    ids.append(doc_id)
                    found.append((bucket, identity, *(x + offset for x in places)))
                size += len(data)
                if size > LOCAL_BYTES:
                    yield met(ids, found)
                    ids, found, size = [], [], 0
            if ids:
                yield met(ids, found)

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, "bucket long, identity long, doc_id long, at int, first int, last int, n int")


def _block_rows(texts: DataFrame, length: int, block: int) -> DataFrame:
    """Cuts each suffix's starts into blocks: the bucket at the later offset that all of a block's strings reach, and the bytes around."""
    core = length - block + 1
    side = block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc_id, z, suffixes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = grow.decompress(z.as_py())
                own = suffixes.values
                at, first, last = (own.field(k).to_numpy().astype(np.int64) for k in ("at", "first", "last"))
                low, high = (at - last) // block, (at - first) // block
                many = high - low + 1
                k = np.repeat(np.arange(len(at)), many)
                x = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + low[k]
                start = at[k] - block * x  # of the core
                shared = mix64(refined(_words(data), 8, core)[start] + x.astype(np.uint64))
                around = np.frombuffer(b"\0" * side + data + b"\0" * side, np.uint8)
                left = np.lib.stride_tricks.sliding_window_view(around, side)
                sides = np.concatenate([left[start], left[start + core + side]], axis=1)
                lo, hi = np.maximum(start - first_of(k, last), 0), np.minimum(start - first_of(k, first), side)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shared.astype(np.int64)),
                        pa.array(np.full(len(k), doc_id, np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(lo.astype(np.int32)),
                        pa.array(hi.astype(np.int32)),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * side), len(k), [None, pa.py_buffer(np.ascontiguousarray(sides))]).cast(pa.binary()),
                    ],
                    ["shared", "doc_id", "start", "lo", "hi", "sides"],
                )

    def first_of(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x[k]

    return texts.mapInArrow(run, "shared long, doc_id long, start int, lo int, hi int, sides binary")


def _string_rows(blocks: DataFrame, block: int) -> DataFrame:
    """``(string, doc_id, at, parts)`` of each string of a block, refined by the bucket at its block's later offset, and the bytes left and right of that."""
    side = block - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shared, doc_id, start, lo, hi = (batch.column(k).to_numpy() for k in range(5))
            parts = batch.column(6).to_numpy()
            raw = b"".join(batch.column(5).to_pylist())
            wide = np.frombuffer(raw, np.uint8).reshape(-1, 2 * side)
            words = np.lib.stride_tricks.as_strided(np.ndarray((1,), "<u8", raw), (len(wide), 2 * side - 7), (2 * side, 1))
            # a string with j bytes to the left has the side bytes from side - j
            j = np.arange(block)
            o = side - j
            h = _joined(_joined(mix64(words[:, o]), mix64(words[:, o + 8])), _joined(mix64(words[:, o + 16]), mix64(words[:, o + side - 8])))
            # the number of bytes left of the core is a part of it: the same side bytes, cut elsewhere, are another string
            h = mix64(h + mix64(j.astype(np.uint64)) + shared.astype(np.uint64)[:, None])
            row, col = np.nonzero((j >= lo[:, None]) & (j <= hi[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[row, col].astype(np.int64)), pa.array(doc_id[row]), pa.array((start[row] - col).astype(np.int32)), pa.array(parts[row])], ["string", "doc_id", "at", "parts"]
            )

    return blocks.mapInArrow(run, "string long, doc_id long, at int, parts int")


def repeated_starts(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, spans)``: maximal ranges ``(first, last)`` of starts of the strings of ``length`` bytes that start elsewhere too.

    Sampled suffixes are put in buckets by their first gram. Buckets are refined by the identity of all that a suffix's
    strings cover: what is alike there is repeated as a whole, and one of it goes on for all. What is left is refined by the buckets at later
    offsets that blocks of strings share, and at last by the strings themselves. Those alone in a bucket drop out at each step, so that each
    step moves less. Counts are summed in the tasks first and joined back between stored tables, which can be split at a hot key;
    strings of hot blocks are counted in parts, and then those alone in their part.
    """
    rows = stored(sampled_suffixes(docs, length, part_bytes), "suffixes")
    # met in the task already: repeated for certain
    known, open_rows = rows.filter("at is null"), rows.filter("at is not null")
    common = stored(open_rows.groupBy("bucket").agg(F.sum("n").alias("in_bucket")).filter("in_bucket > 1"), "buckets")
    met = stored(open_rows.join(common, "bucket").drop("in_bucket"), "bucketed")
    one = F.min(F.struct("doc_id", "first", "at", "last")).alias("one")
    alike = stored(met.groupBy("bucket", "identity").agg(F.sum("n").alias("alike"), one), "alike")
    whole = met.join(alike.filter("alike > 1").select("bucket", "identity"), ["bucket", "identity"], "left_semi")
    # buckets of one identity are done
    apart = alike.join(common, "bucket").filter("alike < in_bucket").select("one.*")
    going = apart.groupBy("doc_id").agg(F.collect_list(F.struct("at", "first", "last")).alias("suffixes"))
    texts = _squeezed(docs).join(going, "doc_id").select("doc_id", "z", "suffixes")
    blocks = stored(_block_rows(texts, length, block), "blocks")
    parts = F.ceil(F.col("n") / hot).cast("int").alias("parts")
    shared = stored(blocks.groupBy("shared").agg(F.count("*").alias("n")).filter("n > 1").select("shared", parts), "shared")
    strings = _string_rows(blocks.join(shared, "shared").select("shared", "doc_id", "start", "lo", "hi", "sides", "parts"), block)
    part = F.pmod(F.xxhash64("doc_id", "at"), F.col("parts"))
    counted = strings.withColumn("part", part).withColumn("n", F.count("*").over(W.partitionBy("string", "part")))
    hot_ones = stored(counted.filter("n > 1 or parts > 1").select("string", "doc_id", "at", "parts", "n"), "strings")
    discard(blocks, shared, common)
    # at most one for each part
    alone = hot_ones.filter("n = 1").withColumn("n", F.count("*").over(W.partitionBy("string"))).filter("n > 1")
    # a string that is alone in its part may stand in others more than once
    often = hot_ones.filter("n > 1 and parts > 1").select("string").distinct()
    rest = hot_ones.filter("n = 1").join(often, "string", "left_semi")
    at = [F.col("at").alias("a"), F.col("at").alias("b")]
    spans = known.unionByName(whole.select(*known.columns)).select("doc_id", F.col("first").alias("a"), F.col("last").alias("b"))
    for found in (hot_ones.filter("n > 1"), alone, rest):
        spans = spans.unionByName(found.select("doc_id", *at))
    # sorted and streamed: lists of a text's single starts would take a task's memory
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "a").mapInArrow(_merged, "doc_id long, spans array<struct<a:int,b:int>>")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the maximal ranges of its starts, from ranges sorted by document and first start."""

    def rows(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b)], ["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.ListArray.from_arrays(pa.array(np.append(head, len(ids)).astype(np.int32)), spans)], ["doc_id", "spans"])

    held = [np.empty(0, np.int64)] * 3  # of the last document so far
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, a, b = (np.concatenate([x, batch.column(k).to_numpy().astype(np.int64)]) for k, x in enumerate(held))
        own = np.cumsum(np.append(False, ids[1:] != ids[:-1])) << 32
        reach = np.maximum.accumulate(own + b)
        first = np.flatnonzero(np.append(True, (own + a)[1:] > reach[:-1] + 1))
        ids, a, b = ids[first], a[first], reach[np.append(first[1:] - 1, len(ids) - 1)] & 0xFFFFFFFF
        done = int(np.count_nonzero(ids != ids[-1]))
        held = [x[done:] for x in (ids, a, b)]
        if done:
            yield rows(ids[:done], a[:done], b[:done])
    if len(held[0]):
        yield rows(*held)


def removed_runs(spans: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs ``(start, stop)`` of bytes that the strings with starts in ``spans`` (first, last) cover."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, stop = spans[:, 0], np.maximum.accumulate(spans[:, 1] + length)
    new = np.append(True, start[1:] > stop[:-1])
    ends = np.append(np.nonzero(new)[0][1:] - 1, len(start) - 1)
    return np.stack([start[new], stop[ends]], 1)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every document.

    Each byte that a string of ``length`` bytes covers which starts anywhere else too, in this
    document or another, is removed; ``kept`` is the other bytes, concatenated. Strings are judged on the input and never
    cross documents. A null or empty text keeps nothing, and a text shorter than ``length`` keeps all.
    A row with a null ``doc_id`` keeps all and is compared with nothing; repeated rows are copies of each other.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[], [], [], []]
                for z, spans in zip(part.column(1), part.column(2), strict=True):
                    data = grow.decompress(z.as_py())
                    runs = np.empty((0, 2), np.int64)
                    if spans.is_valid:
                        own = spans.values
                        runs = removed_runs(np.stack([own.field("a").to_numpy(), own.field("b").to_numpy()], 1).astype(np.int64), length)
                    pieces, last = [], 0
                    for a, b in runs.tolist():
                        pieces.append(data[last:a])
                        last = b
                    for column, x in zip(rows, (len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join([*pieces, data[last:]]))):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _squeezed(docs).join(repeated_starts(docs, length), "doc_id", "left").select("doc_id", "z", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes: digests, then what is left as text (a cut character becomes U+FFFD) and its bytes."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
        F.length("kept").cast("long").alias("n_kept"),
    )


QUERIES = {"op1_suffix_array_dedup": op1_suffix_array_dedup}
ORACLE_SQL: dict[str, str] = {}
