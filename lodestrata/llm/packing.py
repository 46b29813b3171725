"""Packing of tokenized documents into sequences by length patterns fitted to the histogram."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty

MAX_TOKENS = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Documents of a length are numbered in buckets of so many, or of the square root of their number if that is more.
ROWS_A_BUCKET = 500
FITS = 3

#: The added token of the ``tokenizers`` file.
SPECIAL = {"<|endoftext|>": 50256}

#: Runs of the pattern's white space (Unicode's) that are cut off where the pattern can't be matched.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

_encoders: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    r"""Ids of the byte-level BPE of a ranks file. The end token's string is a token of its own, as in the vocabulary's file for ``tokenizers``.

    The pattern's ``\s+(?!\S)`` can't be matched over very long white space. Such a run is cut off by the pattern's own
    rule: all of it at the end of a text, else all but its last character, which goes with what follows.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode_to_numpy(self, text: str, allowed_special: str = "all") -> np.ndarray:
        try:
            return self.bpe.encode_to_numpy(text, allowed_special=allowed_special)
        except ValueError:
            return np.concatenate(list(self._in_parts(text)))

    def _in_parts(self, text: str) -> Iterator[np.ndarray]:
        (special, end_id), *_ = SPECIAL.items()
        ordinary = lambda x: self.bpe.encode_to_numpy(x, disallowed_special=())
        for k, part in enumerate(text.split(special)):
            if k:
                yield np.array([end_id], np.uint32)
            start = 0
            for run in LONG_SPACE.finditer(part):
                end = run.end() - (run.end() < len(part))
                yield ordinary(part[start : run.start()])
                yield np.array(self.bpe._encode_single_piece(part[run.start() : end].encode()), np.uint32)
                start = end
            yield ordinary(part[start:])


def encoder(path: str) -> Encoder:
    """The encoder of a ranks file, kept for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: each whole text's ids and ``end_id``, cut into pieces.

    Only documents of more than ``max_tokens`` are cut. All pieces but the first are
    full. A null or empty text is ``end_id`` alone. One text's ids are in memory at a time.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows: list[list] = [[] for _ in names]
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    ids = np.append(encode(text).astype("<u4"), np.array([end_id], "<u4"))
                    n = -(-len(ids) // max_tokens)
                    start, stop = 0, len(ids) - (n - 1) * max_tokens
                    for piece in range(n):
                        own = ids[start:stop]
                        for column, x in zip(rows, (doc_id, piece, start, stop - start, zlib.crc32(own.tobytes()), own.astype(np.int32))):
                            column.append(x)
                        start, stop = stop, stop + max_tokens
                kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def enumerate_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Patterns of one to four lengths that fill ``size``, as rows of four lengths (0: none).

    All pairs, and triples and quadruples whose inner lengths lie on a grid; so there
    are some ten thousand at most, whatever the number of documents.
    """
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    a = np.arange(size + 1)
    out = [np.array([[size, 0, 0, 0]])]
    pair = np.stack([a, size - a, 0 * a, 0 * a], 1)[: size // 2 + 1]
    step3, step4 = max(1, size // 128), max(1, size // 32)
    b3 = np.arange(step3, size, step3)
    x, y = (v.ravel() for v in np.meshgrid(a, b3, indexing="ij"))
    triple = np.stack([x, y, size - x - y, 0 * x], 1)
    b4 = np.arange(step4, size, step4)
    x, y, z = (v.ravel() for v in np.meshgrid(a, b4, b4, indexing="ij"))
    four = np.stack([x, y, z, size - x - y - z], 1)
    out += [pair, triple[triple[:, 2] > 0], four[(four[:, 3] > 0) & (four[:, 1] <= four[:, 2])]]
    rows = np.sort(np.concatenate(out), axis=1)[:, ::-1]
    rows = rows[(there | (a == 0))[rows].all(axis=1) & (rows.sum(axis=1) == size)]
    return np.unique(rows, axis=0)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeat counts whose lengths come closest to the histogram.

    Accelerated projected gradient steps; a pattern has at most four lengths, so a
    product with the pattern matrix is a gather or a weighted bincount.
    """
    n = len(histogram)
    if not len(patterns):
        return np.zeros(0)
    used = (patterns > 0).astype(float)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns.ravel(), (used * x[:, None]).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[patterns] * used).sum(axis=1)

    v = np.random.default_rng(0).random(len(patterns))
    for _ in range(20):  # the largest singular value, for the step
        v = back(lengths_of(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(lengths_of(y) - histogram))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_packing(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Runs ``(lengths, repeats)`` that use every document of the histogram once.

    Fitted patterns are rounded down and taken while their lengths last, and what is left
    is fitted again, ``FITS`` times in all. The rest
    is packed by best fit: the longest piece, then always the longest that still fits; such a
    run is repeated until one of its lengths is used up. The input has a row for each
    length up to ``size`` and so is bounded, and so is the plan.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    runs: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...], most: int) -> None:
        n = min([most, *(int(left[x]) // pattern.count(x) for x in pattern)])
        if n > 0:
            for x in pattern:
                left[x] -= n
            runs.append((pattern, n))

    take((size,), int(left[size]))
    for _ in range(FITS):
        patterns = enumerate_patterns(np.nonzero(left)[0], size)
        counts = fit_counts(patterns, left.astype(float))
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] < 1:
                break
            take(tuple(int(x) for x in patterns[k] if x), int(counts[k] + 1e-6))
    while left.any():
        room, pattern, there = size, [], left.copy()
        while room and (fits := np.nonzero(there[: room + 1])[0]).size:
            pattern.append(int(fits[-1]))
            there[fits[-1]] -= 1
            room -= pattern[-1]
        take(tuple(pattern), int(left.max()))
    return runs


def pack(pieces: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows ``(doc_id, piece, length, ...)``.

    Only the histogram goes to the driver: a row for each length up to ``size``. Documents of
    a length are numbered within hashed buckets, with the buckets' counts added up
    before, so that a length that a third of all documents have is still spread. A row's
    number decides its place in the plan; equal rows get numbers of their own.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < k <= size for k in histogram):
        raise ValueError(f"lengths must lie from 1 to {size}")
    starts: dict[int, list[tuple[int, int, int]]] = {}
    done: dict[int, int] = {}
    sequence = 0
    for pattern, n in plan_packing(histogram, size):
        offset = 0
        for length in pattern:
            first = done.get(length, 0)
            starts.setdefault(length, []).append((first, sequence, offset))
            done[length] = first + n
            offset += length
        sequence += n
    plan = {k: tuple(np.array(x) for x in zip(*v)) for k, v in starts.items()}

    # neither a bucket nor a length's list of buckets grows faster than the square root of the rows
    buckets = [max(1, -(-n // max(ROWS_A_BUCKET, isqrt(n)))) for n in (histogram.get(k, 0) for k in range(size + 1))]
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)[F.col("length").cast("int")]))
    sizes = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_b", (F.sum("_n").over(W.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    ranked = keyed.withColumn("_r", rank).join(before, ["length", "_b"]).withColumn("_r", F.col("_r") + F.col("_before")).select(*pieces.columns, "_r")
    names = pieces.columns
    length_at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(length_at).to_numpy(zero_copy_only=False)
            ranks = batch.column(len(names)).to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                own = np.nonzero(lengths == length)[0]
                first, ids, at = plan[int(length)]
                k = np.searchsorted(first, ranks[own], side="right") - 1
                sequences[own] = ids[k] + ranks[own] - first[k]
                offsets[own] = at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequences), pa.array(offsets)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Place of every document's pieces in sequences of 1024 tokens. Tokens are made once and written."""
    return pack(stored(tokenize(docs, with_ids=False), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
