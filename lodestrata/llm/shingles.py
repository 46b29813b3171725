"""Hashed sets of word shingles, vectorised over batches of texts, and streaming over sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
#: Texts are hashed together up to so many bytes.
CHUNK_BYTES = 2_000_000


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of ``STEP`` modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 64), STEP, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the runs of bytes other than space and 0x09 to 0x0D."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = (b != 32) & ((b < 9) | (b > 13))
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts = np.nonzero(edge == 1)[0]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    ends = np.append(np.nonzero(edge == -1)[0], len(b))[: len(starts)]
    at = np.nonzero(word)[0]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    sums = np.add.reduceat(BYTE[b[at]] * powers(int(lengths.max()))[place], first)
    return starts, mix64(sums ^ lengths.astype(np.uint64))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words is one shingle as a whole; one without words has none.
    """
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES):
            size += len(texts[j]) + 1
            j += 1
        sizes = np.array([len(t) + 1 for t in texts[i:j]])
        starts, words = word_hashes(b"\n".join(texts[i:j]).lower())
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        rolled = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            whole = words[: len(words) - n + 1].copy()
            for k in range(1, n):
                whole = mix64(whole * STEP + words[k : len(words) - n + 1 + k])
            rolled[: len(whole)] = whole
        for k in range(j - i):
            a, e = bounds[k], bounds[k + 1]
            if e - a >= n:
                out.append(np.unique(rolled[a : e - n + 1]))
            elif e > a:
                few = mix64(words[a : a + 1] + np.uint64(e - a))
                for w in words[a + 1 : e]:
                    few = mix64(few * STEP + w)
                out.append(few)
            else:
                out.append(np.empty(0, np.uint64))
        i = j
    return out


def set_digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits over a set, in whatever order."""
    a = mix64(h + np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix64(h * np.uint64(0xD6E8FEB86659FD93)), initial=np.uint64(0))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in a partition sorted by it, each as a table. One run is in memory at a time, beside its batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(batch.schema.names.index(key)).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
