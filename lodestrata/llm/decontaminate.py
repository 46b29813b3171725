"""Benchmark decontamination by the q-gram lemma over diagonal bands and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, stored, table, text_or_empty

Q = 12
EDIT_SHARE = 0.06
#: Bytes of benchmark text that are indexed, and broadcast with a task, at a time.
BLOCK_BYTES = 4_000_000
FILTER_BITS = 22
#: A q-gram that an item holds more often is counted by a bound, not place by place.
OFTEN = 16
#: A q-gram that more items hold is counted by a bound as well; shorter ones are shared by chance, so their limits are higher.
COMMON = 8
LEVELS = {8: 32, 6: 128, 5: 256, 4: 512}
#: Part of the least number of shared q-grams (or of an item's length) that has to be among the counted ones.
SHARE = 0.125
#: Places of q-grams that are laid out at a time.
HITS_AT_ONCE = 1_000_000


def normalized(data: bytes) -> bytes:
    """A-Z in lower case and white space runs as one space."""
    return b" ".join(data.lower().split())


def gram_hashes(data: bytes, q: int = Q) -> np.ndarray:
    """A hash of each window of ``q`` bytes, 4 to 16."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if q < 8:
        return mix64(np.ndarray((n,), "<u4", data, 0, (1,)).astype(np.uint64) << np.uint64(32) | np.ndarray((n,), "<u4", data, q - 4, (1,)))
    low = np.ndarray((n,), "<u8", data, 0, (1,))
    high = np.ndarray((n,), "<u8", data, q - 8, (1,))
    return mix64(low * np.uint64(0x9E3779B97F4A7C15) ^ high)


class Postings:
    """Places ``(item, place)`` of the q-grams of some items, with the least number of counted q-grams that a match shares.

    An item of ``m`` bytes with ``e`` edits shares ``m - q + 1 - q * e`` of its q-grams at least. Not counted are those
    that it holds more than ``OFTEN`` times, or that stand in more than ``common`` items (a frame that many items share);
    any number of them may be shared, so the bound is lower by as many.
    """

    def __init__(self, texts: dict[int, bytes], edits: np.ndarray, q: int, common: int):
        self.q = q
        numbers = np.array(list(texts), np.int64)
        grams = [gram_hashes(t, q) for t in texts.values()]
        keys = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(numbers, [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams), np.empty(0, np.int32)])
        order = np.lexsort((item, keys))
        keys, item, place = keys[order], item[order], place[order]
        # places of one q-gram in one item
        first = np.nonzero(np.append(True, (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])))[0] if len(keys) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        _, which, items = np.unique(keys[first], return_inverse=True, return_counts=True)
        counted = (n <= OFTEN) & (items[which] <= common)
        left_out = np.bincount(item[first], np.where(counted, 0, n), len(edits)).astype(np.int64)
        self.rest = np.zeros(len(edits), np.int64)
        lengths = np.fromiter(map(len, texts.values()), np.int64, len(texts))
        self.rest[numbers] = lengths - q + 1 - q * edits[numbers] - left_out[numbers]
        self.all = keys, item, place, np.repeat(counted, n), first

    def keep(self, mine: np.ndarray) -> Postings:
        """Only the counted q-grams of the items that ``mine`` marks."""
        keys, item, place, counted, _ = self.all
        own = counted & mine[item]
        self.keys, self.first, self.stop, self.item, self.place = *_postings(keys[own]), item[own].astype(np.int32), place[own]
        del self.all
        return self


class GramIndex:
    """The q-grams of benchmark items, with the budget of edits of each.

    Where the budget leaves no q-gram to be shared, it is lowered until it does. An item is looked for by the longest
    q-grams of ``LEVELS`` of which a match shares a ``SHARE`` of its length at least, those left out that many items hold:
    items that share a frame are told apart by shorter q-grams of the rest. Where no length will do, any place with
    enough of the longest ones is aligned. Items of fewer than ``q`` bytes are searched for exactly, as whole words.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], q: int = Q, edit_share: float = EDIT_SHARE):
        self.q = q
        self.ids = [i for i, t in items if len(t) >= q]
        # one search for each distinct short text, whatever the number of items
        self.short: dict[bytes, list[int | None]] = {}
        for i, t in items:
            if 0 < len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.texts = [t for _, t in items if len(t) >= q]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.minimum((lengths * edit_share).astype(np.int64), (lengths - q) // q)
        self.least = lengths - q + 1 - q * self.edits
        self.levels: list[Postings] = []
        left = np.ones(len(self.texts), bool)
        for size, common in {q: COMMON, **{k: n for k, n in LEVELS.items() if k < q}}.items():
            if left.any():
                level = Postings({i: self.texts[i] for i in np.nonzero(left)[0].tolist()}, self.edits, size, common)
                mine = left & (level.rest > np.minimum(self.least, lengths) * SHARE)
                if size == q:
                    whole = level.all
                if mine.any():
                    self.levels.append(level.keep(mine))
                left &= ~mine
        self.by_density = left
        if len(self.texts):
            keys, item, _, _, first = whole
            one = first[self.by_density[item[first]]]
            self.dense_keys, self.dense_first, self.dense_stop, self.dense_item = *_postings(keys[one]), item[one]
        else:
            self.dense_keys = np.empty(0, np.uint64)
        self.maybe = {}
        for size, keys in [*((level.q, level.keys) for level in self.levels), (q, self.dense_keys)]:
            bits = self.maybe.setdefault(size, np.zeros(1 << FILTER_BITS, bool))
            bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, text: bytes) -> list[tuple[int | None, int, int, int]]:
        """``(item_id, start, stop, edits)`` of the normalized text: the best place for each item and region within its budget."""
        found: dict[tuple[int, int, int], int] = {}
        for size, bits in self.maybe.items():
            h = gram_hashes(text, size)
            at = np.nonzero(bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
            if not len(at):
                continue
            more = [self.near(level, text, at, h[at]) for level in self.levels if level.q == size]
            if size == self.q:
                more.append(self.dense(text, at, h[at]))
            for part in more:
                for key, e in part.items():
                    found[key] = min(e, found.get(key, e))
        return [(self.ids[i], a, b, e) for i, a, b, e in _best(found)] + self.exact(text)

    def exact(self, text: bytes) -> list[tuple[int | None, int, int, int]]:
        """The places of items shorter than ``q`` bytes, between any bytes that aren't letters, digits or above 127."""
        out = []
        for item, ids in self.short.items():
            at, last = text.find(item), 0
            while at >= 0:
                stop = at + len(item)
                if at >= last and not _joins(text[max(0, at - 1) : at], item[:1]) and not _joins(item[-1:], text[stop : stop + 1]):
                    out += [(i, at, stop, 0) for i in ids]
                    last = stop
                at = text.find(item, at + 1)
        return out

    def near(self, level: Postings, text: bytes, at: np.ndarray, h: np.ndarray) -> dict[tuple[int, int, int], int]:
        """``{(item, start, stop): edits}`` by the number of an item's q-grams in a band of diagonals.

        Hits are laid out about ``HITS_AT_ONCE`` at a time, in order of the text, and only counts by item and band are kept. A q-gram at
        the seam of two such parts may count twice, which lets more bands through to the alignment, never fewer.
        """
        at, k = _looked_up(level.keys, at, h)
        if not len(at):
            return {}
        m = level.stop[k] - level.first[k]
        parts = np.split(np.arange(len(at)), np.nonzero(np.diff(np.cumsum(m) // HITS_AT_ONCE))[0] + 1)

        def hits(own: np.ndarray) -> np.ndarray:
            return np.repeat(level.first[k[own]] - (np.cumsum(m[own]) - m[own]), m[own]) + np.arange(m[own].sum())

        total = np.zeros(len(self.texts), np.int64)
        for own in parts:
            total += np.bincount(level.item[hits(own)], minlength=len(total))
        enough = total >= level.rest
        longest = max(map(len, self.texts))
        stride, span = len(text) + longest + 3, longest + 1
        pairs = counts = np.empty(0, np.int64)
        for own in parts if enough.any() else ():
            hit, where = hits(own), np.repeat(at[own], m[own])
            keep = enough[level.item[hit]]
            item, place, where = level.item[hit[keep]].astype(np.int64), level.place[hit[keep]].astype(np.int64), where[keep]
            # bands of 2e + 1 diagonals that overlap by half: each run of e + 1 diagonals lies in one of them
            low = item * stride + (where - place + longest) // (self.edits[item] + 1)
            once = np.unique(np.concatenate([low, low + 1]) * span + np.tile(place, 2))  # each q-gram of the item counts once
            new, n = np.unique(once // span, return_counts=True)
            pairs, back = np.unique(np.concatenate([pairs, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
        found: dict[tuple[int, int, int], int] = {}
        for pair in pairs[counts >= level.rest[pairs // stride]].tolist():
            i, band = divmod(pair, stride)
            width = int(self.edits[i]) + 1
            first = (band - 1) * width - longest
            self._aligned(found, i, text, first - width + 1, first + 2 * width + len(self.texts[i]) + width - 1)
        return found

    def dense(self, text: bytes, at: np.ndarray, h: np.ndarray) -> dict[tuple[int, int, int], int]:
        """The same for items of few, often repeated q-grams: stretches with as many of those as a match shares are aligned piece by piece."""
        found: dict[tuple[int, int, int], int] = {}
        at, k = _looked_up(self.dense_keys, at, h)
        seen = np.unique(k)
        n = self.dense_stop[seen] - self.dense_first[seen]
        items = self.dense_item[np.repeat(self.dense_first[seen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        grams = np.repeat(seen, n)
        for i in np.unique(items).tolist():
            places, need = at[np.isin(k, grams[items == i])], int(self.least[i])
            reach = len(self.texts[i]) + int(self.edits[i])
            if len(places) < need:
                continue
            close = np.nonzero(places[need - 1 :] - places[: len(places) - need + 1] <= reach - self.q)[0]
            last = 0
            for j in close.tolist():
                lo, hi = max(int(places[j]) - reach, last), int(places[j + need - 1]) + self.q + reach
                # a match is no longer than ``reach``, so it lies in one of the pieces of twice that length
                while lo < hi and lo < len(text):
                    self._aligned(found, i, text, lo, lo + 2 * reach)
                    lo += reach
                last = max(last, lo)
        return found

    def _aligned(self, found: dict[tuple[int, int, int], int], i: int, text: bytes, start: int, stop: int) -> None:
        start = max(0, start)
        got = align(self.texts[i], text[start : max(stop, 0)], int(self.edits[i]))
        if got:
            key = (i, start + got[0], start + got[1])
            found[key] = min(got[2], found.get(key, got[2]))


def _postings(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sorted keys, and where each one's run starts and stops."""
    distinct, first = np.unique(keys, return_index=True)
    return distinct, first, np.append(first[1:], len(keys)).astype(np.int64) if len(keys) else np.empty(0, np.int64)


def _looked_up(keys: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the offsets those whose hash is a key, and its number."""
    if not len(keys):
        return at[:0], at[:0]
    k = np.searchsorted(keys, h)
    k[k == len(keys)] = 0
    own = keys[k] == h
    return at[own], k[own]


def _joins(left: bytes, right: bytes) -> bool:
    """Whether a word goes on from one byte to the next."""
    return all(x and (x >= b"\x80" or x.isalnum()) for x in (left, right))


def _best(found: dict[tuple[int, int, int], int]) -> list[tuple[int, int, int, int]]:
    """Overlapping regions of an item become the one with the fewest edits."""
    out: list[tuple[int, int, int, int]] = []
    for (item, a, b), e in sorted(found.items()):
        if out and out[-1][0] == item and a < out[-1][2]:
            if e < out[-1][3]:
                out[-1] = (item, a, b, e)
        else:
            out.append((item, a, b, e))
    return out


def fewest_edits(item: bytes, window: bytes) -> int:
    """The fewest edits between ``item`` and any part of ``window``: a column of the alignment at a time, as bits of one number."""
    m = len(item)
    where: dict[int, int] = {}
    for i, byte in enumerate(item):
        where[byte] = where.get(byte, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m  # where cells are one more, one less than those above; the last cell
    fewest = m
    for byte in window:
        same = where.get(byte, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        now += ((right & top) > 0) - ((left & top) > 0)
        if now < fewest:
            fewest = now
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
    return fewest


def align(item: bytes, window: bytes, budget: int) -> tuple[int, int, int] | None:
    """The place in ``window`` with the fewest edits from ``item``, if within the budget: start, stop, edits.

    The ends of the window are free. Whether any place fits is settled by :func:`fewest_edits`. Diagonals beyond the window's slack can't hold a match and aren't met.
    """
    at = window.find(item)
    if at >= 0:
        return at, at + len(item), 0
    if budget and fewest_edits(item, window) > budget:
        return None
    m, w = len(item), np.frombuffer(window, np.uint8)
    slack = len(window) - m + budget  # diagonals -budget .. slack
    if slack < 0 or not budget:
        return None
    n = slack + budget + 1
    big = m + len(w) + 1
    column = np.arange(-budget, slack + 1)
    cost = np.where((column >= 0) & (column <= len(w)), 0, big)
    begin = np.where(cost == 0, column, 0)
    ramp = np.arange(n)
    for i in range(m):
        j = i + column  # byte of the window on each diagonal
        inside = (j >= 0) & (j < len(w))
        step = cost + np.where(inside, w[np.clip(j, 0, max(0, len(w) - 1))] != item[i], big)
        gone = np.append(cost[1:] + 1, big)  # the item's byte is missing
        take = gone < step
        new, new_begin = np.where(take, gone, step), np.where(take, np.append(begin[1:], 0), begin)
        run = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == run, ramp, 0))
        cost, begin = run + ramp, new_begin[source]
        cost = np.where((i + 1 + column >= 0) & (i + 1 + column <= len(w)), cost, big)
        if cost.min() > budget:
            return None
    k = int(cost.argmin())
    return (int(begin[k]), m + int(column[k]), int(cost[k])) if cost[k] <= budget else None


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about ``block_bytes``, so that what is broadcast has a bound however large the benchmark is."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().cast("binary").alias("data"))
    total = items.agg(F.sum(F.length("data"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "data"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], normalized(bytes(r["data"]))) for r in own.orderBy("item_id", "data").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, start, stop, edits)``: where whole texts hold benchmark items within the budget of edits.

    Offsets are bytes of the text in lower case with white space runs as one space. The budget is
    ``edit_share`` of an item's length. Each block of the benchmark is met with all documents in one
    pass without a shuffle; where there are several, each one's places are written before the next is read. Null and empty texts and items give
    no rows, an item with a null id gives rows with a null ``item_id``; an item shorter than ``q`` bytes is
    found where it stands exactly, as whole words; repeated documents and items each give their own. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    schema = "doc_id long, item_id long, start long, stop long, edits int"
    sc = docs.sparkSession.sparkContext
    out, blocks = None, benchmark_blocks(benchmark, block_bytes)
    block = next(blocks, None)
    while block is not None:
        shared = sc.broadcast(GramIndex(block, q, edit_share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [
                    (doc_id, *region)
                    for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                    for region in index.regions(normalized(data.as_py()))
                ]
                columns = list(zip(*found)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "stop", "edits"])

        part, block = rows.mapInArrow(run, schema), next(blocks, None)
        if out is not None or block is not None:  # of several, one index is there at a time
            part = stored(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item. Null ids stay."""
    leaked = find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a benchmark item in a document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_benchmark_decontamination": op6_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
