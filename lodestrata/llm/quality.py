"""Importance resampling of documents: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, stored, table, text_or_empty
from .shingles import BYTE, CHUNK_BYTES, STEP, word_hashes

#: Labelled documents that the models are fitted on, at most.
MAX_LABELLED = 50_000
SMOOTHING = 0.5
#: Ways to shrink a ratio of ``z`` standard deviations, as ``(p, c)``: it counts by the share ``z**p / (z**p + c)``. None is cut off.
SHRINKAGES = ((2, 25.0), (4, 400.0))
#: Parts of the labelled documents, each of which is scored by models fitted on the others.
FOLDS = 3
#: Of the good labelled documents, the share that sampling is to hold; sets k where that isn't given.
RECALL = 0.995
#: Bytes of the n-grams within words.
CHARS = 5
#: An n-gram that a document holds so often is one more feature.
OFTEN = 3
SEED = 17
#: Bits of a feature's bucket.
BITS = 20

_LETTERS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))
_SIGNS = bytes(32 if i >= 128 or chr(i).isalnum() else i for i in range(256))
_REPEAT = np.uint64(0x8BADF00DCAFE1234)


def ngram_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and hashes of their n-grams, with repeats: words, word pairs, runs of signs and ``CHARS`` bytes within words.

    Words are runs of ASCII letters and digits and of other bytes above 127, with A-Z in lower case. A pair of
    the same word twice is one feature for all words.
    """
    joined = b"\n".join(texts).lower()
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owners, hashes = [], []
    starts, words = word_hashes(joined.translate(_LETTERS))
    owner = np.searchsorted(bounds, starts, side="right")
    owners.append(owner)
    hashes.append(words)
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        pair = mix64(words[:-1] * STEP + words[1:])
        pair[words[:-1] == words[1:]] = _REPEAT
        owners.append(owner[1:][same])
        hashes.append(pair[same])
    starts, signs = word_hashes(joined.translate(_SIGNS))
    owners.append(np.searchsorted(bounds, starts, side="right"))
    hashes.append(mix64(signs + np.uint64(77)))
    b = np.frombuffer(joined.translate(_LETTERS), np.uint8)
    if len(b) >= CHARS:
        n = len(b) - CHARS + 1
        rolled, within = np.zeros(n, np.uint64), np.ones(n, bool)
        word = (b != 32) & ((b < 9) | (b > 13))
        for k in range(CHARS):
            rolled = rolled * STEP + BYTE[b[k : n + k]]
            within &= word[k : n + k]
        at = np.nonzero(within)[0]
        owners.append(np.repeat(np.arange(len(texts)), np.diff(bounds, prepend=0))[at])
        hashes.append(mix64(rolled[at] + np.uint64(CHARS)))
    return np.concatenate(owners), np.concatenate(hashes)


def feature_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and buckets of their distinct n-grams; an n-gram found ``OFTEN`` times or more has a second bucket."""
    owner, feature = ngram_features(texts)
    # 32 bits hold a pair of a few thousand texts, and sort in half the time
    kind = np.uint32 if len(texts) <= 1 << (32 - BITS) else np.uint64
    pairs, counts = _distinct(owner.astype(kind) << kind(BITS) | (feature >> np.uint64(64 - BITS)).astype(kind))
    low = kind((1 << BITS) - 1)
    often = pairs[counts >= OFTEN]
    more = (often & ~low) | (mix64((often & low).astype(np.uint64) * STEP + np.uint64(OFTEN)) >> np.uint64(64 - BITS)).astype(kind)
    pairs, _ = _distinct(np.concatenate([pairs, more]))
    return (pairs >> kind(BITS)).astype(np.int64), (pairs & low).astype(np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values and their counts."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def _chunks(ids: list, texts: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK_BYTES):
            size += len(texts[j])
            j += 1
        yield ids[i:j], texts[i:j]
        i = j


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, data, good, fold)`` of at most ``most`` labelled documents, those with the smallest hashes.

    A document labelled twice takes its lowest quality and highest toxicity; one with neither label is left out. The sample has a
    bound, so it is broadcast and the texts aren't shuffled.
    """
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    good = ((F.coalesce("q", F.lit(1)) == 1) & (F.coalesce("t", F.lit(0)) == 0)).cast("long").alias("good")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).alias("fold")
    chosen = one.filter("doc_id is not null and (q is not null or t is not null)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", good, fold)
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("data"))
    return rows.join(F.broadcast(chosen), "doc_id")


def count_features(sample: DataFrame, folds: int = FOLDS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the sample's documents, and of those that hold an n-gram of a bucket: ``[fold, good]`` and ``[fold, good, bucket]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2 * folds, 1 << BITS), np.int32)
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for rows, texts in _chunks(list(range(batch.num_rows)), batch.column(0).to_pylist()):
                owner, bucket = feature_buckets(texts)
                own = kind[np.asarray(rows)[owner]]
                for k in np.unique(own):
                    counts[k] += np.bincount(bucket[own == k], minlength=counts.shape[1]).astype(np.int32)
        held = np.nonzero(counts.any(axis=0))[0]
        for at in range(0, len(held), 1 << 16):
            own = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(c[own]) for c in counts)], names)

    names = ["f", *(f"n{k}" for k in range(2 * folds))]
    data = sample.select("data", (2 * F.col("fold") + F.col("good")).cast("int").alias("kind"))
    docs = np.zeros(2 * folds, np.int64)
    for r in data.groupBy("kind").count().collect():
        docs[r["kind"]] = r["count"]
    # at most a row for each bucket
    sums = data.mapInArrow(run, "f int" + "".join(f", {c} int" for c in names[1:])).groupBy("f").agg(*[F.sum(c).cast("int").alias(c) for c in names[1:]]).toArrow()
    counts = np.zeros((2 * folds, 1 << BITS), np.int32)
    held = sums.column("f").to_numpy()
    for own, c in zip(counts, names[1:]):
        own[held] = sums.column(c).to_numpy()
    del sums, held
    pa.default_memory_pool().release_unused()
    return docs.reshape(folds, 2), counts.reshape(folds, 2, -1)


def log_ratios(docs: np.ndarray, counts: np.ndarray, shrinkage: tuple[int, float], smoothing: float = SMOOTHING) -> np.ndarray:
    """The log ratio under the target and the raw model of each bucket, from ``[good]`` and ``[good, bucket]`` counts.

    Target text is the good rows of the sample, raw text all of them. A model gives a bucket the
    share of documents that hold one of its n-grams; counting documents keeps one long document from
    deciding. Ratios are smoothed and shrink towards 0 as the sample supports them less, so that
    many weak ones add up where they agree, and rare words of clean documents weigh next to nothing.
    """
    n, t = counts.sum(axis=0).astype(np.float32), counts[1].astype(np.float32)
    if not docs.all():
        return np.zeros(len(n), np.float32)
    share = docs[1] / docs.sum()
    p, c = shrinkage
    z = np.abs(t - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return (np.log((t + smoothing) / (n * share + smoothing)) * z**p / (z**p + c)).astype(np.float32)


class Model(NamedTuple):
    ratios: np.ndarray
    #: Of all documents, the share to sample.
    share: float


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise, a function of ``doc_id`` and ``seed``."""
    return -F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(2**53)))


def fit(sample: DataFrame, recall: float = RECALL, seed: int = SEED) -> Model:
    """The ratios of all of the sample, and the share of documents to sample.

    Each part of the sample is scored by ratios fitted on the other parts. The shrinkage is the one under which the
    fewest labelled documents have to be sampled, by weight and noise, until ``recall`` of the good ones are; that share of all documents is to be
    sampled. The sample's weights, a few for each labelled document, go to the driver. Without good or without other rows all ratios are 0 and the share is 1.
    """
    docs, counts = count_features(sample)
    if not docs.sum(axis=0).all():
        return Model(np.zeros(counts.shape[2], np.float32), 1.0)
    ratios = np.empty((len(SHRINKAGES), len(docs), counts.shape[2]), np.float32)
    for k in range(len(docs)):  # one part at a time: the driver holds few arrays of all buckets
        rest = counts.sum(axis=0) - counts[k]
        for own, s in zip(ratios[:, k], SHRINKAGES):
            own[:] = log_ratios(docs.sum(axis=0) - docs[k], rest, s)
    apart = sample.sparkSession.sparkContext.broadcast(ratios)
    del ratios, rest, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, good, noise, ids = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            for rows, texts in _chunks(list(range(batch.num_rows)), batch.column(0).to_pylist()):
                owner, bucket = feature_buckets(texts)
                own = fold[np.asarray(rows)]
                keys = [np.bincount(owner, ratios[own[owner], bucket], len(rows)) + noise[rows] for ratios in apart.value]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(good[rows]), *map(pa.array, keys)], ["doc_id", *names])

    names = ["good", *(f"k{k}" for k in range(len(SHRINKAGES)))]
    data = sample.select("data", F.col("fold").cast("int").alias("fold"), "good", gumbel(seed).alias("noise"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = data.mapInArrow(run, "doc_id long, good long" + "".join(f", {c} double" for c in names[1:]))
    # one row for each labelled id, however often its document is repeated
    scored = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names]).toArrow()
    apart.destroy()
    good = scored.column("good").to_numpy() > 0
    shares = []
    for c in names[1:]:
        keys = scored.column(c).to_numpy()
        least = np.sort(keys[good])[int((1 - recall) * good.sum())]
        shares.append(float((keys >= least).mean()))
    best = int(np.argmin(shares))
    return Model(log_ratios(docs.sum(axis=0), counts.sum(axis=0), SHRINKAGES[best]), shares[best])


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``(doc_id, log_weight)``: the sum of the log ratios of the buckets of a whole text's n-grams; 0 for an empty or null text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shared.value
        some = ratios.any()
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weights = np.zeros(len(ids))
                if some:
                    owner, bucket = feature_buckets(texts)
                    weights = np.bincount(owner, ratios[bucket], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weights, pa.float64())], ["doc_id", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, log_weight double")


def top_k(rows: DataFrame, key: str, k: int, tie: str = "doc_id", digits: int = 12) -> DataFrame:
    """The ``k`` rows of the largest ``key``, equal keys by smallest ``tie``, without a global sort.

    The k-th key is found by its bits, ``digits`` at a time: each pass counts the rows of the range by
    the next digit, and 4096 counts go to the driver. Only rows equal to that key are sorted.
    """
    if k <= 0:
        return rows.limit(0)
    bits = F.expr(f"cast(floor(({key}) * 1048576D) as bigint) + 4503599627370496L")  # 53 bits, in order
    keyed = rows.withColumn("_bits", F.greatest(F.lit(0).cast("long"), F.least(F.lit(2**53 - 1), bits)))
    low, shift, want = 0, 60, k
    while shift > 0:
        shift -= digits
        size = 1 << digits
        own = keyed.filter(F.col("_bits").between(low, low + (size << shift) - 1)) if low or shift < 48 else keyed
        digit = F.shiftrightunsigned(F.col("_bits") - low, shift)
        found = {r["d"]: r["n"] for r in own.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(found, reverse=True):
            if want <= found[d]:
                low += d << shift
                break
            want -= found[d]
        else:
            return rows  # fewer than k rows
    above = keyed.filter(F.col("_bits") > low)
    equal = keyed.filter(F.col("_bits") == low).withColumn("_n", F.row_number().over(W.partitionBy("_bits").orderBy(F.desc(key), tie)))
    return above.unionByName(equal.filter(F.col("_n") <= want).drop("_n")).drop("_bits")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = MAX_LABELLED, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``(doc_id, log_weight, key)`` of the ``k`` documents sampled by their importance weights, without replacement.

    ``key`` is the log weight plus standard Gumbel noise, a function of ``doc_id`` and
    ``seed``; the largest keys stay, which is a draw of ``k`` documents in proportion to their weights. Without ``k`` it is the share of all documents that ``fit``
    finds to hold ``recall`` of the good ones. Without labels all weights are 1 and all stay. Repeated ids share their noise; a null id is one more id.
    """
    model = fit(labelled_sample(docs, labels, most), recall, seed)
    keyed = stored(log_weights(docs, model.ratios).withColumn("key", F.col("log_weight") + gumbel(seed)), "weights")
    return top_k(keyed, "key", round(model.share * keyed.count()) if k is None else k)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that resampling keeps."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
