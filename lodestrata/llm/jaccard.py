"""Exact Jaccard join of documents by PartEnum signatures, up to connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, mix64, stored, table, text_or_empty
from .components import connected_components
from .shingles import set_digest, shingle_sets, sorted_groups

SHINGLE = 3
NUM, DEN = 90, 100
#: Features of a block of documents that are compared in one task.
BLOCK_FEATURES = 400_000
#: Texts whose signatures are met within the task before the shuffle.
LOCAL_BYTES = 8_000_000
#: Logarithm of the bits of the largest filter of documents (8 MB).
FILTER_BITS = 26


@lru_cache(maxsize=None)
def bands(num: int, den: int, most: int = 2**33) -> np.ndarray:
    """Lowest sizes of the bands; sets that can reach ``num/den`` lie in one band or in two neighbours."""
    lows = [1]
    while lows[-1] < most:
        lows.append(max(lows[-1] + 1, lows[-1] * den // num + 1))
    return np.array(lows)


@lru_cache(maxsize=4096)
def layout(tag: int, num: int, den: int) -> tuple[int, int, int, np.ndarray]:
    """First-level parts, differences that a part may hold, second-level parts, and the subsets to enumerate for a tag's sets.

    Two linked sets of at most ``hi`` features differ in ``k`` of them at most. With ``n1 * (k2 + 1) > k``
    some first-level part holds ``k2`` differences at most, and so some ``n2 - k2`` of its ``n2`` parts hold none.
    Where that leaves few features to a signature (thresholds below nine tenths), small sets enumerate more
    subsets, and large ones have a fifth more parts than that takes, so that :func:`signatures` can pass over their thinnest.
    """
    hi = int(bands(num, den)[tag + 1]) - 1
    k = 2 * hi * (den - num) // (den + num)
    if k <= 5:
        n1, k2, n2 = 1, k, k + 3
    elif 9 * (den - num) <= den:
        n1, k2, n2 = -(-(k + 1) // 2), 1, 3
    elif k > 24:
        n1, k2, n2 = -(-6 * (k + 1) // 10), 1, 3
    else:
        n1, k2, n2 = -(-(k + 1) // 5), 4, 8
    chosen = list(combinations(range(n2), n2 - k2))
    subsets = np.zeros((len(chosen), n2), np.uint64)
    for row, own in zip(subsets, chosen):
        row[list(own)] = 1
    return n1, k2, n2, subsets


def signatures(h: np.ndarray, num: int, den: int, every: bool = False) -> np.ndarray:
    """The signatures of one set, under the tag of its band and that of the next. Sets that link share one for certain.

    A set of ``n`` features differs from one that links to it in so many at most that among any ``need`` of its first-level parts one
    holds ``k2`` differences at most. Its level is the largest count such that in ``need`` parts every subset holds so many
    features; signatures of fewer features, which unrelated texts share, are left out. That loses no link: the
    signature that two sets share by the parts of the higher level holds that many features in both, so both enumerate it.
    With ``every`` those are enumerated too.
    """
    if not len(h):
        return np.empty(0, np.uint64)
    band = int(np.searchsorted(bands(num, den), len(h), side="right")) - 1
    place = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
    worth = mix64(h + np.uint64(0x14057B7EF767814F))
    out = []
    for tag in (band, band + 1):
        n1, k2, n2, subsets = layout(tag, num, den)
        cell = ((place >> np.uint64(32)) % np.uint64(n1)) * np.uint64(n2) + (place & np.uint64(0xFFFFFFFF)) % np.uint64(n2)
        cells = np.zeros(n1 * n2, np.uint64)
        np.add.at(cells, cell, worth)
        sums = (cells.reshape(n1, 1, n2) * subsets).sum(axis=2, dtype=np.uint64)
        own = np.uint64(tag << 40) + (np.arange(n1, dtype=np.uint64) << np.uint64(12))[:, None] + np.arange(len(subsets), dtype=np.uint64)
        found = mix64(mix64(own) + sums)
        if not every:
            other = min(int(bands(num, den)[tag + 1]) - 1, len(h) * den // num)
            need = (len(h) + other) * (den - num) // (den + num) // (k2 + 1) + 1
            counts = np.bincount(cell.astype(np.int64), minlength=n1 * n2).astype(np.uint64)
            held = (counts.reshape(n1, 1, n2) * subsets).sum(axis=2, dtype=np.uint64)
            found = found[held >= np.sort(held.min(axis=1))[n1 - need]]
        out.append(found.ravel())
    return np.concatenate(out)


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, n_shingles, d1, d2)``: each set's size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            d = [set_digest(h) for h in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64())],
                ["doc_id", "n_shingles", "d1", "d2"],
            )

    return _bytes(docs).mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))


def candidate_edges(docs: DataFrame, n: int, num: int, den: int, every: bool = False) -> DataFrame:
    """``(u, v)``: each document with the smallest one that has a signature of its own.

    Within a task, signatures of a few megabytes of text are met first: the smallest document
    stands for the others there, and only its row is shuffled. So a signature of a third of
    all documents costs a few rows for each task.
    """

    def met(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        each = [signatures(sets[i], num, den, every) for i in order]
        own = np.repeat(np.asarray(ids, np.int64)[order], [len(s) for s in each])
        keys = np.concatenate([*each, np.empty(0, np.uint64)])
        key, first, back = np.unique(keys, return_index=True, return_inverse=True)
        hub = own[first]
        pairs = np.unique(np.stack([own, hub[back]], 1)[own != hub[back]], axis=0)
        none = np.zeros(len(pairs), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key.astype(np.int64), none])),
                pa.array(np.concatenate([hub, pairs[:, 0]])),
                pa.array(np.concatenate([np.full(len(key), -1), pairs[:, 1]]), mask=np.concatenate([np.ones(len(key), bool), none > 0])),
            ],
            ["sig", "u", "v"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size > LOCAL_BYTES:
                    yield met(ids, shingle_sets(texts, n))
                    ids, texts, size = [], [], 0
            yield met(ids, shingle_sets(texts, n))

    rows = _bytes(docs).filter("doc_id is not null").mapInArrow(run, "sig long, u long, v long")
    # one exchange by signature; local pairs pass under their own ends
    keyed = rows.select(F.when(F.col("v").isNull(), F.col("sig")).otherwise(F.xxhash64("u", "v")).alias("sig"), "u", "v")
    least = F.min("u").over(W.partitionBy("sig", F.col("v").isNull()))
    return keyed.select("u", F.coalesce("v", least).alias("v")).filter("u <> v").distinct()


def compare(sizes: np.ndarray, feats: list[np.ndarray], asking: np.ndarray, asked: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links ``(x, y)`` between the documents ``asking`` and those ``asked`` (numbers), as trees: all that a link joins already is left out."""
    n = len(sizes)
    values = np.concatenate(feats)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(values, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posted = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    at = np.concatenate([[0], np.cumsum(sizes)])
    may = np.zeros(n, bool)
    may[asked] = True
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    for x in asking.tolist():
        own = code[at[x] : at[x + 1]]
        a, m = begin[own], begin[own + 1] - begin[own]
        hits = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())
        both = np.bincount(posted[hits], minlength=n)
        for y in np.nonzero(may & (den * both >= num * (sizes[x] + sizes - both)))[0].tolist():
            a, b = root(x), root(y)
            if a != b:
                parent[b] = a
                found.append((x, y))
    return found


def _blocks(groups: DataFrame, block_features: int) -> DataFrame:
    """``(component, doc_id, n_shingles, block, hub)``: components laid out by size and cut into blocks of about ``block_features`` features.

    Features are added up by component and size first; documents of one size are dealt to the blocks of their range by hash. So
    the sums run over the distinct sizes of a component, whatever the number of its documents.
    """
    by_size = groups.groupBy("component", "n_shingles").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    own = W.partitionBy("component")
    before = F.sum(F.col("n") * F.col("n_shingles")).over(own.orderBy("n_shingles")) - F.col("n") * F.col("n_shingles")
    sizes = by_size.withColumns({"before": before, "members": F.sum("n").over(own), "hub": F.min("least").over(own)}).filter("members > 1")
    first = F.floor(F.col("before") / block_features)
    many = F.floor((F.col("before") + F.col("n") * F.col("n_shingles") - 1) / block_features) - first + 1
    # stored, so that the join with a size that very many documents of a component have can be split
    ranges = stored(sizes.select("component", "n_shingles", "hub", first.alias("first"), many.alias("many")), "ranges")
    dealt = groups.select("component", "doc_id", "n_shingles").join(ranges, ["component", "n_shingles"])
    return dealt.select("component", "doc_id", "n_shingles", "hub", (F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("many"))).alias("block"))


def _perhaps(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is among ``ids``, and a few others, without a shuffle of ``docs``.

    Each id sets two bits of a word of 64 (a Bloom filter), and the words are broadcast: 8 bits for each id, ``FILTER_BITS`` in all at most.
    Beyond that more others pass, and none of ``ids`` is left out.
    """
    words = 1 << max(0, min(FILTER_BITS, (8 * ids.count()).bit_length()) - 6)
    h = F.xxhash64("doc_id")
    word = F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(words - 1))
    first, second = F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))"), F.expr("shiftleft(1L, cast(shiftrightunsigned(xxhash64(doc_id), 6) & 63 as int))")
    own = first.bitwiseOR(second)
    filled = ids.groupBy(word.alias("_word")).agg(F.bit_or(own).alias("_bits"))
    met = docs.join(F.broadcast(filled), word == F.col("_word"))
    return met.filter(F.col("_bits").bitwiseAND(own) == own).select(*docs.columns)


def _in_tasks(docs: DataFrame, wanted: DataFrame, n: int, run: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> DataFrame:
    """``(u, v)`` from each task's group of ``wanted(doc_id, task, role)``, with the documents' sorted features as ``feats``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(batch.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h in found], pa.list_(pa.int64())), batch.column(2)], ["doc_id", "feats", "tasks"]
            )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in sorted_groups(batches, "task"):
            found += run(group)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 2, ["u", "v"])

    tasks = stored(wanted.groupBy("doc_id").agg(F.collect_set(F.struct("task", "role")).alias("tasks")), "tasks")
    # merged at every size: few tasks would be broadcast, many would not
    texts = _perhaps(_bytes(docs), tasks).join(tasks.hint("merge"), "doc_id").select("doc_id", "data", "tasks")
    rows = texts.mapInArrow(sets, "doc_id long, feats array<long>, tasks array<struct<task:long,role:int>>").select("doc_id", "feats", F.inline("tasks"))
    return rows.repartition("task").sortWithinPartitions("task", "doc_id", "role").mapInArrow(each, "u long, v long")


def _members(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, roles and features of a task's documents, each id once, with its largest role."""
    ids, role = group["doc_id"].to_numpy(), group["role"].to_numpy()
    last = np.append(ids[1:] != ids[:-1], True)
    feats = group["feats"].combine_chunks()
    values, offsets = feats.values.to_numpy(), feats.offsets.to_numpy()
    return ids[last], role[last], [values[offsets[i] : offsets[i + 1]] for i in np.nonzero(last)[0]]


HUB, ASKED, FAR = 0, 1, 2


def verified_edges(docs: DataFrame, groups: DataFrame, n: int, num: int, den: int, block_features: int = BLOCK_FEATURES) -> DataFrame:
    """Links between the documents of each candidate component ``groups(doc_id, component, n_shingles)``.

    A component is laid out by size and cut into blocks of bounded features. In each block all documents are met with the component's hub
    (its first document), and those that don't link to it with all of the block. Where a component has more blocks, the documents that
    are apart from the hub are then met with the other blocks whose sizes can link. No pairs of documents are emitted, only trees of links.
    """

    def within(group: pa.Table) -> Iterator[tuple[int, int]]:
        ids, role, feats = _members(group)
        if len(ids) < 2:
            return
        sizes, h = np.array([len(x) for x in feats]), int(np.nonzero(role == HUB)[0][0]) if (role == HUB).any() else 0
        near = np.zeros(len(ids), bool)
        near[h] = True
        for x, y in compare(sizes, feats, np.array([h]), np.arange(len(ids)), num, den):
            near[y] = True
            yield int(ids[x]), int(ids[y])
        far = np.nonzero(~near)[0]
        if len(far):
            for x, y in compare(sizes, feats, far, np.arange(len(ids)), num, den):
                yield int(ids[x]), int(ids[y])
            # a link to itself tells that a document is apart from the hub
            yield from ((int(ids[x]), int(ids[x])) for x in far)

    def across(group: pa.Table) -> Iterator[tuple[int, int]]:
        ids, role, feats = _members(group)
        far, asked = np.nonzero(role == FAR)[0], np.nonzero(role == ASKED)[0]
        if len(far) and len(asked):
            for x, y in compare(np.array([len(x) for x in feats]), feats, far, asked, num, den):
                yield int(ids[x]), int(ids[y])

    placed = stored(_blocks(groups, block_features), "blocks")
    task = F.xxhash64("component", "block").alias("task")
    # the hub's row in its own block is a member like any other
    hubs = placed.select("component", "block", F.col("hub").alias("doc_id")).distinct()
    wanted = placed.filter("doc_id <> hub").select("doc_id", task, F.lit(ASKED).alias("role")).unionByName(hubs.select("doc_id", task, F.lit(HUB).alias("role")))
    first = stored(_in_tasks(docs, wanted, n, within), "links")
    links = first.filter("u <> v")

    far = first.filter("u = v").select(F.col("u").alias("doc_id")).distinct().join(placed, "doc_id")
    others = placed.groupBy("component", F.col("block").alias("other")).agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    fits = (F.col("block") != F.col("other")) & (den * F.col("hi") >= num * F.col("n_shingles")) & (den * F.col("n_shingles") >= num * F.col("lo"))
    between = F.xxhash64("component", "block", "other").alias("task")
    asking = far.join(others, "component").filter(fits).select("component", "doc_id", "block", "other", between)
    asking = stored(asking, "asking")
    if asking.isEmpty():
        return links
    pairs = asking.select("component", "other", "task").distinct()
    asked = placed.withColumnRenamed("block", "other").join(pairs, ["component", "other"]).select("doc_id", "task", F.lit(ASKED).alias("role"))
    more = asking.select("doc_id", "task", F.lit(FAR).alias("role")).unionByName(asked)
    return links.unionByName(_in_tasks(docs, more, n, across))


def jaccard_components(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN, every: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest document that links of ``den * |A and B| >= num * |A or B|`` reach.

    Sets are of ``n``-word shingles; a text of fewer words is one shingle, and one without
    words (or null) is empty and linked with nothing. Documents with equal sets are one class,
    of which one document is compared. Signatures give candidates and candidate components;
    within these, each pair of classes that can link is met exactly, so all links are found; for ``every`` see :func:`signatures`. A row with a null
    ``doc_id`` links with nothing and has a null component; repeated rows give equal rows. Columns beside
    ``doc_id`` and ``text`` are ignored.
    """
    sizes = stored(set_sizes(docs, n), "sizes")
    filled = sizes.filter("n_shingles > 0")
    classes = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # stored, so that the join with a class that very many documents share can be split
    copied = stored(classes.filter("copies > 1").drop("copies"), "classes")
    same = stored(filled.join(copied, ["n_shingles", "d1", "d2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "same")
    near = candidate_edges(docs, n, num, den, every)
    groups = connected_components(near.unionByName(same))
    reps = sizes.join(same.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    members = groups.withColumnRenamed("node", "doc_id").join(reps, "doc_id").select("doc_id", "component", "n_shingles")
    links = verified_edges(docs, members, n, num, den)
    final = connected_components(links.unionByName(same)).withColumnRenamed("node", "doc_id")
    discard(copied, same)
    return sizes.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


_JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
ORACLE_SQL = {"op7_ngram_jaccard_join": _JACCARD}
QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
