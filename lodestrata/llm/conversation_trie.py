"""The trie of conversations' prefixes: verified nodes, their parents and what sharing them would save."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table
from .scans import running

#: Primes below 2^31, so that products of residues fit into 64 bits, and the bases of the polynomials.
MODULI, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 777_767_777)
#: Turns of a tie are told apart by so many characters before they are compared whole.
HEAD = 64
#: Ids that are put into one row before a node's digest is taken.
BLOCK = 1 << 14


def numbered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, role, text)``: every conversation's turns in order, from 1.

    Order is by turn, null first; ties are in the order of the first 64 characters of role and text, then of role and text,
    and equal rows are turns of their own. Null roles and texts are empty. Rows without ``conv_id`` belong to no
    conversation. Other columns are left out. No conversation is bound to one task.
    """
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    ranges = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.substring("role", 1, HEAD).asc(), F.substring("text", 1, HEAD).asc()]
    order = [*ranges, F.col("role").asc(), F.col("text").asc()]
    return running(rows, "conv_id", ranges, order, lambda batch: [np.ones(batch.num_rows)], {"pos": None}, "turns").select("conv_id", "pos", "role", "text")


def spliced(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(conv_id)`` and their rebuilt turns ``(conv_id, depth, role, text)``.

    Conversation c gets the first h turns of conversation c - c % ``every`` (all if fewer, none if it's absent), then its own
    after its first h; h is the unsigned CRC-32 of the decimal c, modulo ``heads``. The sign of c % ``every`` is that of c.
    """
    convs = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "convs")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(lengths, "base", "left")
    convs = stored(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("k")), "splices")
    lent = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "role", "text")
    first = convs.join(lent, "base").filter("depth <= k").select("conv_id", "depth", "role", "text")
    own = turns.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "role", "text")
    return convs.select("conv_id"), first.unionByName(own)


def _powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base % modulus, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % modulus, out)
        square, left = square * square % modulus, left >> 1
    return out


def fingerprinted(turns: DataFrame, moduli: Sequence[int] = MODULI) -> DataFrame:
    """``(conv_id, depth, role, text, fp, up_fp)``: the rolling fingerprints of the prefix that ends here and of the one before.

    A fingerprint is the polynomial of the turns' hashes in their depth, by each modulus: a running sum of terms.
    """

    def terms(batch: pa.RecordBatch) -> list[np.ndarray]:
        depth, h = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("depth", "h"))
        return [h % m * _powers(b, depth, m) % m for m, b in zip(moduli, BASES)]

    order = [F.col("conv_id").asc(), F.col("depth").asc()]
    rows = running(turns.withColumn("h", F.xxhash64("role", "text")), "conv_id", order, order, terms, {f"f{i}": m for i, m in enumerate(moduli)}, "prefixes")

    def joined(prefix: str):
        out = F.lit(0).cast("long")
        for i, m in enumerate(moduli):
            out = out * m + F.col(f"`{prefix}f{i}`")
        return out

    return rows.select("conv_id", "depth", "role", "text", joined("").alias("fp"), joined("before ").alias("up_fp"))


def verified(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, depth, fp, gen, up_fp, up_gen, n_bytes, rep_id)``: the class ``(depth, fp, gen)`` of every prefix, and its smallest conversation.

    Prefixes of one depth and fingerprint are a group; its representative is its smallest conversation. Every member's last
    turn is compared with that of the representative, and the classes of the prefixes before it as well, which by the same
    rule hold the turns before. Members that differ have collided: they go on as the next generation of their group, with a
    representative of their own, until none differs. Equal prefixes always stay together, as they meet the same
    representatives. Representatives are combined before the shuffle and joined as a written table, so that the rows of a hot
    group can be split.
    """
    gens = None
    key = ["depth", "fp", "gen"]
    while True:
        if gens is None:
            rows = prefixes.withColumns({"gen": F.lit(0), "up_gen": F.lit(0)})
        else:
            up = gens.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("gen").alias("up_gen"))
            rows = prefixes.join(gens, ["conv_id", "depth"]).join(up, ["conv_id", "depth"], "left").withColumn("up_gen", F.coalesce("up_gen", F.lit(0)))
        # the group's smallest conversation has the smallest of these structs
        least = stored(rows.groupBy(*key).agg(F.min(F.struct("conv_id", "up_fp", "up_gen", "role", "text")).alias("rep")), "representatives")
        same = F.lit(True)
        for c in ("up_fp", "up_gen", "role", "text"):
            same &= F.col(c) == F.col("rep")[c]
        joined = rows.join(least, key)
        checked = stored(joined.select("conv_id", *key, "up_fp", "up_gen", F.octet_length("text").cast("long").alias("n_bytes"), F.col("rep.conv_id").alias("rep_id"), same.alias("same")), "compared")
        discard(least)
        if checked.filter("not same").isEmpty():
            return checked.drop("same")
        gens = checked.select("conv_id", "depth", (F.col("gen") + F.when(F.col("same"), 0).otherwise(1)).alias("gen"))


def id_digests(ends: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(rep_id, depth, ends_sha256)`` from ``(rep_id, depth, conv_id)``: SHA-256 of the decimal ids, ascending, comma-joined.

    Ids are sorted by ranges, so that those of one node span tasks, and joined to blocks. A digest can only be taken from
    front to back; the task of a node reads its blocks as a stream, one at a time.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, depth, ids = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])])
            cuts = [c for a, b in zip(cuts, [*cuts[1:], len(ids)]) for c in range(a, b, block)]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([pa.array(rep[cuts]), pa.array(depth[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], ["rep_id", "depth", "first_id", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for rep, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if now == (rep, depth):
                    digest.update(b"," + ids.encode())
                else:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (rep, depth), hashlib.sha256(ids.encode())
            yield made(out)
        if now:
            yield made([(*now, digest.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        rep, depth, sha = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], ["rep_id", "depth", "ends_sha256"])

    order = ["rep_id", "depth", "conv_id"]
    rows = ends.select(F.col("rep_id").cast("long"), F.col("depth").cast("long"), F.col("conv_id").cast("long"))
    parts = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "rep_id long, depth long, first_id long, ids string"), "ids")
    return parts.repartition("rep_id", "depth").sortWithinPartitions("rep_id", "depth", "first_id").mapInArrow(hashed, "rep_id long, depth long, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame, moduli: Sequence[int] = MODULI) -> DataFrame:
    """The nodes of the trie of conversations ``members`` ``(conv_id)`` with ``turns`` ``(conv_id, depth, role, text)``, depths 1, 2, ...

    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: for every
    distinct prefix its smallest member, and likewise of its parent (the root, depth 0, has none); its members and children;
    the childless nodes below it, itself included; the bytes of last texts that its subtree's members share beyond the first;
    the digest of the members that end here. Conversations without turns are members of the root. No members give no rows.

    The roll-up takes no round for each level. A node's smallest member passes through all its ancestors, so what a node has
    to add is put on the row of that member at its depth; a running sum from each conversation's end upwards gives what is
    at or below each of its rows, and the sum over a node's members is what its subtree holds.
    """
    prefixes = fingerprinted(turns, moduli)
    paths = verified(prefixes)
    at = ["rep_id", "depth"]
    nodes = stored(paths.groupBy(*at).agg(F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min(F.struct("fp", "gen", "up_fp", "up_gen")).alias("of")).select(*at, "n_convs", "n_bytes", "of.*"), "nodes")
    root, n_members = members.agg(F.min("conv_id"), F.count("*")).first()
    above = nodes.select(F.col("rep_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"), F.col("fp").alias("up_fp"), F.col("gen").alias("up_gen"))
    top = members.sparkSession.createDataFrame([(root, 1, 0, 0)], above.schema)
    nodes = stored(nodes.join(stored(above.unionByName(top), "above"), ["depth", "up_fp", "up_gen"]).select(*at, "parent_conv_id", "n_convs", "n_bytes"), "parents")
    children = nodes.groupBy(F.col("parent_conv_id").alias("rep_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")
    own = nodes.select(F.col("rep_id").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    rows = paths.select("conv_id", *at).join(own, ["conv_id", "depth"], "left").select("conv_id", *at, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("saved", "leaf")])

    def terms(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("saved", "leaf")]

    upwards = [F.col("conv_id").asc(), F.col("depth").desc()]
    below = running(rows, "conv_id", upwards, upwards, terms, {"saved_tokens": None, "n_leaves": None}, "below")
    subtrees = below.groupBy(*at).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    whole = subtrees.filter("depth = 1").agg(*[F.coalesce(c, F.lit(0)).cast("long") for c in (F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens"))]).first()

    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "rep_id")).alias("end")).select("conv_id", "end.*")
    turnless = members.join(last, "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("rep_id"))
    ends = stored(id_digests(last.unionByName(turnless)), "ends")

    # the root's subtree is that of its children; where it has none, it is childless itself
    n_children, n_leaves, saved = whole
    columns = ["rep_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    first = members.sparkSession.createDataFrame([(root, 0, None, n_members, n_children, max(n_leaves, 1), saved)][: min(n_members, 1)], ", ".join(f"{c} long" for c in columns))
    rest = nodes.join(subtrees, at).select(*columns)
    out = stored(first.unionByName(rest), "trie").join(ends, at, "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(F.col("rep_id").alias("conv_id"), *counts, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share heads."""
    members, turns = spliced(numbered(table(spark, sf_dir, "conversations")))
    return prefix_trie(members, turns)


ORACLE_SQL = {
    "op12_conversation_prefix_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64), coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, count(*) AS n, list_reduce(list_prepend(4294967295::BIGINT,
        flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))) AS crc FROM t GROUP BY conv_id),
c AS (SELECT b.conv_id, b.conv_id - b.conv_id % 5 AS base, xor(b.crc, 4294967295) % 9 AS h, coalesce(o.n, 0) AS n_base
      FROM b LEFT JOIN b o ON o.conv_id = b.conv_id - b.conv_id % 5),
r AS (SELECT c.conv_id, t.pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= c.h
      UNION ALL SELECT c.conv_id, t.pos - c.h + least(c.h, c.n_base), role, text FROM c JOIN t USING (conv_id) WHERE t.pos > c.h),
p AS (SELECT conv_id, depth, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS key,
        coalesce(string_agg(sha256(length(role) || ':' || role || text), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS up,
        depth = max(depth) OVER (PARTITION BY conv_id) AS ends
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
      UNION ALL SELECT conv_id, 0, '', '', NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT depth, key, min(conv_id) AS conv_id, min(up) AS up, count(*) AS n_convs, min(strlen(text)) AS n_bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY depth, key),
k AS (SELECT up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
s AS (SELECT p.key, count_if(k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.n_bytes) AS saved
      FROM n LEFT JOIN k USING (key) JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n u ON u.key = n.up
"""
}
QUERIES = {"op12_conversation_prefix_trie": op12_conversation_prefix_trie}
