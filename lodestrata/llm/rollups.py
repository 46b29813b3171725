"""Token totals kept up to date by signed deltas that a ledger takes once a batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .common import stored, table, text_or_empty
from .packing import encoder, vocabulary_path

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def words(text: Column) -> Column:
    """Version ``words-1``: runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pieces(text: Column) -> Column:
    """Version ``pieces-2``: runs of ASCII letters and digits or of other non-space characters, each cut after 8 of its kind."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]{1,8}|[^A-Za-z0-9\x20\x09-\x0D]{1,8}")).cast("long")


#: Versions that are expressions over the text.
EXPRESSIONS: dict[str, Callable[[Column], Column]] = {"words-1": words, "pieces-2": pieces}
#: The version of the public byte-level BPE, whose vocabulary file is a parameter.
BPE = "byte-bpe-50k"


def count_tokens(docs: DataFrame, versions: Sequence[str] = ("words-1", BPE), keep: Sequence[str] = (), vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, *keep, tokenizer, n_tokens)``: the tokens of every whole text under each version.

    Versions are those of ``EXPRESSIONS`` and ``BPE``, whose tokens are the ids of the public vocabulary without any end
    token; an unknown one is a ``ValueError``. A null text has no tokens; null sources and languages are groups of
    their own; repeated rows count each. Other columns are left out.
    """
    if unknown := set(versions) - {*EXPRESSIONS, BPE}:
        raise ValueError(f"no tokenizer {sorted(unknown)}")
    kept = ["doc_id", "source", "lang", *keep]
    made = {v: EXPRESSIONS[v](text_or_empty()) for v in versions if v in EXPRESSIONS}
    rows = docs.select(*kept, *[c.alias(f"n {v}") for v, c in made.items()], *([text_or_empty().alias("text")] if BPE in versions else []))
    if BPE in versions:
        path = vocabulary or vocabulary_path()
        names = [*rows.columns[:-1], f"n {BPE}"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = encoder(path).encode_to_numpy
            for batch in batches:
                n = np.fromiter((len(encode(x.as_py())) for x in batch.column(batch.num_columns - 1)), np.int64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names)

        rows = rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `n {BPE}` long")
    counted = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"`n {v}`").alias("n_tokens")) for v in versions])
    return rows.select(*kept, F.inline(counted))


def signed(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The delta of one batch: ``inserts`` add and ``deletes`` take away rows ``(source, lang, tokenizer, n_tokens)``.

    A revision is a delete of the old count and an insert of the new one. The signed
    rows are summed before the shuffle, so that a hot source costs a row for each task.
    """
    parts = [
        x.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("n_tokens")).cast("long").alias("n_tokens"))
        for x, sign in ((inserts, 1), (deletes, -1))
        if x is not None
    ]
    if not parts:
        raise ValueError("a batch needs inserts or deletes")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


class Ledger:
    """Committed deltas in a shared folder, one folder ``batch_id=<n>`` for each batch.

    A batch is written aside and then renamed, which fails where its folder is there already. So a batch is either
    there as a whole or not at all, whenever a job dies, and whoever delivers it again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _there(self, path: str) -> bool:
        return self._files.util().exists(self._at(path))

    def _digest(self, path: str) -> tuple:
        rows = self.spark.read.schema(DELTA).parquet(path)
        return tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns)), *[F.sum(m) for m in MEASURES]).first())

    def commit(self, batch_id: int, delta: DataFrame) -> bool:
        """Take a batch's delta; False if the ledger has that batch. Other contents under its number are a ``ValueError``."""
        own, aside = f"{self.path}/batch_id={int(batch_id)}", f"{self.path}/_aside/{int(batch_id)}-{uuid.uuid4().hex}"
        delta.select(*KEYS, *MEASURES).write.parquet(aside)
        if not self._there(own):
            try:
                self._files.rename(self._at(aside), self._at(own), self._never_over)
                return True
            except Exception:
                if not self._there(own):  # else another writer was first
                    raise
        same = self._digest(own) == self._digest(aside)
        self._files.delete(self._at(aside), True)
        if not same:
            raise ValueError(f"batch {batch_id} was committed with other contents")
        return False

    def read(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens, batch_id)`` of all committed batches."""
        schema = f"{DELTA}, batch_id long"
        if not self._there(self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", self.path).schema(schema).parquet(self.path)


def totals(deltas: DataFrame) -> DataFrame:
    """Additive totals by source, language and tokenizer version; a key whose documents are all gone has no row."""
    sums = deltas.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES], F.count_distinct("batch_id").alias("n_batches"))
    return sums.filter("n_docs <> 0")


def three_batches(spark: SparkSession, sf_dir: str, versions: Sequence[str]) -> DataFrame:
    """Totals over all documents after three committed batches, the second of which is delivered twice.

    Batch 1 inserts every document. Batch 2 revises each document with a repeated or outer
    white space run: its text with runs as one space replaces the old one. Batch 3 deletes the
    toxic documents under their counts by then.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", text_or_empty().alias("text"))
    tidy = docs.withColumn("tidy", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))).withColumn("changed", F.col("text") != F.col("tidy"))
    form = lambda k, c: F.struct(F.lit(k).alias("revised"), F.col(c).alias("text"))
    forms = tidy.select("doc_id", "source", "lang", "changed", F.inline(F.when(F.col("changed"), F.array(form(0, "text"), form(1, "tidy"))).otherwise(F.array(form(0, "text")))))
    # each form of a text is counted once; the batches share the written counts
    counts = stored(count_tokens(forms, versions, keep=("changed", "revised")), "counts")
    old, new = counts.filter("revised = 0"), counts.filter("revised = 1")
    bad = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    second = signed(inserts=new, deletes=old.filter("changed"))
    ledger = Ledger(spark, f"{scratch_path(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit(1, signed(inserts=old))
    ledger.commit(2, second)
    ledger.commit(2, second)
    ledger.commit(3, signed(deletes=counts.filter("revised = 1 or not changed").join(bad, "doc_id", "left_semi")))
    return totals(ledger.read())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of words and of tokens of the public byte-level BPE."""
    return three_batches(spark, sf_dir, ("words-1", BPE))


def rollup_of_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches under the versions that SQL can count too."""
    return three_batches(spark, sf_dir, tuple(EXPRESSIONS))


_WS = "[\\x20\\x09-\\x0D]+"
ORACLE_SQL = {
    "rollup_of_expressions": f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, trim(regexp_replace(text, '{_WS}', ' ', 'g'), ' ') AS tidy FROM d),
b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
r AS (SELECT 1 AS batch_id, source, lang, text, 1 AS sign FROM t
      UNION ALL SELECT 2, source, lang, text, -1 FROM t WHERE text <> tidy
      UNION ALL SELECT 2, source, lang, tidy, 1 FROM t WHERE text <> tidy
      UNION ALL SELECT 3, source, lang, tidy, -1 FROM t WHERE doc_id IN (SELECT doc_id FROM b)),
c AS (SELECT batch_id, source, lang, sign, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM r
      UNION ALL SELECT batch_id, source, lang, sign, 'pieces-2', len(regexp_extract_all(text, '[A-Za-z0-9]{{1,8}}|[^A-Za-z0-9\\x20\\x09-\\x0D]{{1,8}}')) FROM r)
SELECT source, lang, tokenizer, CAST(sum(sign) AS BIGINT) AS n_docs, CAST(sum(sign * n) AS BIGINT) AS n_tokens, count(DISTINCT batch_id) AS n_batches
FROM c GROUP BY source, lang, tokenizer HAVING sum(sign) <> 0
"""
}
QUERIES = {"op4_token_counts": op4_token_counts, "rollup_of_expressions": rollup_of_expressions}
