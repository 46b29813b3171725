"""From raw documents to packed training sequences: quality, repeated lines, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import stored, table
from lodestrata.llm.decontaminate import decontaminated
from lodestrata.llm.jaccard import jaccard_components
from lodestrata.llm.line_dedup import dedup_lines
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.quality import resample

#: Near duplicates here share four fifths of their five-word shingles.
NEAR_SHINGLE, NEAR_NUM, NEAR_DEN = 5, 80, 100


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``ids``; a null id matches a null one."""
    ids = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    return _only(docs, resample(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; a document of which nothing is left goes, one that was empty before stays."""
    rest = dedup_lines(docs, carried=[c for c in docs.columns if c != "text"])
    rest = rest.filter((F.col("n_bytes_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rest.select(*[made[c].alias(c) if c in made else F.col("own")[c].alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    groups = jaccard_components(docs, NEAR_SHINGLE, NEAR_NUM, NEAR_DEN)
    return _only(docs, groups.filter("doc_id is null or doc_id = component_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Most stages can't be told in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
