"""Readers and writers of file trees, logs, results, answers and packets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("requestId", T.StringType()),
        T.StructField("generationId", T.StringType()),
        T.StructField("startedAt", T.DoubleType()),
        T.StructField("operation", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("requestBytes", T.LongType()),
        T.StructField("responseBytes", T.LongType()),
        T.StructField("incompleteStream", T.BooleanType()),
        T.StructField("transportError", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def scan_files(spark: SparkSession, root: str, repo: str = ".") -> DataFrame:
    """``(repo, path, bytes, content)`` of all files below ``root``; what isn't selected isn't read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    # paths come back with a scheme and as many slashes as the file system likes
    plain = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    inner = F.substr(plain, F.lit(len(re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/", base)) + 2))
    return found.select(F.lit(repo).alias("repo"), inner.alias("path"), F.col("length").alias("bytes"), "content")


def snapshot(files: DataFrame) -> DataFrame:
    """Adds ``source`` (exact text, null if it isn't UTF-8) and ``content_hash``."""
    text = F.col("content").cast("string")
    return files.withColumns({"source": F.when(F.is_valid_utf8(text), text), "content_hash": F.sha2("content", 256)})


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of each log file with ``valid``, false on all of a file that has a bad line."""
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("log", F.input_file_name())
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("log", parsed.alias("e")).select("log", "e.*")
    flags = rows.groupBy("log").agg((~F.bool_or(F.col("_corrupt").isNotNull())).alias("valid"))
    return rows.join(flags, "log").drop("_corrupt")


def read_results(spark: SparkSession, path: str, rows: str = "rows", lines: bool = False) -> DataFrame:
    """Attempt rows of nested results: one in a file, or with ``lines`` one in a line, so that large files can be split."""
    return spark.read.option("multiLine", not lines).json(path).select(F.inline(rows))


def read_answers(spark: SparkSession, path: str, questions: DataFrame | None = None) -> DataFrame:
    """The newest answer of each digest and question of a store; with ``questions(digest)`` of these digests alone.

    A digest's first two characters name its folder. The questions' distinct ones, some hundreds at most, are a filter on
    folders, so that files of other folders are not opened. Of equal times the larger probability counts.
    """
    stored = spark.read.schema("digest string, question_id long, probability double, created_at timestamp, batch string, prefix string").option("basePath", path).parquet(path)
    if questions is not None:
        own = questions.select("digest").filter("digest is not null").distinct()
        prefixes = [r[0] for r in own.select(F.left("digest", F.lit(2))).distinct().collect()]
        stored = stored.filter(F.col("prefix").isin(prefixes)).join(own, "digest", "left_semi")
    newest = F.max(F.struct("created_at", "probability")).alias("a")
    return stored.groupBy("digest", "question_id").agg(newest).select("digest", "question_id", "a.probability", "a.created_at")


def append_answers(answers: DataFrame, path: str, kind: str = "a") -> None:
    """``answers(digest, question_id, probability, created_at)``, in a folder of its own for each append, in folders by the digest's first two characters."""
    own = answers.select("digest", F.col("question_id").cast("long").alias("question_id"), F.col("probability").cast("double").alias("probability"), F.col("created_at").cast("timestamp").alias("created_at"))
    prefix = F.left("digest", F.lit(2))
    own.withColumn("prefix", prefix).repartition("prefix").write.partitionBy("prefix").parquet(f"{path}/batch={kind}-{uuid.uuid4().hex}")


def compact_answers(spark: SparkSession, path: str) -> int:
    """Puts all appended batches of a store into one, a file for each folder; how many there were.

    The new batch is there before the old ones go. A reader takes the newest answer of each question, so that one who
    comes between, or a job that dies between, changes nothing.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(at) if f.getPath().getName().startswith("batch=a-")]
    if old:
        append_answers(read_answers(spark, path), path, "c")
        for folder in old:
            files.delete(folder, True)
    return len(old)


def write_context(packets: DataFrame, path: str) -> None:
    """One text for each ``query_id``, in folders by it."""
    packets.select("query_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("query_id").text(path)
