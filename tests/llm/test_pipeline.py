"""The pipeline over a small corpus, against brute-force versions of its stages."""

from __future__ import annotations

import collections

import pytest

import corpus_pipeline
from .helpers import check_line_dedup, corpus, frame
from .test_operators import _jaccard

ITEM = "the quick question of the benchmark asks which of the many answers is the right one for all of us here today"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [r for r in corpus(3) if r[0] < 45]
    rows += [(900, "before " + ITEM.upper() + " after", "en", "s0", 1, "", "", "", "", ""), (901, None, None, None, None, None, None, None, None, None)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert kept[name] == before  # all labelled ones are good
        elif name == "line_dedup":
            assert check_line_dedup(before, {i: kept[name].get(i, "") for i in before}) > 10
            assert all((before[i] or "").strip() for i in before.keys() - kept[name].keys())
        elif name == "ngram_jaccard_join":
            groups = _jaccard({i: t or "" for i, t in before.items()}, 5, 80, 100)
            assert kept[name] == {i: before[i] for i, _, c in groups if i == c}
            assert len(kept[name]) < len(before)
        elif name == "benchmark_decontamination":
            assert kept[name] == {i: t for i, t in before.items() if i != 900} and 900 in before
        else:
            assert {r.doc_id for r in docs.collect()} == before.keys()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert rows and max(fill.values()) <= 1024 and 900 not in {r.doc_id for r in rows}


def test_line_dedup_keeps_each_row_once(spark):
    """Repeated rows, several null ids, and columns with the names of the stage's own."""
    passage = " ".join(f"Line {k} of a passage that several of the rows share with one another." for k in range(12))
    rows = [(1, "one " + passage, "a", 1, "x"), (1, "one " + passage, "a", 1, "x"), (2, "two " + passage, "b", 2, "y")]
    rows += [(None, f"text of null {k}", f"n{k}", 10 + k, "z") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes_removed long, _id string")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    own = collections.Counter((r[0], *r[2:]) for r in rows)
    assert collections.Counter((r[0], *r[2:]) for r in got) == own
    assert {r[1] for r in got if r[0] is None} == {r[1] for r in rows if r[0] is None}
    assert all(r[1] == f"text of null {r[2][1:]}" for r in got if r[0] is None)


def test_empty_tables(spark, sf_dir, tmp_path):
    """No documents, and documents without labels or benchmark: nothing fails, and clean documents stay."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
        kept = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (kept.filter("doc_id < 5") if name == "documents" else kept.limit(0)).write.parquet(f"{tmp_path}/plain/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/plain/documents.parquet")
    assert corpus_pipeline.quality_classifier(spark, docs, f"{tmp_path}/plain").count() == docs.count()
    assert corpus_pipeline.benchmark_decontamination(spark, docs, f"{tmp_path}/plain").count() == docs.count()
