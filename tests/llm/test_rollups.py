"""Rollups against counts in plain Python, and the ledger under repeated, broken and differing deliveries."""

from __future__ import annotations

import collections
import re

import pytest

from lodestrata.llm import rollups

from .helpers import DOCS, corpus, frame

ROWS = [r for r in corpus(11) if len(r[1] or "") < 50_000]


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def counted(rows, encode) -> collections.Counter:
    want: collections.Counter = collections.Counter()
    for _, text, lang, source, *_ in rows:
        want[source, lang, "words-1"] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        want[source, lang, rollups.BPE] += len(encode.encode(text or "", add_special_tokens=False).ids)
    return want


def result(df) -> dict:
    return {(r.source, r.lang, r.tokenizer): r.n_tokens for r in df.collect()}


def test_counts(spark, encode):
    rows = [*ROWS, ROWS[9], (None, "a <|endoftext|>  b", None, None, *ROWS[0][4:])]
    got = result(rollups.signed(inserts=rollups.count_tokens(frame(spark, rows))))
    assert got == counted(rows, encode)
    assert rollups.signed(inserts=rollups.count_tokens(spark.createDataFrame([], DOCS))).count() == 0
    with pytest.raises(ValueError):
        rollups.count_tokens(frame(spark, rows), ("words-9",))
    with pytest.raises(ValueError):
        rollups.signed()


def test_ledger(spark, encode, tmp_path):
    counts = rollups.count_tokens(frame(spark, ROWS)).cache()
    ledger = rollups.Ledger(spark, f"file://{tmp_path}/ledger")
    assert rollups.totals(ledger.read()).count() == 0
    base = rollups.signed(inserts=counts)
    assert [ledger.commit(1, base), ledger.commit(1, base)] == [True, False]
    assert result(rollups.totals(ledger.read())) == counted(ROWS, encode)
    with pytest.raises(ValueError):
        ledger.commit(1, rollups.signed(inserts=counts.filter("doc_id > 10")))
    # a writer that died before the rename leaves nothing that is read
    rollups.signed(inserts=counts).write.parquet(f"{tmp_path}/ledger/_aside/2-dead")
    assert result(rollups.totals(ledger.read())) == counted(ROWS, encode)
    assert ledger.commit(2, rollups.signed(deletes=counts)) and rollups.totals(ledger.read()).count() == 0
    assert ledger.commit(3, rollups.signed(inserts=counts.filter("doc_id = 9"), deletes=counts.filter("doc_id = 9")))
    assert rollups.totals(ledger.read()).count() == 0


def test_query(spark, encode, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark, ROWS).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(k % 3 == 0)) for k in range(40)] + [(3, None, 1), (None, None, 1), (9999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tidy = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "").strip(" "), *rest) for i, t, *rest in ROWS if not (i % 3 == 0 and i < 40)]
    want = {k: v for k, v in counted(tidy, encode).items()}
    assert result(rollups.op4_token_counts(spark, str(tmp_path))) == want
    rows = rollups.op4_token_counts(spark, str(tmp_path)).collect()
    n: collections.Counter = collections.Counter((r[3], r[2]) for r in tidy)
    assert {(r.source, r.lang): r.n_docs for r in rows} == n
