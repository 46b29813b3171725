"""Texts with very long white space keep the ids of the vocabulary's own library."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lodestrata.llm import packing, rollups

from .helpers import frame

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1_000_000, 3_000_000, 10_000_000])
def test_a_run_of_one_kind(library, n):
    encode = packing.encoder(packing.vocabulary_path()).encode_to_numpy
    for text in (" " * n, "a" + "\n" * n + "b"):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_runs_beside_words_and_end_tokens(library):
    encode = packing.encoder(packing.vocabulary_path()).encode_to_numpy
    long = " " * 1_000_000
    mixed = "".join(random.Random(2).choice(" \n\t 　\x85") for _ in range(900_000))
    for text in (f"x{long}y", f"x {long}\n{long} 's", f"{long}<|endoftext|>{long}1", f"a{mixed}é", f"{mixed}{long}", f"\x1c{long}\x1c"):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    text = "one" + " " * 1_000_000 + "two"
    rows = [(1, text, "en", "s", 0, "c", "h", "k", "z", "s"), (2, "one", "en", "s", 0, "c", "h", "k", "z", "s")]
    ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID])
    packed = packing.pack_documents(frame(spark, rows)).filter("doc_id = 1").agg({"length": "sum"}).first()[0]
    assert packed == len(ids)
    counts = {r.tokenizer: r.n_tokens for r in rollups.count_tokens(frame(spark, rows)).filter("doc_id = 1").collect()}
    assert counts == {"words-1": 2, rollups.BPE: len(ids) - 1}
