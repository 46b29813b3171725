"""Token ids against the tokenizers file as it is, added token included."""

from __future__ import annotations

import zlib

import numpy as np

from lodestrata.llm import packing


def test_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext", "é<|endoftext|>\n\n", "plain text", ""]
    rows = packing.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [*reference.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.ids == ids and r.length == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
