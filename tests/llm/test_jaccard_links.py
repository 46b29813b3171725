"""Links that a division of the domain hides in its thinnest parts."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import jaccard
from lodestrata.llm.common import mix64
from lodestrata.llm.shingles import shingle_sets


def _pair(parts: int, differences: int, size: int) -> tuple[str, str]:
    """Two texts whose sets of words differ twice in each of some parts, in two of three cells, and have no word in the other parts."""
    covered = differences // 2
    words = [f"w{k}" for k in range(40_000)]
    h = np.array([int(x[0]) for x in shingle_sets([w.encode() for w in words], 1)], np.uint64)
    place = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
    part, cell = (place >> np.uint64(32)) % np.uint64(parts), (place & np.uint64(0xFFFFFFFF)) % np.uint64(3)
    apart = [int(np.nonzero((part == p) & (cell == c))[0][0]) for p in range(covered) for c in (0, 1)]
    taken = set(apart)
    both = [k for k in np.nonzero(part < covered)[0].tolist() if k not in taken][: size - differences]
    more = [words[k] for k in apart]
    return " ".join(words[k] for k in both), " ".join([*(words[k] for k in both), *more])


@pytest.fixture(scope="module")
def pair():
    # 176 words and 220, in neighbouring bands: they only share the tag of sets of up to 230 words, which once had 26 parts
    return _pair(26, 44, 220)


def test_a_link_in_thin_parts(spark, pair, monkeypatch):
    a, b = (set(t.split()) for t in pair)
    assert len(a & b) * 100 >= 80 * len(a | b)
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1])], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(docs, 1, 80, 100, False).collect()} == {1}
    monkeypatch.setattr(corpus_pipeline, "NEAR_SHINGLE", 1)
    assert [r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()] == [1]


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_linked_sets_share_a_signature(num, den):
    """Sets of all sizes at the threshold, of one size and of two, as random as they come and with empty parts."""
    rng = np.random.default_rng(num)
    for size in [*range(1, 60, 3), 97, 113, 128, 150, 211, 264, 400]:
        for thin in (False, True):
            h = np.unique(rng.integers(1, 2**63, 40 * size + 40, dtype=np.uint64))
            if thin:  # only features of the first parts of one of the tags
                band = int(np.searchsorted(jaccard.bands(num, den), size, side="right")) - 1
                parts = jaccard.layout(band + 1, num, den)[0]
                own = (mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) % np.uint64(parts)
                h = h[own <= parts // 2]
            rng.shuffle(h)
            both, rest = h[:size], h[size:]
            apart = rest[: size * den // num - size]
            for cut in {0, len(apart) // 2, len(apart)}:
                a, b = np.unique(np.concatenate([both, apart[:cut]])), np.unique(np.concatenate([both, apart[cut:]]))
                assert den * len(both) >= num * (len(both) + len(apart))
                shared = np.intersect1d(jaccard.signatures(a, num, den), jaccard.signatures(b, num, den))
                assert shared.size, (size, thin, cut)
                assert np.isin(jaccard.signatures(a, num, den), jaccard.signatures(a, num, den, True)).all()


def test_texts_of_candidates_only(spark):
    """Few other rows pass the filter, and none of the wanted ones is held back, however small the filter."""
    docs = spark.range(20_000).selectExpr("id - 10000 as doc_id", "cast(id as string) as data").unionByName(spark.sql("select cast(null as long) as doc_id, 'x' as data"))
    for ids, most in ((docs.filter("doc_id % 40 = 0").select("doc_id"), 2_500), (docs.limit(0).select("doc_id"), 0)):
        want = {r.doc_id for r in ids.collect()}
        got = {r.doc_id for r in jaccard._perhaps(docs, ids).collect()}
        assert want <= got and len(got) <= most
    jaccard.FILTER_BITS, bits = 8, jaccard.FILTER_BITS
    try:
        ids = docs.filter("doc_id % 2 = 0").select("doc_id")
        assert {r.doc_id for r in ids.collect()} <= {r.doc_id for r in jaccard._perhaps(docs, ids).collect()}
    finally:
        jaccard.FILTER_BITS = bits
