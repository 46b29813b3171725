"""Ids and decoded texts against the library itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import sentence_pieces as pieces

from .helpers import corpus, frame

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.vocabulary_path())


def same(library, texts: list[str]) -> None:
    model = pieces.piece_model(pieces.vocabulary_path())
    for text, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text[:80]
        assert model.decode(ids).decode() == library.decode(want), text[:80]


def test_awkward_texts(library):
    same(library, ["", " ", "  ", "a", " a", "  a  b ", "\n", "\t\ta", "▁a ▁", "a▁b", "\x00a", "日本語テキスト", "🎉🎉 x", "1234 567", " ⁇ ", "<s>", "</s> <unk>", "<0x41>", "�", "x́​", "----------- ====", "********* ..... ffff"])


@pytest.mark.parametrize("letters", ["ab", "the", "etaoinshr", "eh ta", "-*=", "abcdeABE  \n\t01é日▁ßtheinrsuo.,🎉"])
def test_random_texts(library, letters):
    rng = random.Random(letters)
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(600)])


def test_long_runs_outlast_the_rounds(library):
    rng = random.Random(4)
    same(library, [" " * 30_000, "x" * 30_000, "the" * 9_000, "a " * 20_000, "".join(rng.choice("etaoinshrdlu") for _ in range(20_000)), "-" * 5_000])


def test_slices_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 7)
    monkeypatch.setattr(pieces, "MERGED", 40)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    rng = random.Random(5)
    same(library, ["".join(rng.choice("abé  \n") for _ in range(rng.choice([0, 5, 300]))) for _ in range(80)])


def test_decoding_any_ids(library):
    rng, model = random.Random(6), pieces.piece_model(pieces.vocabulary_path())
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259), rng.choice([0, 1, 2, 259, 29_871])]) for _ in range(rng.randrange(9))]
        assert model.decode(np.array(ids, np.int32)).decode() == library.decode(ids), ids


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.vocabulary_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceModel(str(tmp_path / "other.model"))


def test_documents(spark, library):
    rows = corpus(7) + [(None, "no id", "en", "s", 1, "c", "h", "k", "z", "s"), (3, "one", "en", "s", 1, "c", "h", "k", "z", "s")]
    got = sorted((r.asDict() for r in pieces.piece_digests(frame(spark, rows)).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_bos=True, add_eos=True)
        want.append({"doc_id": row[0], "n_tokens": len(ids), "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(library.decode(ids).encode())})
    assert got == sorted(want, key=str)
    whole = {(r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_documents(frame(spark, rows)).collect()}
    assert len(whole) == len({(r[0], r[1] or "") for r in rows})
    assert pieces.piece_digests(frame(spark, [])).collect() == []
