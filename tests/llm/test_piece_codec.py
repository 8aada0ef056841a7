import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdtide.llm import piece_codec
from tests.llm.helpers import documents

ODD = [
    None, "", " ", "  ", "   a", "a  b ", "\n", "\n\n x", " \n", "a\tb\r\n", "▁x", "▁▁▁", "a▁b", "\x00a", "<s> </s> <0x41> <unk>", "ﬁ Å ｶ", "　x", "😀x\U0001f9ff",
    "日本語の文章です。한국어 텍스트", "العربية שלום", "é", " " * 15, " " * 16, " " * 17, " " * 33 + "x", "x" + " " * 40 + "\n" + " " * 20 + "the", "#" * 200,
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 33 + " " + "-" * 70, "Ünïcödé straße façade", "​﻿ ", "1234567890" * 9, "�", "x" * 5000, "ab" * 3000 + "\n" + " " * 900,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.piece_bpe_path())


@pytest.fixture(scope="module")
def encoder():
    return piece_codec.Encoder(piece_codec._load(None, None))


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), np.int32).tolist()


def test_odd_texts(library, encoder):
    for text in ODD:
        ids = ids_of(encoder, text)
        assert ids == library.encode(text or ""), text
        assert piece_codec.decode_ids(encoder.model, ids) == library.decode(ids)


def test_every_piece_and_pairs_of_pieces(library, encoder):
    rng = random.Random(3)
    texts = [library.id_to_piece(i).replace("▁", " ") for i in range(259, len(library))]
    texts += ["".join(rng.choices(texts, k=rng.randint(2, 6))) for _ in range(20_000)]
    assert [ids_of(encoder, t) for t in texts] == library.encode(texts)


def test_without_cuts_the_table_gives_the_same(library, encoder):
    for text in ODD:
        if text:
            assert encoder.encode_stretch("▁" + text.replace(" ", "▁")) == library.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n▁abcdeinorst.,'THE0é日😀\x01"), max_size=60))
def test_any_text(library, encoder, text):
    ids = ids_of(encoder, text)
    assert ids == library.encode(text) and piece_codec.decode_ids(encoder.model, ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(3, 31_999), st.sampled_from([28705, 259, 1, 2, 198, 172, 163])), max_size=12))
def test_decoding_any_ids(library, encoder, ids):
    assert piece_codec.decode_ids(encoder.model, ids) == library.decode(ids)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "STRETCHES", 3)
    monkeypatch.setattr(piece_codec, "PAIRS", 5)
    small = piece_codec.Encoder(piece_codec._load(None, None))
    text = "The quick brown fox jumps over the lazy dog, twice; the dog sleeps on. " * 3
    assert ids_of(small, text) == library.encode(text)


def test_query_equals_library(spark, tmp_path, library):
    rng = np.random.default_rng(5)
    texts = ODD + ["".join(rng.choice(list("etaoin shrdlu.\n"), 300)) for _ in range(40)]
    rows = [*enumerate(texts), (3, "again"), (None, "no id")]
    documents(spark, rows).withColumnRenamed("lang", "ids").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, piece_codec.op11_piece_codec(spark, str(tmp_path)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)


def test_general_interface(spark, library):
    docs = documents(spark, ["some text", None])
    coded = piece_codec.encode(docs.withColumnRenamed("source", "ids"), end=False)
    assert coded.columns == ["doc_id", "lang", "n_chars", "ids"]
    back = piece_codec.decode(coded)
    assert [(r["doc_id"], r["ids"], r["text"]) for r in back.orderBy("doc_id").collect()] == [(0, library.encode("some text"), "some text"), (1, [], "")]
    assert piece_codec.decode(piece_codec.encode(documents(spark, []))).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        piece_codec.read_model(b"")
