"""SentencePiece codes against the library."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetlens.llm import piece_codec, queries
from assetlens.llm.token_counts import tokenizer_path


@pytest.fixture(scope="module")
def own():
    return piece_codec.Codec(tokenizer_path(piece_codec.MODEL))


def expected_rows(library, rows):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        digests = (hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids)))
        out.append((doc_id, len(ids), *digests))
    return sorted(out, key=repr)


def test_query(spark, medium, own):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    found = sorted(map(tuple, queries.op11_piece_codec(spark, medium).collect()), key=repr)
    assert found == expected_rows(own.library, ((r.doc_id, r.text) for r in docs.collect()))


def test_awkward_and_empty(spark, awkward, nothing, own):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    found = piece_codec.piece_ids(awkward, digests=True)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == expected_rows(own.library, rows)
    whole = {r.doc_id: r for r in piece_codec.piece_ids(awkward, whole_check=True).collect()}
    assert whole[5].ids == own.library.encode(dict(rows)[5])
    assert whole[7].decoded == dict(rows)[7]
    assert piece_codec.piece_ids(nothing, digests=True).count() == 0


TEXTS = st.text(st.sampled_from(list("aab e  ▁\n\t\x00é€𝄞ß'<>s/0x1Fthe ")) | st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_encode(own, text):
    ids = own.encode(text)
    assert ids == own.library.encode(text)
    assert own.decode(ids) == own.library.decode(ids)
    assert own.differences() == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 259, 28705, 35, 195, 204, 164]) | st.integers(0, 31_999), max_size=12))
def test_decode(own, ids):
    assert own.decode(ids) == own.library.decode(ids)


def test_words_go_when_room_is_taken(own, monkeypatch):
    monkeypatch.setattr(piece_codec, "HELD_WORDS", 4)
    small = piece_codec.Codec(tokenizer_path(piece_codec.MODEL))
    for k in range(50):
        text = f"word{k % 7} other{k} again{k - 1}"
        assert small.encode(text) == own.library.encode(text)
        assert len(small.known) <= 6 and len(small.older) <= 6


def test_one_agenda_or_many(own):
    """Words that go through the rows of many agendas get what they get by one agenda each."""
    words = ["▁a", "▁hello", "▁hel", "▁", "▁internationalisation", "▁zzzzzz", "▁naïve", "▁été,", "▁x_y.z", "▁∮foreign"]
    for word, ids in zip(words, own.agendas.merged(words), strict=True):
        assert ids == (None if "∮" in word and "∮" not in own.pieces else own.merged(word))


def test_long_word(own):
    text = "abcdefgh" * 20_000
    assert own.encode(text) == own.library.encode(text)


def test_a_difference_is_told(own):
    wrong = piece_codec.Codec(tokenizer_path(piece_codec.MODEL))
    pieces = {k: v for k, v in wrong.pieces.items() if k != "▁there"}
    wrong.agendas = piece_codec.Agendas(pieces)
    wrong.encode("hello there")
    assert wrong.differences() == ["▁there"]


def test_other_models_are_refused(own, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(own.library.serialized_model_proto())
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        piece_codec.Codec(str(path))


def test_words_of_one_width_are_merged_together(monkeypatch):
    """Short words don't wait in wide rows for the rounds of long ones."""
    own = piece_codec.Codec(tokenizer_path(piece_codec.MODEL))
    merged, widths = own.agendas.merged, []
    monkeypatch.setattr(piece_codec, "LEARNED_TOGETHER", 8)
    monkeypatch.setattr(own.agendas, "merged", lambda words: widths.append(list(map(len, words))) or merged(words))
    words = {"▁" + "abcdefgh"[k % 8] * (1 + k % 16) for k in range(160)}
    own.learn(words)
    flat = [n for some in widths for n in some]
    assert flat == sorted(flat) and len(flat) == len(words)
    assert own.differences() == []
