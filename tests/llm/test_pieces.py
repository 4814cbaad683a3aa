"""Decoding comes from the ids, and memory of units changes nothing."""

import hashlib

import pytest
import sentencepiece

import public_tokenizers
from vecloop.llm import pieces, stages

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Alpha beta, gamma.\nDelta  epsilon", "中文 é 😀 x", "don't _{ stop", " lead", "beta beta gamma", "alphabetagamma " * 50, "a" * 200]


def test_a_wrong_id_shows_in_the_text():
    own = pieces.PieceModel(MODEL)
    right = own.digest_parts("Alpha beta")
    wrong = own.ids["▁gamma"] if "▁gamma" in own.ids else own.ids["▁g"]
    segment = own.segment
    own.whole, own.segment = {}, lambda unit: [wrong, *segment(unit)[1:]]
    own.forget()
    broken = own.digest_parts("Alpha beta")
    assert broken[1] != right[1] and broken[2] != right[2] == "Alpha beta"


def test_a_wrong_byte_shows_in_the_text():
    own = pieces.PieceModel(MODEL)
    assert own.digest_parts("x ͸")[2] == "x ͸"
    own.bytes[0xB8] = own.bytes[0xB9]
    own.forget()
    assert own.digest_parts("x ͸")[2] == "x ͹"


@pytest.mark.parametrize("cached", [1, 2, 5, 1000])
def test_memory_changes_nothing(cached):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceModel(MODEL, cached_units=cached)
    for text in TEXTS * 3:
        ids = library.encode(text)
        assert own.encode(text) == ids and own.digest_parts(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
        assert len(own.cache) <= cached
    own.forget()
    assert own.encode(TEXTS[0]) == library.encode(TEXTS[0])


def test_round_trip_of_the_stage(spark, monkeypatch):
    docs = spark.createDataFrame([*enumerate([*TEXTS, "", None, "a▁b"])], "doc_id bigint, text string").repartition(2)
    found = {r["doc_id"]: r for r in stages.encode(docs, MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in enumerate([*TEXTS, "", "", "a▁b"]):
        assert found[i]["ids"] == library.encode(text) and found[i]["n_tokens"] == len(found[i]["ids"])
        assert found[i]["round_trip"] == (library.decode(found[i]["ids"]) == text) == ("▁" not in text)
    digests = {r["doc_id"]: r["ids_sha256"] for r in pieces.token_digests(docs, MODEL).collect()}
    assert digests == {i: hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() for i, r in found.items()}
