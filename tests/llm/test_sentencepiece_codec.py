"""Parity with the sentencepiece library, round trips, and models written by hand."""

import struct
import zlib
from array import array

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import sentencepiece_codec as sp
from rankloom.llm.registry import QUERIES, tokenizer_file

RAW = sp.load_model(tokenizer_file("piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a", " a  b\nc 　d é 日本 \U0001f600", "trail ", "\n\n x", "▁ marker▁▁x ▁", "<s> <unk> <0x41>", "tab\t\tx", "w " * 4000, "z" * 3000, "aaaaaaaaaaaaaaa aaaa", "été über ñandú."]


@pytest.fixture(scope="module")
def other():
    return sentencepiece.SentencePieceProcessor(model_proto=RAW)


def test_documents(spark, other):
    rng = np.random.default_rng(1)
    texts = ODD + [None] + [" ".join(rng.choice(["thing", "of", "Onether", "über,", "x.\ny"], size=int(n))) for n in rng.integers(1, 200, 60)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, ids long").repartition(3)
    got = {r.doc_id: r for r in sp.encode(docs, RAW).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        if t is None:
            assert got[k].ids is None and got[k].n_tokens == 0 and got[k].checked
        else:
            assert list(array("I", bytes(got[k].ids))) == other.encode(t), t
            assert got[k].n_tokens == len(got[k].ids) // 4 and got[k].checked
    back = {r.doc_id: r.decoded for r in sp.decode(sp.encode(docs, RAW), RAW).collect()}
    assert back == {k: t and t.replace("▁", " ") for k, t in enumerate(texts)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ▁\n\té日<>0x", max_size=25), max_size=5))
def test_units_agree_with_the_library(texts):
    other = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    ids, fine = sp.codec(sp.settings_of(RAW))(texts)
    assert [list(array("I", x)) for x in ids] == other.encode(texts) and all(fine)


def test_disagreement_is_told(monkeypatch):
    run = sp.Codec(sp.build(sp.parse(RAW)), sp.build(sp.parse(RAW), prefix=False), RAW, True, True, 1, True)
    right = run.other.encode
    run.other = type("Odd", (), {"encode": staticmethod(lambda ts, num_threads: [[1] if t == "strange" else right(t) for t in ts])})
    assert run(["a strange word", "a word", "strange"])[1] == [False, True, False]


def test_disagreement_is_told_each_time():
    run = sp.Codec(sp.build(sp.parse(RAW)), sp.build(sp.parse(RAW), prefix=False), RAW, True, True, 1, True)
    right = run.other.encode
    run.other = type("Odd", (), {"encode": staticmethod(lambda ts, num_threads: [[1] if t == "strange" else right(t) for t in ts])})
    for _ in range(4):
        assert run(["a strange word", "a word", "strange", "strange word"])[1] == [False, True, False, False]


def test_query_decodes_whole_documents(spark, tmp_path):
    texts = [*ODD, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op10_sentencepiece"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        assert got[k].round_trip == (t is None or "▁" not in t), t
        assert got[k].decoded_crc32 == (None if t is None else zlib.crc32(t.replace("▁", " ").encode()))


def message(number, value):
    if isinstance(value, int):
        return bytes([number << 3]) + bytes([value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    size = len(value)
    head = [number << 3 | 2] if number < 16 else [(number << 3 | 2) & 127 | 128, number >> 4]
    return bytes(head) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value


def test_unigram_model_written_by_hand():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -3.2, 1), ("▁ab", -4.0, 1), ("ba", -5.0, 1), ("c", -6.0, 1)]
    raw = b"".join(message(1, message(1, p.encode()) + message(2, s) + (message(3, k) if k != 1 else b"")) for p, s, k in pieces)
    raw += message(2, message(3, 1)) + message(3, message(1, b"identity") + message(3, 1) + message(4, 0))
    other = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["ab", "abab ba", "aab  b", "cab", "b a", "aaxab"]
    model = sp.parse(raw)
    assert model.kind == sp.UNIGRAM and model.pieces[6][0] == "ab"
    ids, fine = sp.codec(sp.settings_of(raw))(texts)
    assert [list(array("I", x)) for x in ids] == other.encode(texts)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(docs, RAW).count() == 0 and sp.decode(sp.encode(docs, RAW), RAW).count() == 0
