"""SentencePiece: equal to the library on odd texts, on both ways of merging, with nulls and clashing columns."""

import hashlib
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from phrasemill.llm.pieces import MARK, decode_pieces, encode_pieces, encoder_of, round_trip
from phrasemill.llm.queries import PIECES, op2_sentencepiece

ODD = ["", " ", "  a", " a b  ", "▁x", "a\tb\n\nc", "\x00", "<s>hi</s>", "ﬁ①Ａ", "日本　x", "é", "é", "\r\n", "a" * 3000,
       "😀😀 x", "▁" * 70, " " * 333 + "x", "the▁▁ and", "<0x0A>", "<unk>", "long" * 40 + " short", "x " * 2000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_odd_texts(library):
    encoder = encoder_of(PIECES)
    packed, agrees = encoder.encode(ODD)
    assert agrees
    for text, got in zip(ODD, packed, strict=True):
        want = library.encode(text)
        assert got == struct.pack(f"<{len(want)}I", *want), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(" ▁\naetionrsh.é😀<>0#"), max_size=40))
def test_both_ways(text):
    encoder = encoder_of(PIECES)
    want = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text) if text else []
    assert encoder.encode([text])[0][0] == struct.pack(f"<{len(want)}I", *want)
    part = MARK + text.replace(" ", MARK)
    assert encoder.merged(part) == encoder.merged_together([part])[0]


def test_tables(spark, library):
    rows = [(1, "the thing", "x"), (2, None, "y"), (2, None, "y"), (None, "", None), (3, "the thing", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.text): r for r in decode_pieces(encode_pieces(df, PIECES), PIECES).collect()}
    assert got[1, "the thing"].ids == [1, *library.encode("the thing"), 2] and got[1, "the thing"].decoded == "the thing"
    assert got[2, None].ids == [1, 2] and got[2, None].decoded == ""
    assert round_trip(df, PIECES).count() == 5
    assert encode_pieces(df.limit(0), PIECES).count() == 0 and round_trip(df.limit(0), PIECES).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op2_sentencepiece(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.library_agrees) == (len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
