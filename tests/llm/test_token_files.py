"""Token files: equal to the library over whole texts, order, offsets, settings of the files, selective reads."""

import glob
import struct
import zlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

from phrasemill.llm.queries import WORDS, op8_token_files
from phrasemill.llm.token_files import encoder_of, ids_crc32, read_tokens, write_tokens

ODD = ["", " \n", "Ünder  the\t\tSEA", "don't we'll", "é ́x", "ΣΑΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "日本　語 ½ x²", "\x1c\x85a b",
       "x" * 4000, "1234 5,6", "###word *** 😀!", "ﬁ ﬀ", "<|ENDOFTEXT|>", "J\u030cx T\u0308 A\u030a", "It's THE'S word.Word,x thor### l'Été, ªº µ × ÷ ß,É!",
       "One, two. Three;four,five! Six\x0bseven\x0ceight\xa0nine, ten", ",first", "a ,b", "end,", "end.. x,. y", "a1, b2."]


def test_words_give_whole_texts():
    library = Tokenizer.from_file(WORDS)
    for text, got in zip(ODD, encoder_of(WORDS).encode(ODD), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(want)}I", *want), text


def test_files(spark, tmp_path):
    rows = [(5, "five", 1), (-2, None, 1), (None, "none", 1), (3, "b", 1), (3, "a", 1), *[(i, t, 1) for i, t in enumerate(ODD, 100)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    path = str(tmp_path / "t")
    write_tokens(df, path, WORDS, end=2)
    got = read_tokens(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (doc, text, _) in zip(got, order, strict=True):
        want = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(want), want)
        at += len(want)
    write_tokens(df.limit(0), path, WORDS, end=2)
    assert read_tokens(spark, path).count() == 0


def test_layout(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    write_tokens(df, str(tmp_path / "t"), WORDS, end=2)
    file = pq.ParquetFile(max(glob.glob(str(tmp_path / "t/tokens/*.parquet"))))
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in columns["at"].encodings
    assert ids.has_offset_index and columns["doc_id"].has_column_index
    few = read_tokens(spark, str(tmp_path / "t")).filter("doc_id between 10 and 12").select("doc_id", "n_tokens")
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in few._jdf.queryExecution().toString()
    assert "ids" not in few._jdf.queryExecution().executedPlan().toString() and few.count() == 3


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    library, at = Tokenizer.from_file(WORDS), 0
    got = op8_token_files(spark, folder).orderBy("doc_id").collect()
    for r, d in zip(got, spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_checksum_of_nothing(spark):
    assert ids_crc32(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0
