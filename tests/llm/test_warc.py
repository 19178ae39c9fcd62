"""WARC: round trip, records that cross splits, chance magic bytes, damaged members, equal payloads and odd rows."""

import base64
import hashlib
import os

import pyarrow.fs as pafs
import pytest

from phrasemill.llm.queries import op4_warc
from phrasemill.llm.warc import MAGIC, archive_pages, page_rows, read_warc, record, records_in, write_warc


def expected(rows, least=0):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(first.get(data, page), page)
    out, seen = [], set()
    for page, html in rows:
        data = (html or "").encode()
        known = first.get(data) if page is not None and len(data) >= least else None
        again = known is not None and (page != known or (page, data) in seen)
        seen.add((page, data))
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if again else "response", known if again else None))
    return sorted(out, key=str)


ROWS = [(4, "same"), (2, "same"), (9, "same"), (1, None), (3, ""), (None, "same"), (None, "x"), (7, "é" * 5000), (7, "é" * 5000),
        (8, "w " * 40_000)]


@pytest.mark.parametrize("least", [0, 3])
def test_pages(spark, tmp_path, least):
    df = spark.createDataFrame([(p, "http://x/\r\ny", h, 1) for p, h in ROWS], "page_id long, url string, html string, digest int")
    archive_pages(df, str(tmp_path / "w"), least)
    got = page_rows(read_warc(spark, str(tmp_path / "w"), split_bytes=100))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == expected(ROWS, least)
    assert got.filter("not sound").count() == 0


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archive_pages(df, str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


def test_every_split_size(tmp_path):
    """Each record is owned by one split only, wherever the borders fall."""
    payloads = [b"", MAGIC * 50, os.urandom(3000) + MAGIC + os.urandom(50), b"plain " * 3000, MAGIC]
    data = b"".join(record("response", f"page:{i}", "u", base64.b32encode(hashlib.sha1(p).digest()).decode(), p)
                    for i, p in enumerate(payloads))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    store = pafs.LocalFileSystem()
    for size in (1, 7, 100, 999, len(data)):
        found = [f for at in range(0, len(data), size) for f in records_in(store, str(path), at, min(at + size, len(data)), len(data))]
        assert [f[0] for f in found] == [f"page:{i}" for i in range(len(payloads))]
        assert [f[6] for f in found] == payloads and all(f[7] for f in found)


def test_damage(tmp_path):
    parts = [record("response", f"page:{i}", "u", base64.b32encode(hashlib.sha1(b"p%d" % i).digest()).decode(), b"p%d" % i) for i in range(3)]
    broken = parts[1][:40] + bytes(b ^ 255 for b in parts[1][40:60]) + parts[1][60:]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"junk" + parts[0] + broken + parts[2] + parts[0][:30])
    size = path.stat().st_size
    assert [f[0] for f in records_in(pafs.LocalFileSystem(), str(path), 0, size, size)] == ["page:0", "page:2"]


def test_general_records(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "response", None, None, bytearray(b"xyz"))],
                               "id string, uri string, type string, digest string, refers_to string, payload binary")
    write_warc(df, str(tmp_path / "w"))
    row = read_warc(spark, str(tmp_path / "w")).first()
    assert (row.id, bytes(row.payload), row.sound) == ("a", b"xyz", False)  # no digest was given


def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html").collect()
    got = op4_warc(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected([tuple(r) for r in pages]) and all(r.sound for r in got)
