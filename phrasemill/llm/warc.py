"""WARC archives: a writer, and a splittable reader.

Every record is a gzip member of its own. The reader cuts archives into byte
ranges; a task looks for the gzip magic in its range, accepts a place only if
the member decodes and begins with a WARC header, and owns the records that
start inside its range, wherever they end. Archives are written under a name
of their own by each task attempt; only those that the committed manifest
lists are read, so a lost or repeated task leaves no doubled records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.common import attach, by_batch, parts_for, whole
from phrasemill.session import written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: Bytes of a split; archives are closed at about this size times ``SPLITS_OF_FILE``.
SPLIT_BYTES = 8 << 20
SPLITS_OF_FILE = 16
#: Bytes read at once.
READ_BYTES = 1 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"

RECORDS = "id string, type string, uri string, digest string, refers_to string, payload_bytes long, payload binary, sound boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value: line ends would end the header."""
    return " ".join((value or "").split())


def record(kind: str, ident: str, uri: str, digest: str, payload: bytes, refers_to: str = "") -> bytes:
    """One record as a gzip member; a revisit has the HTTP header of the full payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{ident}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_clean(uri)}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parsed(raw: bytes) -> tuple | None:
    """The fields of ``RECORDS`` of one decoded member, or None if it is no record of a known form."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found or not head.startswith(VERSION):
        return None
    fields = {}
    for line in head[len(VERSION):].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode()
    try:
        block = rest[:int(fields[b"content-length"])]
        kind, ident = fields[b"warc-type"], fields[b"warc-record-id"]
    except (KeyError, ValueError):
        return None
    urn = lambda v: v.removeprefix("<urn:").removesuffix(">") if v else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    sound = kind == "revisit" or (len(payload) == size and base32_sha1(payload) == digest)
    return (urn(ident), kind, fields.get(b"warc-target-uri"), digest, urn(fields.get(b"warc-refers-to")), size,
            None if kind == "revisit" else payload, sound)


def write_warc(df: DataFrame, folder: str, file_bytes: int = SPLIT_BYTES * SPLITS_OF_FILE) -> None:
    """Write (id, uri, type, digest, refers_to, payload binary) rows as archives below ``folder``.

    Needs a folder that all executors reach by its address. Null values become
    empty; an empty table gives an empty manifest. Records keep the order of a
    partition's rows.
    """
    columns = ["id", "uri", "type", "digest", "refers_to", "payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, closed = None, "", 0, []
        for batch in batches:
            for ident, uri, kind, digest, refers_to, payload in zip(
                    *(batch.column(c).to_pylist() for c in columns), strict=True):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(kind, ident or "", uri or "", digest or "", payload or b"", refers_to or "")
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    closed.append((name, size))
        if out is not None:
            out.close()
            closed.append((name, size))
        if closed:
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in closed]), pa.array([c[1] for c in closed], pa.int64())],
                                             ["name", "bytes"])

    # Only attempts that Spark commits are in the manifest.
    df.select(*columns).mapInArrow(run, "name string, bytes long").write.mode("overwrite").parquet(f"{folder}/manifest")


class _Range:
    """Bytes of an archive from a place on, read piece by piece."""

    def __init__(self, source: pa.NativeFile, at: int, size: int):
        self.source, self.at, self.size, self.data = source, at, size, b""

    def upto(self, n: int) -> bytes:
        """At least ``n`` bytes from the current place, or all that is left."""
        while len(self.data) < n and self.at + len(self.data) < self.size:
            self.source.seek(self.at + len(self.data))
            self.data += self.source.read(READ_BYTES)
        return self.data

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: _Range) -> tuple[bytes, int] | None:
    """The decoded member at the current place and its length, or None if there is no record.

    The first bytes already tell a header; a chance match of the magic fails there.
    """
    decode, out, used, checked = zlib.decompressobj(31), [], 0, False
    while not decode.eof:
        data = window.upto(used + 1)[used:]
        if not data:
            return None  # cut off
        try:
            piece = decode.decompress(data, 1 << 16 if not checked else 0)
            while not checked and not decode.eof and decode.unconsumed_tail and sum(map(len, out)) + len(piece) < len(VERSION):
                piece += decode.decompress(decode.unconsumed_tail, 1 << 16)
            out.append(piece)
            if not checked and sum(map(len, out)) >= len(VERSION):
                if not b"".join(out).startswith(VERSION):
                    return None
                checked = True
            if decode.unconsumed_tail:
                out.append(decode.decompress(decode.unconsumed_tail))
        except zlib.error:
            return None
        used += len(data) - len(decode.unused_data)
    return (b"".join(out), used) if checked else None


def records_in(store: pafs.FileSystem, path: str, start: int, end: int, size: int) -> Iterator[tuple]:
    """Records whose first byte lies in [start, end)."""
    with store.open_input_file(path) as source:
        window = _Range(source, start, size)
        while window.at < end:
            data = window.upto(READ_BYTES)
            at = data.find(MAGIC)
            if at < 0:  # the magic may begin in the last bytes
                if window.at + len(data) >= size:
                    return
                window.skip(len(data) - len(MAGIC) + 1)
                continue
            window.skip(at)
            if window.at >= end:
                return
            found = _member(window)
            fields = parsed(found[0]) if found else None
            if fields:
                yield fields
                window.skip(found[1])
            else:
                window.skip(1)


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives below ``folder``, one task range at a time; columns as in ``RECORDS``.

    ``sound`` tells whether a response's payload has its stated length and
    digest. Damaged members give no row; their neighbours are still found.
    """
    manifest = spark.read.schema("name string, bytes long").parquet(f"{folder}/manifest")
    splits = manifest.filter("bytes > 0").withColumn("start", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))))
    splits = splits.repartition(parts_for(spark), "name", "start")
    schema = pa.schema([("id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
                        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
                        ("sound", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, rows = 0, []
                for fields in records_in(store, f"{base}/{row['name']}", row["start"],
                                         min(row["start"] + split_bytes, row["bytes"]), row["bytes"]):
                    rows.append(fields)
                    held += len(fields[6] or b"")
                    if held > 4 << 20 or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        held, rows = 0, []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return splits.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", uri: str = "url",
                  html: str = "html") -> None:
    """Write one record for each row: the first of equal payloads is a response, the others revisit it.

    Payloads of fewer than ``least`` bytes are always responses. A null html is
    an empty payload, a null address is empty. Rows that repeat a key with the
    same payload all become revisits of that key but for one of them; a row
    without key is a response, as nothing could refer to it. An empty table
    gives an empty archive; further columns are not read.
    """
    source = pages.select(F.col(key).cast("long").alias("page"), F.col(uri).cast("string").alias("uri"),
                          whole(html).cast("binary").alias("payload"))

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums = [base32_sha1(p) for p in batch.column("payload").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page"), batch.column("uri"), batch.column("payload"),
                                               pa.array(sums, pa.string())], ["page", "uri", "payload", "digest"])

        return by_batch(batches, work)

    summed = source.mapInArrow(digests, "page long, uri string, payload binary, digest string").withColumn(
        "size", F.length("payload"))
    slim = written(summed.select("page", "digest", "size"), "digests")
    counted = slim.filter(F.col("page").isNotNull() & (F.col("size") >= least))
    groups = written(counted.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("rows"))
                     .filter("rows > 1"), "payloads")
    # One row for each page that is a revisit; of equal keys and payloads one row stays a response.
    copies = attach(counted.select("page", "digest"), groups, "digest", "rows", max(slim.count(), 1)).filter("first is not null")
    copies = written(copies.groupBy("page", "digest").agg(F.first("first").alias("first")), "copies")
    # A payload moves once, by its own page; nothing is gathered by digest here.
    dealt = summed.repartition(parts_for(pages.sparkSession), "page", "digest")
    spare = _spare(dealt.join(copies, ["page", "digest"], "left"))
    kind = F.when(F.col("first").isNull() | ((F.col("page") == F.col("first")) & ~F.col("again")), "response").otherwise("revisit")
    name = lambda c: F.concat(F.lit("page:"), F.col(c).cast("string"))
    write_warc(spare.withColumn("type", kind).select(
        F.coalesce(name("page"), F.lit("page:")).alias("id"), "uri", "type", "digest",
        F.when(F.col("type") == "revisit", name("first")).alias("refers_to"), "payload"), folder)


def _spare(marked: DataFrame) -> DataFrame:
    """``again``: true for all but one of the rows with the same key and payload.

    Rows of a key lie in one partition already; a sort there and one look at
    the row before tell, without gathering a group.
    """
    columns = ["page", "uri", "payload", "digest", "first"]
    dealt = marked.select(*columns).sortWithinPartitions("page", "digest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            again = []
            for pair in zip(batch.column("page").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                again.append(pair == last and pair[0] is not None)
                last = pair
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(again, pa.bool_())],
                                             [*columns, "again"])

    return dealt.mapInArrow(run, "page long, uri string, payload binary, digest string, first long, again boolean")


def page_rows(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, sound) of the records that ``archive_pages`` wrote."""
    page = lambda c: F.regexp_extract(c, r"^page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return records.select(number("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "sound")


_FIVE_BITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, {5 * k + 1}, 5) AS INTEGER) >> {shift}) & 31), 1)"
                         for k in range(8) for shift in (15, 10, 5, 0))
#: What ``page_rows`` says of the archived ``pages``, in SQL.
SQL = f"""
WITH held AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, html, min(page_id) AS first FROM held GROUP BY digest, html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_FIVE_BITS} AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to, true AS sound
FROM held JOIN firsts USING (digest, html)
"""
