"""Token ids as Parquet files.

Documents are dealt out by ranges of their ids, sorted, encoded and written by
Spark's own writer, which commits whole tasks only. Ids of tokens are
dictionary-encoded lists, sorted numbers are delta-encoded, row groups and
pages have set sizes, and the page indexes let a reader take a few documents,
or only the metadata columns, without reading the rest. A small index table
holds how many ids the earlier files have.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, list_bounds, list_of, parts_for, whole

#: Words that a worker remembers at most; beyond that it starts anew, which changes no result.
REMEMBERED = 300_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000


#: Marks at which a word of letters is cut off.
MARKS = b".,!?;:#$%&*"
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Every byte of Latin-1 as a letter (L), a blank (S), a mark (M) or something else (O).
KINDS = bytes(ord("L" if LETTERS.fullmatch(chr(b)) else "S" if b in b" \t\n\x0b\x0c\r" else "M" if b in MARKS else "O") for b in range(256))


class WordEncoder(dict):
    """Ids of words between blanks, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token crosses it, nor does one cross
    from a letter to a mark such as a comma; so the ids of the pieces that are
    cut there, end to end, are those of the whole text.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,!?;:#$%&*])|[^ \t\n\r]+")
        # A word of letters is one unit to the tokenizer, whose last id, and no other, is that of a word's end.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def words_of(self, text: str) -> list[bytes] | list[str]:
        """Pieces of a text: in Latin-1 and lower case where that is safe, else as strings."""
        data = _small(text)
        if isinstance(data, str):
            return self.word.findall(data)
        kinds = data.translate(KINDS)
        if kinds[:1] == b"M" or b"OM" in kinds or b"MM" in kinds or b"SM" in kinds:
            return [w.encode("latin-1") for w in self.word.findall(data.decode("latin-1"))]
        for mark in MARKS:  # each follows a letter
            if mark in data:
                data = data.replace(b"%c" % mark, b" %c" % mark)
        return data.split()

    def learn(self, words: list[bytes] | list[str]) -> None:
        """Remember the ids of ``words``; some hundreds of plain ones go through the library as one text."""
        if words and isinstance(words[0], bytes):
            texts = dict(zip(b" ".join(words).decode("latin-1").split(" "), words, strict=True))
        else:
            texts = dict(zip(words, words, strict=True))
        plain = [t for t in texts if t.isalpha() and (t.isascii() or LETTERS.fullmatch(t))]
        odd = list(texts.keys() - plain)
        groups = [plain[i:i + 256] for i in range(0, len(plain), 256)]
        codes = self.tokenizer.encode_batch_fast([*map(" ".join, groups), *odd], add_special_tokens=False)
        for group, code in zip(groups, codes):
            ids = np.array(code.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            data = ids.tobytes()
            self.update(zip(map(texts.__getitem__, group), [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        for word, code in zip(odd, codes[len(groups):], strict=True):
            self[texts[word]] = struct.pack(f"<{len(code.ids)}I", *code.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.words_of(t) for t in texts]
        if len(self) >= REMEMBERED:
            self.clear()
        new = list(set().union(*words).difference(self))
        self.learn([w for w in new if isinstance(w, bytes)])
        self.learn([w for w in new if isinstance(w, str)])
        return [b"".join(map(self.__getitem__, ws)) for ws in words]


def _small(text: str) -> str | bytes:
    """The text in Latin-1 with A-Z in lower case, as the tokenizer will have it, so that fewer words differ.

    As it is where it has other characters, or where lower case might not
    commute with the tokenizer's other rules: no special token can arise, and
    no combining mark could join a small letter and not a capital.
    """
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if b"<|" in data else data.lower()


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a worker process, which outlives a task; losing it costs time only."""
    return WordEncoder(path)


def write_tokens(df: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", key: str = "doc_id") -> None:
    """Encode ``text`` of every row, append ``end`` and write files in ascending order of ``key`` below ``path``.

    Null texts count as empty and hold the end id alone. Null keys come first;
    rows with equal keys are ordered by text. An empty table gives files
    without rows. Only ``key`` and ``text`` are read, other columns do no harm.
    """
    spark = df.sparkSession
    source = df.select(F.col(key).cast("long").alias("doc_id"), whole(text).alias("text"))
    ordered = source.repartitionByRange(parts_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        last, part = np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        at = 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            packed = [p + last for p in encoder.encode(batch.column("text").to_pylist())]
            lengths = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            ends = at + np.cumsum(lengths)
            starts, at = ends - lengths, int(ends[-1]) if len(ends) else at
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(lengths), part, np.int32)), pa.array(starts),
                 pa.array(lengths), list_of(lengths, flat, pa.int32())],
                ["doc_id", "part", "at", "n_tokens", "ids"])

        return by_batch(batches, work, 512)

    tokens = ordered.mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids array<int>")
    (tokens.write.mode("overwrite")
     .option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
     .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#at", "false").option("parquet.enable.dictionary#n_tokens", "false")
     .parquet(f"{path}/tokens"))
    # One row for each file; the window runs over those only.
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    (sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
     .write.mode("overwrite").parquet(f"{path}/index"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``start`` counts the ids before a document.

    Filters on ``doc_id`` skip files, row groups and pages; without ``ids``
    only the metadata columns are read. The index has one row for each file.
    """
    tokens = spark.read.schema("doc_id long, part int, at long, n_tokens long, ids array<int>").parquet(f"{path}/tokens")
    index = spark.read.schema("part int, base long").parquet(f"{path}/index")
    return tokens.join(F.broadcast(index), "part").select(
        "doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids")


def ids_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with ``ids_crc32``, the checksum of its ids as little-endian unsigned 32-bit integers, in place of them."""
    kept = [c for c in df.columns if c not in (ids, "ids_crc32")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = list_bounds(batch.column(ids))
            flat = np.asarray(values).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())],
                                             [*kept, "ids_crc32"])

    return df.mapInArrow(run, df.select(*kept, F.lit(0).cast("long").alias("ids_crc32")).schema)
