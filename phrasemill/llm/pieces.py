"""SentencePiece encoding and decoding with a merge-type vocabulary.

A text is cut before every run of word marks (no piece crosses such a place;
the vocabulary is checked for that when it is loaded), each part is merged by
an agenda of adjacent symbol pairs, best score first and leftmost on ties, and
symbols without a piece become their bytes. Parts repeat a lot, so a worker
remembers their ids. The library checks every part when a worker meets it, and
a whole text of every Arrow batch.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, list_of, unused, whole

MARK = "▁"
#: Parts of at most this many symbols are merged together, longer ones one by one.
SHORT = 24
NONE = np.int32(2**31 - 1)
#: Parts that a worker remembers at most; beyond that it starts anew, which changes no result.
REMEMBERED = 300_000


class PieceEncoder(dict):
    """Ids of text parts, as little-endian unsigned 32-bit integers; fills itself."""

    def __init__(self, model: str):
        super().__init__()
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {pieces[i]: i for i in plain}
        # Best score first: a merged piece's place in that order, equal for equal scores, in the high bits of its
        # agenda entry; the place in the text, which breaks ties, in the low bits.
        scores = sorted({-lib.get_score(i) for i in plain})
        place = {s: n << 32 for n, s in enumerate(scores)}
        self.order = {pieces[i]: place[-lib.get_score(i)] for i in plain if len(pieces[i]) > 1}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.part = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+")
        # The same as numbers: a symbol is its piece's id, or beyond those its code point; a pair of symbols has a key.
        self.size = len(pieces)
        pairs = {}
        for piece in self.order:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if (len(a) == 1 or a in self.ids) and (len(b) == 1 or b in self.ids):
                    pairs[self._symbol(a) << 32 | self._symbol(b)] = (self.order[piece] >> 32, self.ids[piece])
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.places = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merges = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)

    def _symbol(self, symbol: str) -> int:
        found = self.ids.get(symbol)
        return self.size + ord(symbol) if found is None else found

    def merged(self, part: str) -> list[int]:
        """The symbols of ``part`` after all merges, by a heap."""
        order, push, pop = self.order.get, heapq.heappush, heapq.heappop
        symbols, last = list(part), len(part) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = [n | i for i in range(last) if (n := order(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = pop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right > last or not symbols[left]:
                continue
            pair = symbols[left] + symbols[right]
            n = order(pair)
            if n is None or n | left != entry:
                continue  # one of the two has been merged otherwise
            symbols[left], symbols[right] = pair, ""
            after[left] = further = after[right]
            if further <= last:
                before[further] = left
                if (n := order(pair + symbols[further])) is not None:
                    push(agenda, n | left)
            if (back := before[left]) >= 0 and (n := order(symbols[back] + pair)) is not None:
                push(agenda, n | back)
        return [self._symbol(s) for s in symbols if s]

    def _entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the piece that each pair makes; ``NONE`` for no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.places[at], NONE)

    def merged_together(self, parts: list[str]) -> list[list[int]]:
        """As ``merged`` for many short parts: an agenda is a row of places, its head the first smallest entry."""
        lengths = np.array([len(p) for p in parts])
        width = int(lengths.max())
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen, which = np.unique(points, return_inverse=True)
        symbols = np.full((len(parts), width + 1), -1, dtype=np.int32)
        symbols[:, :width][np.arange(width) < lengths[:, None]] = np.array(
            [self._symbol(chr(c)) for c in seen.tolist()], dtype=np.int32)[which]
        agenda = self._entries(symbols[:, :-1], symbols[:, 1:])
        done: list[list[int]] = [[]] * len(parts)
        rows, columns = np.arange(len(parts)), np.arange(width)
        while len(rows):
            head = agenda.argmin(axis=1)
            every = np.arange(len(rows))
            over = agenda[every, head] == NONE
            if over.any():
                ended = symbols[over]
                sizes = (ended >= 0).sum(axis=1)
                for row, line, n in zip(rows[over].tolist(), ended.tolist(), sizes.tolist(), strict=True):
                    done[row] = line[:n]
                rows, symbols, agenda, head = rows[~over], symbols[~over], agenda[~over], head[~over]
                every = np.arange(len(rows))
            if not len(rows):
                break
            keys = symbols[every, head].astype(np.int64) << 32 | symbols[every, head + 1]
            made = self.merges[np.searchsorted(self.keys, keys)]
            # Everything right of the pair moves one place to the left.
            shifted = np.minimum(columns + (columns > head[:, None]), width)
            symbols[:, :width] = np.take_along_axis(symbols, shifted, axis=1)
            symbols[:, width] = -1
            symbols[every, head] = made
            agenda = np.take_along_axis(np.pad(agenda, ((0, 0), (0, 1)), constant_values=NONE), shifted, axis=1)
            agenda[every, head] = self._entries(made, symbols[every, head + 1])
            inner = np.flatnonzero(head)
            agenda[inner, head[inner] - 1] = self._entries(symbols[inner, head[inner] - 1], made[inner])
        return done

    def learn(self, parts: list[str]) -> None:
        """Remember the ids of ``parts``."""
        short = sorted((p for p in parts if len(p) <= SHORT), key=len)
        long = [p for p in parts if len(p) > SHORT]
        found = [x for at in range(0, len(short), 4096) for x in self.merged_together(short[at:at + 4096])]
        found += [self.merged(p) for p in long]
        for part, symbols in zip(short + long, found, strict=True):
            if max(symbols) >= self.size:
                ids = []
                for s in symbols:
                    ids += [s] if s < self.size else [self.bytes[b] for b in chr(s - self.size).encode()]
                symbols = ids
            self[part] = struct.pack(f"<{len(symbols)}I", *symbols)

    def encode(self, texts: list[str], check: bool = True) -> tuple[list[bytes], bool]:
        """Ids of whole texts, without begin and end, and whether the library agrees wherever it was asked."""
        parts = [self.part.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self) >= REMEMBERED:
            self.clear()
        new = list({p for ps in parts for p in ps if p not in self})
        self.learn(new)
        packed = [b"".join(map(self.__getitem__, ps)) for ps in parts]
        agrees = True
        if check:
            # The library puts a mark before a text, as the part has it; a mark alone is a piece of its own.
            asked = [p for p in new if len(p) > 1]
            of_parts = self.library.encode([p[1:] for p in asked], num_threads=1)
            agrees = all(struct.pack(f"<{len(w)}I", *w) == self[p] for p, w in zip(asked, of_parts, strict=True))
            if texts:
                first = self.library.encode(texts[0])
                agrees &= struct.pack(f"<{len(first)}I", *first) == packed[0]
        return packed, agrees

    def whole(self, texts: list[str], begin_end: bool, check: bool = True) -> tuple[list[bytes], bool]:
        """As ``encode``, with the begin and end ids if wanted."""
        packed, agrees = self.encode(texts, check)
        if begin_end:
            first, last = (struct.pack("<I", i) for i in (self.library.bos_id(), self.library.eos_id()))
            packed = [first + p + last for p in packed]
        return packed, agrees


@functools.lru_cache(maxsize=2)
def encoder_of(model: str) -> PieceEncoder:
    """The encoder of a worker process, which outlives a task; losing it costs time only."""
    return PieceEncoder(model)


def encode_pieces(df: DataFrame, model: str, text: str = "text", ids: str = "ids", agrees: str = "library_agrees",
                  begin_end: bool = True, check: bool = True) -> DataFrame:
    """``df`` with the ids of ``text`` (list of int) and whether the library agrees on the row's Arrow batch.

    A null text counts as empty; an empty text has only the begin and end ids.
    Rows are independent: repeated rows and ties need no rule, an empty table
    gives an empty table. Columns of ``df`` with the names of new ones are
    replaced. With ``check`` off, ``agrees`` is null.
    """
    kept = [c for c in df.columns if c not in (ids, agrees)]
    held = unused(df, "text")
    source = df.withColumn(held, whole(text)).select(*kept, held)
    schema = source.drop(held).withColumns({ids: F.array(F.lit(0)), agrees: F.lit(None).cast("boolean")}).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed, same = encoder_of(model).whole(batch.column(held).to_pylist(), begin_end, check)
        lengths = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), list_of(lengths, flat, pa.int32()),
             pa.array([same if check else None] * len(packed), pa.bool_())], [*kept, ids, agrees])

    return source.mapInArrow(lambda batches: by_batch(batches, work, 256), schema)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its id lists, by the library; a null list counts as empty.

    Control ids give no text. A column named ``text`` is replaced.
    """
    kept = [c for c in df.columns if c != text]
    source = df.withColumn(ids, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))).select(*kept)
    schema = source.withColumn(text, F.lit("")).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = encoder_of(model).library.decode(batch.column(ids).to_pylist(), num_threads=1) if batch.num_rows else []
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, text])

    return source.mapInArrow(lambda batches: by_batch(batches, work, 256), schema)


def round_trip(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode with begin and end ids and decode again in one pass, so that no ids leave the worker.

    (key, n_tokens, ids_sha256, decoded_sha256, library_agrees) of every row:
    the digests of the ids as little-endian unsigned 32-bit integers and of the
    decoded text in UTF-8. Nulls, empty texts and tables as in ``encode_pieces``;
    further columns are not read.
    """
    source = df.select(F.col(key).alias(key), whole(text).alias("held"))
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"]
    schema = source.select(key, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"),
                           F.lit("").alias("decoded_sha256"), F.lit(True).alias("library_agrees")).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoder_of(model)
        packed, same = encoder.whole(batch.column(1).to_pylist(), True)
        ids = [np.frombuffer(p, "<u4").tolist() for p in packed]
        decoded = encoder.library.decode(ids, num_threads=1) if ids else []
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array([len(i) for i in ids], pa.int64()), pa.array([digest(p) for p in packed], pa.string()),
             pa.array([digest(t.encode()) for t in decoded], pa.string()), pa.array([same] * len(ids), pa.bool_())], names)

    return source.mapInArrow(lambda batches: by_batch(batches, work, 256), schema)
