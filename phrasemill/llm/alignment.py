"""Alignment of the tokens of two tokenizers, and how often their tokens meet over a corpus.

A text is encoded by a byte-level vocabulary (A) and by a SentencePiece
vocabulary (B). Byte offsets where tokens of both end cut it into groups; tokens
of one group are linked. The two arrays of token ends are compared at a fixed
shift of their indexes, by probes of growing length, so that stretches where the
tokens agree one to one are passed in a few comparisons of memory; where they
differ, the smaller end is moved up until the ends meet again, and the shift of
the next stretch is what that left.

Pairs of ids are counted over the corpus by documents. Counts of the most
frequent pairs, a bounded number of them, travel to the documents; the pairs
that are left, none of which is frequent, go to their counts by a shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.session import written

#: Text bytes of a piece of an Arrow batch; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20
#: Groups with more links than this are crossed one by one, by their distinct ids.
WIDE = 4096
#: Pairs whose counts are broadcast, at most (12 bytes each).
BROADCAST_PAIRS = 2_000_000
#: Distinct pairs that a counting task holds before it hands them on.
HELD_PAIRS = 2_000_000
#: Texts whose characters all come before this one are split into words alike by all versions of Unicode's tables.
SETTLED = "͸"


class ByteVocabulary:
    """A byte-level vocabulary of the tokenizers library: ids of texts, and the bytes of a token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The printable stand-ins of bytes: those that print stand for themselves, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        vocabulary = self.library.get_vocab()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        # The same vocabulary for the quicker library, if merges rank as their ids do; else the first one does all.
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
        same = made == sorted(set(made)) and len(ranks) == len(made) + 256
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if same else None

    def exact(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts; one text of each call goes through both libraries, which must agree."""
        if self.quick is None:
            return self.exact(texts)
        settled = [t.isascii() or max(t) < SETTLED for t in texts]
        rest = iter(self.exact([t for t, s in zip(texts, settled, strict=True) if not s]))
        out = [self.quick.encode_ordinary(t) if s else next(rest) for t, s in zip(texts, settled, strict=True)]
        if texts and settled[0] and self.exact(texts[:1])[0] != out[0]:
            raise ValueError("the two libraries disagree on the byte-level vocabulary")
        return out


class PieceVocabulary:
    """A SentencePiece vocabulary: ids of texts, and the bytes of a token."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode()
                      for i in range(lib.get_piece_size()) for p in [lib.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []


class Pair:
    """Both vocabularies, and tables over their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteVocabulary(byte_path), PieceVocabulary(piece_path)
        self.length_a, self.length_b = (np.array([len(x) for x in v.bytes], dtype=np.int64) for v in (self.a, self.b))
        self.base = len(self.b.bytes)
        # Decimal ids with what follows them: inside its side, or as the side's last.
        self.text = [f"{i}{c}".encode() for c, n in ((",", len(self.a.bytes)), ("|", len(self.a.bytes)),
                                                     (",", self.base), (";", self.base)) for i in range(n)]


@functools.lru_cache(maxsize=2)
def vocabularies(byte_path: str, piece_path: str) -> Pair:
    """The vocabularies of a worker process, which outlive a task; losing them costs time only."""
    return Pair(byte_path, piece_path)


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A tokens and of B tokens up to each place where both end.

    Both arrays rise strictly and have the same last value.
    """
    width = 8
    raw_a, raw_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(list_a), len(list_b)
    found: list[int] = []  # first A token, first B token and length of each stretch
    i = j = 0
    while i < n_a:
        a, b = list_a[i], list_b[j]
        run = 1
        if a == b:
            # A one-to-one stretch: double the probe until it fails, then halve it.
            step, most = 1, min(n_a - i, n_b - j)
            while run + step <= most:
                x, y, n = width * (i + run), width * (j + run), width * step
                if raw_a[x:x + n] != raw_b[y:y + n]:
                    break
                run += step
                step *= 2
            while step > 1:
                step //= 2
                x, y, n = width * (i + run), width * (j + run), width * step
                if run + step <= most and raw_a[x:x + n] == raw_b[y:y + n]:
                    run += step
        else:
            while a != b:
                if a < b:
                    i += 1
                    a = list_a[i]
                else:
                    j += 1
                    b = list_b[j]
        found += (i, j, run)
        i += run
        j += run
    first_a, first_b, runs = np.array(found, dtype=np.int64).reshape(-1, 3).T
    place = np.arange(1, int(runs.sum()) + 1) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first_a, runs) + place, np.repeat(first_b, runs) + place


@dataclass
class Aligned:
    """Some texts after alignment; arrays have a value for each text, pairs are (text, A id * base + B id, times)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    of: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _sums(values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``values`` for each number in ``of``, which rises."""
    edges = np.searchsorted(of, np.arange(size + 1))
    return np.diff(np.concatenate([[0], np.cumsum(values)])[edges])


def _links(ids_a: np.ndarray, ids_b: np.ndarray, p: np.ndarray, q: np.ndarray, of: np.ndarray, base: int,
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) of all links and how often each occurs, in order."""
    first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
    wide = p * q > WIDE
    span = np.int64(base) * (int(ids_a.max(initial=0)) + 1)
    small = ~wide
    n = (p * q)[small]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    q_of = np.repeat(q[small], n)
    down = within // q_of
    keys = (np.repeat(of[small], n) * span + ids_a[np.repeat(first_a[small], n) + down].astype(np.int64) * base
            + ids_b[np.repeat(first_b[small], n) + within - down * q_of])
    found, times = np.unique(keys, return_counts=True)
    if wide.any():
        parts, counts = [found], [times.astype(np.int64)]
        for g in np.flatnonzero(wide).tolist():
            a, m = np.unique(ids_a[first_a[g]:first_a[g] + p[g]], return_counts=True)
            b, k = np.unique(ids_b[first_b[g]:first_b[g] + q[g]], return_counts=True)
            parts.append((of[g] * span + a.astype(np.int64)[:, None] * base + b[None, :]).ravel())
            counts.append((m.astype(np.int64)[:, None] * k[None, :]).ravel())
        found, where = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.zeros(len(found), dtype=np.int64)
        np.add.at(times, where, np.concatenate(counts))
    return found // span, found % span, times


def align_texts(texts: list[str], pair: Pair) -> Aligned:
    """Align whole texts; one that is empty or that a vocabulary does not keep byte by byte has no tokens."""
    size = len(texts)
    data = [b" " + t.encode() for t in texts]
    all_a = pair.a.encode([" " + t for t in texts])
    all_b = pair.b.encode(texts)
    for d, raw in enumerate(data):
        if (len(raw) == 1 or b"".join(map(pair.a.bytes.__getitem__, all_a[d])) != raw
                or b"".join(map(pair.b.bytes.__getitem__, all_b[d])) != raw):
            all_a[d] = all_b[d] = []
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (all_a, all_b))
    ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int64, count=int(n.sum()))
                    for ids, n in ((all_a, n_a), (all_b, n_b)))
    ends_a, ends_b = np.cumsum(pair.length_a[ids_a]), np.cumsum(pair.length_b[ids_b])
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    cuts_a, cuts_b, n_groups = [], [], np.zeros(size, dtype=np.int64)
    for d in np.flatnonzero(n_a).tolist():
        a, b, n, m = from_a[d], from_b[d], n_a[d], n_b[d]
        got_a, got_b = shared_ends(ends_a[a:a + n], ends_b[b:b + m])
        cuts_a.append(got_a + a)
        cuts_b.append(got_b + b)
        n_groups[d] = len(got_a)
    none = np.zeros(0, dtype=np.int64)
    cut_a, cut_b = np.concatenate([none, *cuts_a]), np.concatenate([none, *cuts_b])
    p, q = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    of = np.repeat(np.arange(size), n_groups)
    # The groups as text: A tokens stand before the B tokens of their group; the last of a side has another mark.
    groups = np.arange(len(p))
    last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    last_a[cut_a - 1] = last_b[cut_b - 1] = 1
    order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    order[np.arange(len(ids_a)) + (cut_b - q)[np.repeat(groups, p)]] = ids_a + last_a * len(pair.a.bytes)
    order[np.arange(len(ids_b)) + cut_a[np.repeat(groups, q)]] = ids_b + last_b * pair.base + 2 * len(pair.a.bytes)
    marks, digests = order.tolist(), []
    at = 0
    for n in (n_a + n_b).tolist():
        told = b"".join(map(pair.text.__getitem__, marks[at:at + n]))
        digests.append(hashlib.sha256(told[:-1]).hexdigest() if n else "")
        at += n
    found, pairs, times = _links(ids_a, ids_b, p, q, of, pair.base)
    return Aligned(n_a, n_b, n_groups, _sums(p * q, of, size), digests, found, pairs, times)


def _pieces(column: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Rows from and to of pieces with a bounded number of text bytes, or a single text."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]) if len(column) else []
    at = held = 0
    for i, size in enumerate(sizes):
        if i > at and held + size > PIECE_BYTES:
            yield at, i
            at, held = i, 0
        held += size
    if at < len(column):
        yield at, len(column)


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def _aligned_rows(docs: DataFrame, byte_path: str, piece_path: str, key: str, text: str) -> DataFrame:
    """Facts of every document, its distinct pairs and how often it has them (binary), under a row number."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    names = ["key", *FACTS, "groups_sha256", "pairs", "times"]
    schema = source.select("key", *[F.lit(0).cast("long").alias(c) for c in FACTS], F.lit("").alias("groups_sha256"),
                           F.lit(b"").alias("pairs"), F.lit(b"").alias("times")).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(byte_path, piece_path)
        for batch in batches:
            for a, b in _pieces(batch.column("text")):
                rows = batch.slice(a, b - a)
                got = align_texts(rows.column("text").to_pylist(), pair)
                edges = np.searchsorted(got.of, np.arange(rows.num_rows + 1)).tolist()
                each = list(zip(edges[:-1], edges[1:], strict=True))
                keys, times = got.pairs.astype("<u4" if pair.base * len(pair.a.bytes) < 1 << 32 else "<i8"), got.times.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), *(pa.array(getattr(got, c)) for c in FACTS), pa.array(got.digests, pa.string()),
                     *(pa.array([v[x:y].tobytes() for x, y in each], pa.binary()) for v in (keys, times))], names)

    return source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def _unpacked(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(times, "<u4")
    return np.frombuffer(pairs, "<u4" if len(pairs) == len(times) else "<i8").astype(np.int64), n.astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs): in how many of a task's documents a pair is linked, a few times for the same pair if they are many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    room = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        pairs, where = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        docs = np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(pairs)).astype(np.int64)
        return pairs, docs

    def told(pairs: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[at:at + 100_000]), pa.array(docs[at:at + 100_000])], ["pair", "docs"])

    for batch in batches:
        pairs, times = (batch.column(c).to_pylist() for c in ("pairs", "times"))
        for at in range(0, len(pairs), 500):
            seen = np.concatenate([_unpacked(p, t)[0] for p, t in zip(pairs[at:at + 500], times[at:at + 500], strict=True)])
            one, docs = np.unique(seen, return_counts=True)
            held.append((one, docs.astype(np.int64)))
            room += len(one)
            if room > HELD_PAIRS:
                held = [merged()]
                room = len(held[0][0])
                if room > HELD_PAIRS // 2:
                    yield from told(*held[0])
                    held, room = [], 0
    if held:
        yield from told(*merged())


@dataclass
class Alignment:
    """``documents``: facts of every document. ``pairs``: (a, b, docs, best), how many documents link two ids."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text",
          broadcast_pairs: int = BROADCAST_PAIRS) -> Alignment:
    """Align every document and weigh its links by what the corpus links.

    ``documents`` has (key, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256) for every row: ``count_sum`` adds, over the links, in how
    many documents their ids are linked; ``n_best`` counts the links where no
    other B id is linked with the A id in more documents. A text that is null,
    empty, or not kept byte by byte by both vocabularies has zeros and no
    digest. Rows are documents of their own, so repeated or null keys and equal
    texts need no rule; only ``key`` and ``text`` are read, other columns do no
    harm; an empty table gives empty tables. Executors need the two files.
    """
    spark = docs.sparkSession
    rows = written(_aligned_rows(docs, byte_path, piece_path, key, text), "aligned")
    base = vocabularies(byte_path, piece_path).base
    counts = written(rows.select("pairs", "times").mapInArrow(_counted, "pair long, docs long")
                     .groupBy("pair").agg(F.sum("docs").alias("docs")), "counts")
    a = F.expr(f"pair div {base}")
    # One row for each A id.
    tops = F.broadcast(counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top")))
    facts = written(counts.withColumn("a", a).join(tops, "a").select(
        "pair", "a", (F.col("pair") % base).alias("b"), "docs", (F.col("docs") == F.col("top")).alias("best")), "facts")
    # The smallest power of two such that the pairs with so many documents are few enough.
    steps = {r.step: r.n for r in facts.groupBy(F.floor(F.log2("docs")).alias("step")).agg(F.count("*").alias("n")).collect()}
    least, n = max(steps, default=-1) + 1, 0
    while least > 0 and n + steps.get(least - 1, 0) <= broadcast_pairs:
        least, n = least - 1, n + steps.get(least - 1, 0)
    often = F.col("docs") >= (1 << least)
    table = facts.filter(often).select("pair", "docs", "best").toArrow()
    pairs = table.column("pair").to_numpy()
    up = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[up], table.column("docs").to_numpy()[up],
                                         table.column("best").to_numpy(zero_copy_only=False)[up]))
    names = ["row", key, *FACTS, "n_best", "count_sum", "groups_sha256", "rest", "rest_times"]
    schema = rows.select("row", F.col("key").alias(key), *FACTS, F.lit(0).cast("long").alias("n_best"),
                         F.lit(0).cast("long").alias("count_sum"), "groups_sha256",
                         F.array(F.lit(0).cast("long")).alias("rest"), F.array(F.lit(0).cast("long")).alias("rest_times")).schema

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs_of, best_of = sent.value
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, 500):
                batch = whole_batch.slice(begin, 500)
                each = [_unpacked(p, t) for p, t in zip(*(batch.column(c).to_pylist() for c in ("pairs", "times")), strict=True)]
                sizes = np.array([len(p) for p, _ in each])
                found, times = (np.concatenate([x[i] for x in each]) for i in (0, 1))
                of = np.repeat(np.arange(len(each)), sizes)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                hit = known[at] == found if len(known) else np.zeros(len(found), dtype=bool)
                at = np.where(hit, at, 0)
                zero = np.zeros(1, dtype=np.int64)
                count = np.where(hit, (docs_of if len(known) else zero)[at], 0) * times
                best = np.where(hit & (best_of if len(known) else zero)[at].astype(bool), times, 0)
                left = ~hit
                offsets = np.concatenate([[0], np.cumsum(_sums(left.astype(np.int64), of, len(each)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("key"), *(batch.column(c) for c in FACTS),
                     pa.array(_sums(best, of, len(each))), pa.array(_sums(count, of, len(each))), batch.column("groups_sha256"),
                     *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[left])) for v in (found, times))], names)

    weighed = rows.mapInArrow(weigh, schema)
    columns = [key, *FACTS, "n_best", "count_sum", "groups_sha256"]
    if least > 0:  # pairs are left, each of fewer than ``1 << least`` documents
        weighed = written(weighed, "weighed")
        rest = (weighed.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x"))
                .select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
                .join(facts.filter(~often), "pair").groupBy("row").agg(
                    F.sum(F.col("docs") * F.col("times")).alias("_sum"),
                    F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best")))
        weighed = weighed.join(rest, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return Alignment(weighed.select(*columns), facts.select("a", "b", "docs", "best"))
