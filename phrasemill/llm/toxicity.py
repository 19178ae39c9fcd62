"""Toxicity by compression distance.

Two zstandard dictionaries share what ordinary text has in common; one of them
also holds what a dictionary trainer makes of the strings that toxic documents
use more than ordinary ones, the other what it makes of the reverse. A document
is cut into windows of a few words, each is compressed with either dictionary,
and the difference of the two lengths is the window's evidence. Thresholds on
that difference are calibrated on labelled rows: each step of it gets a
log-likelihood ratio, a document adds them up, and a logistic curve makes a
probability of the sum.

The dictionaries and the curve are fitted on at most ``FIT_DOCS`` labelled
rows; whole texts are scored.
"""

from __future__ import annotations

import collections
import itertools
import math
import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, parts_for, unused, whole
from phrasemill.session import written

#: Labelled rows to fit on, at most, and windows of those rows that the shared dictionary is trained on, at most.
FIT_DOCS = 6000
FIT_WINDOWS = 30_000
WINDOW_WORDS = 8
#: A window without blanks is cut into pieces of this many bytes.
WINDOW_BYTES = 400
#: Texts with more characters are cut into strings piece by piece.
LONG = 200_000
#: Different strings that a task counts before it hands its counts on, besides those of one text.
HELD = 200_000
SHARED_BYTES = 64 << 10
OWN_BYTES = 4 << 10
#: Strings that tell the classes apart: characters, and standard errors between their rates.
STRING = range(4, 13)
APART = 7.0
#: Differences of length are told apart from here to here.
LEAST, MOST = -4, 8
SCORE_CUT = 0.3


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """The text in lower case, a few words at a time."""
    found = text.lower().split()
    out = [(" " + " ".join(found[i:i + words]) + " ").encode("utf-8", "replace") for i in range(0, len(found), words)]
    if any(len(w) > WINDOW_BYTES for w in out):
        out = [w[i:i + WINDOW_BYTES] for w in out for i in range(0, len(w), WINDOW_BYTES)]
    return out


def strings(text: str) -> set[str]:
    """All short strings of a text's words, their blanks included."""
    found = set()
    for word in set(text.lower().split()):
        held = f" {word} "
        for n in STRING:
            found.update(held[i:i + n] for i in range(len(held) - n + 1))
    return found


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, y, s): the strings of texts, a part of a text at a time, so some more than once."""
    step = LONG // 10

    def told(row: int, y: int, found: set[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([y] * len(found), pa.int32()),
                                           pa.array(list(found), pa.string())], ["row", "y", "s"])

    for batch in batches:
        for row, text, y in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "y")), strict=True):
            found: set[str] = set()
            for word in set(text.lower().split()):
                held = f" {word} "
                for at in range(0, len(held), step):
                    piece = held[at:at + step + STRING[-1] - 1]
                    found.update(piece[i:i + n] for n in STRING for i in range(len(piece) - n + 1))
                    if len(found) > LONG:
                        yield told(row, y, found)
                        found = set()
            yield told(row, y, found)


def _counts(batches: Iterable[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """(s, o, t): in how many texts of either class a string is; a string comes again once ``held`` others were counted."""

    def told(seen: tuple[collections.Counter, collections.Counter]) -> Iterator[pa.RecordBatch]:
        for o, names in ((1, seen[0]), (0, seen[1])):
            each = iter(names.items())
            while part := list(itertools.islice(each, 50_000)):
                n, none = pa.array([k for _, k in part], pa.int64()), pa.array([0] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.string()), *((n, none) if o else (none, n))], ["s", "o", "t"])

    seen: tuple[collections.Counter, collections.Counter] = (collections.Counter(), collections.Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            seen[y].update(strings(text))
            if len(seen[0]) + len(seen[1]) > held:
                yield from told(seen)
                seen = collections.Counter(), collections.Counter()
    yield from told(seen)


@dataclass
class Dictionaries:
    """Content of the two dictionaries."""

    toxic: bytes
    ordinary: bytes

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters.from_level(
            3, min_match=3, write_checksum=False, write_content_size=False, write_dict_id=False)
        return tuple(zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(
            content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for content in (self.toxic, self.ordinary))


def differences(text: str, compressors: tuple) -> np.ndarray:
    """How many bytes the toxic dictionary saves in each window over the ordinary one."""
    toxic, ordinary = compressors[0].compress, compressors[1].compress
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], dtype=np.int64)


def histogram(text: str, compressors: tuple) -> np.ndarray:
    return np.bincount(np.clip(differences(text, compressors), LEAST, MOST) - LEAST, minlength=MOST - LEAST + 1)


def _trained(samples: list[bytes], size: int, **settings: int) -> bytes:
    """Content of a trained dictionary; too little text to train on is itself the content."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, **settings).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def telling(counts: dict[str, tuple[int, int]], rows: tuple[int, int]) -> tuple[list, list]:
    """Strings far more frequent in one class: (string, documents) lists for toxic and ordinary.

    Of strings that contain each other the one that tells most speaks, made as
    long as it can be while it tells nearly as much.
    """
    ordinary, toxic = rows
    apart = {}
    for s, (o, t) in counts.items():
        p = (o + t) / (ordinary + toxic)
        if 0 < p < 1:
            apart[s] = (t / toxic - o / ordinary) / math.sqrt(p * (1 - p) * (1 / ordinary + 1 / toxic))
    out = []
    for sign in (1, -1):
        mine = {s: sign * z for s, z in apart.items() if sign * z >= APART}
        taken: list[str] = []
        for s in sorted(mine, key=lambda s: (-mine[s], s)):
            if any(s in x or x in s for x in taken):
                continue
            taken.append(max((x for x in mine if s in x and mine[x] >= 0.85 * mine[s] and not any(y in x for y in taken)),
                             key=lambda x: (len(x), x), default=s))
        out.append([(s, sum(counts[s])) for s in taken])
    return out[0], out[1]


def _own(found: list[tuple[str, int]]) -> bytes:
    samples = [(s * 4).encode() for s, n in found for _ in range(n)]
    random.Random(1).shuffle(samples)  # the trainer takes its samples in turn
    return _trained(samples, OWN_BYTES, k=20, d=8)


@dataclass
class Model:
    """Dictionaries, evidence of each length difference, and the curve from its sum to a probability."""

    dictionaries: Dictionaries
    evidence: np.ndarray
    curve: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities from one histogram of differences for each document."""
        return 1 / (1 + np.exp(-np.clip(_inputs(counts, self.evidence) @ self.curve, -50, 50)))


def _inputs(counts: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    total = counts @ evidence
    return np.stack([total, total / np.sqrt(np.maximum(counts.sum(axis=1), 1)), np.ones(len(total))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve by Newton steps, until they rest."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        most: int = FIT_DOCS) -> Model:
    """A model from the texts of ``df`` that ``labels`` (key, label) has a label for.

    At most ``most`` labels are used, chosen by hash of the key, and copies of
    a text once; so the texts to fit on are picked where they lie. Labels that
    are null or have no text are left out, null texts count as empty. With one
    class only, every score is that class's share.
    """
    spark = df.sparkSession
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).dropna().orderBy(
        F.xxhash64("key"), "key", "y").limit(most)
    rows = df.select(F.col(key).alias("key"), whole(text).alias("text"))
    sample = rows.join(F.broadcast(chosen), "key").dropDuplicates(["text", "y"])
    sample = written(sample.repartition(parts_for(spark), F.xxhash64("key")).select("text", "y"), "toxicity-fit")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n = (sizes.get(0, 0), sizes.get(1, 0))
    if not min(n):
        share = n[1] / max(sum(n), 1)
        flat = np.array([0.0, 0.0, 50.0 if share else -50.0])
        return Model(Dictionaries(b"", b""), np.zeros(MOST - LEAST + 1), flat)

    # A text with a very long word has too many strings for one set: it goes through in pieces, and Spark drops the repeats.
    long = F.length("text") > LONG
    each = sample.filter(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(_pieces, "row long, y int, s string").distinct()
    pieces = each.groupBy("s").agg(F.count_if(F.col("y") == 0).alias("o"), F.count_if(F.col("y") == 1).alias("t"))

    # At least five documents, and rates that differ by the error wanted.
    p = (F.col("o") + F.col("t")) / sum(n)
    z = (F.col("t") / n[1] - F.col("o") / n[0]) / F.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))
    far = written(sample.filter(~long).mapInArrow(_counts, "s string, o long, t long").unionByName(pieces).groupBy("s").agg(
        F.sum("o").alias("o"), F.sum("t").alias("t")).filter((F.col("o") + F.col("t") >= 5) & (F.abs(z) >= APART)), "telling")
    # Strings that are always part of the same longer one say nothing of their own.
    parts = far.filter(F.length("s") > STRING[0]).select(F.explode(F.array(
        F.expr("substr(s, 1, length(s) - 1)"), F.expr("substr(s, 2)"))).alias("s"), "o", "t")
    told = far.join(parts.distinct(), ["s", "o", "t"], "left_anti").collect()
    toxic, ordinary = telling({r["s"]: (r["o"], r["t"]) for r in told}, n)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(windows(t), pa.binary())], ["w"])

    common = (sample.filter("y = 0").select("text").mapInArrow(cut, "w binary").orderBy(F.xxhash64("w"), "w")
              .limit(FIT_WINDOWS).collect())
    shared = _trained([bytes(r["w"]) for r in common], SHARED_BYTES)
    own = _own(toxic), _own(ordinary)
    size = max(map(len, own))  # equal lengths, so that what is shared lies equally far back
    dictionaries = Dictionaries(*(x.rjust(size, b"\0") + shared for x in own))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = dictionaries.compressors()
        for batch in batches:
            found = [histogram(t, compressors).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch.column("y")], ["h", "y"])

    measured = sample.mapInArrow(measure, "h array<long>, y int").collect()  # a short row for each fitted document
    counts, y = np.array([r["h"] for r in measured], dtype=np.float64), np.array([r["y"] for r in measured])
    rate = lambda c: (c.sum(axis=0) + 1) / (c.sum() + c.shape[1])
    evidence = np.log(rate(counts[y == 1]) / rate(counts[y == 0]))
    return Model(dictionaries, evidence, logistic(_inputs(counts, evidence), y))


def score_toxicity(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the probability that each text is toxic.

    A null text counts as empty; an empty text has no window and gets the
    probability of no evidence. Rows are independent, so repeated rows and ties
    need no rule; a column named ``score`` is replaced; an empty table gives an
    empty table.
    """
    held = unused(df, "held")
    kept = [c for c in df.columns if c != score]
    source = df.withColumn(held, whole(text)).select(*kept, held)
    schema = source.drop(held).withColumn(score, F.lit(0.0)).schema
    shipped = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 68 KB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        compressors = model.dictionaries.compressors()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = np.array([histogram(t, compressors) for t in batch.column(held).to_pylist()],
                              dtype=np.float64).reshape(-1, MOST - LEAST + 1)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(counts))],
                                              [*kept, score])

        return by_batch(batches, work, 256)

    return source.mapInArrow(run, schema)
