"""Text quality by positive-unlabelled learning.

Only trusted good documents are labelled; the rest of the corpus is unlabelled
and holds an unknown share of good ones. A first model tells trusted from
unlabelled documents. The class prior is read from its scores over the whole
corpus: the smallest ratio, over all cuts, of unlabelled to trusted documents
above the cut, with a margin for chance. A second model then minimises the
non-negative unbiased risk under that prior.

Models are small networks on shape features of whole texts (no word lists, no
language): they are fitted on bounded samples, features and the prior cover
every row.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import by_batch, list_of, unused, whole
from phrasemill.session import written

#: Trusted and unlabelled rows to fit on, at most.
FIT_TRUSTED = 4000
FIT_UNLABELLED = 8000
HIDDEN = 16
STEPS = 500
BINS = 200
SCORE_CUT = 0.3

_GROUPS = np.zeros(256, dtype=np.int64)  # of bytes: 0 letters, 1 capitals, 2 digits, 3 blanks, 4 line ends ...
for _n, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'-", b"!?", b"|",
                             b"#$%&*+=<>@^_~/\\`", b"()[]{}\""), 1):
    _GROUPS[list(_bytes)] = _n
_GROUPS[[*range(9), 11, 12, *range(14, 32), 127]] = 10
FEATURES = 18


def features(text: str) -> list[float]:
    """Shape of a whole text; all zeros if it is empty."""
    data = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [0.0] * FEATURES
    n, size = len(words), len(data)
    groups = np.bincount(_GROUPS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=11).tolist()
    distinct = len(set(words))
    repeated = sum(map(operator.eq, words, words[1:]))
    capital = sum(w[0].isupper() for w in words)
    bare = sum(not w[0].isalnum() for w in words)
    letters = max(groups[0] + groups[1], 1)
    per_word = lambda k: math.log1p(100 * groups[k] / n)
    return [1.0, math.log(n), (size - groups[3] - groups[4]) / n, math.log1p(100 * groups[1] / letters), per_word(2), per_word(4),
            per_word(5), per_word(6), per_word(7), per_word(8), per_word(9), per_word(10), math.log(distinct) - math.log(n),
            math.log1p(100 * repeated / n), math.log1p(100 * capital / n), math.log1p(100 * bare / n),
            len(zlib.compress(data, 1)) / size, math.log(size)]


def feature_table(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the features of each text in place of it; a null text counts as empty."""
    held = unused(df, "held")
    kept = [c for c in df.columns if c not in (text, "shape")]
    source = df.withColumn(held, whole(text)).select(*kept, held)
    schema = source.drop(held).withColumn("shape", F.array(F.lit(0.0))).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t) for t in batch.column(held).to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in kept), list_of(np.full(len(found), FEATURES), found.ravel(), pa.float64())],
            [*kept, "shape"])

    return source.mapInArrow(lambda batches: by_batch(batches, work), schema)


@dataclass
class Network:
    """One hidden layer over centred and scaled features."""

    centre: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def hidden(self, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.hstack([np.clip((shapes - self.centre) / self.scale, -8, 8), np.ones((len(shapes), 1))])
        return x, np.hstack([np.tanh(x @ self.inner), np.ones((len(shapes), 1))])

    def score(self, shapes: np.ndarray) -> np.ndarray:
        return _sigmoid(self.hidden(shapes)[1] @ self.outer)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train(trusted: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5, steps: int = STEPS,
          decay: float = 1e-3) -> Network:
    """A network of least risk with logistic loss.

    Without a prior, unlabelled rows count as negative. With one, the negative
    risk is that of the unlabelled rows less the trusted rows' part in it; where
    it falls below nothing, the step goes the other way for it (non-negative
    risk), as a smaller value can only come from overfitting.
    """
    rng = np.random.default_rng(seed)
    spread = unlabelled.std(axis=0)
    net = Network(unlabelled.mean(axis=0), np.where(spread > 1e-9, spread, 1.0),
                  rng.normal(0, 0.4, (unlabelled.shape[1] + 1, HIDDEN)), rng.normal(0, 0.1, HIDDEN + 1))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (net.inner, net.outer)]
    for step in range(1, steps + 1):
        xp, hp = net.hidden(trusted)
        xu, hu = net.hidden(unlabelled)
        zp, zu = hp @ net.outer, hu @ net.outer
        # Derivatives of log(1 + exp(-z)) and log(1 + exp(z)) are -sigmoid(-z) and sigmoid(z).
        if prior is None:
            gp, gu = -_sigmoid(-zp) / len(zp), _sigmoid(zu) / len(zu)
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp, gu = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
            if negative < 0:
                gp, gu = -gp, -gu
            else:
                gp = gp - prior * _sigmoid(-zp) / len(zp)
        outer = hp.T @ gp + hu.T @ gu + decay * net.outer
        back = lambda x, h, g: x.T @ (np.outer(g, net.outer[:-1]) * (1 - h[:, :-1] ** 2))  # noqa: E731, B023
        inner = back(xp, hp, gp) + back(xu, hu, gu) + decay * net.inner
        for w, g, (m, v) in zip((net.inner, net.outer), (inner, outer), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def prior_of(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from counts of both by rising score.

    Above a cut there are at least as many unlabelled rows as the positives
    among them; the tightest cut tells, once chance is allowed for.
    """
    p, u = trusted.sum(), unlabelled.sum()
    if not p or not u:
        return 0.5
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (trusted, unlabelled))
    chance = math.sqrt(math.log(4 / 0.1) / (2 * u)) + math.sqrt(math.log(4 / 0.1) / (2 * p))
    fine = above_p > 0.05
    ratio = (above_u[fine] + chance) / above_p[fine]
    best = int(np.argmin(ratio))
    return float(np.clip(above_u[fine][best] / above_p[fine][best], 0.02, 0.98))


def _sample(shapes: DataFrame, key: str, most: int) -> np.ndarray:
    """Features of at most ``most`` rows, by hash of the key."""
    rows = shapes.orderBy(F.xxhash64(F.col(key), F.lit(3)), "shape").limit(most).select("shape").collect()
    return np.array([r["shape"] for r in rows], dtype=np.float64).reshape(-1, FEATURES)


def fit(shapes: DataFrame, trusted: DataFrame, key: str = "doc_id", most: tuple[int, int] = (FIT_TRUSTED, FIT_UNLABELLED)
        ) -> tuple[Network, float]:
    """A network and the estimated prior, from the features of all rows and the keys of the trusted ones.

    Without trusted rows nothing can be learnt and every score is one half.
    """
    good = shapes.join(trusted.select(key).distinct(), key, "left_semi")
    p, u = _sample(good, key, most[0]), _sample(shapes, key, most[1])
    if not len(p):
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES + 1, HIDDEN)), np.zeros(HIDDEN + 1)), 0.5
    first = train(p[::2], u, None)
    shipped = shapes.sparkSession.sparkContext.broadcast(first)

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            at = np.minimum((shipped.value.score(_shapes(batch.column("shape"))) * BINS).astype(int), BINS - 1)
            total += np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total)], ["bin", "n"])

    rows = shapes.select("shape").mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    unlabelled = np.zeros(BINS, dtype=np.int64)
    for r in rows:
        unlabelled[r["bin"]] = r["n"]
    rest = p[1::2] if len(p) > 1 else p
    seen = np.bincount(np.minimum((first.score(rest) * BINS).astype(int), BINS - 1), minlength=BINS)
    prior = prior_of(seen, unlabelled)
    return train(p, u, prior), prior


def _shapes(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, FEATURES)


def score_shapes(shapes: DataFrame, network: Network, score: str = "score") -> DataFrame:
    """``shapes`` with the probability that a text is good in place of its features."""
    kept = [c for c in shapes.columns if c not in ("shape", score)]
    schema = shapes.select(*kept, F.lit(0.0).alias(score)).schema
    shipped = shapes.sparkSession.sparkContext.broadcast(network)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept),
                                           pa.array(shipped.value.score(_shapes(batch.column("shape"))))], [*kept, score])

    return shapes.select(*kept, "shape").mapInArrow(lambda batches: by_batch(batches, work, 10_000), schema)


def score_quality(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, from the keys of trusted good rows.

    A null text counts as empty and gets a score like any other. Repeated rows
    get equal scores; keys of ``trusted`` that are null or not in ``df`` have no
    effect. An empty table gives an empty table; further columns are not read.
    """
    shapes = written(feature_table(df.select(key, text), text), "shapes")
    network, _ = fit(shapes, trusted, key)
    return score_shapes(shapes, network)


def score_texts(df: DataFrame, network: Network, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the probability that each text is good, in one pass that keeps every column."""
    held = unused(df, "held")
    kept = [c for c in df.columns if c != score]
    source = df.withColumn(held, whole(text)).select(*kept, held)
    shipped = df.sparkSession.sparkContext.broadcast(network)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([features(t) for t in batch.column(held).to_pylist()], dtype=np.float64).reshape(-1, FEATURES)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shipped.value.score(found))],
                                          [*kept, score])

    return source.mapInArrow(lambda batches: by_batch(batches, work),
                             source.drop(held).withColumn(score, F.lit(0.0)).schema)
