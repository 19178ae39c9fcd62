"""Quality and toxicity: held-out accuracy, what they read, and odd rows; parts against plain versions."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import quality, toxicity
from phrasemill.llm.queries import op3_pu_quality, op5_zstd_toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, FOLDER).join(labels, "doc_id").filter("held_out").collect()
    return np.array([r.y for r in rows]), np.array([r.predicted for r in rows]), np.array([r.score for r in rows])


def test_quality(spark):
    y, predicted, score = held_out(spark, op3_pu_quality, "quality")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == (score >= 0.3)).all()
    assert predicted[y == 1].mean() > 0.99 and predicted[y == 0].mean() < 0.1


def test_toxicity(spark):
    y, predicted, score = held_out(spark, op5_zstd_toxicity, "toxic")
    assert ((score >= 0) & (score <= 1)).all() and (predicted == (score >= 0.3)).all()
    hits = (predicted & y).sum()
    assert hits / y.sum() > 0.8 and hits / predicted.sum() > 0.8


def test_prior():
    rng = np.random.default_rng(0)
    good, bad = rng.beta(8, 2, 20_000), rng.beta(2, 8, 8000)
    bins = lambda x: np.histogram(x, quality.BINS, (0, 1))[0]
    assert abs(quality.prior_of(bins(good[:8000]), bins(np.concatenate([good[8000:], bad]))) - 0.6) < 0.05


def test_non_negative_risk():
    rng = np.random.default_rng(1)
    shape = lambda n, m: rng.normal(m, 1, (n, quality.FEATURES))
    p, u = shape(500, 1), np.vstack([shape(700, 1), shape(300, -1)])
    score = quality.train(p, u, 0.7, steps=300).score(u)
    assert (score[:700] > 0.5).mean() > 0.95 and (score[700:] < 0.5).mean() > 0.95


def test_features():
    assert quality.features("") == [0.0] * quality.FEATURES == quality.features(" \n\x0b")
    assert all(np.isfinite(quality.features(t)).all() for t in ("a", "|", "é", "\x00", "\ud800", "x" * 100_000, "A " * 70_000))


def test_windows():
    assert toxicity.windows("") == [] and toxicity.windows("A b\tc", 2) == [b" a b ", b" c "]
    assert b"".join(toxicity.windows("x" * 1000)) == b" " + b"x" * 1000 + b" "


@pytest.mark.parametrize("long", [200_000, 50])
def test_every_string_is_learnt(spark, monkeypatch, long):
    """A telling string far inside a text without blanks, and more telling words than a list of fixed length would hold."""
    monkeypatch.setattr(toxicity, "LONG", long)
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklm"))
    made = lambda n: "".join(rng.choice(letters, n))
    bad = [f"z{made(6)}z" for _ in range(200)]
    rows = [(i, made(260) + ("qqxxyyqq" if i % 2 else "") + made(20), i % 2) for i in range(400)]
    rows += [(1000 + i, " ".join([made(5), *(bad if i % 2 else []), made(5)]), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(df, df)
    assert b"qqxxyyqq" in model.dictionaries.toxic
    test = spark.createDataFrame([(1, made(300) + "qqxxyyqq" + made(300)), (2, made(600)), *[(10 + i, f"{made(4)} {b} {made(5)}") for i, b in enumerate(bad)]],
                                 "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(test, model).collect()}
    assert score[1] > score[2]


def test_strings_are_counted_in_bounded_memory():
    """Counts are handed on in parts that add up to those of a single pass, however many strings a task meets."""
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(8)) for _ in range(60)]
    rows = [(t, i % 2) for i, t in enumerate(texts)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in part]), pa.array([y for _, y in part], pa.int32())], ["text", "y"])
               for part in (rows[:25], rows[25:25], rows[25:])]
    most = max(len(toxicity.strings(t)) for t in texts)
    got, sizes = collections.defaultdict(lambda: [0, 0]), []
    seen = iter(batches)
    next(toxicity._counts(seen, held=500))
    assert next(seen, None) is not None  # handed on before all batches were read
    for part in toxicity._counts(batches, held=500):
        sizes.append(part.num_rows)
        for s, o, t in zip(*(part.column(c).to_pylist() for c in ("s", "o", "t")), strict=True):
            got[s][0] += o
            got[s][1] += t
    assert max(sizes) <= 500 + most and len(got) > 4 * (500 + most)
    plain = [collections.Counter(s for t, y in rows if y == k for s in toxicity.strings(t)) for k in (0, 1)]
    assert dict(got) == {s: [c[s] for c in plain] for s in {*plain[0], *plain[1]}}


def test_telling_strings():
    counts = {" bad ": (1, 50), "bad": (2, 50), " the ": (90, 95), "ba": (30, 60)}
    assert toxicity.telling(counts, (100, 100)) == ([(" bad ", 51)], [])


ROWS = [(1, "fine words here", "z"), (None, None, "z"), (2, "", None), (2, "", None), (3, "w " * 60_000, "z")]


@pytest.mark.parametrize("labels", [[], [1, 1, 1, 1, 1], [0, 1, 0, 1, None]])
def test_odd_rows(spark, labels):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, score string")
    known = spark.createDataFrame([(*r[:2], y) for r, y in zip(ROWS, labels, strict=False)], "doc_id long, text string, toxic int")
    for scored in (toxicity.score_toxicity(df, toxicity.fit(df, known)),
                   quality.score_quality(df, known.filter("toxic = 1").select("doc_id"))):
        assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == 5
    assert toxicity.score_toxicity(df.limit(0), toxicity.fit(df, known.limit(0))).count() == 0
    assert quality.score_quality(df.limit(0), known.select("doc_id").limit(0)).count() == 0
