"""Near copies: buckets and pieces against the similarity of all pairs, odd rows, the pipeline's stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from phrasemill.llm.near_copies import RADIUS, alike, near_copies, shingles
from phrasemill.llm.simhash import majority

FOLDER = "/root/testdata/sf0.01"


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(texts, least=0.8):
    """Smallest position reachable over texts of this similarity, by all pairs."""
    found = [frozenset(shingles(t).tolist()) for t in texts]
    links = [[j for j in range(len(found)) if similarity(found[i], found[j]) >= least] for i in range(len(found))]
    label = list(range(len(texts)))
    while True:
        new = [min(label[j] for j in near) for near in links]
        if new == label:
            return label
        label = new


def copies(rng, n, of=4):
    """Texts in families; every member differs in some words from another of its family."""
    out = []
    for f in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 200))]
        for _ in range(of):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return out


def test_shingles():
    assert len(shingles("")) == len(shingles(" \n")) == 0 and len(shingles("a b")) == 1
    assert shingles("A b c d e f").tolist() == shingles("a B c  d e\nf").tolist() and len(shingles("a b c d e f a b c d e f a b c d e")) == 6


def test_alike():
    sets = [np.arange(10), np.arange(1, 10), np.arange(2, 10), np.array([50])]
    offsets = np.cumsum([0, *map(len, sets)])
    assert alike(np.concatenate(sets), offsets).tolist() == [0, 0, 0, 3]
    assert alike(np.concatenate(sets[::2]), offsets[[0, 1, 1]] + [0, 0, 8]).tolist() == [0, 0]  # 8 of 10, exactly 0.8


def test_fingerprints():
    """Only sets whose fingerprints a BK-tree finds are compared, and it finds those of similar sets."""
    sets = [np.arange(10), np.arange(1, 10), np.arange(2, 10), np.arange(2, 10)]
    offsets = np.cumsum([0, *map(len, sets)])
    far = np.array([0, 1, 2**40 - 1, 2**40 - 1], dtype=np.int64)
    assert alike(np.concatenate(sets), offsets, prints=far).tolist() == [0, 0, 2, 2]
    assert alike(np.concatenate(sets), offsets, prints=far, radius=40).tolist() == [0, 0, 0, 0]
    rng = np.random.default_rng(5)
    for n in [5, 6, 9, 10, 20, 50, 333] * 40:
        whole = rng.integers(0, 2**64, n, dtype=np.uint64)
        some = whole[n // 5:]
        assert (majority(whole) % 2**64 ^ majority(some) % 2**64).bit_count() <= RADIUS


@pytest.mark.parametrize("crowd", [1000, 4])
def test_all_pairs(spark, crowd):
    texts = copies(random.Random(7), 25)
    want = plain(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component for r in near_copies(df, crowd=crowd).collect()} == dict(enumerate(want))
    assert len(set(want)) > 25


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(5, text, "a"), (3, text.upper(), "b"), (5, text, "c"), (None, text, "d"), (9, None, "e"), (8, " ", "f"), (7, "other words", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted((str(r.doc_id), r.component) for r in near_copies(df).collect())
    assert got == sorted([("5", 3), ("3", 3), ("5", 3), ("None", 3), ("9", 8), ("8", 8), ("7", 7)])
    assert near_copies(df.limit(0)).count() == 0


def test_stage(spark):
    """The stage over documents against the similarity of all pairs."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    want = [i for (i, _), c, at in zip(rows, plain([t for _, t in rows]), range(len(rows)), strict=True) if c == at]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, FOLDER).select("doc_id").collect()) == want


def test_repeated_ids(spark):
    """Rows that share an id but not a text are judged one by one."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white grey")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, c, "z"), (5, c, "y"), (7, b, "x"), (None, a, "x"), (8, a + " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = sorted((str(r.doc_id), r.text, r.source) for r in stage(spark, df, FOLDER).collect())
    assert got == sorted([("1", a, "x"), ("5", b, "x"), ("5", c, "y"), ("None", a, "x")])
