"""Alignment of two tokenizers: against common ends found by sets, odd texts, pair counts with and without broadcast."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from phrasemill.llm.alignment import align, align_texts, shared_ends, vocabularies
from phrasemill.llm.queries import BYTES, PIECES, op13_alignment

ODD = ["", " ", "  x", "▁", "a▁b", "日本語 text 😀😀", "<|endoftext|> </s> <s> <unk>", "x" * 3000, "\x00\x01", "é" * 300,
       "<0x41>", "\n\n\n", " " * 2000, "𝕏" * 1500, "It's DON'T we'll", "á ͸ ẞ ﬁ"]


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, groups) of a text, by the libraries and sets of ends."""
    library, pieces = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    pair = vocabularies(BYTES, PIECES)

    def of(text):
        raw = b" " + (text or "").encode()
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, pieces.encode(text or "")
        tokens = [[pair.a.bytes[i] for i in a], [pair.b.bytes[i] for i in b]]
        if not text or any(b"".join(t) != raw for t in tokens):
            return [], [], []
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in tokens]
        groups = defaultdict(lambda: ([], []))
        common = sorted(set(ends[0]) & set(ends[1]))
        for side, ids in enumerate((a, b)):
            for i, end in zip(ids, ends[side], strict=True):
                groups[next(k for k, c in enumerate(common) if c >= end) if len(common) < 50 else int(np.searchsorted(common, end))][side].append(i)
        return a, b, [groups[k] for k in sorted(groups)]

    return of


def told(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


def expected(rows, plain):
    """Rows of the query from (key, text) rows."""
    found = [(key, *plain(text)) for key, text in rows]
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for _, _, _, groups in found]
    count = Counter(pair for each in links for pair in each)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(((key, len(a), len(b), len(groups), sum(each.values()), sum(n for p, n in each.items() if count[p] == top[p[0]]),
                    sum(n * count[p] for p, n in each.items()), told(groups))
                   for (key, a, b, groups), each in zip(found, links, strict=True)), key=repr), count, top


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_shared_ends(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    end = max(a[-1], b[-1])
    a, b = np.unique([*a, end]), np.unique([*b, end])
    got_a, got_b = shared_ends(a, b)
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert got_a.tolist() == [a.tolist().index(c) + 1 for c in common]
    assert got_b.tolist() == [b.tolist().index(c) + 1 for c in common]


def test_odd_texts(plain):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice("ab c  \n\t.1é日😀'sΣ\xa0\x85\x1c") for _ in range(draw.randint(1, 80))) for _ in range(150)]
    texts += ["".join(chr(draw.choice([draw.randrange(1, 0x378), draw.randrange(32, 127)])) for _ in range(40)) for _ in range(300)]
    got = align_texts(texts, vocabularies(BYTES, PIECES))
    for k, text in enumerate(texts):
        a, b, groups = plain(text)
        assert (got.n_a[k], got.n_b[k], got.n_groups[k], got.digests[k]) == (len(a), len(b), len(groups), told(groups)), text
    assert align_texts([], vocabularies(BYTES, PIECES)).digests == []


def test_wide_group():
    """A group with more links than are made at once."""
    pair = vocabularies(BYTES, PIECES)
    got = align_texts(["=" * 20_000 + "-", "a"], pair)
    assert got.times[got.of == 0].sum() == got.n_links[0] and got.times.sum() == got.n_links.sum()


@pytest.mark.parametrize("most", [2_000_000, 300, 0])
def test_counts(spark, plain, most):
    """Repeated keys and rows, nulls, clashing columns; counts by broadcast, by shuffle, and by both."""
    rows = [*enumerate(ODD), (3, "once more"), (3, "once more"), (None, "no key"), (70, None),
            *[(100 + i, "the same text in many rows, more than others") for i in range(40)]]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, pairs string, row int").repartition(5)
    got = align(docs, BYTES, PIECES, broadcast_pairs=most)
    want, count, top = expected(rows, plain)
    assert sorted([tuple(r) for r in got.documents.select(*COLUMNS).collect()], key=repr) == want
    assert {(r.a, r.b): (r.docs, r.best) for r in got.pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_empty_table(spark):
    got = align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES)
    assert got.documents.count() == got.pairs.count() == 0 and got.documents.columns == COLUMNS


def test_query(spark, plain):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_alignment(spark, folder)
    assert got.columns == COLUMNS
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected(rows, plain)[0]
