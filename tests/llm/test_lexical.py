"""Ranked lexical search: against a plain version, SQL over a table, crowds of copies, blocks of items, odd rows."""

import math
import re
from collections import Counter

import duckdb
import pytest

from phrasemill.llm import lexical
from phrasemill.llm.lexical import search, terms_of
from phrasemill.llm.queries import ORACLE, op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=50):
    """Rows of the search from (id, text) lists."""
    bags = [(d, Counter(TERM.findall((t or "").translate(SMALL)))) for d, t in docs]
    held = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(n > 0 for n in held), sum(held)
    df = Counter(t for _, b in bags for t in b)
    out = []
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(SMALL)))
    for item, terms in wanted.items():
        rows = []
        for (d, bag), n in zip(bags, held, strict=True):
            if d is None or not n:
                continue
            m = 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in terms if bag[t])
            if score > 0:
                rows.append((-score, d))
        out += [(item, k, d, -s) for k, (s, d) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_terms():
    for text in ["", "It's 2 Big-words_x", "É\xa0ß日本 K\x00\x7fz", "\x80a\x1cB"]:
        assert terms_of(text) == [t.encode() for t in TERM.findall(text.translate(SMALL))]


DOCS = [(1, "red green blue blue"), (2, "Red, red; green?"), (3, None), (4, ""), (5, "..."), (None, "red red red"), (7, "other words"),
        (7, "other words"), (8, "red " * 5000), (9, "blue"), (-3, "blue"), *[(100 + i, "same text red blue") for i in range(400)],
        *[(1000 - i, "blue blue") for i in range(60)], *[(2000 + i, "words " * i) for i in range(40)]]
ITEMS = [(1, "red"), (2, "green blue RED red"), (3, None), (4, "!"), (5, "nowhere"), (None, "red"), (6, "other"), (6, "blue"), (7, "words")]


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_small(spark, block):
    """Ties, repeated rows, crowds that are cut first (with a top of 3), clashing columns, items in one or several blocks."""
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in DOCS], "doc_id long, text string, class int, bag string").repartition(7)
    items = spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, doc_id string")
    assert rows(search(docs, items, block_pairs=block)) == plain(DOCS, ITEMS)
    assert rows(search(docs, items, top=3)) == plain(DOCS, ITEMS, 3)


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search(docs.limit(0), items).count() == search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("cells", [2_000_000, 50])
def test_query(spark, monkeypatch, cells):
    """The registered query against its SQL and the plain version."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    folder = "/root/testdata/sf0.001"
    got = op12_lexical_search(spark, folder)
    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = base.sql(ORACLE["op12_lexical_search"])
    assert got.columns == found.columns and rows(got) == sorted(found.fetchall())
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()]
    assert rows(got) == plain(read("documents", "doc_id"), read("benchmark", "item_id"))
