"""Nearest neighbours: recall and distances against brute force, ties, few candidates, vectors that take no part."""

import numpy as np

from phrasemill.llm import kmeans_tree
from phrasemill.llm.kmeans_tree import Tree, search
from phrasemill.llm.queries import op7_kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, score string"


def exact(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q, v in queries:
        d = np.sqrt(((vectors - np.array(v, dtype=np.float64)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in op7_kmeans_tree(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys()
    found = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    by_id = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, hits in got.items():
        assert [h[0] for h in hits] == list(range(1, 11)) and sorted(hits, key=lambda h: (h[2], h[1])) == hits
        assert all(abs(s - np.sqrt(((by_id[i] - by_id[q]) ** 2).sum())) < 1e-12 for _, i, s in hits)


def test_clusters(spark, monkeypatch):
    """Vectors with structure: recall by a small part of the rows, through the leaves that queries visit."""
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 10, (120, 12))
    rows = [(i, (centres[rng.integers(120)] + rng.normal(0, 1, 12)).tolist()) for i in range(12_000)]
    seen, whole = {}, kmeans_tree._calibrate
    monkeypatch.setattr(kmeans_tree, "_calibrate", lambda *a: seen.setdefault("visits", (whole(*a), a[2]))[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asked = [r for r in rows if r[0] % 100 == 0]
    want, got = exact(rows, asked), {}
    for r in search(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    visits, tree = seen["visits"]
    leaves = tree.leaves_of(np.array([v for _, v in rows]))
    compared = 0
    for q, v in asked:
        mine = [leaf for leaf, _ in zip(tree.walk(np.array(v)), range(visits))]
        inside = np.isin(leaves, mine)
        compared += int(inside.sum())
        assert got[q] <= {rows[i][0] for i in np.flatnonzero(inside)}  # nothing but what the visited leaves hold
    assert compared < 0.3 * len(asked) * len(rows)


def test_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0]) for i in range(1, 40)] + [(i, rng.normal(size=2).tolist()) for i in range(100, 130)]
    odd = [(500, None), (501, [0.0, 0.0]), (502, [float("nan"), 1.0]), (503, [None, 1.0]), (504, [1.0]), (505, [float("inf"), 1.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], SCHEMA)
    got = search(df, df.filter("vec_id in (1, 100, 500, 501, 504)")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {1, 100}
    assert [(r.vec_id, r.score) for r in got if r.query_id == 1] == [(i, 0.0) for i in range(2, 12)]


def test_few(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "") for i in range(4)], SCHEMA)
    assert [r.vec_id for r in search(df, df.filter("vec_id = 0")).orderBy("rank").collect()] == [1, 2, 3]
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_tree():
    items = np.random.default_rng(4).normal(size=(3000, 8))
    tree = Tree.fit(items, 3000, leaf=100)
    leaves = tree.leaves_of(items)
    assert len(set(leaves.tolist())) > 20 and all(not tree.children[n] for n in leaves)
    order = list(tree.walk(items[0]))
    assert sorted(order) == [n for n, c in enumerate(tree.children) if not c]
