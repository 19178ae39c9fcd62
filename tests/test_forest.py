"""Forests: splits against all splits, growth rules, few rows against many, forests apart, cuts, blocks of trees."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.operators.forest import (Forest, ForestModel, Growth, Nodes, Rows, best_splits, forest_votes, grow_forest, grown, root_keys,
                                         subset, tree_labels, votes)
from phrasemill.plans import grid_search as gs
from phrasemill.plans.classifiers import CLASSIFIERS
from phrasemill.plans.sweep import tree_predictions
from phrasemill.session import written


def impurity(y, classes, criterion):
    p = np.bincount(y, minlength=classes) / max(len(y), 1)
    return 1 - (p ** 2).sum() if criterion == "gini" else -(p[p > 0] * np.log(p[p > 0])).sum()


def made(n=300, dim=6, classes=3, seed=0):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, classes, n)
    x = draw.normal(0, 1, (n, dim)).round(1)
    x[:, :classes] += 2 * np.eye(classes)[y]
    return x, y


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("leaf", [1, 20])
def test_best_splits(criterion, leaf):
    x, y = made()
    rows, node = Rows(x, y, 3), np.repeat([0, 1, 2], [100, 150, 50])
    sample, features = np.arange(300), np.array([[0, 1, 2], [3, 4, 5], [5, 0, 3]])
    totals = np.stack([np.bincount(y[node == k], minlength=3) for k in range(3)])
    got = best_splits(rows, sample, np.ones(300, dtype=np.int64), node, features, totals, Growth(criterion, min_leaf=leaf))
    for k in range(3):
        mine, labels = x[node == k], y[node == k]
        best = min((sum(len(s) * impurity(s, 3, criterion) for s in (labels[mine[:, f] <= v], labels[mine[:, f] > v])), f, v)
                   for f in features[k] for v in np.unique(mine[:, f])[:-1] if leaf <= (mine[:, f] <= v).sum() <= len(mine) - leaf)
        f, v = got.feature[k], rows.values[rows.first[got.feature[k]] + got.rank[k]]
        cost = sum(len(s) * impurity(s, 3, criterion) for s in (labels[mine[:, f] <= v], labels[mine[:, f] > v]))
        assert got.found[k] and cost == pytest.approx(best[0])


def test_weights():
    """Rows that weigh more count as often."""
    x, y = made()
    rows, weight = Rows(x, y, 3), np.random.default_rng(2).integers(1, 5, 300)
    for features in (np.array([[0, 1, 2]]), np.array([[3, 4, 5]])):
        many = np.repeat(np.arange(300), weight)
        totals = np.bincount(y[many], minlength=3)[None, :]
        one = best_splits(rows, np.arange(300), weight, np.zeros(300, dtype=np.int64), features, totals, Growth(min_leaf=40))
        all_rows = best_splits(rows, many, np.ones(len(many), dtype=np.int64), np.zeros(len(many), dtype=np.int64), features, totals, Growth(min_leaf=40))
        assert (one.feature[0], one.rank[0], one.above[0]) == (all_rows.feature[0], all_rows.rank[0], all_rows.above[0])


def depth_of(nodes, at=0):
    return 0 if nodes.feature[at] < 0 else 1 + max(depth_of(nodes, nodes.left[at]), depth_of(nodes, nodes.left[at] + 1))


def check(nodes, growth, classes):
    inner = np.flatnonzero(nodes.feature >= 0)
    assert (nodes.counts[inner] == nodes.counts[nodes.left[inner]] + nodes.counts[nodes.left[inner] + 1]).all()
    size = nodes.counts.sum(axis=1)
    assert (size[inner] >= growth.min_split).all() and (size >= growth.min_leaf).all()
    assert growth.max_depth is None or depth_of(nodes) <= growth.max_depth


@pytest.mark.parametrize("growth", [Growth(features=2), Growth("entropy", 6, min_split=30), Growth(features=3, min_leaf=15), Growth(features=1, max_depth=4)])
def test_growth(growth):
    x, y = made()
    samples = [np.random.default_rng(k).integers(0, 300, 300) for k in range(4)]
    trees = grown(Rows(x, y, 3), samples, root_keys(1, 0, np.arange(4)), growth)
    for k, (nodes, s) in enumerate(zip(trees, samples, strict=True)):
        check(nodes, growth, 3)
        assert (nodes.counts[0] == np.bincount(y[s], minlength=3)).all()
        alone = grown(Rows(x, y, 3), [s], root_keys(1, 0, np.array([k])), growth)[0]
        assert all((getattr(alone, c) == getattr(nodes, c)).all() for c in ("feature", "threshold", "left", "counts"))
        top = grown(Rows(x, y, 3), [s], root_keys(1, 0, np.array([k])), replace(growth, max_depth=2))[0]
        assert np.allclose(votes(top, np.array([0]), x, [None]), votes(nodes, np.array([0]), x, [2]))
    assert len({len(t.feature) for t in trees}) > 1


def test_deep():
    """No limit of depth; equal rows of different classes end in a leaf."""
    x, y = np.arange(120.0)[:, None], np.arange(120) % 2
    tree = grown(Rows(x, y, 2), [np.arange(120)], root_keys(1, 0, np.arange(1)), Growth())[0]
    assert depth_of(tree) > 30 and (votes(tree, np.array([0]), x, [None])[0].argmax(axis=1) == y).all()
    same = grown(Rows(np.ones((4, 2)), np.array([0, 1, 1, 1]), 2), [np.arange(4)], root_keys(1, 0, np.arange(1)), Growth(features=2))[0]
    assert same.feature.tolist() == [-1] and same.counts.tolist() == [[1, 3]]
    # If no drawn feature varies, the others are looked at.
    x = np.zeros((40, 30))
    x[:, 7] = np.arange(40)
    tree = grown(Rows(x, np.arange(40) // 20, 2), [np.arange(40)], root_keys(1, 0, np.arange(1)), Growth(features=1))[0]
    assert tree.feature[0] == 7 and len(tree.feature) == 3


@pytest.fixture(scope="module")
def points(spark):
    x, y = made(900, 6, 3, 5)
    return spark.createDataFrame([(i, int(c), v.tolist(), i % 3) for i, (v, c) in enumerate(zip(x, y, strict=True))],
                                 "row_id long, label int, vec array<double>, fold int").repartition(5).cache()


def stored(trees):
    return [(r.part, r.tree, Nodes(np.array(r.feature), np.array(r.threshold), np.array(r.left), np.array(r.counts).reshape(-1, 3)))
            for r in trees.orderBy("part", "tree").collect()]


@pytest.mark.parametrize("local_bytes", [1 << 20, 20_000, 4000])
def test_forests_apart(spark, points, local_bytes):
    """By rows sent to all tasks, and by histograms down to a few hundred, or some dozen, rows."""
    growth, parts, each = Growth(features=2, seed=3), *((3, 12) if local_bytes == 1 << 20 else (2, 5))
    points = points.filter(F.col("fold") < parts).cache()
    trees = written(grow_forest(points, 3, each, growth, "fold", parts, local_bytes=local_bytes), "trees")
    found = stored(trees)
    assert [(p, t) for p, t, _ in found] == [(p, t) for p in range(parts) for t in range(each)]
    rows = points.collect()
    x, y, fold = np.array([r.vec for r in rows]), np.array([r.label for r in rows]), np.array([r.fold for r in rows])
    for p, _, nodes in found:
        check(nodes, growth, 3)
        others = (fold != p).sum()
        assert abs(nodes.counts[0].sum() - others) < 6 * np.sqrt(others)
        assert ((nodes.counts[nodes.feature < 0] > 0).sum(axis=1) == 1).mean() > 0.95  # leaves are pure
    assert len({nodes.threshold.tobytes() for _, _, nodes in found}) == parts * each
    got = {r.row_id: r.votes for r in forest_votes(points, trees, 3, [None, 1], ["row_id"], "fold", model_bytes=3000).filter("depth_no = 0").collect()}
    mine = np.array([got[r.row_id] for r in rows])
    for p in range(parts):
        want = sum(votes(n, np.array([0]), x[fold == p], [None])[0] for q, _, n in found if q == p)
        assert np.allclose(mine[fold == p], want)
    assert (mine.argmax(axis=1) == y).mean() > 0.65
    if local_bytes == 1 << 20:  # the same, however the rows come in
        again = stored(grow_forest(points.repartition(2), 3, each, growth, "fold", parts, local_bytes=local_bytes))
        assert all((a[2].threshold == b[2].threshold).all() for a, b in zip(found, again, strict=True))


def test_estimator(points):
    forest = CLASSIFIERS["RandomForestAlgorithm"].build(gs.shape_of(points), n_estimators=20, min_samples_split=5)
    assert isinstance(forest, Forest) and forest.growth.min_split == 5 and forest.growth.features == subset("sqrt", 6) == 2
    model = forest.fit(gs.as_features(points))
    out = model.transform(gs.as_features(points))
    assert out.filter(F.col("prediction") == F.col("label")).count() / 900 > 0.9
    limited = replace(forest.growth, max_depth=2)
    other = Forest(6, 3, 20, limited).fit(gs.as_features(points)).transform(gs.as_features(points))
    told = lambda df: {r.row_id: (r.prediction, r.probability) for r in df.collect()}
    assert told(model.cut(2).transform(gs.as_features(points))) == told(other)
    with pytest.raises(ValueError):
        forest.fit(gs.as_features(points.limit(0)))


def test_labels_of_trees(spark):
    """Two trees made by hand; several blocks of trees, limited depth."""
    trees = spark.createDataFrame([
        (0, 0, [0, -1, 1, -1, -1], [0.5, 0.0, 2.0, 0.0, 0.0], [1, 0, 3, 0, 0], [3, 2, 2, 0, 1, 2, 0, 1, 1, 1]),
        (0, 1, [-1], [0.0], [0], [1, 4])], "part int, tree int, feature array<int>, threshold array<double>, left array<int>, counts array<int>")
    points = spark.createDataFrame([(1, [0.5, 9.0]), (2, [0.6, 2.0]), (3, [0.6, 2.1])], "row_id long, vec array<double>")
    told = lambda **k: sorted(map(tuple, tree_labels(points, trees, 2, ["row_id"], **k).collect()))
    want = [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 1), (3, 0, 0), (3, 1, 1)]
    assert told() == told(model_bytes=1) == want
    assert told(depth=1) == [(1, 0, 0), (1, 1, 1), (2, 0, 1), (2, 1, 1), (3, 0, 1), (3, 1, 1)]
    assert told(depth=0) == [(i, t, t) for i in (1, 2, 3) for t in (0, 1)]
    assert sorted(map(tuple, tree_predictions(ForestModel(trees, 2, Growth()), points).collect())) == want


def test_scores_of_a_grid(points):
    """A search over depths fits each forest once, and finds what separate forests score."""
    train = points.withColumnRenamed("fold", "cv_fold")
    settings = [{"n_estimators": 15, "criterion": c, "max_depth": d, "max_features": m} for c in ("gini", "entropy") for d in (None, 1, 3) for m in ("auto", "sqrt")]
    scores = gs.forest_scores(train, settings, 3)
    for one, score in zip(settings[2:6], scores[2:6], strict=True):
        forest = CLASSIFIERS["RandomForestAlgorithm"].build(gs.shape_of(train), **one)
        trees = grow_forest(train, 3, 15, forest.growth, "cv_fold", 3)
        right = (F.array_position("votes", F.array_max("votes")) - 1 == F.col("label")).cast("int")
        alone = forest_votes(train, trees, 3, [one["max_depth"]], ["label"], "cv_fold").agg(F.round(100 * F.avg(right), 2)).first()[0]
        assert alone == score
    assert scores[0] == scores[1] and scores[0] > scores[2]
