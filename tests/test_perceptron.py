"""Perceptrons: gradients against finite differences, few rows against many, rates, settings side by side."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phrasemill.operators.perceptron import Network, Perceptron, Steps, Training, fold_hits, sliced, summed_gradient, trained, trained_together, trained_wide
from phrasemill.plans import grid_search as gs
from phrasemill.plans.classifiers import CLASSIFIERS, unsettled


def made(n=400, seed=0):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, 3, n)
    return (draw.normal(0, 1, (n, 5)) + 4 * np.eye(5)[y]).round(4), y


@pytest.fixture(scope="module")
def points(spark):
    x, y = made()
    return spark.createDataFrame([(i, int(c), v.tolist(), i % 4) for i, (v, c) in enumerate(zip(x, y, strict=True))],
                                 "row_id long, label int, vec array<double>, cv_fold int").repartition(6).cache()


@pytest.mark.parametrize("activation", ["logistic", "relu"])
def test_gradient(activation):
    x, y = made(30)
    network = Network.drawn(5, 3, Training((7, 4), activation, seed=3))
    loss = lambda: network.decayed(*network.gradient(x, y), 0.3, 30)[0]
    _, gradient = network.decayed(*network.gradient(x, y), 0.3, 30)
    flat = [v for layer in network.layers for v in layer]
    assert [g.shape for g in gradient] == [v.shape for v in flat]
    for v, g in zip(flat, gradient, strict=True):
        for at in list(np.ndindex(v.shape))[:12]:
            held, v[at] = v[at], v[at] + 1e-6
            above, v[at] = loss(), held - 1e-6
            below, v[at] = loss(), held
            assert (above - below) / 2e-6 == pytest.approx(g[at], abs=1e-6)


@pytest.mark.parametrize("how", [Training((8,)), Training((8, 6), "relu", 0.01), Training((8,), "relu", solver="sgd", rate=0.05),
                                 Training((8,), solver="sgd", rate=0.5, learning_rate="adaptive")])
def test_training(how):
    x, y = made()
    network, settled = trained(x, y, 3, how)
    assert settled and (network.outputs(x)[-1].argmax(axis=1) == y).mean() > 0.95
    assert not trained(x, y, 3, replace(how, max_iter=2))[1]
    again, _ = trained(x, y, 3, how)
    assert all((a == b).all() for p, q in zip(network.layers, again.layers, strict=True) for a, b in zip(p, q, strict=True))


def test_decay_keeps_weights_small():
    x, y = made()
    size = lambda alpha: sum((w ** 2).sum() for w, _ in trained(x, y, 3, Training((8,), "relu", alpha))[0].layers)
    assert size(20.0) < 0.7 * size(1e-4)


def test_rates():
    how = Training(solver="sgd", learning_rate="adaptive", patience=1, rate=0.001)
    steps, rates = Steps(how), []
    while not steps.rests(1.0):
        rates.append(steps.rate)
    assert rates[0] == 0.001 and rates[-1] < 1e-6 and {round(a / b) for a, b in zip(rates, rates[1:], strict=False)} == {1, 5}
    steps = Steps(replace(how, learning_rate="constant"))
    assert [steps.rests(1.0) for _ in range(3)] == [False, False, True]


def test_many_rows(points):
    """Gradients summed by tasks, and training by slices."""
    x, y = made()
    network = Network.drawn(5, 3, Training((6,), seed=2))
    loss, gradient, n = summed_gradient(points, network)
    want_loss, want = network.gradient(x, y)
    assert n == 400 and loss == pytest.approx(want_loss) and all(np.allclose(a, b) for a, b in zip(gradient, want, strict=True))
    wide, _ = trained_wide(points, 5, 3, Training((6,), "relu", rate=0.1, max_iter=12), slice_rows=200)
    assert (wide.outputs(x)[-1].argmax(axis=1) == y).mean() > 0.95


def test_estimator(points):
    model = Perceptron(5, 3, Training((6,), "relu")).fit(gs.as_features(points))
    out = model.transform(gs.as_features(points))
    assert out.filter(F.col("prediction") == F.col("label")).count() > 380 and unsettled(model) == []
    assert unsettled(Perceptron(5, 3, Training((6,), max_iter=1)).fit(gs.as_features(points))) == ["PerceptronModel"]
    with pytest.raises(ValueError):
        Perceptron(5, 3, Training()).fit(gs.as_features(points.limit(0)))


def test_side_by_side(points):
    settings = [Training((6,)), Training((6,), "relu", 0.01)]
    got = {(r.setting, r.fold): (r.hits, r.n) for r in fold_hits(points, 3, settings, "cv_fold", 4).collect()}
    assert len(got) == 8 and all(n == 100 and hits > 85 for hits, n in got.values())
    grid = {"alpha": [1e-4, 1e-3], "activation": ["logistic", "relu"], "learning_rate": ["constant", "adaptive"], "hidden_layer_sizes": [(6,)]}
    found, told = gs.grid_search(points.drop("cv_fold"), "MLPAlgorithm", grid, folds=3)
    rows = found.orderBy("line_no").collect()
    assert len(rows) == 8 and all(r.cv > 90 for r in rows) and "'activation': 'relu', 'alpha': 0.001" in rows[-1].params
    assert rows[0].cv == rows[1].cv and told.count() == 2 and len(CLASSIFIERS["MLPAlgorithm"].grid) == 4


def test_many_rows_side_by_side(points):
    """Networks of all settings and folds over slices: one pass of tasks for all of them, and no fold sees its own rows."""
    settings = [Training((6,), rate=0.02, tol=0.01, patience=2), Training((6,), "relu", 0.01, rate=0.02, tol=0.01, patience=2)]
    got = fold_hits(points, 3, settings, "cv_fold", 4, local_bytes=0, slice_rows=100).collect()
    assert {(r.setting, r.fold) for r in got} == {(s, f) for s in range(2) for f in range(4)} and len(got) == 8
    assert all(r.n == 100 and r.hits > 85 and r.settled for r in got)
    told = fold_hits(points, 3, [replace(settings[0], max_iter=1)], "cv_fold", 4, local_bytes=0).collect()
    assert len(told) == 4 and not any(r.settled for r in told)


def test_slices_are_averaged(points):
    """One pass: each slice takes its own steps from the same weights, and the weights are averaged by rows."""
    x, y = made()
    how = Training((6,), max_iter=1, batch=50)
    cut = lambda rows, part: sliced(rows.select("label", "vec", F.lit(part).alias("part")), 100)
    (network, settled), = trained_together(cut(points, -1), 5, 3, [(how, None)])
    start = Network.drawn(5, 3, how)
    mean = lambda net: net.gradient(x, y)[0] / 400
    assert not settled and mean(network) < mean(start)
    (none, rested), (other, _) = trained_together(cut(points.where("label = 0"), 2), 5, 3, [(replace(how, max_iter=3), 2), (how, 1)])
    assert not rested and all((a == b).all() for p, q in zip(none.layers, start.layers, strict=True) for a, b in zip(p, q, strict=True))
    assert other.outputs(x)[-1].shape == (400, 3)
