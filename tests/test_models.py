import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from phrasemill.operators.kernel import FourierFeatures
from phrasemill.operators.folds import stratified_folds
from phrasemill.operators.knn import KNNClassifier
from phrasemill.operators.reduce import project
from phrasemill.plans import grid_search as gs
from phrasemill.plans import sweep
from phrasemill.functions.params import params_text
from phrasemill.plans.classifiers import CLASSIFIERS, Shape, combinations, perceptron, same_model, unsettled
from phrasemill.plans.score import best_settings, class_scores, fit_best, fit_classifier
from phrasemill.sources.results import parse_results


@pytest.fixture(scope="module")
def clusters(spark):
    """Three well separated groups in five dimensions."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, [float(x) for x in (rng.normal(0, 1, 5) + np.eye(5)[i % 3] * 8).round(4)]) for i in range(150)]
    return spark.createDataFrame(rows, "row_id long, label int, vec array<double>").cache()


def test_pca(spark, clusters):
    points = clusters.withColumn("features", array_to_vector("vec"))
    out, model = project(points, 4)
    got = np.array([r.p for r in out.orderBy("row_id").select(vector_to_array("pca").alias("p")).collect()])
    x = np.array([r.vec for r in clusters.orderBy("row_id").collect()])
    x = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ axes[:4].T), atol=1e-6)
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert (np.diff(got.var(axis=0)) <= 1e-9).all()
    with pytest.raises(ValueError):
        project(points, 0)


def test_fourier_features_come_near_the_kernel(spark, clusters):
    gamma = 0.02
    out = FourierFeatures(gamma=gamma, count=4000, seed=1).transform(clusters.withColumn("features", array_to_vector("vec")))
    rows = out.orderBy("row_id").limit(20).select("vec", vector_to_array("fourier").alias("z")).collect()
    x, z = np.array([r.vec for r in rows]), np.array([r.z for r in rows])
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - kernel).max() < 0.1


SETTINGS = [
    ("RandomForestAlgorithm", {"n_estimators": 10, "max_depth": None, "criterion": "entropy", "max_features": "log2"}),
    ("MLPAlgorithm", {"hidden_layer_sizes": (8, 6)}),
    ("SvmAlgorithm", {"C": 10.0, "gamma": 0.01}),
    ("NearestNeighborsAlgorithm", {"n_neighbors": 5, "p": 1, "weights": "distance"}),
]


@pytest.mark.parametrize("name,settings", SETTINGS)
def test_one_contract(spark, clusters, name, settings):
    """Every kind gives a label and probabilities by label that agree, also where a class has no training row."""
    split = gs.split_rows(clusters)
    train, test = split.where("not is_test"), split.where("is_test").drop("is_test", "cv_fold")
    for known in (train, train.where("label != 1")):
        model = fit_classifier(name, settings, known, classes=4)
        got = class_scores(model, test)
        assert got.columns == ["row_id", "label", "prediction", "probability"]
        rows = got.collect()
        seen = {r.label for r in known.select("label").distinct().collect()}
        hits = [r.prediction == r.label for r in rows if r.label in seen]
        assert len(rows) == test.count() and np.mean(hits) > 0.9
        for r in rows:
            assert len(r.probability) in (3, 4) and sum(r.probability) == pytest.approx(1)
            assert r.probability[r.prediction] == pytest.approx(max(r.probability)) and r.prediction in seen
        assert unsettled(model) == []


@pytest.mark.parametrize("name,settings", SETTINGS)
def test_best_of_a_result_table(spark, clusters, name, settings):
    """A line of a result file is enough to fit its model again."""
    lines = [(1, name, f"GloveEmbedding;g.txt,200;SumEmbedding;{params_text(settings)};95.10"),
             (2, name, "GloveEmbedding;g.txt,200;SumEmbedding;{'n_neighbors': 1};80.00")]
    found = parse_results(spark.createDataFrame(lines, "line_no long, classifier string, value string"))
    searched = CLASSIFIERS[name].grid
    assert best_settings(found) == (name, {k: v for k, v in settings.items() if k in searched}, "SumEmbedding")
    assert class_scores(fit_best(found.where("line_no = 1"), clusters), clusters).where("label = prediction").count() > 135


def test_settings_that_are_one_model():
    forests = [same_model("RandomForestAlgorithm", s) for s in combinations(CLASSIFIERS["RandomForestAlgorithm"].grid)]
    assert len(forests) == 36 and len({params_text(s) for s in forests}) == 24
    networks = [same_model("MLPAlgorithm", s) for s in combinations(CLASSIFIERS["MLPAlgorithm"].grid)]
    assert len(networks) == 8 and len({params_text(s) for s in networks}) == 4
    with pytest.raises(ValueError):
        perceptron(Shape(5, 3, 150), activation="tanh")


def test_limit_is_reported(spark, clusters):
    model = fit_classifier("SvmAlgorithm", {"C": 10.0, "gamma": 0.01, "max_iter": 1}, clusters)
    assert len(unsettled(model)) == 3


def test_knn_grid_matches_single_runs(spark, clusters):
    grid = {"n_neighbors": [1, 3, 8], "p": [1, 2], "weights": ["uniform", "distance"]}
    noisy = clusters.withColumn("label", F.when(F.col("row_id") % 7 == 0, 0).otherwise(F.col("label")))
    split = gs.split_rows(noisy, 4)
    results = gs.knn_grid_search(split, grid)
    found = {(r.n_neighbors, r.p, r.weights): r.cv for r in results.collect()}
    assert len(found) == 12
    train = split.where("not is_test").select("row_id", "label", "vec", "cv_fold")
    for (k, p, w), cv in found.items():
        if p == 2:
            got = KNNClassifier(k, w, p).fit(train).scored(train, apart="cv_fold")
            assert cv == pytest.approx(100 * got.where("label = prediction").count() / train.count(), abs=0.0051)
    best = gs.best_knn(results)
    assert found[best["n_neighbors"], best["p"], best["weights"]] == max(found.values())
    scores = {r.split: r.n for r in gs.evaluate_knn(split, best).collect()}
    assert scores == {"test": split.where("is_test").count(), "train": train.count()}


def test_grid_search(spark, clusters):
    results, evaluations = gs.grid_search(clusters, "NearestNeighborsAlgorithm", {
        "n_neighbors": [1, 4], "p": [2], "weights": ["distance"]}, folds=3)
    rows = results.orderBy("line_no").collect()
    assert [r.params for r in rows] == ["{'n_neighbors': 1, 'p': 2, 'weights': 'distance'}",
                                        "{'n_neighbors': 4, 'p': 2, 'weights': 'distance'}"]
    assert all(r.cv > 90 for r in rows)
    assert {r.split: r.score for r in evaluations.collect()}["train"] == 100.0


def test_components_inside_the_fold(spark, clusters):
    """Two components tell the groups apart; all five are a rotation, so nothing changes."""
    cut = stratified_folds(clusters, 3)
    plain, two, five = (gs.cross_validate(cut, "NearestNeighborsAlgorithm", {"n_neighbors": 3}, 3, dims=d) for d in (None, 2, 5))
    assert two.where("label = prediction").count() > 140
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, five.collect()))
    results, _ = gs.grid_search(clusters, "NearestNeighborsAlgorithm", {"n_neighbors": [3], "p": [2], "weights": ["uniform"]}, 3, dims=2)
    assert results.first().cv > 90


def test_sweep(spark, clusters):
    assert sweep.sweep_dims(1527, 200, 5)[:5] == [1, 2, 3, 5, 12] and sweep.sweep_dims(1527, 200, 5)[-1] == 200
    assert len(sweep.sweep_dims(1527, 200, 5)) == 30
    rows = sweep.pca_sweep(clusters, "NearestNeighborsAlgorithm", {}, folds=3, count=4).collect()
    assert [(r.dims, r.is_pca) for r in rows] == [(1, True), (2, True), (3, True), (5, True), (5, False)]
    # All components together are a rotation, which keeps every distance.
    assert rows[3].acc == pytest.approx(rows[4].acc, abs=0.02) and rows[2].acc > 0.9
    assert max(max(r.rel_train, r.rel_test) for r in rows) == pytest.approx(1.0)


def test_projection_and_grid(spark, clusters):
    flat = sweep.projected(clusters, 3, ["row_id"], fit_on=clusters)
    assert flat.columns == ["row_id", "x0", "x1", "x2"] and flat.count() == 150
    grid = sweep.decision_grid(clusters, KNNClassifier(3), size=20)
    assert grid.count() == 400 and {r.prediction for r in grid.select("prediction").distinct().collect()} == {0, 1, 2}
    trees = sweep.tree_grid(clusters, 3, {"n_estimators": 4, "max_depth": 3}, size=20)
    assert trees.count() == 1600 and {r.tree for r in trees.select("tree").distinct().collect()} == {0, 1, 2, 3}
    assert trees.columns == ["x", "y", "tree", "prediction"] and {r.prediction for r in trees.select("prediction").distinct().collect()} == {0, 1, 2}
