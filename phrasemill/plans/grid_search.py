"""Grid search with a held-out fold and cross-validation in the rest.

Input tables have ``row_id``, ``label`` and the text vector.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from phrasemill.functions.params import params_text
from phrasemill.operators.evaluate import accuracy, correct
from phrasemill.operators.folds import nested_folds, stratified_folds
from phrasemill.operators.forest import forest_votes, grow_forest
from phrasemill.operators.knn import KNNClassifier, TrainSet, grid_votes
from phrasemill.operators.perceptron import fold_hits
from phrasemill.operators.reduce import project
from phrasemill.plans.classifiers import CLASSIFIERS, combinations, same_model
from phrasemill.plans.score import shape_of
from phrasemill.session import written

KNN_GRID = CLASSIFIERS["NearestNeighborsAlgorithm"].grid


def split_rows(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Held-out part and folds, written once for the many passes of a search.

    Adaptive execution gives the table as many parts as its size calls for: the iterative fits
    start some jobs per iteration, and small data in many parts would only cost scheduling.
    """
    return written(nested_folds(rows, folds), "split")


def knn_grid_predictions(train: DataFrame, grid: dict[str, list], fold: str = "cv_fold") -> DataFrame:
    """Out-of-fold predictions for all settings: one neighbour search per ``p``, all folds at once."""
    most = max(grid["n_neighbors"])
    known = TrainSet(train, apart=fold)
    keep, parts = ["row_id", "label", fold], []
    once = train.groupBy(*keep).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    for p in grid["p"]:
        found = known.search(train, most, p)
        votes = grid_votes(found, keep, grid["n_neighbors"], grid["weights"], once)
        parts.append(votes.withColumn("p", F.lit(p)))
    return reduce(DataFrame.unionByName, parts)


def knn_grid_search(split: DataFrame, grid: dict[str, list] = KNN_GRID) -> DataFrame:
    """``(n_neighbors, p, weights, cv)`` with the mean over all rows of all folds, in percent."""
    predictions = knn_grid_predictions(split.where(~F.col("is_test")), grid)
    return predictions.groupBy("n_neighbors", "p", "weights").agg(F.round(100.0 * F.avg(correct()), 2).alias("cv"))


def best_knn(results: DataFrame) -> dict[str, Any]:
    """The best setting; on ties the one that comes first in the grid's order."""
    row = results.orderBy(F.desc("cv"), "n_neighbors", "p", F.when(F.col("weights") == "uniform", 0).otherwise(1)).first()
    return {"n_neighbors": row["n_neighbors"], "p": row["p"], "weights": row["weights"]}


def evaluate_knn(split: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """Score of one setting on the held-out part (``test``) and on the training part itself (``train``)."""
    model = KNNClassifier(**settings).fit(split.where(~F.col("is_test")))
    predictions = model.transform(split)
    return accuracy(predictions.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")), "split")


def cross_validate_knn(rows: DataFrame, folds: int, settings: dict[str, Any]) -> DataFrame:
    """Score of each fold."""
    cut = written(stratified_folds(rows, folds), "folds")
    return accuracy(KNNClassifier(**settings).fit(cut).scored(cut, apart="fold"), "fold")


def knn_predictions_by_fold(rows: DataFrame, folds: int, grid: dict[str, list]) -> DataFrame:
    """Out-of-fold predictions of a grid over plain folds, for either kind of mean."""
    cut = written(stratified_folds(rows, folds), "folds")
    return knn_grid_predictions(cut, grid, "fold")


def as_features(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def reduced(train: DataFrame, others: DataFrame, dims: int | None) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``vec`` on the first ``dims`` principal components of ``train``; as they are without ``dims``."""
    if not dims:
        return train, others
    to_vec = lambda df: df.withColumn("vec", vector_to_array("pca")).drop("features", "pca", "pca_centred")
    shown, model = project(as_features(train), dims)
    return to_vec(shown), to_vec(model.transform(as_features(others)))


def cross_validate(rows: DataFrame, name: str, settings: dict[str, Any], folds: int,
                   fold: str = "fold", dims: int | None = None) -> DataFrame:
    """Out-of-fold predictions ``(row_id, label, fold, prediction)`` of any classifier.

    The model of a fold, with everything that is fitted, principal components
    included, only sees the other folds.
    """
    shape, parts = shape_of(rows), []
    if dims:
        shape = replace(shape, dim=dims)
    for i in range(folds):
        train, test = reduced(rows.where(F.col(fold) != i), rows.where(F.col(fold) == i), dims)
        model = CLASSIFIERS[name].build(shape, **settings).fit(as_features(train))
        parts.append(model.transform(as_features(test)).select(
            "row_id", "label", fold, F.col("prediction").cast("int").alias("prediction")))
    return reduce(DataFrame.unionByName, parts)


def forest_scores(train: DataFrame, settings: list[dict[str, Any]], folds: int, fold: str = "cv_fold") -> list[float]:
    """Cross-validation scores of forests: settings that differ in depth only are cuts of one forest for each fold."""
    shape, name = shape_of(train), "RandomForestAlgorithm"
    shared: dict[str, list[tuple[int, int | None]]] = {}
    builds: dict[str, dict[str, Any]] = {}
    for i, one in enumerate(settings):
        rest = {k: v for k, v in same_model(name, one).items() if k != "max_depth"}
        builds[params_text(rest)] = rest
        shared.setdefault(params_text(rest), []).append((i, one.get("max_depth")))
    scores = [0.0] * len(settings)
    for text, cuts in shared.items():
        depths = list(dict.fromkeys(d for _, d in cuts))
        deepest = None if None in depths else max(depths)
        forest = CLASSIFIERS[name].build(shape, **builds[text], max_depth=deepest)
        trees = written(grow_forest(train, shape.classes, forest.trees, forest.growth, apart=fold, parts=folds), "trees")
        votes = forest_votes(train, trees, shape.classes, depths, ["row_id", "label"], apart=fold)
        right = (F.array_position("votes", F.array_max("votes")) - 1 == F.col("label")).cast("int")
        found = {r["depth_no"]: r["cv"] for r in votes.groupBy("depth_no").agg(F.round(100.0 * F.avg(right), 2).alias("cv")).collect()}
        for i, depth in cuts:
            scores[i] = found[depths.index(depth)]
    return scores


def network_scores(train: DataFrame, settings: list[dict[str, Any]], folds: int, fold: str = "cv_fold") -> list[float]:
    """Cross-validation scores of perceptrons, all settings and folds side by side."""
    shape, name = shape_of(train), "MLPAlgorithm"
    distinct = {params_text(same_model(name, s)): same_model(name, s) for s in settings}
    how = [CLASSIFIERS[name].build(shape, **s).how for s in distinct.values()]
    hits = fold_hits(train, shape.classes, how, fold, folds).groupBy("setting").agg(
        F.round(100.0 * F.sum("hits") / F.sum("n"), 2).alias("cv")).collect()  # one row for each setting
    found = dict(zip(distinct, (r["cv"] for r in sorted(hits, key=lambda r: r["setting"])), strict=True))
    return [found[params_text(same_model(name, s))] for s in settings]


def grid_search(rows: DataFrame, name: str, grid: dict[str, list] | None = None, folds: int = 5,
                parallelism: int = 4, dims: int | None = None, embedding: tuple[str, str, str] = ("TableEmbedding", "vectors,0", "SumEmbedding"),
                ) -> tuple[DataFrame, DataFrame]:
    """Search the settings of one classifier; returns its grid results and its evaluations.

    Driver threads start the jobs of several settings at a time; all data stay in the executors,
    one number per setting comes back.
    """
    spark = rows.sparkSession
    split = split_rows(rows, folds)
    train = split.where(~F.col("is_test"))
    settings = combinations(grid or CLASSIFIERS[name].grid)

    def score(one: dict[str, Any]) -> float:
        predictions = cross_validate(train, name, one, folds, "cv_fold", dims)
        return predictions.agg(F.round(100.0 * F.avg(correct()), 2)).first()[0]

    if name == "RandomForestAlgorithm" and not dims:
        scores = forest_scores(train, settings, folds)
    elif name == "MLPAlgorithm" and not dims:
        scores = network_scores(train, settings, folds)
    else:  # settings that give the same model are fitted once
        distinct = {params_text(same_model(name, s)): same_model(name, s) for s in settings}
        with ThreadPool(parallelism) as pool:
            found = dict(zip(distinct, pool.map(inheritable_thread_target(spark)(score), distinct.values())))
        scores = [found[params_text(same_model(name, s))] for s in settings]
    best = settings[scores.index(max(scores))]
    known, everything = reduced(train, split, dims)
    model = CLASSIFIERS[name].build(shape_of(known), **best).fit(as_features(known))
    predictions = model.transform(as_features(everything))
    word_emb, word_emb_params, sent_emb = embedding
    results = spark.createDataFrame(
        [(name, i, word_emb, word_emb_params, sent_emb, params_text(s), float(cv))
         for i, (s, cv) in enumerate(zip(settings, scores))],
        "classifier string, line_no int, word_emb string, word_emb_params string, sent_emb string, "
        "params string, cv double")
    evaluations = accuracy(
        predictions.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")), "split").select(
        F.lit(name).alias("classifier"), F.lit(word_emb).alias("word_emb"),
        F.lit(word_emb_params).alias("word_emb_params"), F.lit(sent_emb).alias("sent_emb"), "split", "score")
    return results, evaluations


