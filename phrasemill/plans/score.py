"""Scoring texts with a fitted model of any kind, and fitting the best model of a result table."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from phrasemill.functions.params import typed_params
from phrasemill.operators.embed import sum_embedding
from phrasemill.operators.labels import SeenLabels, place_of
from phrasemill.plans import analysis
from phrasemill.plans.classifiers import CLASSIFIERS, Shape
from phrasemill.sources.texts import tokenised


def vectors_of(texts: DataFrame, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Texts to ``keep`` columns and ``vec``: tokenise, look up, add up."""
    return sum_embedding(tokenised(texts), vectors, keep, out="vec")


def shape_of(rows: DataFrame, classes: int | None = None) -> Shape:
    """What a classifier has to know of ``(label, vec)`` rows."""
    row = rows.agg(F.count("*").alias("rows"), (F.max("label") + 1).alias("classes"), F.max(F.size("vec")).alias("dim")).first()
    if not row["rows"]:
        raise ValueError("the training set is empty")
    return Shape(row["dim"], max(classes or 0, int(row["classes"])), row["rows"])


def fit_classifier(name: str, settings: dict[str, Any], rows: DataFrame, classes: int | None = None) -> Model:
    """A registered classifier fitted to ``(row_id, label, vec)``."""
    shape = shape_of(rows, classes)
    ready = rows.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))
    seen = sorted(r["label"] for r in rows.select("label").distinct().collect())  # one row for each category
    if name == "NearestNeighborsAlgorithm" or seen == list(range(shape.classes)):
        return CLASSIFIERS[name].build(shape, **settings).fit(ready)
    # Some fits cannot do with a class without rows: they get labels without gaps.
    model = CLASSIFIERS[name].build(replace(shape, classes=len(seen)), **settings).fit(
        ready.withColumn("label", place_of(F.col("label"), seen)))
    return PipelineModel([model, SeenLabels(seen, shape.classes)])


def class_scores(model: Model, points: DataFrame) -> DataFrame:
    """``points`` (with ``vec``) and, in place of it, ``prediction`` and ``probability``, an array by label.

    The same for every kind of model, also for one that was fitted to ``vec`` itself.
    """
    keep = [c for c in points.columns if c not in ("vec", "features", "prediction", "probability")]
    out = model.transform(points.select(*keep, "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features")))
    likely = F.col("probability")
    if isinstance(out.schema["probability"].dataType, VectorUDT):
        likely = vector_to_array(likely)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"), likely.alias("probability"))


def category_percent(scored: DataFrame, categories: DataFrame, keep: list[str]) -> DataFrame:
    """One row per text and category with the probability in percent; ``categories`` is one row per category.

    Positions are labels; a category that the model does not know has 0 percent.
    """
    count = categories.count()
    likely = F.concat("probability", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(count) - F.size("probability"))))
    each = scored.select(*keep, F.posexplode(likely).alias("idx", "p"))
    return (each.join(F.broadcast(categories), "idx")
            .select(*keep, F.col("name").alias("category"), F.round(100.0 * F.col("p"), 2).alias("percent")))


def score_texts(model: Model, texts: DataFrame, vectors: DataFrame, categories: DataFrame,
                keep: list[str]) -> DataFrame:
    return category_percent(class_scores(model, vectors_of(texts, vectors, keep)), categories, keep)


def is_confident(threshold: float, include_unclassified: bool = False, classes: int | None = None) -> Column:
    """Any probability reaches the threshold; the last class ("other") counts only if asked for.

    ``classes`` is the number of categories, where the model may not know the last ones.
    """
    p = F.col("probability")
    named = F.lit(classes - 1) if classes else F.size(p) - 1
    among = p if include_unclassified else F.slice(p, F.lit(1), F.greatest(named, F.lit(0)))
    return F.exists(among, lambda x: x >= threshold)


def best_settings(results: DataFrame, classifiers: list[str] | None = None) -> tuple[str, dict[str, Any], str]:
    """Classifier, typed settings and sentence embedding of the best row of a result table (``sources.results``)."""
    row = analysis.best_overall(results, classifiers or list(CLASSIFIERS)).first()
    if row is None:
        raise ValueError("no result has a score")
    searched = CLASSIFIERS[row["classifier"]].grid
    return row["classifier"], {k: v for k, v in typed_params(row["params"]).items() if k in searched}, row["sent_emb"]


def fit_best(results: DataFrame, rows: DataFrame, classes: int | None = None) -> Model:
    """The best setting of a result table, fitted to ``(row_id, label, vec)``."""
    name, settings, _ = best_settings(results)
    return fit_classifier(name, settings, rows, classes)
