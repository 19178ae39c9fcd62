"""How the stored tables are used as input of the library.

``documents`` are the labelled texts (category = language), ``embeddings`` the
store of ready vectors and of word vectors, ``conversations`` the texts to
score, ``labels`` the human answers, ``events`` the log of search results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phrasemill.operators.embed import sum_embedding
from phrasemill.operators.words import ranked_vocabulary
from phrasemill.session import spread_small, written
from phrasemill.sources.results import evaluation_line, result_line
from phrasemill.sources.texts import tokenised

CATEGORIES = ["de", "en", "es", "fr"]
DIM = 64
SOME_NEIGHBOURS = {"n_neighbors": [1, 5, 12, 25], "p": [2], "weights": ["uniform", "distance"]}
RUNS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def category_of(lang) -> F.Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), lang) - 1).cast("int")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, label, text)``"""
    return spread_small(table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), category_of(F.col("lang")).alias("label"), "text"), "row_id")


def word_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, label, words)``"""
    return tokenised(texts(spark, folder))


def stored_lists(spark: SparkSession, folder: str) -> DataFrame:
    """``word_lists``, tokenised once for the steps that read them."""
    return written(word_lists(spark, folder), "lists")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, label, vec)``"""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), "label", F.col("embedding").alias("vec"))


def ranked_vectors(spark: SparkSession, folder: str, words: DataFrame) -> DataFrame:
    """``(word, vec, rank, df)``: the n-th word of the vocabulary takes the n-th vector, the rest has none.

    Written out, as a vector table is a stored table that many steps read.
    """
    store = table(spark, folder, "embeddings").select(F.col("vec_id").alias("rank"), F.col("embedding").alias("vec"))
    return written(ranked_vocabulary(words).join(store, "rank").select("word", "vec", "rank", "df"), "vectors")


def text_points(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as ``(row_id, label, vec)``, and the word vectors used."""
    lists = stored_lists(spark, folder)
    vectors = ranked_vectors(spark, folder, lists)
    return written(sum_embedding(lists, vectors, ["row_id", "label"], out="vec"), "text-points"), vectors


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "idx int, name string")


def chat_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, conv_id, turn, text)``"""
    chat = table(spark, folder, "conversations")
    return spread_small(chat.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("row_id"),
                                    "conv_id", "turn", "text"), "row_id")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    early = F.col("user_id") < 75
    return spread_small(table(spark, folder, "events"), "event_id").select(
        F.col("event_id").alias("line_no"), F.col("event_type").alias("classifier"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id",
        F.when(early, "GloveEmbedding").otherwise("Word2VecEmbedding").alias("word_emb"),
        F.when(early, "glove.txt,200").otherwise("news.bin,300").alias("word_emb_params"),
    ).withColumn("sent_emb", F.when(F.col("k") < 60, "SumEmbedding").otherwise("ConcatenationEmbedding"))


def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Grid-result lines ``(line_no, classifier, value)``, one per event."""
    params = F.format_string(
        "{'hidden_layer_sizes': (100, 50), 'max_depth': None, 'n_neighbors': %d, 'p': %d, 'weights': '%s'}",
        F.col("k") + 1, F.floor(F.col("user_id") / 30) + 1, F.when(F.col("value") < 35, "uniform").otherwise("distance"))
    return _log(spark, folder).select("line_no", "classifier", result_line(
        F.col("word_emb"), F.col("word_emb_params"), F.col("sent_emb"), params, F.col("value")).alias("value"))


def evaluation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation lines ``(line_no, classifier, split, value)``, one per event."""
    trained = F.col("classifier").isin("click", "view", "signup") & (F.col("value") >= 50)
    return _log(spark, folder).select(
        "line_no", "classifier", F.when(trained, "train").otherwise("test").alias("split"),
        evaluation_line(F.col("word_emb"), F.col("word_emb_params"), F.col("sent_emb"), F.col("value")).alias("value"))
