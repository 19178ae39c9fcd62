"""Text vectors from word vectors.

A text whose words all lack a vector stays, as a zero vector.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame, Window, functions as F

from phrasemill.functions.tokens import words_of
from phrasemill.functions.vectors import element_sums, pad
from phrasemill.operators.lookup import BROADCAST_BYTES, attach_vectors, token_stream
from phrasemill.session import spread, written
from phrasemill.sources.vectors import dimension

#: Words at the beginning of a text that are looked up before all of it, for each word that is wanted.
AHEAD = 4


def sum_embedding(texts: DataFrame, vectors: DataFrame, keep: list[str], out: str = "features",
                  budget: int = BROADCAST_BYTES) -> DataFrame:
    """Element-wise sum of the word vectors; ``keep`` identifies a text.

    One sum per element: partial sums are made where the tokens are, so that
    about one row per text goes through the shuffle.
    """
    dim = dimension(vectors)
    tokens = attach_vectors(token_stream(texts, keep), vectors, "left", budget)
    sums = tokens.groupBy(*keep).agg(*element_sums("vec", dim))
    return sums.select(*keep, F.expr("array(" + ", ".join(f"_s{i}" for i in range(dim)) + ")").alias(out))


def _first_known(texts: DataFrame, vectors: DataFrame, keep: list[str], most: int, budget: int, *more: str) -> DataFrame:
    """The first ``most`` tokens with a vector of each text (``known``), and then others; columns ``more`` are kept."""
    tokens = attach_vectors(token_stream(texts, [*keep, *more]), vectors.select("word", F.lit(True).alias("known")),
                            "left", budget, row_bytes=80)
    order = Window.partitionBy(*keep).orderBy(F.col("known").isNull(), "pos")
    return tokens.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")


def _first_words(texts: DataFrame, vectors: DataFrame, keep: list[str], most: int, budget: int) -> DataFrame:
    """As ``_first_known``; texts are only read as far as it takes.

    The local sort ahead of the row limit would otherwise hold every word of every
    text. A text with too few words of the table at its beginning is read whole.
    """
    ahead = AHEAD * most
    begun = texts.select(*keep, F.slice("words", 1, ahead).alias("words"), (F.size("words") > ahead).alias("_longer"))
    first = written(_first_known(begun, vectors, keep, most, budget, "_longer"), "first-words")
    few = written(first.groupBy(*keep).agg(F.count("known").alias("_n"), F.max("_longer").alias("_longer"))
                  .where(F.col("_longer") & (F.col("_n") < most)).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keep)]), "few-words")
    first = first.drop("_longer")
    if few.isEmpty():
        return first
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keep)]
    return first.join(few, same, "left_anti").unionByName(
        _first_known(texts.select(*keep, "words").join(few, same, "left_semi"), vectors, keep, most, budget))


def concat_embedding(texts: DataFrame, vectors: DataFrame, keep: list[str], out: str = "features",
                     max_words: int = 30, budget: int = BROADCAST_BYTES) -> DataFrame:
    """The vectors of the first ``max_words`` words that have one, one after another, padded with zeros.

    The words that count are picked first, by their mere presence in the vector
    table; vectors are attached to those only, where the words of a text have
    met. Words without a vector are sorted to the end, so every text keeps at
    least one row; the row limit is also applied ahead of the shuffle.
    """
    dim = dimension(vectors)
    first = _first_words(texts, vectors, keep, max_words, budget)
    # Adaptive execution would deal these rows by what they weigh without their vectors.
    found = attach_vectors(spread(first.drop("known"), *keep), vectors, "left", budget)
    listed = F.collect_list(F.when(F.col("vec").isNotNull(), F.struct("pos", "vec")))
    joined = F.flatten(F.transform(F.array_sort(listed), lambda t: t["vec"].cast("array<double>")))
    return found.groupBy(*keep).agg(pad(joined, max_words * dim).alias(out))


class Words(Transformer, HasInputCol, HasOutputCol):
    """Pipeline stage: text to array of words."""

    def __init__(self, *, inputCol: str = "text", outputCol: str = "words"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), words_of(F.col(self.getInputCol())))


class _VectorStage(Transformer, HasInputCol, HasOutputCol):
    idCol = Param(Params._dummy(), "idCol", "column that identifies a text", TypeConverters.toString)

    def __init__(self, vectors: DataFrame):
        super().__init__()
        self.vectors = vectors

    def _embed(self, texts: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        """Adds an ML vector column; a text without words gets no row, as it has no token to look up."""
        key, out = self.getOrDefault(self.idCol), self.getOutputCol()
        texts = df.select(key, F.col(self.getInputCol()).alias("words"))
        embedded = self._embed(texts).select(key, array_to_vector(out).alias(out))
        return df.join(embedded, key)


class SumVectors(_VectorStage):
    """Pipeline stage: array of words to the sum of their vectors."""

    def __init__(self, vectors: DataFrame, *, idCol: str = "row_id", inputCol: str = "words",
                 outputCol: str = "features"):
        super().__init__(vectors)
        self._set(idCol=idCol, inputCol=inputCol, outputCol=outputCol)

    def _embed(self, texts: DataFrame) -> DataFrame:
        return sum_embedding(texts, self.vectors, [self.getOrDefault(self.idCol)], self.getOutputCol())


class ConcatVectors(_VectorStage):
    """Pipeline stage: array of words to the concatenation of their vectors."""

    maxWords = Param(Params._dummy(), "maxWords", "words that count", TypeConverters.toInt)

    def __init__(self, vectors: DataFrame, *, idCol: str = "row_id", inputCol: str = "words",
                 outputCol: str = "features", maxWords: int = 30):
        super().__init__(vectors)
        self._set(idCol=idCol, inputCol=inputCol, outputCol=outputCol, maxWords=maxWords)

    def _embed(self, texts: DataFrame) -> DataFrame:
        return concat_embedding(texts, self.vectors, [self.getOrDefault(self.idCol)],
                                self.getOutputCol(), self.getOrDefault(self.maxWords))
