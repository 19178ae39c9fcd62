"""Looking words up in a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasemill.session import fits, written
from phrasemill.sources.vectors import dimension

BROADCAST_BYTES = 128 << 20
# A word with more than this share of all tokens is joined apart from the rest.
HOT_SHARE = 0.001


def token_stream(texts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per token: ``keep`` columns, ``pos`` and ``word``."""
    return texts.select(*keep, F.posexplode("words").alias("pos", "word"))


def attach_vectors(tokens: DataFrame, vectors: DataFrame, how: str = "left",
                   budget: int = BROADCAST_BYTES, row_bytes: int | None = None) -> DataFrame:
    """Join a token stream to its vectors (or to any other columns of a word table with rows of ``row_bytes``).

    A vector table within ``budget`` is broadcast, and tokens stay where they
    are. A bigger one is joined by shuffle; common words, of which there can be
    at most ``1 / HOT_SHARE``, would pile up in single tasks, so only they are
    broadcast and the rest is shuffled.
    """
    if fits(vectors, row_bytes or 64 + 4 * dimension(vectors), budget):
        return tokens.join(F.broadcast(vectors), "word", how)
    counts = written(tokens.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > HOT_SHARE * total).select("word", F.lit(True).alias("hot"))
    marked = tokens.join(F.broadcast(hot), "word", "left")
    hot_vectors = F.broadcast(vectors.join(F.broadcast(hot.select("word")), "word", "left_semi"))
    common = marked.where(F.col("hot")).drop("hot").join(hot_vectors, "word", how)
    others = marked.where(F.col("hot").isNull()).drop("hot").join(vectors.hint("merge"), "word", how)
    return common.unionByName(others)


def known_words(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows whose ``word`` has a vector."""
    return words.join(vectors.select("word"), "word", "left_semi")


def unknown_words(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows whose ``word`` has no vector."""
    return words.join(vectors.select("word"), "word", "left_anti")
