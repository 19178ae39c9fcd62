"""Words of a corpus: vocabulary, category counts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phrasemill.operators.lookup import known_words
from phrasemill.operators.slices import global_rank

# RGB colours of the categories, in order.
COLOURS = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (0.3, 0.3, 0.3), (1, 1, 1)]


def unique_words(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode("words").alias("word")).distinct()


def document_frequency(texts: DataFrame) -> DataFrame:
    """``(word, df)``: in how many texts a word occurs."""
    return (texts.select(F.explode(F.array_distinct("words")).alias("word"))
            .groupBy("word").agg(F.count("*").alias("df")))


def ranked_vocabulary(texts: DataFrame) -> DataFrame:
    """``(word, df, rank)`` with rank 0 for the word of most texts, ties by word."""
    return global_rank(document_frequency(texts), F.desc("df"), F.asc("word"))


def category_counts(texts: DataFrame, longer_than: int = 0) -> DataFrame:
    """``(word, label, n)``: in how many texts of each category a word occurs."""
    words = texts.select(F.explode(F.array_distinct("words")).alias("word"), "label")
    return (words.where(F.length("word") > longer_than)
            .groupBy("word", "label").agg(F.count("*").alias("n")))


def category_profile(texts: DataFrame, categories: int, longer_than: int = 0) -> DataFrame:
    """``(word, counts, total)`` with one count per category, in one shuffle."""
    words = texts.select(F.explode(F.array_distinct("words")).alias("word"), "label")
    sums = [F.count_if(F.col("label") == i) for i in range(categories)]
    return (words.where(F.length("word") > longer_than)
            .groupBy("word").agg(F.array(*sums).alias("counts"), F.count("*").alias("total")))


def frequent_words(texts: DataFrame, vectors: DataFrame, categories: int, at_least: int = 3) -> DataFrame:
    """Profiles of words longer than two letters that occur in enough texts and have a vector."""
    profile = category_profile(texts, categories, longer_than=2).where(F.col("total") >= at_least)
    return known_words(profile, vectors)


def dominant(counts: Column) -> Column:
    """Index of the largest count, the lowest index on ties."""
    return (F.array_position(counts, F.array_max(counts)) - 1).cast("int")


def mixed_colour(counts: Column, colours=COLOURS) -> list[Column]:
    """Red, green and blue: mean of the category colours, weighted by the cubes of the counts."""
    cubes = F.transform(counts, lambda n: F.pow(n.cast("double"), F.lit(3.0)))

    def weighted(channel: int) -> Column:
        scale = F.array(*[F.lit(float(c[channel])) for c in colours])
        return F.aggregate(F.zip_with(cubes, F.slice(scale, F.lit(1), F.size(cubes)), lambda w, c: w * c),
                           F.lit(0.0), lambda acc, x: acc + x)

    total = F.aggregate(cubes, F.lit(0.0), lambda acc, x: acc + x)
    return [(weighted(i) / total).alias(name) for i, name in enumerate(["red", "green", "blue"])]


def top_words(profile: DataFrame, per_category: int = 75) -> DataFrame:
    """The first words of each dominant category, by total (descending) and word."""
    order = Window.partitionBy("category").orderBy(F.desc("total"), F.asc("word"))
    return (profile.withColumn("category", dominant(F.col("counts")))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_category))


def coverage(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many of the words have a vector."""
    flagged = words.join(vectors.select("word", F.lit(1).alias("hit")), "word", "left")
    return flagged.agg(
        F.count("*").alias("words"), F.count("hit").alias("covered"),
        F.round(100.0 * F.count("hit") / F.count("*"), 2).alias("percent"))
