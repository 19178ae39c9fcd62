"""Choosing texts for the training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def select_labelled(texts: DataFrame, answers: DataFrame, categories: DataFrame) -> DataFrame:
    """Texts with a valid answer: a category name or its number. ``(row_id, label, text)``.

    ``categories`` has one row per category.
    """
    by_name = F.broadcast(categories.select(F.col("name").alias("answer"), F.col("idx").alias("named")))
    by_number = F.broadcast(categories.select(F.col("idx").cast("string").alias("number"), "idx"))
    number = F.col("answer").try_cast("int").cast("string")
    valid = (answers.join(by_name, "answer", "left").withColumn("number", number).join(by_number, "number", "left")
             .select("row_id", F.coalesce("named", "idx").alias("label")).where(F.col("label").isNotNull()))
    return texts.join(valid, "row_id").select("row_id", "label", "text")


def expand_training_set(train: DataFrame, selected: DataFrame) -> DataFrame:
    """Both tables ``(row_id, label, text)``, each text once: the lowest id wins, old rows before new ones.

    Texts are grouped by themselves with partial aggregation, so many copies of one text cost one row per task.
    """
    both = train.withColumn("_new", F.lit(0)).unionByName(selected.withColumn("_new", F.lit(1)))
    first = F.min_by(F.struct("row_id", "label"), F.struct("_new", "row_id"))
    return both.groupBy("text").agg(first.alias("f")).select("f.row_id", "f.label", "text")
