"""Labelled text lines, processed lines and the data set descriptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasemill.functions.tokens import words_of
from phrasemill.operators.slices import global_rank

DESCRIPTOR = "Title string, Categories array<string>, Size int"


def _label(line: Column) -> Column:
    return F.substring_index(line, " ", 1).cast("int")


def _rest(line: Column) -> Column:
    """Everything after the first space; nothing if there is none."""
    return F.when(F.instr(line, " ") > 0, F.regexp_replace(line, "^[^ ]* ", "")).otherwise("")


def tokenised(texts: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by its ``words``; texts without a word are dropped.

    Written as a generator of one or no row: a filter on ``words`` would be
    pushed below the projection and tokenise every text twice.
    """
    rest = [c for c in texts.columns if c != text]
    one = F.transform(F.array(words_of(F.col(text))), lambda w: F.struct(w.alias("words")))
    return texts.select(*rest, F.inline(F.filter(one, lambda r: F.size(r["words"]) > 0)))


def parse_labelled(lines: DataFrame, line: str = "value") -> DataFrame:
    """``<int label> <text>`` lines to ``(label, words)`` plus the other columns."""
    parts = lines.withColumn("label", _label(F.col(line))).withColumn("text", _rest(F.col(line))).drop(line)
    return tokenised(parts)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, value)``: all lines of the files at ``path``, numbered from 0 by file name and place in the file."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    return global_rank(lines, "_file", "_block", "_line", name="row_id").select("row_id", "value")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, label, words)`` of ``<int label> <text>`` lines."""
    return parse_labelled(numbered_lines(spark, path))


def processed_line(label: Column, words: Column) -> Column:
    """``<label> w1,w2,...``"""
    return F.concat_ws(" ", label.cast("string"), F.array_join(words, ","))


def write_processed(texts: DataFrame, path: str) -> None:
    texts.select(processed_line(F.col("label"), F.col("words")).alias("value")).write.text(path)


def parse_processed(lines: DataFrame, line: str = "value") -> DataFrame:
    words = F.transform(F.split(_rest(F.col(line)), ","), lambda w: F.rtrim(w))
    return lines.withColumn("label", _label(F.col(line))).withColumn("words", words).drop(line)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    return parse_processed(numbered_lines(spark, path))


def write_descriptor(descriptor: DataFrame, path: str) -> None:
    descriptor.select("Title", "Categories", "Size").write.json(path)


def read_descriptor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DESCRIPTOR).option("multiLine", True).json(path)


def category_dim(descriptor: DataFrame) -> DataFrame:
    """One row per category: ``(idx, name)``."""
    return descriptor.select(F.posexplode("Categories").alias("idx", "name"))
