"""Word-vector tables ``(word, vec)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def vector_lines(vectors: DataFrame) -> DataFrame:
    """``word v1 ... vd`` lines of a vector table, other columns kept."""
    numbers = F.array_join(F.transform("vec", lambda v: v.cast("string")), " ")
    return vectors.withColumn("value", F.concat_ws(" ", "word", numbers)).drop("word", "vec")


def parse_vector_lines(lines: DataFrame, line_no: str) -> DataFrame:
    """Parse ``word v1 ... vd`` lines; of a word given twice the last line counts."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    vec = F.slice(F.col("parts"), F.lit(2), F.size("parts") - 1).cast("array<float>")
    parsed = lines.select(line_no, parts.alias("parts")).select(
        line_no, F.col("parts")[0].alias("word"), vec.alias("vec"))
    return parsed.groupBy("word").agg(F.max_by("vec", line_no).alias("vec"))


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read a vector text file.

    Lines carry no number; file name and offset order of the rows in a
    partition stand in for it, which keeps "last line wins" within a file.
    """
    lines = spark.read.text(path).select(
        "value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                          F.monotonically_increasing_id()).alias("line_no"))
    return parse_vector_lines(lines, "line_no")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Read a vector table kept as Parquet."""
    return spark.read.parquet(path).select("word", "vec")


def dimension(vectors: DataFrame, column: str = "vec") -> int:
    """Vector length, taken from one row."""
    row = vectors.select(F.size(column).alias("n")).first()
    if row is None:
        raise ValueError("the vector table is empty")
    return row["n"]
