"""Result tables of grid searches, evaluations and PCA sweeps, and their line formats.

Grid result line: ``wordEmb;path,dim;sentEmb;{params};cv``; evaluation line:
``wordEmb;path,dim;sentEmb;score``; sweep line: ``dims;accuracy;train;test``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phrasemill.functions.params import params_map

# How the files of each kind are named.
RESULTS, EVALUATION, TRAIN_EVALUATION = "grid_search_results", "evaluation", "train_set_evaluation"
SWEEP = "dims int, acc double, rel_train double, rel_test double"


def score_text(score: Column) -> Column:
    return F.format_string("%.2f", score)


def result_line(word_emb: Column, word_emb_params: Column, sent_emb: Column, params: Column, cv: Column) -> Column:
    return F.concat_ws(";", word_emb, word_emb_params, sent_emb, params, score_text(cv))


def evaluation_line(word_emb: Column, word_emb_params: Column, sent_emb: Column, score: Column) -> Column:
    return F.concat_ws(";", word_emb, word_emb_params, sent_emb, score_text(score))


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """Grid result lines to columns; ``params`` also gets the two embeddings as keys."""
    f = F.split(F.col(line), ";")
    params = F.map_concat(params_map(f[3]), F.create_map(
        F.lit("Sentence Embedding"), f[2],
        F.lit("Word Embedding"), F.concat(f[0], F.lit("("), f[1], F.lit(")"))))
    return lines.select(
        *[c for c in lines.columns if c != line], f[0].alias("word_emb"), f[1].alias("word_emb_params"),
        F.substring_index(f[1], ",", 1).alias("word_emb_path"),
        F.substring_index(f[1], ",", -1).cast("int").alias("dim"),
        f[2].alias("sent_emb"), params.alias("params"), f[4].cast("double").alias("cv"))


def parse_evaluations(lines: DataFrame, line: str = "value") -> DataFrame:
    f = F.split(F.col(line), ";")
    return lines.select(*[c for c in lines.columns if c != line], f[0].alias("word_emb"),
                        f[1].alias("word_emb_params"), f[2].alias("sent_emb"), f[3].cast("double").alias("score"))


def _numbered(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lines of the files of one kind in a folder, or of one such file, with the classifier of each.

    Files are named ``<data set>_<classifier>_<kind>.txt``; a folder of that name, as Spark writes it, counts as one
    file. Files of other kinds beside them are not read: the names are compared before anything is.
    """
    place = F.col("_metadata.file_path")
    name = rf"([^_/]+)_{kind}\.txt(?:/[^/]+)?$"
    lines = spark.read.option("recursiveFileLookup", "true").text(path).where(place.rlike(name))
    if kind == EVALUATION:  # the other kind ends alike
        lines = lines.where(~place.rlike(rf"_{TRAIN_EVALUATION}\.txt(?:/[^/]+)?$"))
    return lines.select(F.regexp_extract(place, name, 1).alias("classifier"), F.monotonically_increasing_id().alias("line_no"), "value")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(_numbered(spark, path, RESULTS))


def read_evaluations(spark: SparkSession, path: str, split: str) -> DataFrame:
    kind = EVALUATION if split == "test" else TRAIN_EVALUATION
    return parse_evaluations(_numbered(spark, path, kind)).withColumn("split", F.lit(split))


def append_results(results: DataFrame, path: str) -> None:
    """Append to the result table; partitioned so that one classifier can be read by itself."""
    results.write.mode("append").partitionBy("classifier").parquet(path)


def write_evaluations(evaluations: DataFrame, path: str) -> None:
    """Write evaluations, replacing earlier ones of the same classifiers and splits only."""
    (evaluations.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("classifier", "split").parquet(path))


def write_lines(lines: DataFrame, path: str, data_set: str, classifier: str, kind: str) -> None:
    """Write lines (``value``) of one classifier where the readers of a folder find them."""
    lines.select("value").write.mode("overwrite").text(f"{path}/{data_set}_{classifier}_{kind}.txt")


def write_sweep(sweep: DataFrame, path: str) -> None:
    sweep.select("dims", "acc", "rel_train", "rel_test").write.option("sep", ";").csv(path)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SWEEP).option("sep", ";").csv(path)
