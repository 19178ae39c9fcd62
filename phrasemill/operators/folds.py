"""Stratified folds without shuffling: each class is cut into contiguous blocks in row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phrasemill.operators.slices import ranked


def block_number(pos: Column, size: Column, folds: int) -> Column:
    """Block of position ``pos`` when ``size`` rows are cut into ``folds`` blocks, the first ones longer."""
    short = F.floor(size / F.lit(folds))
    longer = size % F.lit(folds)
    border = longer * (short + 1)
    return (F.when(pos < border, F.floor(pos / (short + 1)))
            .otherwise(longer + F.floor((pos - border) / F.greatest(short, F.lit(1)))).cast("int"))


def stratified_folds(df: DataFrame, folds: int, label: str = "label", order: str = "row_id",
                     out: str = "fold", parts: int | None = None) -> DataFrame:
    """Add the fold number 0 .. ``folds - 1``."""
    return (ranked(df, [label], order, parts)
            .withColumn(out, block_number(F.col("pos"), F.col("size"), folds)).drop("pos", "size"))


def nested_folds(df: DataFrame, folds: int, label: str = "label", order: str = "row_id") -> DataFrame:
    """Hold out fold 0 (``is_test``) and cut the rest into folds again (``cv_fold``, null in the test part).

    The rest keeps its order, so both cuts follow from one ranking: the first
    block of a class is the test part, and positions after it count from its end.
    """
    pos, size = F.col("pos"), F.col("size")
    held = F.ceil(size / F.lit(folds))
    return (ranked(df, [label], order)
            .withColumn("is_test", pos < held)
            .withColumn("cv_fold", F.when(~F.col("is_test"), block_number(pos - held, size - held, folds)))
            .drop("pos", "size"))


def sample_folds(rows: int, categories: int, per_category: int = 100) -> int:
    """Number of folds that leaves about ``per_category`` rows of each category in one fold, at least 3."""
    return max(rows // (per_category * categories), 3)


def stratified_sample(df: DataFrame, rows: int, categories: int, per_category: int = 100) -> DataFrame:
    """The test part of the first of ``sample_folds`` folds."""
    folds = sample_folds(rows, categories, per_category)
    return stratified_folds(df, folds).where(F.col("fold") == 0).drop("fold")
