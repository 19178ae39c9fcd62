"""Order-dependent work on groups of any size.

A window over a whole group puts that group into one task. Here rows are dealt
out by ranges of (group, order), whatever the values of the order are, so that a
group of any size takes as many parts as it needs. Work runs per (group, part),
and a small table with one row for each carries the result across parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from phrasemill.session import written


def in_parts(df: DataFrame, *order, parts: int | None = None) -> DataFrame:
    """Add ``_part`` and ``_no``: range parts in order, and numbers that rise by one within a part.

    Written out, since a second run could draw the ranges differently.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_no")), "parts")


def ranked(df: DataFrame, groups: list[str], order: str, parts: int | None = None) -> DataFrame:
    """Add ``pos`` (0-based position in the group, by ``order``) and ``size`` (rows of the group)."""
    keys = [*groups, "_part"]
    cut = in_parts(df, *groups, order, parts=parts)
    # One row for each part and group in it.
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_no").alias("_first"))
    whole = Window.partitionBy(*groups)
    offsets = counts.select(
        *keys, "_first",
        (F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .alias("_before"),
        F.sum("_n").over(whole).alias("size"))
    return (cut.join(offsets, keys).withColumn("pos", F.col("_before") + F.col("_no") - F.col("_first"))
            .select(*df.columns, "pos", "size"))


def running_max(df: DataFrame, groups: list[str], order: str, value: str, out: str,
                parts: int | None = None) -> DataFrame:
    """Add the largest ``value`` of the group up to and including each row."""
    keys = [*groups, "_part"]
    cut = in_parts(df, *groups, order, parts=parts)
    tops = cut.groupBy(*keys).agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, F.max("_top").over(earlier).alias("_carried"))
    local = F.max(value).over(
        Window.partitionBy(*keys).orderBy("_no").rowsBetween(Window.unboundedPreceding, 0))
    return (cut.withColumn("_local", local).join(carried, keys)
            .withColumn(out, F.greatest("_local", "_carried"))
            .select(*df.columns, out))


def global_rank(df: DataFrame, *order, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in one order over the whole table."""
    numbered = in_parts(df, *order, parts=parts)
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_no").alias("_first"))
    # As many rows as there are range partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (numbered.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_no") - F.col("_first"))
            .drop("_part", "_no", "_first", "_before"))
