"""What several operators of this package share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; so there are at most ``1 / HOT_SHARE`` hot keys.
HOT_SHARE = 0.001


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader so that any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(column: str) -> F.Column:
    """The text of ``column``, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a shuffle by hand: what the session is set to, and one for each core at least."""
    return max(least, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_batch(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch],
             rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """``work`` over pieces of ``rows`` rows, so that long texts cannot pile up in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield work(batch.slice(at, rows))


def list_of(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from the length of each list and all values end to end."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def list_bounds(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets into, and the flat values of, a list column that may be a slice."""
    return np.asarray(column.offsets), column.values


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``facts``, one fact row for each key, however often a key occurs.

    ``count`` names the column of ``facts`` that holds the number of rows of a
    key. Keys with at least ``HOT_SHARE`` of the ``total`` rows, a thousand at
    most, are joined by broadcast where their rows lie; the others are shuffled.
    Both tables are read twice, so they should be stored.
    """
    least = max(math.ceil(total * HOT_SHARE), 1)
    hot = F.broadcast(facts.filter(F.col(count) >= least))
    few = facts.filter(F.col(count) < least)
    return rows.join(hot, key).unionByName(
        rows.join(hot.select(key), key, "left_anti").join(few, key, "left").select(*rows.columns, *[
            c for c in facts.columns if c != key]), allowMissingColumns=True)
