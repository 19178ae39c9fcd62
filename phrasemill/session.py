"""Shared storage of a session: where intermediate tables are written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a new folder is made, but only in local mode: on a
    cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):  # "local-cluster" has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_folders:
        _own_folders[sc.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _own_folders[sc.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that later steps neither recompute ``df`` nor depend
    on the executors that made it; the file sizes also give Catalyst true
    statistics for its join choices.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path`` to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def removed(spark: SparkSession, path: str) -> None:
    """Delete what is stored at ``path``, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def kept_while(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As ``written``, for a table that nobody reads after the block; it is deleted then."""
    spark = df.sparkSession
    path = new_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)


def fits(df: DataFrame, row_bytes: int, budget: int) -> bool:
    """True if ``df`` has at most ``budget`` bytes, for rows of ``row_bytes``.

    Counts no further than the limit, so the check stays cheap on big tables.
    """
    most = max(budget // row_bytes, 1)
    return df.limit(most + 1).count() <= most


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` over all cores.

    The partition number is the larger of cores and ``spark.sql.shuffle.partitions``,
    which a cluster sets by its data; adaptive execution does not merge them.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def spread_small(table: DataFrame, key: str) -> DataFrame:
    """``spread`` for a stored table that has fewer splits than there are cores; others stay as they are."""
    if table.rdd.getNumPartitions() < table.sparkSession.sparkContext.defaultParallelism:
        return spread(table, key)
    return table
