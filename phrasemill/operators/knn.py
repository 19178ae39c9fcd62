"""Exact k-nearest-neighbour search and classification.

Distances are Minkowski distances, rounded to ``DIGITS`` places so that ties are
ties on every machine; ties go to the lower training id.

A training set within ``BROADCAST_BYTES`` is sent to the executors; the queries
are dealt out over all cores, in one shuffle, and scored there. A bigger one is cut into cells
around pivots; bounds from the triangle inequality tell which cells a query
must see. Small cells side by side share a block, big ones and big query groups
are cut, so that no task holds more than one block of each side and a query
goes to each block once. Both ways give the same result.

A block is searched in strips: rough distances, by one matrix product or in
single precision, leave few rows for exact ones, whatever their rounding. Of high
powers the rough value is the largest gap, which bounds the distance on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import Column, DataFrame, functions as F, types as T

from phrasemill.functions.vectors import normalise
from phrasemill.session import fits, spread, written

DIGITS = 9
BROADCAST_BYTES = 64 << 20
#: Bytes of vectors and rows of a block, at most.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 1 << 16
PIVOTS = 256
RINGS = 8
#: Points that are held against the training rows together.
TILE = 128
#: Numbers of a strip of training rows, few enough for a core's cache.
STRIP = 1 << 15
#: Rows of a strip at least, where gaps are taken point by point and a strip stays below ``WIDE`` numbers: numpy takes
#: a row of so many at once, shorter ones cost it twice the time a number.
LONG = 1 << 13
WIDE = 1 << 20
#: Higher powers are not summed up in single precision.
HIGH = 8
#: Rows that a tile remembers before its limits are made tighter.
HELD = 1 << 18

NEIGHBOURS = T.ArrayType(T.StructType([
    T.StructField("distance", T.DoubleType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("label", T.IntegerType()),
]))


def _matrix(column) -> np.ndarray:
    """Arrow list column to a matrix, one row per list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _numbers(column) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def distances(across: np.ndarray, point: np.ndarray, p: float, buffer: np.ndarray | None = None) -> np.ndarray:
    """Minkowski distances of one point to the columns of ``across`` (dimension x rows)."""
    gap = np.subtract(across, point[:, None], out=buffer)
    if p == 2:
        np.multiply(gap, gap, out=gap)
        return np.sqrt(gap.sum(axis=0))
    np.abs(gap, out=gap)
    if p == 1:
        return gap.sum(axis=0)
    power = gap.copy() if float(p).is_integer() else None
    if power is None:
        np.power(gap, p, out=gap)
    else:
        for _ in range(int(p) - 1):
            np.multiply(power, gap, out=power)
        gap = power
    return gap.sum(axis=0) ** (1.0 / p)


def _nearest(found: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` smallest values; equal values in index order."""
    if k < len(found):
        limit = np.partition(found, k - 1)[k - 1]
        near = np.flatnonzero(found <= limit)
    else:
        near = np.arange(len(found))
    return near[np.argsort(found[near], kind="stable")][:k]


def _block(table, apart: str | None) -> tuple:
    """Training rows held by a task, in id order: ids, labels, vectors as columns, values of ``apart``."""
    ids = _numbers(table.column("row_id"))
    order = np.argsort(ids, kind="stable")
    return (ids[order], _numbers(table.column("label"))[order].astype(np.int32),
            np.ascontiguousarray(_matrix(table.column("vec"))[order].T),
            _numbers(table.column(apart))[order] if apart else None)


def _tight(edge: np.ndarray, points: np.ndarray, most: float, p: float) -> np.ndarray:
    """What a rough value may reach so that its row can be among the nearest, where ``edge`` is the k-th rough value, or for
    powers above ``HIGH`` a distance that k rows keep to.

    ``most`` is the largest absolute value among the training rows.
    Rough values are squares of distances (``p`` 2), from a matrix product, else sums of powers in single precision, of
    powers above ``HIGH`` the largest gaps. Neither what rounding does to them nor to distances loses a row.
    """
    if p == 2:
        root = np.sqrt(np.maximum(edge, 0.0)) + 10.0 ** (1 - DIGITS)
        return root * root + 1e-11 * (most * most * points.shape[1] + (points**2).sum(axis=1) + 1.0)
    unit, dim = 2.0**-24, points.shape[1]
    if p > HIGH:
        off = 4 * unit * (most + np.abs(points).max(axis=1, initial=0.0)) + 1e-37
        reach = edge * (1 + 1e-9) + 10.0 ** (1 - DIGITS)
        return np.maximum(reach, 1e-300 ** (1 / p)) * (1 + 1e-6) + off  # powers of smaller gaps vanish
    share = 2 * (dim + p + 8) * unit
    off = 2 * unit * dim * (most + np.abs(points).max(axis=1, initial=0.0)) + (dim * 1e-37) ** (1 / p)
    reach = (edge ** (1 / p) * (1 + share) + off + 10.0 ** (1 - DIGITS)) * (1 + share) + off
    return reach**p * (1 + 1e-6)


def _farthest(gap: np.ndarray, p: float) -> float:
    """The largest of the distances that are made of gaps (dimension x rows); no power of all vanishes, none overflows."""
    top = gap.max(axis=0)
    return float((top * ((gap / np.where(top > 0, top, 1.0)) ** p).sum(axis=0) ** (1 / p)).max())


def _powers(points: np.ndarray, across: np.ndarray, p: float) -> np.ndarray:
    """Sums of the powers of all gaps between a tile of points and the columns of ``across``; of high powers the largest gap."""
    out, gap = np.empty((len(points), across.shape[1]), across.dtype), np.empty_like(across)
    power = np.empty_like(across) if 2 < p <= HIGH and float(p).is_integer() else gap
    ones = np.ones(len(across), across.dtype)
    for point, into in zip(points, out, strict=True):
        np.subtract(across, point[:, None], out=gap)
        np.abs(gap, out=gap)
        if p > HIGH:
            np.maximum.reduce(gap, axis=0, out=into)
            continue
        if power is not gap:
            np.multiply(gap, gap, out=power)
            for _ in range(int(p) - 2):
                np.multiply(power, gap, out=power)
        elif p != 1:
            np.power(gap, p, out=gap)
        np.dot(ones, power, out=into)
    return out


def _possible(across: np.ndarray, points: np.ndarray, counts: np.ndarray | None, k: int, p: float, most: float) -> list[np.ndarray]:
    """Rows (columns of ``across``) that can be among the ``k`` nearest of each of a tile of points, in order.

    Rows are met in strips that stay in a core's cache; only those within the limit, which falls
    as more rows are seen, are remembered. ``counts`` tells which rows may count.
    """
    dim = max(len(across), 1)
    step = LONG if p != 2 and LONG * dim <= WIDE else max(STRIP // dim, TILE)
    limit = np.full(len(points), np.inf)
    held = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    squared = (points**2).sum(axis=1)[:, None]
    left, right = points * -2.0, points.astype(np.float32)

    def tightened() -> None:
        who, rows, rough = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((rough, who))
        who, rows, rough = who[order], rows[order], rough[order]
        first = np.searchsorted(who, np.arange(len(points) + 1))
        full = np.flatnonzero(np.diff(first) >= k)
        edge = rough[first[full] + k - 1]
        if p > HIGH:
            edge = np.array([_farthest(np.abs(across[:, rows[a:a + k]] - points[i][:, None]), p) for i, a in zip(full, first[full], strict=True)])
        limit[full] = np.minimum(limit[full], _tight(edge, points[full], most, p))
        near = rough <= limit[who]
        held[:] = [(who[near], rows[near], rough[near])]

    seen = due = fresh = 0
    for at in range(0, across.shape[1], step):
        part, places = across[:, at:at + step], None
        if counts is not None:
            places = np.flatnonzero(counts[at:at + step])
            if not len(places):
                continue
            part = part[:, places]
        if p == 2:
            rough = left @ part
            rough += (part * part).sum(axis=0)
            rough += squared
        else:
            rough = _powers(right, part.astype(np.float32), p)
        if not seen and rough.shape[1] > k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(np.float64)
            if p > HIGH:
                edge = (edge * (1 + 1e-6) + 1e-6 * (most + np.abs(points).max(axis=1, initial=0.0))) * dim ** (1 / p)
            limit = _tight(edge, points, most, p)
        who, near = np.nonzero(rough <= limit[:, None])
        held.append((who, (near if places is None else places[near]) + at, rough[who, near].astype(np.float64)))
        seen, fresh = seen + rough.shape[1], fresh + len(who)
        if seen >= due or fresh > HELD:
            tightened()
            due, fresh = 2 * seen, 0
    tightened()
    who, rows, _ = held[0]
    first = np.searchsorted(who, np.arange(len(points) + 1))
    return [np.sort(rows[a:b]) for a, b in zip(first, first[1:], strict=False)]


def _plain(most: float, points: np.ndarray, p: float) -> bool:
    """Whether the bounds of ``_possible`` hold: numbers that are finite and whose powers are, of a proper distance."""
    reach = most + float(np.abs(points).max())
    if not (p >= 1 and np.isfinite(reach) and reach < 1e30):
        return False
    powers = p * np.log10(reach + 1) + np.log10(points.shape[1])
    return bool(powers < (36 if p <= HIGH else 300))


def nearest(across: np.ndarray, points: np.ndarray, k: int, p: float, row_aparts: np.ndarray | None = None,
            aparts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each point the columns of ``across`` that are nearest to it, and their rounded distances; on ties the first.

    With ``aparts`` only columns with another value count.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=int), np.empty(0))] * len(points)
    if not (len(points) and across.size) or k < 1:
        return out
    counts, where = None, np.arange(len(points))
    most = max(float(across.max()), -float(across.min()))
    plain = _plain(most, points, p)
    groups = [where] if aparts is None else [np.flatnonzero(aparts == a) if a == a else np.flatnonzero(aparts != aparts)
                                             for a in np.unique(np.asarray(aparts))]
    for group in groups:
        if aparts is not None:
            counts = row_aparts != aparts[group[0]]
        for at in range(0, len(group), TILE):
            tile = group[at:at + TILE]
            possible = _possible(across, points[tile], counts, k, p, most) if plain else [
                np.arange(across.shape[1]) if counts is None else np.flatnonzero(counts)] * len(tile)
            for i, rows in zip(tile.tolist(), possible, strict=True):
                found = np.round(distances(across[:, rows], points[i], p), DIGITS) if len(rows) else np.empty(0)
                near = _nearest(found, k)
                out[i] = rows[near], found[near]
    return out


def _search(block: tuple, points: np.ndarray, aparts, k: int, p: float) -> pa.ListArray:
    """The neighbours of each point among the rows of a block, as one list per point."""
    ids, labels, across, row_aparts = block
    found = nearest(across, points, k, p, row_aparts, aparts)
    ends = np.cumsum([0] + [len(x) for x, _ in found]).astype(np.int32)
    pick = np.concatenate([x for x, _ in found]) if found else np.empty(0, dtype=int)
    gap = np.concatenate([x for _, x in found]) if found else np.empty(0)
    rows = pa.StructArray.from_arrays(
        [pa.array(gap, pa.float64()), pa.array(ids[pick], pa.int64()), pa.array(labels[pick], pa.int32())],
        names=["distance", "row_id", "label"])
    return pa.ListArray.from_arrays(pa.array(ends), rows)


class TrainSet:
    """Training rows made ready for many searches.

    ``train`` has ``row_id``, ``label`` and ``vec``. With ``apart`` (an integer
    column of both sides) a query only sees training rows with another value,
    as cross-validation needs it.
    """

    def __init__(self, train: DataFrame, apart: str | None = None, budget: int = BROADCAST_BYTES,
                 block_rows: int | None = None, pivots: int = PIVOTS):
        self.rows = train.select("row_id", F.col("label").cast("int"), F.col("vec").cast("array<double>"),
                                 *([apart] if apart else []))
        self.apart, self.pivots = apart, pivots
        row = self.rows.select(F.size("vec").alias("n")).first()
        if row is None:
            raise ValueError("the training set is empty")
        self.block_rows = block_rows or min(BLOCK_ROWS, max(BLOCK_BYTES // (8 * max(row["n"], 1)), 1))
        self.block = None
        if fits(self.rows, 8 * row["n"] + 24, budget):
            self.block = train.sparkSession.sparkContext.broadcast(_block(self.rows.toArrow(), apart))

    def search(self, queries: DataFrame, k: int, p: float = 2) -> DataFrame:
        """The ``k`` nearest training rows of each query, as a sorted array column ``neighbours``.

        ``queries`` has ``row_id`` and ``vec`` and any other columns, which are kept (``vec`` is not).
        """
        queries = queries.withColumn("vec", F.col("vec").cast("array<double>"))
        if self.block is not None:
            return _search_broadcast(queries, self.block, k, p, self.apart)
        return _search_cells(queries, self.rows, k, p, self.apart, self.block_rows, self.pivots)


def neighbours(queries: DataFrame, train: DataFrame, k: int, p: float = 2, apart: str | None = None,
               **how) -> DataFrame:
    """One search, see ``TrainSet``."""
    return TrainSet(train, apart, **how).search(queries, k, p)


def _kept(queries: DataFrame) -> list[T.StructField]:
    return [f for f in queries.schema.fields if f.name != "vec"]


def _search_broadcast(queries: DataFrame, block, k: int, p: float, apart: str | None) -> DataFrame:
    kept = _kept(queries)
    # Scoring is bound by arithmetic: a short shuffle of the vectors lets all cores take part
    # where the input came in few partitions.
    queries = spread(queries, "row_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _search(block.value, _matrix(batch.column("vec")),
                            _numbers(batch.column(apart)) if apart else None, k, p)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [found],
                                             names=[f.name for f in kept] + ["neighbours"])

    return queries.mapInArrow(score, T.StructType(kept + [T.StructField("neighbours", NEIGHBOURS)]))


def _packed(centres: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Block of each cell: cells side by side share one until it is full; a cell with more rows has one of its own."""
    left, blocks, filled, block, here = list(range(len(rows))), np.zeros(len(rows), dtype=np.int32), 0, 0, 0
    while left:
        nearest_first = np.square(centres[left] - centres[here]).sum(axis=1)
        here = left.pop(int(np.argmin(nearest_first)))
        if filled and filled + rows[here] > most:
            block, filled = block + 1, 0
        blocks[here], filled = block, filled + rows[here]
    return blocks


def _search_cells(queries: DataFrame, train: DataFrame, k: int, p: float, apart: str | None,
                  block_rows: int, pivots: int) -> DataFrame:
    spark = queries.sparkSession
    # A fixed number of training rows, spread evenly by a hash of their ids.
    centres = np.unique(_matrix(
        train.orderBy(F.xxhash64("row_id"), "row_id").limit(pivots).select("vec").toArrow().column("vec")), axis=0)
    centre_table = spark.sparkContext.broadcast(np.ascontiguousarray(centres.T))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = centre_table.value
        for batch in batches:
            gaps = [distances(across, point, p) for point in _matrix(batch.column("vec"))]
            cells = [int(np.argmin(g)) for g in gaps]
            radii = [float(g[c]) for g, c in zip(gaps, cells)]
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(cells, pa.int32()), pa.array(radii, pa.float64())],
                names=batch.schema.names + ["cell", "radius"])

    celled = written(train.mapInArrow(to_cells, T.StructType(train.schema.fields + [
        T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType())])), "cells")

    # Rings of a cell: how many rows lie how far from its pivot. At most pivots x RINGS x folds rows.
    reach = celled.groupBy("cell").agg(F.max("radius").alias("_reach"))
    ring = F.least(F.floor(F.col("radius") * RINGS / F.greatest("_reach", F.lit(1e-12))), F.lit(RINGS - 1))
    group = F.col(apart) if apart else F.lit(0)
    rings = (celled.join(F.broadcast(reach), "cell")
             .groupBy("cell", ring.alias("ring"), group.alias("apart"))
             .agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))).toPandas()
    cell_low = rings.groupby("cell")["low"].min()
    cell_high = rings.groupby("cell")["high"].max()
    # A query meets each block once, so that it is copied no more often than there are blocks where nothing can be left out.
    block_of = _packed(centres[cell_low.index.to_numpy()], rings.groupby("cell")["n"].sum().to_numpy(), block_rows)
    bounds = spark.sparkContext.broadcast((
        rings["cell"].to_numpy(), rings["high"].to_numpy(), rings["n"].to_numpy(), rings["apart"].to_numpy(),
        cell_low.index.to_numpy(), cell_low.to_numpy(), cell_high.to_numpy(), block_of))

    def to_targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        across = centre_table.value
        ring_cell, ring_high, ring_n, ring_apart, cells, low, high, blocks = bounds.value
        for batch in batches:
            aparts = _numbers(batch.column(apart)) if apart else None
            wanted = []
            for i, point in enumerate(_matrix(batch.column("vec"))):
                gap = distances(across, point, p)
                # The k-th neighbour is no farther than the rows that surely lie within `limit`.
                upper = gap[ring_cell] + ring_high
                count = ring_n if aparts is None else np.where(ring_apart == aparts[i], 0, ring_n)
                order = np.argsort(upper)
                enough = np.searchsorted(np.cumsum(count[order]), k)
                limit = upper[order[enough]] if enough < len(order) else np.inf
                lower = np.maximum.reduce([gap[cells] - high, low - gap[cells], (gap[cells] - gap.min()) / 2])
                wanted.append(np.unique(blocks[lower <= limit + 10.0 ** (1 - DIGITS) + 1e-9 * abs(limit)]).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("vec")] + ([batch.column(apart)] if apart else [])
                + [pa.array(wanted, pa.list_(pa.int32()))],
                names=["row_id", "vec"] + ([apart] if apart else []) + ["blocks"])

    needed = queries.select("row_id", "vec", *([apart] if apart else []))
    targets = written(needed.mapInArrow(to_targets, T.StructType(
        needed.schema.fields + [T.StructField("blocks", T.ArrayType(T.IntegerType()))])), "targets")
    visits = targets.select(*needed.columns, F.explode("blocks").alias("block"))
    packed = spark.createDataFrame(list(zip(cell_low.index.tolist(), block_of.tolist(), strict=True)), "cell int, block int")
    blocked = celled.join(F.broadcast(packed), "cell").drop("cell", "radius")

    # Parts of at most about block_rows rows on either side; one row per block.
    sizes = (blocked.groupBy("block").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
             .join(visits.groupBy("block").agg(F.ceil(F.count("*") / block_rows).alias("chunks")), "block"))
    sizes = F.broadcast(sizes)
    spread = F.xxhash64("row_id")
    left = (visits.join(sizes, "block").withColumn("chunk", F.pmod(spread, "chunks"))
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "chunks"))
    right = (blocked.join(sizes, "block").withColumn("part", F.pmod(spread, "parts"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
             .drop("parts", "chunks"))

    def match(points: pa.Table, rows: pa.Table) -> pa.Table:
        found = _search(_block(rows, apart), _matrix(points.column("vec")),
                        _numbers(points.column(apart)) if apart else None, k, p)
        return pa.table({"row_id": points.column("row_id"), "neighbours": found})

    keys = ["block", "part", "chunk"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        match, T.StructType([T.StructField("row_id", T.LongType()), T.StructField("neighbours", NEIGHBOURS)]))
    merged = partial.groupBy("row_id").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("neighbours"))), 1, k).alias("neighbours"))
    none = F.array().cast(NEIGHBOURS)
    return (queries.drop("vec").join(merged, "row_id", "left")
            .withColumn("neighbours", F.coalesce("neighbours", none)))


def vote_weight(weights: str, distance: Column, first_distance: Column) -> Column:
    """Weight of a neighbour. By ``distance`` it is 1/d, but if any neighbour is at 0, only those count."""
    if weights == "uniform":
        return F.lit(1.0)
    if weights != "distance":
        raise ValueError(f"unknown weights: {weights}")
    return F.when(first_distance == 0, (distance == 0).cast("double")).otherwise(1.0 / distance)


def class_votes(classes: list[int], weights: str) -> Column:
    """Array with the summed weight of each class among ``neighbours``."""
    near = F.col("neighbours")
    first = F.get(near, F.lit(0))["distance"]

    def votes(label: int) -> Column:
        mine = F.filter(near, lambda n: n["label"] == label)
        return F.aggregate(mine, F.lit(0.0), lambda acc, n: acc + vote_weight(weights, n["distance"], first))

    return F.array(*[votes(c) for c in classes])


def voted(df: DataFrame, classes: list[int], weights: str) -> DataFrame:
    """Add ``votes``, ``probability`` and ``prediction`` (lowest label on ties)."""
    even = F.transform("votes", lambda v: F.round(v, DIGITS))
    labels = F.array(*[F.lit(c) for c in classes])
    return (df.withColumn("votes", class_votes(classes, weights))
            .withColumn("probability", normalise(F.col("votes")))
            .withColumn("prediction", F.get(labels, (F.array_position(even, F.array_max(even)) - 1).cast("int"))))


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    nNeighbors = Param(Params._dummy(), "nNeighbors", "how many neighbours vote", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    p = Param(Params._dummy(), "p", "Minkowski power", TypeConverters.toFloat)


def _as_array(df: DataFrame, column: str) -> Column:
    """The feature column as an array, whether it is one or an ML vector."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(column)
    return F.col(column)


class KNNClassifier(Estimator, _KNNParams):
    """k nearest neighbours with ``uniform`` or ``distance`` weights and Minkowski power ``p``.

    ``fit`` takes a table with ``row_id``, the label and the features.
    """

    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", p: float = 2, *,
                 featuresCol: str = "vec", labelCol: str = "label", classes: int | None = None):
        super().__init__()
        if weights not in ("uniform", "distance"):
            raise ValueError(f"unknown weights: {weights}")
        self._set(nNeighbors=n_neighbors, weights=weights, p=float(p), featuresCol=featuresCol, labelCol=labelCol)
        self.classes = classes  # how many there are, if the training rows may lack some

    def _fit(self, train: DataFrame) -> "KNNModel":
        rows = train.select("row_id", *[c for c in train.columns if c in ("fold", "cv_fold")],
                            F.col(self.getLabelCol()).cast("int").alias("label"),
                            _as_array(train, self.getFeaturesCol()).alias("vec"))
        last = rows.agg(F.max("label")).first()[0]
        if last is None:
            raise ValueError("the training set is empty")
        # Positions are labels, as in MLlib, also where a class has no training row.
        return self._copyValues(KNNModel(rows, list(range(max(self.classes or 0, last + 1)))))


class KNNModel(Model, _KNNParams):
    def __init__(self, train: DataFrame, classes: list[int]):
        super().__init__()
        self.train, self.classes = train, classes
        self._ready: dict[str | None, TrainSet] = {}

    def scored(self, queries: DataFrame, apart: str | None = None) -> DataFrame:
        """Add ``neighbours``, ``votes``, ``probability`` (one per label from 0), ``prediction``."""
        points = queries.withColumn("vec", _as_array(queries, self.getFeaturesCol()))
        if apart not in self._ready:  # once per model, also when it scores many micro-batches
            self._ready[apart] = TrainSet(self.train, apart)
        found = self._ready[apart].search(points, self.getOrDefault("nNeighbors"), self.getOrDefault("p"))
        return voted(found, self.classes, self.getOrDefault("weights"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.scored(df)


def _leaders(places: np.ndarray, labels: np.ndarray, shares: list[np.ndarray], ks: list[int]) -> list[int]:
    """The predicted label for every ``k`` and weighting, out of the neighbours of one query; equal votes go to the lowest."""
    order = np.argsort(places, kind="stable")
    ends = np.searchsorted(places[order], ks) - 1
    seen, code = np.unique(labels[order], return_inverse=True)
    mine = code[:, None] == np.arange(len(seen))
    sums = [np.round(np.cumsum(mine * share[order, None], axis=0), DIGITS)[ends] for share in shares]
    return seen[np.stack(sums, axis=1).argmax(axis=2)].ravel().tolist()


def grid_votes(found: DataFrame, keep: list[str], ks: list[int], weights: list[str], once: bool = False) -> DataFrame:
    """Predictions for every ``k`` and weighting out of one neighbour list per query.

    The list for the largest ``k`` holds those for all smaller ones as its
    beginnings, so a whole grid needs one search per ``p``. Rows that repeat
    ``keep`` vote together: their lists are brought together first, unless it is
    known that each is there ``once``. Votes are counted where a list is.
    """
    first = F.get("neighbours", F.lit(0))["distance"]
    weighed = F.transform("neighbours", lambda n, i: F.struct(i.alias("place"), n["label"].alias("label"), *[
        vote_weight(w, n["distance"], first).alias(w) for w in weights]))
    lists = found.where(F.size("neighbours") > 0).select(*keep, weighed.alias("_near"))
    if not once:
        lists = lists.groupBy(*keep).agg(F.flatten(F.collect_list("_near")).alias("_near"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("_near")
            ends, flat = near.offsets.to_numpy(), near.values
            place, label, *shares = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "label", *weights))
            told = [_leaders(place[a:b], label[a:b], [x[a:b] for x in shares], ks) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(told, pa.list_(pa.int32()))], names=[*keep, "_told"])

    told = lists.mapInArrow(vote, T.StructType([*(lists.schema[c] for c in keep), T.StructField("_told", T.ArrayType(T.IntegerType()))]))
    rows = ", ".join(f"struct({k} as n_neighbors, '{w}' as weights, _told[{i}] as prediction)"
                     for i, (k, w) in enumerate((k, w) for k in ks for w in weights))
    return told.select(*keep, F.expr(f"inline(array({rows}))"))
