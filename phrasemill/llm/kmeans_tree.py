"""Approximate nearest neighbours over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row goes to the leaf that a walk
down the nearest centres ends in. A query walks the tree best bin first: a
priority queue of nodes by the distance of their centres gives leaves in order,
until it has seen as many as the calibration asks for, and it is held against
the rows of those leaves only. Leaves that lie side by side in the tree travel
together as one bin, crowded ones are cut into blocks. Calibration searches a
stated number of rows, which the tree was not fitted on, exactly over all rows
and takes the fewest leaf visits that reach the recall.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import parts_for
from phrasemill.session import written

#: Rows of the sample that the tree is fitted on, at most.
FIT_ROWS = 20_000
#: Queries of the calibration and the mean recall that it has to reach.
CALIBRATION = 200
RECALL = 0.97
BRANCH = 8
#: Rows of a leaf to aim at; rows of a bin or block and queries of a chunk, on average, in a search task's group.
LEAF = 400
BLOCK = 4000
CHUNK = 500


@dataclass
class Tree:
    """Centres of all nodes; node 0 is the root, a node without children is a leaf."""

    centres: np.ndarray
    children: list[list[int]]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, branch: int = BRANCH, leaf: int = LEAF) -> Tree:
        """Split nodes by k-means until a node stands for at most ``leaf`` of all ``rows``."""
        sample = np.unique(sample, axis=0)  # copies would pull several centres to one place
        centres, children = [sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])], [[]]
        waiting, weight, rng = [(0, sample)], rows / max(len(sample), 1), np.random.default_rng(7)
        while waiting:
            node, items = waiting.pop()
            k = min(branch, len(items) // 4)
            if k < 2 or len(items) * weight <= leaf:
                continue
            middle = items[rng.choice(len(items), k, replace=False)]
            for _ in range(10):
                to = _nearest(items, middle)
                middle = np.stack([items[to == i].mean(axis=0) if (to == i).any() else middle[i] for i in range(k)])
            to = _nearest(items, middle)
            for i in np.unique(to):
                if (to == i).all():
                    break
                children[node].append(len(centres))
                waiting.append((len(centres), items[to == i]))
                centres.append(middle[i])
                children.append([])
        return cls(np.stack(centres), children)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest centre, level by level."""
        at = np.zeros(len(vectors), dtype=np.int64)
        moving = np.arange(len(vectors)) if self.children[0] else np.zeros(0, np.int64)
        while len(moving):
            for node in np.unique(at[moving]):
                here = moving[at[moving] == node]
                below = np.array(self.children[node])
                at[here] = below[_nearest(vectors[here], self.centres[below])]
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return at

    def bins(self, counts: dict[int, int], rows: int) -> dict[int, int]:
        """A bin for each leaf that has rows: leaves side by side share one until it has ``rows`` rows."""
        found, here, n, waiting = {}, 0, 0, [0]
        while waiting:
            node = waiting.pop()
            waiting += reversed(self.children[node])
            if node in counts:
                if n and n + counts[node] > rows:
                    here, n = here + 1, 0
                found[node] = here
                n += counts[node]
        return found

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if below := self.children[node]:
                far = ((self.centres[below] - query) ** 2).sum(axis=1)
                for d, child in zip(far.tolist(), below, strict=True):
                    heapq.heappush(queue, (d, child))
            else:
                yield node


def _nearest(items: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * items @ centres.T).argmin(axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, size)


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, distance) of the k nearest rows of each query, ties to smaller ids, own id left out.

    A matrix product picks rows that can be among them, the distances are then
    taken from the differences of the vectors.
    """
    who, where, far = [], [], []
    norms = (vectors**2).sum(axis=1)
    for at in range(0, len(queries), 64):
        q = queries[at:at + 64]
        rough = norms[None, :] - 2 * q @ vectors.T + (q**2).sum(axis=1)[:, None]
        rough[own[at:at + 64, None] == ids[None, :]] = np.inf
        for i in range(len(q)):
            line = rough[i]
            if len(line) > k:
                edge = np.partition(line, k - 1)[k - 1]
                if np.isfinite(edge):
                    edge += 1e-9 * (1 + abs(edge) + norms.max())
                near = np.flatnonzero((line <= edge) & np.isfinite(line))
            else:
                near = np.flatnonzero(np.isfinite(line))
            d = np.sqrt(((vectors[near] - q[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], d))[:k]
            who.append(np.full(len(best), at + i))
            where.append(near[best])
            far.append(d[best])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(who, np.int64), join(where, np.int64), join(far, np.float64)


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec) of rows with a key and a vector without null, non-finite or only zero components."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vec, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & fine)


def _top(found: DataFrame, k: int) -> DataFrame:
    """Ranks of the k nearest of each query."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _calibrate(rows: DataFrame, probes: list, tree: Tree, size: int, k: int, recall: float) -> int:
    """Leaf visits that reach ``recall`` on the probes, whose neighbours are found over all rows."""
    ids = np.array([p["id"] for p in probes], dtype=np.int64)
    vectors = np.array([p["vec"] for p in probes], dtype=np.float64)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            vec, own, leaf = _matrix(batch.column("vec"), size), batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            who, where, far = nearest(vectors, ids, vec, own, k)
            best = [np.concatenate(x) for x in zip(best, (who, own[where], far, leaf[where]), strict=True)]
            order = np.lexsort((best[1], best[2], best[0]))
            best = [x[order] for x in best]
            start = np.searchsorted(best[0], best[0])
            best = [x[np.arange(len(best[0])) - start < k] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "vec_id", "score", "leaf"])

    found = _top(rows.mapInArrow(scan, "query_id long, vec_id long, score double, leaf long"), k).collect()  # probes * k rows
    place = [{leaf: n for n, leaf in enumerate(tree.walk(v))} for v in vectors]
    needed = np.sort([place[r["query_id"]][r["leaf"]] + 1 for r in found])
    return int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) if len(needed) else 1


def search(rows: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL, fit_rows: int = FIT_ROWS,
           key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each query, by Euclidean distance in double precision.

    Rows whose key equals the query's are no candidates. Rows and queries whose
    key or vector is null, or whose vector is zero, holds null or non-finite
    components, or has not the commonest length take no part. Rows that repeat
    a key are candidates of their own; of queries that repeat a key the
    smallest vector asks. Ties go to the smaller key. A query gets all
    candidates if there are fewer than k. Empty tables give an empty result;
    further columns are not read.
    """
    spark = rows.sparkSession
    good = usable(rows, key, vector)
    common = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size, total = (common["size"], common["count"]) if common else (1, 0)
    good = good.filter(F.size("vec") == size)
    asked = usable(queries, key, vector).filter(F.size("vec") == size).groupBy("id").agg(F.min("vec").alias("vec"))
    drawn = good.orderBy(F.xxhash64("id", "vec")).limit(fit_rows + CALIBRATION).collect()
    probes = drawn[:CALIBRATION]
    sample = drawn[CALIBRATION:] if len(drawn) > 2 * CALIBRATION else drawn  # few rows: the probes as well
    tree = Tree.fit(np.array([r["vec"] for r in sample], dtype=np.float64).reshape(-1, size), total)
    held = spark.sparkContext.broadcast(tree)  # grows with the sample only

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = held.value.leaves_of(_matrix(batch.column("vec"), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["id", "vec", "leaf"])

    index = written(good.mapInArrow(place, "id long, vec array<double>, leaf long"), "tree-index")
    visits = _calibrate(index, probes, tree, size, k, recall)
    sizes = written(index.groupBy("leaf").agg(F.count("*").alias("rows")), "leaves")  # one row for each leaf
    counts = {r["leaf"]: r["rows"] for r in sizes.collect()}
    bins = tree.bins(counts, BLOCK)
    # A key's own rows are no candidates, so a query has to see that many more.
    own = index.join(asked.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    asked = asked.join(own, "id", "left").fillna(0, ["own"])

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, found, leaves, vec = [], [], [], _matrix(batch.column("vec"), size)
            for i, mine in enumerate(batch.column("own").to_pylist()):
                seen, mine_bins = 0, {}
                for n, leaf in enumerate(held.value.walk(vec[i])):
                    if n >= visits and seen >= k + mine:
                        break
                    if leaf in counts:
                        seen += counts[leaf]
                        mine_bins.setdefault(bins[leaf], []).append(leaf)
                who += [i] * len(mine_bins)
                found += mine_bins
                leaves += mine_bins.values()
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("vec").take(take),
                                              pa.array(found, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["query_id", "vec", "bin", "leaves"])

    # A query travels to a bin once and brings home the k best of the leaves that it visits there.
    visited = written(asked.mapInArrow(walk, "query_id long, vec array<double>, bin long, leaves array<long>"), "visits")
    asking = visited.groupBy("bin").agg(F.count("*").alias("queries"))
    where = spark.createDataFrame(list(bins.items()), "leaf long, bin long")  # one row for each leaf
    filled = sizes.join(where, "leaf").groupBy("bin").agg(F.sum("rows").alias("rows"))
    plan = written(filled.join(asking, "bin").select(
        "bin", F.ceil(F.col("rows") / BLOCK).alias("blocks"), F.ceil(F.col("queries") / CHUNK).alias("chunks")), "plan")
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = index.join(F.broadcast(where.join(plan, "bin")), "leaf").withColumn("block", spread("id", "blocks")).withColumn("chunk", every("chunks"))
    right = visited.join(F.broadcast(plan), "bin").withColumn("chunk", spread("query_id", "chunks")).withColumn(
        "block", every("blocks"))
    group = ["bin", "block", "chunk"]

    def match(rows: pa.Table, queries: pa.Table) -> pa.Table:
        empty = not rows.num_rows or not queries.num_rows
        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if empty:
            return pa.table([pa.array([], t) for t in types], names)
        ids, asked, leaf = rows.column("id").to_numpy(), queries.column("query_id").to_numpy(), rows.column("leaf").to_numpy()
        vectors, points = _matrix(rows.column("vec"), size), _matrix(queries.column("vec"), size)
        leaves = queries.column("leaves").combine_chunks()
        visitor, visit = np.repeat(np.arange(len(asked)), np.diff(np.asarray(leaves.offsets))), np.asarray(leaves.flatten())
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for one in np.unique(leaf):
            mine, come = np.flatnonzero(leaf == one), visitor[visit == one]
            who, where, far = nearest(points[come], asked[come], vectors[mine], ids[mine], k)
            best = [np.concatenate(x) for x in zip(best, (asked[come][who], ids[mine][where], far), strict=True)]
        order = np.lexsort((best[1], best[2], best[0]))
        best = [x[order] for x in best]
        keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
        return pa.table([pa.array(x[keep]) for x in best], names)

    parts = parts_for(spark)
    found = (left.select(*group, "id", "vec", "leaf").repartition(parts, *group).groupBy(*group)
             .cogroup(right.select(*group, "query_id", "vec", "leaves").repartition(parts, *group).groupBy(*group))
             .applyInArrow(match, "query_id long, vec_id long, score double"))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
